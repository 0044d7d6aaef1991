import base64
import gzip
import hashlib
import random

from lectern.functions.session import fresh_path
from lectern.llm import queries, warc
from workload.compare import compare, connect

from tests.llm.cases import count

PAGES = "page_id long, url string, html string, path string, kind string, digest string, bytes string, payload string"


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, *("x",) * 5) for i, u, h in rows], PAGES)


def test_query_equals_sql(spark, small_dir):
    ok, note = compare(spark, connect(small_dir), small_dir, "op7", queries.op7_warc, queries.ORACLES["op7_warc"])
    assert ok, note


def test_cases(spark):
    rows = [
        (1, "http://a/", "<p>same</p>"),
        (2, "http://b/\r\nX: y", "<p>same</p>"),
        (3, None, None),
        (4, "", ""),
        (5, "http://e/", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
        (6, "http://f/", "żółć \U0001f600\n\r\n\r\n" * 3),
        (7, "http://g/", "<i>" + "long " * 100_000),
        (8, "http://h/", "<p>same</p>"),
        (8, "http://h2/", "<p>same</p>"),
        (None, "http://n/", "<p>same</p>"),
    ]
    path = fresh_path(spark, "archives")
    warc.write_archives(_pages(spark, rows).repartition(3), path, per_file=3)
    got = warc.read_archives(spark, path).collect()
    assert {r.kind for r in got} == {"record"} and len(got) == len(rows)
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        top = largest[h or ""]
        again = i != top
        want.append(("" if i is None else str(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", str(top) if again else None))
        if not again:
            assert any(r.page_id == str(i) and bytes(r.payload) == body for r in got)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.refers_to) == sorted(w for w in want if w[4])
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in got) == sorted(w[:4] for w in want)


def test_least_size_for_revisits_and_empty(spark):
    pages = _pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")])
    path = fresh_path(spark, "archives")
    warc.write_archives(pages, path, min_bytes=5)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()}
    assert got == {"1": ("response", None), "2": ("response", None), "3": ("revisit", "4"), "4": ("response", None)}
    path = fresh_path(spark, "archives")
    warc.write_archives(pages.where("false"), path)
    assert count(warc.salvage(spark.read.format("binaryFile").load(path))) == 0


def _record(n, size=200):
    body = (f"page {n} " * size).encode()
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _ids(found):
    return [what["warc-record-id"] for kind, _, _, what, _ in found if kind == "record"]


def test_plain_damage_costs_only_the_records_it_touches():
    parts = [_record(n) for n in range(12)]
    whole = b"".join(parts)
    rng = random.Random(3)
    starts = [sum(map(len, parts[:n])) for n in range(13)]
    for _ in range(60):
        at, size = rng.randrange(len(whole)), rng.randrange(1, 900)
        broken = whole[:at] + bytes(rng.randrange(256) for _ in range(size)) + whole[at + size :]
        broken = broken[: len(whole)]
        found = list(warc.records(broken))
        touched = {n for n in range(12) if starts[n] < at + size and at < starts[n + 1]}
        same = {n for n in range(12) if broken[starts[n] : starts[n + 1]] == parts[n]}
        assert {int(i[10:-1]) for i in _ids(found)} >= same - touched | same
        assert sum(length for _, _, length, _, _ in found) == len(broken)  # every byte is accounted for
        assert [f[1] for f in found] == sorted(f[1] for f in found)


def test_lost_and_cut_bytes():
    parts = [_record(n) for n in range(5)]
    cut = b"".join(parts)[100:-50]
    found = list(warc.records(cut))
    assert _ids(found) == [f"<urn:page:{n}>" for n in (1, 2, 3)]
    assert [f[0] for f in found] == ["gap", "record", "record", "record", "gap"]
    assert list(warc.records(b"")) == [] and [f[0] for f in warc.records(b"noise")] == ["gap"]


def test_members_are_salvaged():
    packed = [gzip.compress(_record(n)) for n in range(8)]
    whole = b"".join(packed)
    starts = [sum(map(len, packed[:n])) for n in range(9)]
    assert len(_ids(warc.members(whole))) == 8
    rng = random.Random(4)
    for _ in range(40):
        at, size = rng.randrange(len(whole)), rng.randrange(1, 60)
        broken = (whole[:at] + bytes(rng.randrange(256) for _ in range(size)) + whole[at + size :])[: len(whole)]
        found = list(warc.members(broken))
        same = {n for n in range(8) if broken[starts[n] : starts[n + 1]] == packed[n]}
        assert {int(i[10:-1]) for i in _ids(found)} >= same
        assert len(_ids(found)) == 8 or any(f[0] == "gap" for f in found)
    one = gzip.compress(b"".join(_record(n) for n in range(8)))
    found = list(warc.members(one[: len(one) * 2 // 3]))
    assert _ids(found)[:1] == ["<urn:page:0>"] and found[-1][0] == "gap"


def test_a_damaged_byte_in_written_archives_costs_one_record(spark):
    rows = [(n, f"http://x/{n}", f"<p>page {n} " + "text " * (n % 50)) for n in range(120)] + [(500, "u", "x" * 17_000_000)]
    path = fresh_path(spark, "archives")
    warc.write_archives(_pages(spark, rows).coalesce(1), path, per_file=1000)
    assert {r.page_id for r in warc.read_archives(spark, path, False).collect()} == {str(i) for i, _, _ in rows}
    file = next(f for f in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect())
    body = bytearray(file.content)
    rng = random.Random(6)
    for at in (rng.randrange(3, len(body) // 2) for _ in range(12)):
        broken = bytes(body[:at]) + bytes([body[at] ^ 0x55]) + bytes(body[at + 1 :])
        found = list(warc.members(broken))
        whole = [f for f in found if f[0] == "record"]
        assert len(whole) >= len(rows) - 1 and (len(whole) == len(rows) or any(f[0] == "gap" for f in found))


def test_pages_that_share_a_payload_are_not_one_task(spark):
    pages = spark.range(3000).selectExpr("id page_id", "'u' url", "if(id % 3 = 0, 'error', concat('page ', id)) html")
    plan = warc.typed(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    got = {r.page_id: r.refers_to for r in warc.typed(pages).collect()}
    assert all(got[i] == (2997 if i % 3 == 0 and i != 2997 else None) for i in range(3000))
