"""Near duplicates by improved consistent weighted sampling.

A text is a weighted set: its shingles of five words (lower case, punctuation apart), weighted
by how often they occur in it times a damped inverse document frequency, counted over all
documents. Consistent weighted sampling draws ``SAMPLES`` samples of it, such that two texts
agree on a sample with the probability of their weighted Jaccard similarity. Samples are
banded; texts that share a band are compared, and a pair of weighted Jaccard similarity
``SIMILARITY`` or more is a link. Classes are the components of the links.

Equal texts are one node from the start. In a bucket of texts that share a band, all meet a
leader first: one comparison each, which joins most of a group of copies. Then every pair of
texts of one bucket that is still in two classes is compared, in blocks of ``BLOCK`` by
``BLOCK`` texts dealt over all tasks: samples first, and where these allow it the exact sets;
only links that join two classes leave a task. So no pair of texts that share a band goes
uncompared, no pair is ever a row, and a task holds two blocks at most.

The inverse document frequency is damped to between ``FLOOR`` and 1: it sets common
boilerplate back without letting the copies of a large group, whose shingles are all frequent,
drift apart. In the exact comparison shingles are told apart by 32 bits.

Cases: a text of one to four words has one shingle, all its words; a text without words but
with a visible character is near its exact copies only; a null or blank text is a class of its
own; repeated rows are copies of each other, whatever their doc_id;
the smallest doc_id of a class (null last, then the first row) is its class_id and is kept; an
empty table gives no rows; columns of any name are carried in ``doc``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.session import through_table
from lectern.llm import exchange
from lectern.llm.components import components
from lectern.llm.text import ALNUM, Words, mix, runs, text_bytes, windows

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 15
BAND_SAMPLES = 4
SAMPLES = BANDS * BAND_SAMPLES
#: agreeing samples below which a pair of similarity 0.8 falls once in a million times
LIKELY = 33
FLOOR = 0.9
#: texts of a bucket that one task compares with as many others
BLOCK = 256
_DRAWS = 1 << 16
_AT_ONCE = 1 << 15


class Shingles:
    """Distinct shingles of each text of a block, by text and then by digest, with their counts."""

    def __init__(self, block: pa.Table) -> None:
        words = Words(block.column("text"), ALNUM, lower=True)
        digests, n = words.digests(), words.counts
        found, owner = [], []
        document = words.documents().astype(np.uint16 if n.size <= 1 << 16 else np.int64)
        for width in range(1, SHINGLE + 1):
            made = windows(digests, width)
            if width == SHINGLE:
                own = document[: made.size] == document[width - 1 :][: made.size]
                found.append(made[own])
                owner.append(document[: made.size][own])
            else:
                short = np.flatnonzero(n == width)
                found.append(made[words.first[short]])
                owner.append(short.astype(document.dtype))
        every, whose = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(every)
        order = order[np.argsort(whose[order], kind="stable")]
        every, whose = every[order], whose[order]
        head = np.ones(every.size, dtype=bool)
        head[1:] = (every[1:] != every[:-1]) | (whose[1:] != whose[:-1])
        at = np.flatnonzero(head)
        self.digest, self.owner = every[at], whose[at].astype(np.int64)
        self.times = np.diff(np.append(at, every.size))
        self.first = np.searchsorted(self.owner, np.arange(n.size + 1))

    def frequencies(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending distinct shingles and the texts of the block that hold each."""
        ranked = np.sort(self.digest)
        start, size = runs(ranked)
        return ranked[start], size.astype(np.uint64)

    def weights(self, told: pa.Table, n_docs: int) -> np.ndarray:
        keys, own = self.frequencies()
        df = exchange.settle(keys, own, told)[np.searchsorted(keys, self.digest)].astype(np.float64)
        idf = np.log1p(n_docs / df) / np.log1p(n_docs)
        return (self.times * (FLOOR + (1 - FLOOR) * idf)).astype(np.float32)


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the method's three random variables: r, log c (both Gamma(2, 1)) and beta."""
    rng = np.random.default_rng(20)
    u = 1 - rng.random((4, _DRAWS))
    r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
    return r.astype(np.float32), np.log(c).astype(np.float32), rng.random(_DRAWS).astype(np.float32)


def samples(digest: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Consistent weighted samples: one row per non-empty set, ``SAMPLES`` numbers each.

    For element e of weight w and sample k, with the draws (r, c, beta) of (e, k):
    t = floor(ln w / r + beta), y = exp(r (t - beta)), a = c / (y exp r); the element of least
    a, with its t, is the sample.
    """
    r_all, c_all, beta_all = _draws()
    factors = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
    sets = np.flatnonzero(np.diff(first))
    out = np.empty((sets.size, SAMPLES), dtype=np.int32)
    log_weight = np.log(weight)
    begin = 0
    while begin < sets.size:
        stop = max(begin + 1, int(np.searchsorted(first[sets], first[sets[begin]] + _AT_ONCE)))
        a, b = int(first[sets[begin]]), int(first[sets[stop - 1] + 1])
        heads = first[sets[begin:stop]] - a
        e, lw, place = digest[a:b], log_weight[a:b], np.arange(b - a, dtype=np.uint64)
        for k in range(SAMPLES):
            draw = (e * factors[k]) >> np.uint64(48)
            r, beta = r_all[draw], beta_all[draw]
            t = np.floor(lw / r + beta)
            bits = (c_all[draw] - r * (t - beta + np.float32(1))).view(np.uint32)
            bits = bits ^ np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))  # same order as the floats
            best = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | place, heads) & np.uint64(0xFFFFFFFF)
            chosen = mix(e[best] ^ (t[best].astype(np.int64).view(np.uint64) * factors[k]))
            out[begin:stop, k] = (chosen >> np.uint64(32)).astype(np.uint32).view(np.int32)
        begin = stop
    return out


def similarity(keys_a: np.ndarray, a: np.ndarray, keys_b: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets given by ascending keys."""
    place = np.minimum(np.searchsorted(keys_b, keys_a), keys_b.size - 1)
    same = keys_b[place] == keys_a
    common = float(np.minimum(a[same], b[place[same]]).sum(dtype=np.float64))
    return common / (float(a.sum(dtype=np.float64)) + float(b.sum(dtype=np.float64)) - common)


class Classes:
    """Result of the search: the block ``table`` and, per row of it, ``members``."""

    def __init__(self, table: DataFrame, members: DataFrame) -> None:
        self.table, self.members = table, members

    def kept_documents(self) -> DataFrame:
        """``doc`` and text of one document per class; texts stay where they are, the verdicts travel."""
        schema = T.StructType([self.table.schema["doc"], self.table.schema["text"]])
        kept = self.members.where("kept").select(F.shiftright("row", exchange.ORD_BITS).alias("block"), F.col("row").alias("keeper"))

        def chosen(block: pa.Table, keepers: pa.Table) -> pa.Table:
            mask = (1 << exchange.ORD_BITS) - 1
            ords = np.sort(keepers.column("keeper").to_numpy() & mask)
            own = block.column("ord").to_numpy()
            return block.select(["doc", "text"]).take(pa.array(np.searchsorted(own, ords), pa.int64()))

        return exchange.meet(self.table, kept, chosen, schema)


def classes(docs: DataFrame, keep: Iterable[str] = ("doc_id",)) -> Classes:
    """Classes of near duplicates: members has row, doc_id, class_id and kept."""
    table = exchange.blocks(docs, keep, "near_blocks", {"id": docs["doc_id"].cast("long")})
    n_docs = table.count()

    def shingled(block: pa.Table) -> tuple:
        return *Shingles(block).frequencies(), None

    heard = exchange.answer(exchange.send(table, shingled, exchange.bucket_count(table, 0.17)), "shingle_counts")
    drawn = through_table(_drawn(table, heard, n_docs), "samples")

    copies = drawn.where("digest is not null")
    nodes = copies.groupBy("digest").agg(F.min("row").alias("row"), F.min(_order()).alias("least"))
    nodes = through_table(nodes, "nodes")
    sketches = drawn.where("sketch is not null").join(nodes.select("row"), "row").select("row", "total", "sketch")
    sketches = through_table(sketches, "sketches")
    roots = _roots(table, heard, n_docs, sketches)
    rooted = nodes.join(roots.withColumnRenamed("node", "row"), "row", "left").select("digest", "least", F.coalesce("root", "row").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    named = through_table(rooted.join(best, "root").select("digest", "best"), "classes")
    whole = copies.select("row", "id", "digest").join(named, "digest")
    whole = whole.select("row", F.col("id").alias("doc_id"), F.col("best.id").alias("class_id"), (F.col("row") == F.col("best.row")).alias("kept"))
    alone = drawn.where("digest is null").select("row", F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    return Classes(table, whole.unionByName(alone))


def _order():
    """Order of the documents of a class: by doc_id, null last, then by row."""
    return F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))


def _rows(block: pa.Table) -> np.ndarray:
    return (block.column("block").to_numpy() << exchange.ORD_BITS) | block.column("ord").to_numpy()


def _drawn(table: DataFrame, heard: DataFrame, n_docs: int) -> DataFrame:
    """row, id, digest of the text (null if blank), total weight and samples (null without words) of every row."""
    schema = "row long, id long, digest binary, total double, sketch array<int>"

    def drawn(block: pa.Table, told: pa.Table) -> pa.Table:
        own = Shingles(block)
        weight = own.weights(told, n_docs)
        some = np.diff(own.first) > 0
        made = samples(own.digest, weight, own.first)
        total = np.zeros(weight.size + 1)
        np.cumsum(weight, out=total[1:])
        data, offsets = text_bytes(block.column("text"))
        body = data.tobytes()
        spans = zip(offsets[:-1].tolist(), offsets[1:].tolist())
        digest = [hashlib.md5(body[a:b]).digest() if body[a:b].strip() else None for a, b in spans]
        sketch: list = [None] * some.size
        for n, row in zip(np.flatnonzero(some).tolist(), made):
            sketch[n] = row
        return pa.table(
            [
                pa.array(_rows(block)),
                block.column("id"),
                pa.array(digest, pa.binary()),
                pa.array(total[own.first[1:]] - total[own.first[:-1]]),
                pa.array(sketch, pa.list_(pa.int32())),
            ],
            names=["row", "id", "digest", "total", "sketch"],
        )

    return exchange.meet(table, heard, drawn, schema)


def _roots(table: DataFrame, heard: DataFrame, n_docs: int, sketches: DataFrame) -> DataFrame:
    """node and root of every node that has a link."""
    band = lambda k: F.xxhash64(F.lit(k), *[F.col("sketch")[k * BAND_SAMPLES + j] for j in range(BAND_SAMPLES)])
    banded = sketches.select("row", F.posexplode(F.array(*[band(k) for k in range(BANDS)])).alias("band", "bucket"))
    led = banded.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min(F.struct(F.xxhash64("row", "bucket").alias("p"), "row"))["row"].alias("leader")
    )
    led = led.where("n > 1").select("bucket", "n", "leader")
    members = through_table(banded.join(led, "bucket"), "buckets")
    sets = through_table(_sets(table, heard, n_docs, members.select("row").distinct()), "sets")

    first = members.where("row <> leader").select(F.col("row").alias("a"), F.col("leader").alias("b")).distinct()
    side = lambda c: sketches.select(*[F.col(n).alias(f"{c}_{n}" if n != "row" else c) for n in sketches.columns])
    first = first.join(side("a"), "a").join(side("b"), "b").where(_alike()).select("a", "b")
    roots = components(through_table(_verified(first, sets), "links"))

    # buckets that still hold two classes, besides those of a leader and one other
    placed = members.join(roots.withColumnRenamed("node", "row"), "row", "left").select(
        "bucket", "band", "n", "row", F.coalesce("root", "row").alias("root")
    )
    placed = through_table(placed.where("n > 2"), "placed")
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    parts = F.ceil(F.col("n") / BLOCK)
    work = placed.join(open_, "bucket").select("bucket", "band", "row", "root", parts.alias("parts"), F.pmod(F.xxhash64("row"), parts).alias("part"))
    work = work.join(sketches, "row").join(sets, "row")
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    work = work.select("*", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).drop("parts", "other")
    joined = through_table(work.groupBy("bucket", "i", "j").applyInArrow(_joining, "a long, b long"), "joining")
    merged = components(joined)
    onward = merged.select(F.col("node").alias("root"), F.col("root").alias("to"))
    moved = roots.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(merged.join(roots.select("node"), "node", "left_anti"))


def _joining(block: pa.Table) -> pa.Table:
    """Links of a bucket's two blocks between texts of different classes, each pair of classes once."""
    block = block.sort_by("row").combine_chunks()
    column = lambda name: block.column(name).to_numpy()
    part, root, total = column("part"), column("root"), column("total")
    band, diagonal = int(block.column("band")[0].as_py()), block.column("i")[0].as_py() == block.column("j")[0].as_py()
    sketch = block.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, SAMPLES)
    left = np.flatnonzero(part == block.column("i")[0].as_py())
    right = left if diagonal else np.flatnonzero(part != block.column("i")[0].as_py())
    agree = np.zeros((left.size, right.size), dtype=np.uint8)
    before = np.zeros(agree.shape, dtype=bool)
    for k in range(BANDS):
        shared = np.ones(agree.shape, dtype=bool)
        for column_ in range(k * BAND_SAMPLES, (k + 1) * BAND_SAMPLES):
            same = sketch[left, column_][:, None] == sketch[right, column_][None, :]
            agree += same
            shared &= same
        if k < band:  # such a pair is compared in the bucket of that band
            before |= shared
    low = np.minimum(total[left][:, None], total[right][None, :])
    high = np.maximum(total[left][:, None], total[right][None, :])
    good = (agree >= LIKELY) & ~before & (low >= (SIMILARITY - 1e-6) * high) & (root[left][:, None] != root[right][None, :])
    if diagonal:
        good &= np.triu(np.ones(good.shape, dtype=bool), 1)
    keys = [np.frombuffer(x, dtype="<u4") for x in block.column("keys").to_pylist()]
    weights = [np.frombuffer(x, dtype="<f4") for x in block.column("weights").to_pylist()]
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    links = []
    for x, y in zip(*(v.tolist() for v in np.nonzero(good))):
        a, b = int(left[x]), int(right[y])
        p, q = top(int(root[a])), top(int(root[b]))
        if p != q and similarity(keys[a], weights[a], keys[b], weights[b]) >= SIMILARITY:
            above[max(p, q)] = min(p, q)
            links.append((int(root[a]), int(root[b])))
    return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])


def _alike():
    """Whether totals and samples of a pair allow the similarity."""
    agree = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    bound = SIMILARITY - 1e-6
    return (F.least("a_total", "b_total") >= bound * F.greatest("a_total", "b_total")) & (agree >= LIKELY)


def _sets(table: DataFrame, heard: DataFrame, n_docs: int, wanted: DataFrame) -> DataFrame:
    """Packed weighted sets of the wanted rows."""
    asked = wanted.select(
        F.shiftright("row", exchange.ORD_BITS).alias("block"),
        F.lit(None).cast("binary").alias("keys"),
        F.lit(None).cast("binary").alias("values"),
        F.col("row").alias("wanted"),
    )
    told = heard.select("block", "keys", "values", F.lit(None).cast("long").alias("wanted"))

    def packed(block: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.sort(right.column("wanted").drop_null().to_numpy())
        rows, keys, weights = [], [], []
        if wanted.size:
            own = Shingles(block)
            weight = own.weights(right.filter(pc.is_valid(right.column("keys"))), n_docs)
            low = (own.digest >> np.uint64(32)).astype("<u4")
            number = np.searchsorted(_rows(block), wanted)
            for row, n in zip(wanted.tolist(), number.tolist()):
                a, b = own.first[n], own.first[n + 1]  # ascending digests, so ascending leading halves
                rows.append(row)
                keys.append(low[a:b].tobytes())
                weights.append(weight[a:b].astype("<f4").tobytes())
        return pa.table([pa.array(rows, pa.int64()), pa.array(keys, pa.binary()), pa.array(weights, pa.binary())], names=["row", "keys", "weights"])

    return exchange.meet(table, told.unionByName(asked), packed, "row long, keys binary, weights binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose exact weighted Jaccard similarity reaches the bound."""
    side = lambda c: sets.select(F.col("row").alias(c), F.col("keys").alias(f"{c}_keys"), F.col("weights").alias(f"{c}_weights"))
    whole = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_keys", "a_weights", "b_keys", "b_weights")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda name, kind: [np.frombuffer(x, dtype=kind) for x in batch.column(name).to_pylist()]  # noqa: E731, B023
            columns = zip(read("a_keys", "<u4"), read("a_weights", "<f4"), read("b_keys", "<u4"), read("b_weights", "<f4"))
            good = [similarity(*c) >= SIMILARITY for c in columns]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return whole.mapInArrow(checked, "a long, b long")
