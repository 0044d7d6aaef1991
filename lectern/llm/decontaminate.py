"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` turns the training documents into a table of index segments. A segment holds
the postings of a few megabytes of text: its terms, and for each term the ascending word
positions. It is cut by size, so a source, passage or word that fills a third of all rows
is spread over as many segments as its text fills, and no posting list is ever shuffled.

``find`` asks for phrases. It counts the test terms in the whole index, then intersects,
in every segment, the offset-adjusted posting lists of a phrase from its rarest term on; a
phrase with a term that a segment lacks costs nothing there. ``near`` asks for terms in any
order within a span of words. Test items are taken in blocks of ``BLOCK_BYTES``, so what is
sent to the executors at once has a fixed bound.

Cases: a null text has no words and is never hit; a null item text asks nothing; an item
without an id hits like any other but is not among the items named; an item
without item_id is left out; rows that repeat a doc_id are documents of their own, and items
that repeat an item_id count once; an empty table gives an empty result (or documents that
are all clean). Extra columns are carried along under their own names where asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.session import fresh_path, through_table
from lectern.llm.text import ALNUM, Words, pieces, runs

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: a row is megabytes here, so the (compressed) size of a row group is looked at from its second row on, not its hundredth
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of ascending runs' differences: long streaks of zeros for the file's codec."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(body: bytes) -> np.ndarray:
    planes = np.frombuffer(body, dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class Segment:
    """Postings of one run of documents. ``positions[at[t]:at[t + 1]]`` belong to term ``t``."""

    def __init__(self, terms: pa.Array, sizes: np.ndarray, packed: bytes, first: np.ndarray) -> None:
        self.terms = terms
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.first = first
        steps = _unpack(packed).astype(np.int64)
        total = np.cumsum(steps)
        before = total[self.at[:-1]] - steps[self.at[:-1]] if steps.size else total
        self.positions = total - np.repeat(before, sizes)

    @staticmethod
    def columns(texts: pa.Array) -> dict:
        words = Words(texts, ALNUM, lower=True)
        coded = words.strings().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
        order = np.sort((codes << np.uint64(32)) | np.arange(codes.size, dtype=np.uint64))
        positions = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start, sizes = runs(order >> np.uint64(32))
        steps = np.diff(positions, prepend=0)
        steps[start] = positions[start]
        return {"terms": coded.dictionary, "sizes": sizes.astype(np.int32), "postings": _pack(steps), "first": words.first}

    def codes_of(self, wanted: pa.Array) -> np.ndarray:
        """Own number of each wanted term, -1 where the segment lacks it."""
        found = pc.index_in(wanted, value_set=self.terms)
        return found.fill_null(-1).to_numpy(zero_copy_only=False)

    def list_of(self, code: int) -> np.ndarray:
        return self.positions[self.at[code] : self.at[code + 1]]

    def phrase(self, codes: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Starts of the phrase, intersecting offset-adjusted lists in ``order``."""
        starts = self.list_of(codes[order[0]]) - order[0]
        for offset in order[1:]:
            if not starts.size:
                return starts
            other, want = self.list_of(codes[offset]), starts + offset
            place = np.searchsorted(other, want)
            place[place == other.size] = 0
            starts = starts[other[place] == want]
        starts = starts[starts >= 0]
        own = np.searchsorted(self.first, starts, side="right")
        return starts[starts + codes.size <= self.first[own]] if starts.size else starts

    def near(self, codes: np.ndarray, rarity: np.ndarray, span: int) -> np.ndarray:
        """Places from which all terms occur within ``span`` words of one document."""
        rarest = self.list_of(codes[rarity[0]])
        lists = [self.list_of(c) for c in codes[rarity]]
        begins = []
        for other in lists:
            place = np.searchsorted(rarest, other - span + 1)
            close = place < rarest.size
            close[close] = rarest[place[close]] < other[close] + span
            begins.append(other[close])
        begin = np.unique(np.concatenate(begins))
        last = begin.copy()
        for other in lists:
            place = np.searchsorted(other, begin)
            inside = place < other.size
            begin, last, place = begin[inside], last[inside], place[inside]
            last = np.maximum(last, other[place])
        own = np.searchsorted(self.first, begin, side="right")
        good = (last - begin < span) & (last < self.first[own])
        return begin[good]


def build_index(docs: DataFrame, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Index segments of ``docs.text``, written to the shared folder.

    ``keep`` names document columns that results will carry.
    """
    rows = docs.select(F.col("text").alias("text"), F.struct(*[docs[c] for c in keep]).alias("doc"))
    doc_type = rows.schema["doc"].dataType
    schema = T.StructType(
        [
            T.StructField("segment", T.LongType(), False),
            T.StructField("docs", T.ArrayType(doc_type)),
            T.StructField("first", T.ArrayType(T.LongType())),
            T.StructField("terms", T.ArrayType(T.BinaryType())),
            T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("postings", T.BinaryType()),
        ]
    )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch):
                made = Segment.columns(piece.column("text"))
                held = piece.column("doc")
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        one(held),
                        one(pa.array(made["first"], pa.int64())),
                        one(made["terms"].cast(pa.binary())),
                        one(pa.array(made["sizes"], pa.int32())),
                        pa.array([made["postings"]], pa.binary()),
                    ],
                    names=["segment", "docs", "first", "terms", "sizes", "postings"],
                )
                number += 1

    spark = docs.sparkSession
    path = fresh_path(spark, "postings")
    made = rows.mapInArrow(segments, schema)
    made.write.options(**ROW_GROUPS).option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


class Phrases:
    """A bounded block of phrases: distinct windows as term numbers, and whose they are."""

    def __init__(self, items: list[tuple[int, str]], window: int) -> None:
        words = Words(pa.array([t for _, t in items], pa.string()), ALNUM, lower=True)
        coded = words.strings().dictionary_encode()
        self.terms = coded.dictionary.cast(pa.binary())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        owners: dict[tuple[int, ...], set[int]] = {}
        for n, (item, _) in enumerate(items):
            own = codes[words.first[n] : words.first[n + 1]].tolist()
            for at in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[at : at + window]), set()).add(item)
        self.windows = [np.array(w) for w in owners]
        self.owners = [sorted(x for x in o if x is not None) for o in owners.values()]  # an item without id hits, but has no name
        self.flat = np.concatenate(self.windows) if owners else np.zeros(0, dtype=np.int64)
        self.begin = np.cumsum([0, *map(len, owners)])[:-1]
        self.counts = np.zeros(len(self.terms), dtype=np.int64)
        self.order: list[np.ndarray] = []

    def rank(self, counts: dict[int, int]) -> None:
        """Order each window's words from the rarest by their counts in the whole index."""
        for term, n in counts.items():
            self.counts[term] = n
        self.order = [np.argsort(self.counts[w], kind="stable") for w in self.windows]


def _segment(row: dict) -> Segment:
    values = lambda name: row[name].values.to_numpy(zero_copy_only=False)
    terms = row["terms"].values
    return Segment(terms, values("sizes"), row["postings"].as_py(), values("first"))


def term_counts(index: DataFrame, terms: pa.Array) -> dict[int, int]:
    """Occurrences in the whole index of each term of a bounded list, by its number."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), dtype=np.int64)
        for batch in batches:
            for n in range(batch.num_rows):
                known, sizes = batch.column(0)[n].values, batch.column(1)[n].values.to_numpy()
                place = pc.index_in(sent.value, value_set=known)
                own = place.is_valid().to_numpy(zero_copy_only=False)
                total[own] += sizes[place.drop_null().to_numpy()]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["term", "n"])

    parts = index.select("terms", "sizes").mapInArrow(counted, "term long, n long")
    return {r.term: r.n for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def blocks(items: DataFrame, size: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Test items in blocks of bounded text, streamed to the driver."""
    held, room = [], 0
    asked = items.where("text is not null").select("item_id", "text", F.octet_length("text").alias("size"))
    for row in asked.toLocalIterator():
        held.append((row.item_id, row.text))
        room += row["size"]
        if room >= size:
            yield held
            held, room = [], 0
    if held:
        yield held


def _matched(index: DataFrame, phrases: Phrases) -> DataFrame:
    """Per document of the index: its columns, words, hit spans and items of this block."""
    phrases.rank(term_counts(index, phrases.terms))
    sent = index.sparkSession.sparkContext.broadcast(phrases)
    doc_type = index.schema["docs"].dataType.elementType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [
            T.StructField("segment", T.LongType()),
            T.StructField("place", T.LongType()),
            T.StructField("doc", doc_type),
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(span)),
            T.StructField("items", T.ArrayType(T.LongType())),
        ]
    )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = sent.value
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n] for name in batch.schema.names}
                part = _segment(row)
                codes = part.codes_of(ask.terms)
                n_docs = part.first.size - 1
                cover = np.zeros(int(part.first[-1]) + 1, dtype=np.int64)
                hits: dict[int, set[int]] = {}
                present = np.minimum.reduceat(codes[ask.flat], ask.begin) >= 0 if ask.windows else np.zeros(0, dtype=bool)
                for k in np.flatnonzero(present).tolist():  # windows whose words the segment all has
                    window, order, owners = ask.windows[k], ask.order[k], ask.owners[k]
                    own = codes[window]
                    starts = part.phrase(own, order)
                    if starts.size:
                        np.add.at(cover, starts, 1)
                        np.add.at(cover, starts + window.size, -1)
                        for d in set((np.searchsorted(part.first, starts, side="right") - 1).tolist()):
                            hits.setdefault(d, set()).update(owners)
                # a window never leaves its document, so cover is back at 0 between documents only by spans
                hit = np.cumsum(cover)[:-1] > 0
                edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                begin, end = edge[0::2], edge[1::2]
                spans: list[list] = [[] for _ in range(n_docs)]
                for a, b in zip(begin.tolist(), end.tolist()):  # a span may run over into the next document
                    d = int(np.searchsorted(part.first, a, side="right")) - 1
                    while a < b:
                        stop = min(b, int(part.first[d + 1]))
                        if stop > a:
                            spans[d].append({"start": a - int(part.first[d]), "end": stop - int(part.first[d])})
                        a, d = stop, d + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n_docs, row["segment"].as_py()), pa.int64()),
                        pa.array(np.arange(n_docs), pa.int64()),
                        row["docs"].values,
                        pa.array(np.diff(part.first), pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(hits.get(d, ())) for d in range(n_docs)], pa.list_(pa.int64())),
                    ],
                    names=["segment", "place", "doc", "n_words", "spans", "items"],
                )

    return index.mapInArrow(searched, schema)


def _joined_spans(spans):
    """Union of sorted spans, as a fold with one open span."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(empty.alias("done"), F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))
    closed = lambda s: F.when(s["start"] >= 0, F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["done"])
    step = lambda s, x: F.when(
        (s["start"] >= 0) & (x["start"] <= s["end"]),
        F.struct(s["done"].alias("done"), s["start"].alias("start"), F.greatest(s["end"], x["end"]).alias("end")),
    ).otherwise(F.struct(closed(s).alias("done"), x["start"].alias("start"), x["end"].alias("end")))
    return F.aggregate(F.array_sort(spans), start, step, closed)


def find(index: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per indexed document: ``doc``, ``n_words``, hit ``spans`` and the ``items`` found in it.

    An item asks for every ``window`` consecutive words of it (all of a shorter one).
    """
    found, count = None, 0
    for block in blocks(items, block_bytes):
        part = _matched(index, Phrases(block, window))
        found = part if found is None else found.unionByName(part.where("size(spans) > 0"))
        count += 1
    if found is None:
        found = _matched(index, Phrases([], window))
    if count > 1:  # a document's hits of all blocks meet
        found = through_table(found, "block-hits")
        keys = ["segment", "place"]
        merged = found.groupBy(*keys).agg(
            F.max("n_words").alias("n_words"),
            _joined_spans(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        whole = index.select("segment", F.posexplode("docs").alias("place", "doc"))
        whole = whole.withColumn("place", F.col("place").cast("long"))
        found = whole.join(merged, keys).select(*keys, "doc", "n_words", "spans", "items")
    return found.select("doc", "n_words", "spans", "items")


def near(index: DataFrame, items: DataFrame, span: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Proximity matches: ``doc``, ``item_id`` and ``starts`` from which all words of the
    item's text occur, in any order, within ``span`` words of the document."""
    doc_type = index.schema["docs"].dataType.elementType
    schema = T.StructType(
        [T.StructField("doc", doc_type), T.StructField("item_id", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType()))]
    )
    out = None
    for block in blocks(items, block_bytes):
        words = Words(pa.array([t for _, t in block], pa.string()), ALNUM, lower=True)
        coded = words.strings().dictionary_encode()
        terms = coded.dictionary.cast(pa.binary())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        counts = term_counts(index, terms)
        asked = []
        for n, (item, _) in enumerate(block):  # an item without id gives rows without one
            own = np.array(sorted(set(codes[words.first[n] : words.first[n + 1]].tolist())), dtype=np.int64)
            if own.size:
                asked.append((item, own, np.argsort([counts.get(int(c), 0) for c in own], kind="stable")))
        sent = index.sparkSession.sparkContext.broadcast((terms, asked))

        def searched(batches, sent=sent):
            terms, asked = sent.value
            for batch in batches:
                for n in range(batch.num_rows):
                    row = {name: batch.column(name)[n] for name in batch.schema.names}
                    part = _segment(row)
                    own = part.codes_of(terms)
                    picked, ids, places = [], [], []
                    for item, codes, rarity in asked:
                        if own[codes].min() < 0:
                            continue
                        starts = part.near(own[codes], rarity, span)
                        d = np.searchsorted(part.first, starts, side="right") - 1
                        for doc in sorted(set(d.tolist())):
                            picked.append(doc)
                            ids.append(item)
                            places.append((starts[d == doc] - part.first[doc]).tolist())
                    yield pa.RecordBatch.from_arrays(
                        [
                            row["docs"].values.take(pa.array(picked, pa.int64())),
                            pa.array(ids, pa.int64()),
                            pa.array(places, pa.list_(pa.int64())),
                        ],
                        names=["doc", "item_id", "starts"],
                    )

        part = index.mapInArrow(searched, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else index.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, items: DataFrame, keep: Iterable[str] = ("doc_id",), window: int = WINDOW) -> DataFrame:
    """``doc`` (a struct of ``keep``), n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = find(build_index(docs, keep), items, window)
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )
