"""Values of a keyed corpus table, brought to the documents that hold the keys.

Operators that need a figure of the whole corpus for every n-gram, shingle or symbol of a
document would shuffle a row per occurrence. Here documents are first dealt into blocks of a
few megabytes of text, written once. A block sends each of its distinct keys once, packed
into one row per bucket of the key space; a bucket merges what all blocks sent and answers
only where the merged value tells a block something new; answers and blocks then meet by
block. The block table is bucketed by block, so texts are never shuffled.

A block is pre-aggregated, so a key that fills a third of all rows is sent once by each block;
the number of buckets follows the amount of text, so a bucket stays within one task's memory.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.session import fresh_path
from lectern.llm.text import text_bytes

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 1 << 16
#: keys that a bucket should hold
BUCKET_KEYS = 500_000
ORD_BITS = 22

_ZSTD = pa.Codec("zstd", 1)

SENT = "bucket long, block long, keys binary, values binary, bounds binary"
ANSWER = "block long, keys binary, values binary"


def pack(values: np.ndarray) -> bytes:
    """Compressed byte planes: small values leave little but their last plane."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return values.size.to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def unpack(body: bytes | None) -> np.ndarray:
    size = int.from_bytes(body[:8], "little") if body else 0
    if not size:
        return np.zeros(0, dtype=np.uint64)
    planes = np.frombuffer(_ZSTD.decompress(body[8:], 8 * size), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_ascending(keys: np.ndarray) -> bytes:
    """Ascending keys by their steps."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_ascending(body: bytes | None) -> np.ndarray:
    return np.cumsum(unpack(body), dtype=np.uint64)


def blocks(docs: DataFrame, keep: Iterable[str], name: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Documents as a written table: block, ord, doc (struct of ``keep``), text and ``extra``.

    ``block << ORD_BITS | ord`` numbers the rows.
    """
    spark = docs.sparkSession
    extra = extra or {}
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), docs["text"].alias("text"), *[c.alias(n) for n, c in extra.items()])
    schema = T.StructType([T.StructField("block", T.LongType(), False), T.StructField("ord", T.LongType(), False), *rows.schema.fields])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 20
        block, room, ord_ = 0, 0, 0
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            sizes = np.diff(offsets).tolist()
            whose, place = [], []
            for size in sizes:
                if ord_ and (room + size > BLOCK_BYTES or ord_ >= BLOCK_ROWS):
                    block, room, ord_ = block + 1, 0, 0
                whose.append(base + block)
                place.append(ord_)
                room, ord_ = room + size, ord_ + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(whose, pa.int64()), pa.array(place, pa.int64()), *batch.columns], names=["block", "ord", *batch.schema.names]
            )

    table = f"{name}_{uuid.uuid4().hex}"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    writer = rows.mapInArrow(dealt, schema).write.format("parquet").bucketBy(parts, "block").option("compression", "zstd")
    writer.option("path", fresh_path(spark, name)).saveAsTable(table)
    made = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the catalog forgets the name; files and buckets stay
    return made


def in_order(group: pa.Table) -> pa.Table:
    """A block's rows as they were dealt, each column in one piece."""
    return group.sort_by("ord").combine_chunks()


def bucket_count(table: DataFrame, keys_per_byte: float) -> int:
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, int(size * keys_per_byte / BUCKET_KEYS) + 1)


def sent_rows(block: int, keys: np.ndarray, values: np.ndarray, bounds: np.ndarray | None, buckets: int) -> pa.Table:
    """One row per bucket for a block's ascending distinct keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    start = np.flatnonzero(np.diff(bucket, prepend=np.uint64(0xFFFFFFFFFFFFFFFF)) != 0)
    cut = np.append(start, keys.size).tolist()
    spans = list(zip(cut, cut[1:]))
    return pa.table(
        {
            "bucket": pa.array(bucket[start].astype(np.int64)),
            "block": pa.array(np.full(start.size, block, dtype=np.int64)),
            "keys": pa.array([pack_ascending(keys[a:b]) for a, b in spans], pa.binary()),
            "values": pa.array([pack(values[a:b]) for a, b in spans], pa.binary()),
            "bounds": pa.array([None if bounds is None else pack(bounds[a:b]) for a, b in spans], pa.binary()),
        }
    )


def send(table: DataFrame, keys_of: Callable[[pa.Table], tuple], buckets: int) -> DataFrame:
    """What every block sends: ``keys_of`` gives ascending distinct keys, their values, and bounds or None."""

    def sent(group: pa.Table) -> pa.Table:
        keys, values, bounds = keys_of(in_order(group))
        return sent_rows(group.column("block")[0].as_py(), keys, values, bounds, buckets)

    return table.groupBy("block").applyInArrow(sent, SENT)


def answer(sent: DataFrame, name: str, least: bool = False, totals: Callable[[np.ndarray, np.ndarray], list[int]] | None = None) -> DataFrame:
    """Merge by bucket and answer by block; written to the shared folder.

    Values are added up; a block hears of keys whose total is not its own. With ``least`` the
    least is taken; a block hears of keys whose least value lies under its bound. ``totals``
    makes figures of a bucket's distinct keys and values, given as the answer to block -1.
    """

    def merged(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        block = group.column("block").to_pylist()
        keys = [unpack_ascending(b) for b in group.column("keys").to_pylist()]
        values = np.concatenate([unpack(b) for b in group.column("values").to_pylist()])
        sizes = [k.size for k in keys]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        joined = (np.minimum if least else np.add).reduceat(values[order], first)
        total = np.empty_like(values)
        total[order] = np.repeat(joined, np.diff(np.append(first, ranked.size)))
        if least:
            news = total < np.concatenate([unpack(b) for b in group.column("bounds").to_pylist()])
        else:
            news = total != values
        out: dict[str, list] = {"block": [], "keys": [], "values": []}
        at = 0
        for number, size in zip(block, sizes):
            own = news[at : at + size]
            if own.any():
                out["block"].append(number)
                out["keys"].append(pack_ascending(every[at : at + size][own]))
                out["values"].append(pack(total[at : at + size][own]))
            at += size
        if totals is not None:
            out["block"].append(-1)
            out["keys"].append(b"")
            out["values"].append(pack(np.array(totals(ranked[first], joined), dtype=np.uint64)))
        return pa.table([pa.array(out["block"], pa.int64()), pa.array(out["keys"], pa.binary()), pa.array(out["values"], pa.binary())], names=["block", "keys", "values"])

    spark = sent.sparkSession
    path = fresh_path(spark, name)
    sent.groupBy("bucket").applyInArrow(merged, ANSWER).write.option("compression", "zstd").parquet(path)
    let_go(spark)
    return spark.read.schema(ANSWER).parquet(path)


def let_go(spark) -> None:
    """Have Spark delete the shuffle files of finished steps before the next one needs room.

    It does so when the driver's garbage is collected, which may else be long after.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def heard(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's answers, by ascending key."""
    if not answers.num_rows:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    keys = np.concatenate([unpack_ascending(b) for b in answers.column("keys").to_pylist()])
    values = np.concatenate([unpack(b) for b in answers.column("values").to_pylist()])
    order = np.argsort(keys)
    return keys[order], values[order]


def replaced(keys: np.ndarray, values: np.ndarray, known: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Own values by ascending key, with the told ones in place."""
    out = values.copy()
    out[np.searchsorted(keys, known)] = told
    return out


def settle(keys: np.ndarray, values: np.ndarray, answers: pa.Table) -> np.ndarray:
    """Own values, replaced where an answer came."""
    return replaced(keys, values, *heard(answers))


def meet(table: DataFrame, answers: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """``use`` of every block with the answers to it."""

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        return use(in_order(left), right)

    return table.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(met, schema)


def look_up(known: np.ndarray, told: np.ndarray, keys: np.ndarray, missing: int) -> np.ndarray:
    """Told value of each key, ``missing`` where none is known."""
    if not known.size:
        return np.full(keys.size, missing, dtype=np.uint64)
    place = np.minimum(np.searchsorted(known, keys), known.size - 1)
    return np.where(known[place] == keys, told[place], np.uint64(missing))
