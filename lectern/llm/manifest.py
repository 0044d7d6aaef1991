"""Merkle manifest of a dataset by bitmap ranks and slot arrays.

Each row is a leaf of its group's tree, in the order of its id; the groups' roots are the
leaves of the last tree, in the order of the groups. Nothing is sorted to place a leaf:

* **Bitmaps.** Every task turns the ids it reads into containers per (group, id >> 16): the
  low halves as a list, or as a compressed bitmap where that is shorter. Containers of the
  same key are merged, and get a popcount directory (rows before each 64-bit word).
* **Ranks.** Containers are counted up the 16-bit digits of the ids, so no step sees more
  than 65,536 rows of a key. A leaf's place is its container's offset, the directory entry of
  its word, and the bits before it in that word.
* **Slot arrays.** Leaves of 1,024 consecutive places meet by (group, place >> 10), are put
  into an array by their place, and ten levels are reduced at once; the nodes that come out go
  the same way until each group has one. Sibling paths come back down through the same slots.

A node with one child is the digest of that child alone. ``proof_sha256`` is the digest of the
siblings from the leaf up to the root. A leaf that was tampered with is folded up in place of
the original; ``verified`` tells whether the root comes out.

Cases: a null group is the first; null ids stand first in their group; rows that share an id
stand in the order of their leaf digests (rows equal in all fields are interchangeable); a
null field is written ``-``, an empty one ``0:``; a single row is its group's root; an empty
table gives no rows. Columns beyond ``fields`` are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.ordering import rank_within
from lectern.functions.session import through_table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SLOT_BITS = 10
#: ids, or containers, that a task holds before it sends them on
HELD_IDS, HELD_KEYS = 4_000_000, 100_000
#: ids up to which a container is looked up in a list
LISTED = 256
#: where null ids stand: below every long
_NULL_HIGH = -(1 << 47) - 1


# ---------------------------------------------------------------- leaves


def leaf_of(values: Sequence[Column]) -> Column:
    """Digest of a row's fields, each as byte count and value."""
    told = []
    for value in values:
        text = value.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*told).cast("binary"), 256)


def leaves(rows: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", tampered: Column | None = None, changed: str = "n_chars") -> DataFrame:
    """tree, high, low, key, leaf, and ``seen`` where a leaf was tampered with (digests as bytes).

    ``tampered`` may use the columns of ``fields``.
    """
    rows = rows.select(*[rows[f] for f in fields])
    seen = F.lit(None).cast("string")
    if tampered is not None:
        seen = F.when(tampered, leaf_of([F.try_add(f, F.lit(1)) if f == changed else F.col(f) for f in fields]))
    number = F.col(key).cast("long")
    return rows.select(
        F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("tree"),
        F.coalesce(F.shiftright(number, 16), F.lit(_NULL_HIGH)).alias("high"),
        F.coalesce(number.bitwiseAND(F.lit(0xFFFF)), F.lit(0)).cast("int").alias("low"),
        number.alias("key"),
        F.unhex(leaf_of([F.col(f) for f in fields])).alias("leaf"),
        F.unhex(seen).alias("seen"),
    )


# ---------------------------------------------------------------- bitmaps and ranks


def container(lows: np.ndarray) -> tuple[bytes, bytes | None]:
    """Distinct lows, as a list or a compressed bitmap, and how often each came if any came twice."""
    distinct, times = np.unique(lows.astype(np.uint16), return_counts=True)
    body = b"L" + distinct.astype("<u2").tobytes()
    if distinct.size > LISTED:
        bits = np.zeros(1 << 16, dtype=np.uint8)
        bits[distinct] = 1
        packed = b"B" + zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
        body = min(body, packed, key=len)
    return body, (zlib.compress(times.astype("<i8").tobytes(), 1) if times.max(initial=1) > 1 else None)


def opened(body: bytes, times: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lows of a container and the times of each."""
    if body[:1] == b"B":
        bits = np.unpackbits(np.frombuffer(zlib.decompress(body[1:]), dtype=np.uint8), bitorder="little")
        lows = np.flatnonzero(bits)
    else:
        lows = np.frombuffer(body[1:], dtype="<u2").astype(np.int64)
    return lows, np.ones(lows.size, dtype=np.int64) if times is None else np.frombuffer(zlib.decompress(times), dtype="<i8")


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], list[np.ndarray]] = {}
    count = 0

    def sent() -> pa.RecordBatch:
        rows = [(t, h, *container(np.concatenate(parts))) for (t, h), parts in held.items()]
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tree", "high", "body", "times"])

    for batch in batches:
        trees = batch.column(0).dictionary_encode()
        names, codes = trees.dictionary.to_pylist(), trees.indices.to_numpy()
        high, low = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        order = np.lexsort((high, codes))
        edge = np.flatnonzero(np.diff(codes[order], prepend=-1).astype(bool) | np.diff(high[order], prepend=np.int64(0)).astype(bool)).tolist()
        for a, b in zip(edge, [*edge[1:], order.size]):
            some = order[a:b]
            held.setdefault((names[codes[some[0]]], int(high[some[0]])), []).append(low[some].astype(np.uint16))
        count += batch.num_rows
        if count >= HELD_IDS or len(held) >= HELD_KEYS:
            yield sent()
            held.clear()
            count = 0
    yield sent()


def _merged(group: pa.Table) -> pa.Table:
    total = np.zeros(1 << 16, dtype=np.int64)
    for body, times in zip(group.column("body"), group.column("times")):
        lows, counts = opened(body.as_py(), times.as_py())
        total[lows] += counts
    lows = np.flatnonzero(total)
    before = np.cumsum(total) - total
    repeated = bool((total > 1).any())
    row = {"tree": [group.column("tree")[0].as_py()], "high": [group.column("high")[0].as_py()], "rows": [int(total.sum())], "repeated": [repeated]}
    if repeated or lows.size <= LISTED:
        row |= {"lows": [lows.tolist()], "before": [before[lows].tolist()], "times": [total[lows].tolist()] if repeated else [None], "words": [None], "ranks": [None]}
    else:
        bits = np.packbits((total > 0).astype(np.uint8), bitorder="little").view("<i8")
        row |= {"lows": [None], "before": [None], "times": [None], "words": [bits.tolist()], "ranks": [before[::64].tolist()]}
    return pa.table({f.name: pa.array(row[f.name], f.type) for f in _DIRECTORY_ARROW}, schema=_DIRECTORY_ARROW)


_DIRECTORY = "tree string, high long, rows long, repeated boolean, lows array<int>, before array<long>, times array<long>, words array<long>, ranks array<long>"
_DIRECTORY_ARROW = pa.schema(
    [(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}[k]) for n, k in (f.split() for f in _DIRECTORY.split(", "))]
)


def directory(placed: DataFrame) -> DataFrame:
    """Merged containers of (tree, high, low) rows, each with ``first``, the rows of its tree that
    stand before it, and ``total``, all rows of the tree. A written table."""
    parts = placed.select("tree", "high", "low").mapInArrow(_containers, "tree string, high long, body binary, times binary")
    merged = through_table(parts.groupBy("tree", "high").applyInArrow(_merged, _DIRECTORY), "bitmaps")
    one = merged.select("tree", "high", "rows").withColumn("h2", F.shiftright("high", 16)).withColumn("h3", F.shiftright("high", 32))
    two = one.groupBy("tree", "h3", "h2").agg(F.sum("rows").alias("rows"))
    three = two.groupBy("tree", "h3").agg(F.sum("rows").alias("rows"))

    def before(keys: list[str], order: str) -> Column:
        return F.coalesce(F.sum("rows").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    three = three.select("tree", "h3", before(["tree"], "h3").alias("o3"), F.sum("rows").over(W.partitionBy("tree")).alias("total"))
    two = two.withColumn("o2", before(["tree", "h3"], "h2")).join(three, ["tree", "h3"]).select("tree", "h2", (F.col("o2") + F.col("o3")).alias("o2"), "total")
    one = one.withColumn("o1", before(["tree", "h2"], "high")).join(two, ["tree", "h2"]).select("tree", "high", (F.col("o1") + F.col("o2")).cast("long").alias("first"), "total")
    return through_table(merged.join(one, ["tree", "high"]), "directory")


def ranked(placed: DataFrame, found: DataFrame) -> DataFrame:
    """``placed`` with ``at``, the row's place in its tree, and the tree's ``total``."""
    word, bit = F.shiftright("low", 6), F.col("low").bitwiseAND(F.lit(63))
    below = F.bit_count(F.get("words", word).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))))
    slot = F.array_position("lows", F.col("low")).cast("int") - 1
    inside = F.when(F.col("words").isNotNull(), F.get("ranks", word) + below).otherwise(F.get("before", slot))
    joined = placed.join(found, ["tree", "high"])
    rows = joined.select(*placed.columns, "total", (F.col("first") + inside).cast("long").alias("at"), F.get("times", slot).alias("n"))
    if found.where("repeated").isEmpty():
        return rows.drop("n")
    single = rows.where("coalesce(n, 1) = 1").drop("n")
    tied = rows.where("n > 1").drop("n")
    bucket = F.conv(F.hex(F.substring("leaf", 1, 3)), 16, 10).cast("long")
    tied = rank_within(tied, ["tree", "high", "low"], bucket, ["leaf"], "nth")
    return single.unionByName(tied.withColumn("at", F.col("at") + F.col("nth") - 1).drop("nth"))


# ---------------------------------------------------------------- trees


def digest(*children: bytes) -> bytes:
    """Digest of children that are given as bytes and hashed as hex text."""
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def height(count: int) -> int:
    return (count - 1).bit_length()


def slot_levels(slot: list[bytes], levels: int) -> list[list[bytes]]:
    """The slot array and the arrays of nodes above it."""
    out = [slot]
    for _ in range(levels):
        row = out[-1]
        out.append([digest(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return out


def _slot(group: pa.Table, column: str, bits: int) -> tuple[list[int], list[list[bytes]]]:
    """Positions of a group's rows in their slot, and the slot's levels."""
    mask = (1 << bits) - 1
    at = [a & mask for a in group.column("at").to_pylist()]
    array: list[bytes] = [b""] * len(at)
    for a, node in zip(at, group.column(column).to_pylist()):
        array[a] = node
    return at, slot_levels(array, min(bits, height(group.column("total")[0].as_py())))


NODES = "tree string, at long, total long, node binary"
_NODES_ARROW = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("total", pa.int64()), ("node", pa.binary())])


def lifted(nodes: DataFrame, column: str, bits: int) -> DataFrame:
    """One level of slot arrays: a node per slot."""

    def reduced(group: pa.Table) -> pa.Table:
        _, levels = _slot(group, column, bits)
        at, total = group.column("at")[0].as_py(), group.column("total")[0].as_py()
        return pa.table([[group.column("tree")[0].as_py()], [at >> bits], [-(-total >> bits) if total > 1 else 1], [levels[-1][0]]], schema=_NODES_ARROW)

    rows = nodes.select("tree", "at", "total", column, F.shiftright("at", bits).alias("slot"))
    return rows.groupBy("tree", "slot").applyInArrow(reduced, NODES)


def layers(nodes: DataFrame, column: str, highest: int, bits: int) -> list[DataFrame]:
    """Tables of nodes above ``nodes``, up to one per tree; ``highest`` is the largest tree's row count."""
    out, left = [], highest
    while left > 1 or not out:
        below, name = (out[-1], "node") if out else (nodes, column)
        out.append(through_table(lifted(below, name, bits), "layer"))
        left = -(-left >> bits)
    return out


def siblings(levels: list[list[bytes]], at: int) -> list[bytes]:
    """A sibling of each level, after a byte that tells its side; empty where there is none."""
    out = []
    for row in levels[:-1]:
        other = at ^ 1
        out.append((b"L" if other < at else b"R") + row[other] if other < len(row) else b"")
        at >>= 1
    return out


def fold(node: bytes, path: list[bytes]) -> bytes:
    """What a node becomes at the end of its path."""
    for entry in path:
        side, other = entry[:1], entry[1:]
        node = digest(node) if not side else digest(other, node) if side == b"L" else digest(node, other)
    return node


PATHS = "tree string, at long, path array<binary>"
_PATHS_ARROW = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("path", pa.list_(pa.binary()))])


def _above(paths: pa.Table) -> list[bytes]:
    return paths.column("path")[0].as_py() if paths.num_rows else []


def lowered(nodes: DataFrame, paths: DataFrame, bits: int) -> DataFrame:
    """Paths of ``nodes`` from those of their slots."""

    def down(own: pa.Table, above: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _PATHS_ARROW.empty_table()
        at, levels = _slot(own, "node", bits)
        rest = _above(above)
        return pa.table([own.column("tree"), own.column("at"), pa.array([siblings(levels, a) + rest for a in at], pa.list_(pa.binary()))], schema=_PATHS_ARROW)

    rows = nodes.withColumn("slot", F.shiftright("at", bits))
    return rows.groupBy("tree", "slot").cogroup(paths.groupBy("tree", "at")).applyInArrow(down, PATHS)


PROVED = "tree string, key long, leaf string, proof_sha256 string, folded_root string"
_PROVED_ARROW = pa.schema([(n, pa.int64() if n == "key" else pa.string()) for n in ("tree", "key", "leaf", "proof_sha256", "folded_root")])


def proved(nodes: DataFrame, paths: DataFrame, bits: int) -> DataFrame:
    """Proof and folded root of every leaf."""

    def down(own: pa.Table, above: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _PROVED_ARROW.empty_table()
        at, levels = _slot(own, "leaf", bits)
        rest = _above(above)
        leaf = own.column("leaf").to_pylist()
        proof, root = [], []
        for a, node, other in zip(at, leaf, own.column("seen").to_pylist()):
            path = siblings(levels, a) + rest
            proof.append(digest(*[e[1:] for e in path]).hex())
            root.append(fold(node if other is None else other, path).hex())
        return pa.table([own.column("tree"), own.column("key"), [n.hex() for n in leaf], proof, root], schema=_PROVED_ARROW)

    rows = nodes.select("tree", "at", "total", "key", "leaf", "seen", F.shiftright("at", bits).alias("slot"))
    return rows.groupBy("tree", "slot").cogroup(paths.groupBy("tree", "at")).applyInArrow(down, PROVED)


def _paths(tables: list[DataFrame], top: DataFrame, bits: int) -> DataFrame:
    """Paths of the lowest of ``tables`` from those of the highest."""
    paths = top
    for table in reversed(tables[:-1]):
        paths = through_table(lowered(table, paths, bits), "paths")
    return paths


def build(
    rows: DataFrame,
    fields: Sequence[str] = FIELDS,
    key: str = "doc_id",
    group: str = "lang",
    tampered: Column | None = None,
    changed: str = "n_chars",
    bits: int = SLOT_BITS,
) -> DataFrame:
    """key, tree (group, ``0`` for null, ``1`` and its name else), leaf, subroot, root,
    proof_sha256, folded_root, verified: a row per row of the table."""
    spark = rows.sparkSession
    placed = through_table(leaves(rows, fields, key, group, tampered, changed), "leaves")
    found = directory(placed)
    nodes = through_table(ranked(placed, found), "places")
    highest = found.agg(F.max("total")).first()[0] or 0
    own = layers(nodes, "leaf", highest, bits)
    subroots = own[-1].select("tree", "node")
    begin = F.rpad(F.hex(F.substring(F.encode("tree", "UTF-8"), 1, 5)), 10, "0")  # grows with the name
    numbered = rank_within(subroots.withColumn("all", F.lit("all")), ["all"], F.conv(begin, 16, 10).cast("long"), ["tree"], "nth")
    groups = subroots.count()
    tops = through_table(numbered.select(F.lit("").alias("tree"), (F.col("nth") - 1).alias("at"), F.lit(groups).cast("long").alias("total"), "node", F.col("tree").alias("name")), "subroots")
    upper = layers(tops.drop("name"), "node", groups, bits)
    head = upper[-1].first()
    root = head.node.hex() if head else ""
    start = spark.createDataFrame([("", 0, [])], PATHS)
    paths = through_table(lowered(tops.drop("name"), _paths(upper, start, bits), bits), "paths")
    paths = tops.select("at", F.col("name").alias("tree")).join(paths.select("at", "path"), "at").select("tree", F.lit(0).cast("long").alias("at"), "path")
    done = proved(nodes, _paths(own, paths, bits), bits)
    named = tops.select(F.col("name").alias("tree"), F.lower(F.hex("node")).alias("subroot"))
    return done.join(named, "tree").select(
        "key", "tree", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )
