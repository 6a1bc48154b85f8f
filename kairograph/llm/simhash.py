"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 9).

Fingerprints are taken from 3-word shingles with repeats. Distinct fingerprints
are cut into segments of 23, 23 and 18 bits. If two fingerprints differ in at
most two bits, some segment is equal and the segment after it (in a circle)
differs in at most one bit: with errors (a, b, c) and a + b + c <= 2 no
assignment escapes the three cases. So a fingerprint has three kinds of keys:
the exact bits of one segment joined with Golay indices of the next. As index
entry it carries the indices of all variants of the next segment with one bit
changed (one or six different ones), as probe only its own. Equal keys are
joined and the bits compared.

A key held by more than ``CROWD`` fingerprints is not joined with itself.
Fingerprints of such keys are linked through their variants with at most one
bit changed: two fingerprints share such a variant exactly if they differ in at
most two bits, and a variant has 65 fingerprints at most. This keeps the work
linear in a crowded key and loses no link.

Defined cases: a null text is an empty text; a text without words has
fingerprint zero and links like any other; a text of fewer than three words has
one shingle of all its words; texts of any length are read whole; repeated rows
share a fingerprint; a row without an id has its component's smallest id as others
do (null if none has an id); an empty table gives an empty one; columns other than
the id and the text are not read, whatever their names.

Groups of rows are reduced to one row per fingerprint on the map side before any
join. Only the last join, which hands the component back to every row, meets a
fingerprint's copies again: its other side has one row per fingerprint, so it is
broadcast while small, and beyond that the adaptive skew join splits the copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .golay import nearby
from .session import small, stored, table

SEED = 42
SHINGLE = 3
DISTANCE = 2
CROWD = 64
_CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint, unsigned, of one text."""
    words = text.lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends = ends[len(words) - n :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, _CHUNK):
        h = np.array([digest(body[s:e], SEED) for s, e in zip(starts[a : a + _CHUNK], ends[a : a + _CHUNK], strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", text_key: bool = False) -> DataFrame:
    """``(id, fp long)``, with ``t1`` and ``t2``, hashes of the text, if they are wanted; ``fp`` has the fingerprint's bits."""
    extra = [F.xxhash64(F.col(text_col)).alias("t1"), F.xxhash64(F.lit("text"), F.col(text_col)).alias("t2")] if text_key else []
    source = docs.select(F.col(id_col), *extra, F.col(text_col).cast("binary").alias("__text"))
    names = source.columns[:-1]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py() or b"") for t in batch.column(len(names))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made.view(np.int64))], names=[*names, "fp"])

    return source.mapInArrow(run, f"{kinds}, fp long")


def keys(prints: DataFrame) -> DataFrame:
    """``(fp, key, probe)`` of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(every), 20_000):
                signed = every[at : at + 20_000]
                fp = signed.view(np.uint64)
                segments = [(fp >> np.uint64(41)).astype(np.int64), (fp >> np.uint64(18) & np.uint64(0x7FFFFF)).astype(np.int64), (fp & np.uint64(0x3FFFF)).astype(np.int64)]
                rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for k in range(3):
                    prefix = np.int64(k) << 60 | segments[k] << 12
                    index = nearby(segments[(k + 1) % 3])
                    rows.append((signed, prefix | index[:, 0], np.ones(len(fp), bool)))
                    index.sort(axis=1)
                    new = np.ones(index.shape, bool)
                    new[:, 1:] = index[:, 1:] != index[:, :-1]
                    row, column = np.nonzero(new)
                    rows.append((signed[row], prefix[row] | index[row, column], np.zeros(len(row), bool)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=["fp", "key", "probe"])

    return prints.select("fp").mapInArrow(run, "fp long, key long, probe boolean")


def links(prints: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that keep every component whole."""
    rows = stored(keys(prints), "golay-keys")
    crowded = stored(rows.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded-keys")
    some = not crowded.isEmpty()
    rest = rows.join(crowded, "key", "left_anti") if some else rows
    a = rest.where("probe").select("key", F.col("fp").alias("a"))
    b = rest.where("NOT probe").select("key", F.col("fp").alias("b"))
    joined = a.join(b, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    if not some:
        return joined
    packed = rows.join(crowded, "key", "left_semi").select("fp").distinct()
    flips = [0, *((1 << k) - (1 << 64 if k == 63 else 0) for k in range(64))]
    variants = packed.select("fp", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    near = variants.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return joined.union(near.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b"))


def _by_component(prints: DataFrame, key: Column, name: str) -> DataFrame:
    """``(fp, name)``: for every fingerprint the least ``key`` of all rows in its component."""
    groups = prints.groupBy("fp").agg(F.min(key).alias("first"))
    roots = stored(components(links(groups)), "roots")
    linked = groups.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias(name))
    alone = groups.join(roots.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("first").alias(name))
    return linked.join(least, "root").select("fp", name).union(alone)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id)``, one row per row of ``docs``."""
    prints = stored(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    return prints.join(_by_component(prints, F.col(id_col), "component_id"), "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all its columns as they are.

    It is the row with the smallest id; rows without an id come last; of equal ids
    the smaller pair of text hashes goes first; of rows equal in id and text the one
    least in its other columns (maps aside) stays. Rows are told apart by id and
    text, so a row is never taken for another with its id, or for another without.
    """
    key = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")
    prints = stored(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), id_col="id", text_col="text", text_key=True), "fingerprints")
    rows = prints.groupBy("fp", key.alias("key")).agg(F.count(F.lit(1)).alias("copies"))
    placed = stored(rows.join(_by_component(prints, key, "kept"), "fp").select("key", "copies", (F.col("key") == F.col("kept")).alias("stays")), "placed")
    own = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(text_col)).alias("t1"), F.xxhash64(F.lit("text"), F.col(text_col)).alias("t2"))

    def keys(condition: str) -> DataFrame:
        return small(placed.where(condition).select(F.col("key").alias("__key")))

    left = docs.join(keys("NOT stays"), own.eqNullSafe(F.col("__key")), "left_anti")
    if placed.where("stays AND copies > 1").isEmpty():
        return left
    again = keys("stays AND copies > 1")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    ordered = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    first = left.join(again, own.eqNullSafe(F.col("__key")), "left_semi").groupBy(own.alias("__key")).agg(F.min_by(F.struct(*columns), F.struct(*ordered)).alias("__row"))
    return left.join(again, own.eqNullSafe(F.col("__key")), "left_anti").union(first.select(*[F.col("__row")[c].alias(c) for c in docs.columns]))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
