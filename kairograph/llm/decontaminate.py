"""Benchmark decontamination by size-partitioned MinHash containment (operator 7).

An item is contained if at least 0.8 of its n distinct 5-word shingles are in the
document. Items are partitioned by size: partition p has those of 2**p to
2**(p + 1) - 1 shingles. An item is signed by its smallest shingle hashes. At most
n - ceil(0.8 n) shingles of a contained item are missing, so a signature of one
more than that always has one that the document holds. Documents are signed once
for each partition, by all their shingles whose hash is at most the partition's
threshold, the largest hash in the signatures of its items. Such a sketch grows
with the document, which one of fixed length must not if a short item shall be
found inside a long text, and it needs no windows: an item's shingles count
wherever they stand.

Search: a document is a candidate for a partition if its sketch meets a signature
there; signatures are probed in a bitmap of ``2 ** BITS`` bits, whatever the items'
number. Verification: the candidate's shingles that may be in the partition's items
(a second bitmap) go on as text, and are joined with the items' shingles and counted
exactly. Hashes and bitmaps only ever let too much through.

A shingle that very many documents hold is a hot key of that join. Up to
``small``'s limit the items' shingles are broadcast and no document row is
shuffled by shingle; beyond it the adaptive skew join splits the key, and counts
are combined per document and item before they are shuffled.

Defined cases: words are runs of characters other than ASCII white space, in
lower case; items of fewer than five words have no shingle and match nothing;
null texts are empty; texts of any length are searched whole; rows equal in id
and text count as one; repeated items with one id are one item (the union of
their shingles); empty tables give no match; other columns pass through
``decontaminate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import small, stored, table
from .textbytes import pieces, release, shingle_hashes, span_hashes, word_spans

WORDS = 5
#: Containment as a fraction of whole numbers.
PARTS, OF = 4, 5
BITS = 25
#: Shingles of items that are broadcast at most (about 100 bytes each).
BROADCAST_SHINGLES = 200_000


class _Texts:
    """Texts of some rows in lower case, with their shingles' hashes (63 bits) and each row's first."""

    def __init__(self, texts: list[str | None]):
        column = pa.array([(t or "").lower() for t in texts], pa.large_string())
        _, _, body = column.buffers()
        self.data = np.frombuffer(body, np.uint8)[: len(body)] if body is not None else np.zeros(0, np.uint8)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
        self.data = self.data[: offsets[-1]]
        self.starts, self.ends, self.words = word_spans(self.data, offsets)
        hashes, self.first = shingle_hashes(span_hashes(self.data, self.starts, self.ends), self.words, WORDS)
        self.h = (hashes >> np.uint64(1)).view(np.int64)

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def shingles(self, at: np.ndarray, row: np.ndarray) -> list[str]:
        """The text of some shingles: their words with one space between."""
        word = (self.words[row] + at - self.first[row]).tolist()
        raw = [[self.data[self.starts[w + k] : self.ends[w + k]].tobytes() for k in range(WORDS)] for w in word]
        return [b" ".join(x).decode() for x in raw]


def item_shingles(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, p, n, s, h, signature)``: distinct shingles with their hash, the item's size and partition, and whether they sign it."""
    source = items.select(F.col(id_col).alias("item"), F.col(text_col))
    kind = source.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, offsets in pieces(batch.column(1)):
                part = _Texts(batch.column(1).slice(a, len(offsets) - 1).to_pylist())
                at = np.arange(len(part.h))
                row = part.row(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(part.shingles(at, row), pa.string()), pa.array(part.h)], names=["item", "s", "h"])

    distinct = source.mapInArrow(run, f"item {kind}, s string, h long").where("item IS NOT NULL").distinct()
    sizes = distinct.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("h", "s"))).alias("all"))  # one benchmark item's shingles
    length = F.col("n") - F.expr(f"(n * {PARTS} + {OF - 1}) div {OF}") + 1
    each = sizes.select("item", "n", F.floor(F.log2("n")).cast("int").alias("p"), length.alias("length"), F.posexplode("all").alias("at", "x"))
    return each.select("item", "p", "n", "x.s", "x.h", (F.col("at") < F.col("length")).alias("signature"))


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """The bitmap of ``shingles(p, h)``, merged by words of 64 bits; at most ``2 ** BITS / 64`` rows reach the driver."""
    place = F.col("h").bitwiseXOR((F.col("p").cast("long") * F.lit(0x9E3779B97F4A7)).bitwiseAND(F.lit(0x7FFFFFFFFFFF))).bitwiseAND(F.lit((1 << BITS) - 1))
    words = shingles.select(place.alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    bitmap = np.zeros(1 << max(0, BITS - 6), np.uint64)
    rows = words.toPandas()
    bitmap[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def _in(bitmap: np.ndarray, h: np.ndarray, p: int) -> np.ndarray:
    place = (h ^ (p * 0x9E3779B97F4A7 & 0x7FFFFFFFFFFF)) & (64 * len(bitmap) - 1)
    return (bitmap[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def text_key(text_col: str) -> list:
    """128 bits that stand for a text in the key of its row."""
    return [F.xxhash64(F.col(text_col)).alias("t1"), F.xxhash64(F.lit("text"), F.col(text_col)).alias("t2")]


def contained_items(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast: int = BROADCAST_SHINGLES) -> DataFrame:
    """``(id, t1, t2, item_id, shared, item_shingles)`` for every item contained in a document; ``t1`` and ``t2`` are its text's hashes."""
    wanted = stored(item_shingles(items, id_col=item_col, text_col=item_text), "item-shingles")
    signed = wanted.where("signature")
    thresholds = sorted((r.p, r.h) for r in signed.groupBy("p").agg(F.max("h").alias("h")).collect())  # one row a power of two
    maps = docs.sparkSession.sparkContext.broadcast((_bitmap(signed), _bitmap(wanted)))
    source = docs.select(F.col(id_col).alias("id"), *text_key(text_col), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signature, every = maps.value
        for batch in batches:
            for a, _, offsets in pieces(batch.column(3)):
                part = _Texts(batch.column(3).slice(a, len(offsets) - 1).to_pylist())
                for p, threshold in thresholds:
                    sketch = np.flatnonzero(part.h <= threshold)
                    met = sketch[_in(signature, part.h[sketch], p)]
                    if not len(met):
                        continue
                    candidate = np.zeros(len(part.first), bool)
                    candidate[part.row(met)] = True
                    at = np.flatnonzero(np.repeat(candidate[:-1], np.diff(part.first)))
                    at = at[_in(every, part.h[at], p)]
                    row = part.row(at)
                    found: dict[tuple[int, str], int] = {}
                    for k, x in enumerate(zip(row.tolist(), part.shingles(at, row), strict=True)):
                        found.setdefault(x, k)
                    keep, texts = list(found.values()), [x for _, x in found]
                    owner = pa.array(row[keep] + a)
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(owner) for k in range(3)), pa.array(np.full(len(keep), p, np.int32)), pa.array(texts, pa.string())], names=["id", "t1", "t2", "p", "s"])
        release()

    hits = source.mapInArrow(run, f"id {kind}, t1 long, t2 long, p int, s string").distinct()
    pairs = hits.join(small(wanted.select("item", "n", "p", "s"), broadcast), ["p", "s"])
    counted = pairs.groupBy("id", "t1", "t2", "item", "n").agg(F.count(F.lit(1)).alias("shared"))
    return counted.where(f"shared * {OF} >= n * {PARTS}").select("id", "t1", "t2", F.col("item").alias("item_id"), "shared", F.col("n").alias("item_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """``docs`` without the rows that contain an item; columns pass through, whatever their names."""
    found = contained_items(docs, items, id_col=id_col, text_col=text_col, **names).select(F.struct("id", "t1", "t2").alias("__hit")).distinct()
    key = F.struct(F.col(id_col).alias("id"), *text_key(text_col))
    return docs.join(small(found), key.eqNullSafe(F.col("__hit")), "left_anti")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "shared", "item_shingles")


OP7_SQL = """
WITH item_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM benchmark
), item_grams AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM item_words
), sized AS (
  SELECT item_id, s, count(*) OVER (PARTITION BY item_id) AS n FROM item_grams
), doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), doc_grams AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM doc_words
)
SELECT doc_id, item_id, count(*) AS shared, any_value(n) AS item_shingles
FROM doc_grams JOIN sized USING (s) GROUP BY doc_id, item_id HAVING count(*) * 5 >= any_value(n) * 4
"""
