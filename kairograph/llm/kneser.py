"""Interpolated modified Kneser-Ney models over UTF-8 bytes.

An n-gram is ``order`` bytes packed into a long, the last byte lowest, so a
suffix is a mask and a context is a shift: continuation counts, contexts and
back-off are plain aggregates and joins on longs, sharded by n-gram. Texts are
preceded by ``order - 1`` zero bytes. Orders above ``shared`` are counted by
class, with discounts of their own; orders up to it are the continuation counts
of all classes together, and are the shared back-off.

Scoring needs the values of the distinct n-grams of the scored texts. They are
found by joining those n-grams, at every order, with the sharded counts. How the
values come back to the texts depends on their measured number: up to
``BROADCAST_GRAMS`` they are broadcast; beyond, texts are dealt into blocks, and
each block is grouped with the values of its own n-grams. Both ways give the
same scores. A block holds whole rows, dealt by a hash of all their columns: give
rows an id, so that copies of one text are spread.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored
from .textbytes import pieces, release

#: Values that are broadcast at most; an entry takes 8 bytes and 4 per value.
BROADCAST_GRAMS = 2_000_000
BLOCK_BYTES = 48 << 20
#: Distinct n-grams that a task holds before it passes them on.
HELD = 1_500_000
#: Discounts of an order whose counts of counts have gaps.
PLAIN = (0.5, 1.0, 1.5)


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte of the texts."""
    rows = len(offsets) - 1
    padded = np.zeros(len(data) + (order - 1) * rows, np.uint8)
    shift = np.repeat(np.arange(1, rows + 1) * (order - 1), np.diff(offsets))
    place = np.arange(len(data)) + shift
    padded[place] = data
    wide = padded.astype(np.int64)
    packed = wide.copy()
    for j in range(1, order):
        packed[j:] |= wide[:-j] << (8 * j)
    return packed[place]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.diff(np.append(edge, len(keys)))


class _Held:
    """Distinct keys with their counts, merged as slices come in."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray) -> None:
        self.new.append(_counted(keys))
        self.waiting += len(self.new[-1][0])
        if self.waiting > max(HELD // 2, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        counts = np.concatenate([self.counts, *(c for _, c in self.new)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[edge], np.add.reduceat(counts, edge) if len(edge) else np.zeros(0, np.int64)
        self.new, self.waiting = [], 0

    def full(self) -> bool:
        return len(self.keys) > HELD


def count_grams(rows: DataFrame, order: int, classes: int) -> DataFrame:
    """``(g, c0, c1, ...)`` of ``rows(text, cls)``: counts per class of every n-gram, combined on the map side first."""
    names = [f"c{k}" for k in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_Held() for _ in range(classes)]

        def out(k: int) -> Iterator[pa.RecordBatch]:
            held[k].merge()
            n = len(held[k].keys)
            for a in range(0, n, 100_000):
                part = slice(a, a + 100_000)
                zero = pa.array(np.zeros(len(held[k].keys[part]), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(held[k].keys[part]), *(pa.array(held[k].counts[part]) if j == k else zero for j in range(classes))], names=["g", *names])
            held[k] = _Held()

        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            for k in range(classes):
                own = batch.column(0).filter(pa.array(kind == k))
                for _, data, offsets in pieces(own):
                    held[k].add(grams(data, offsets, order))
                if held[k].full():
                    yield from out(k)
        for k in range(classes):
            yield from out(k)
        release()

    made = rows.select("text", "cls").mapInArrow(run, ", ".join(["g long", *(f"{n} long" for n in names)]))
    return made.groupBy("g").agg(*[F.sum(n).alias(n) for n in names])


def distinct_grams(texts: DataFrame, order: int, block: bool = False) -> DataFrame:
    """``(g)`` of ``texts(text)``, or ``(block, g)`` of ``texts(text, block)``: n-grams, each once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Held] = {}

        def out(k: int) -> Iterator[pa.RecordBatch]:
            keys = held.pop(k)
            keys.merge()
            for a in range(0, len(keys.keys), 100_000):
                g = keys.keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(g), *([pa.array(np.full(len(g), k, np.int64))] if block else [])], names=["g", *(["block"] if block else [])])

        for batch in batches:
            kinds = batch.column(1).to_numpy(zero_copy_only=False) if block else np.zeros(len(batch), np.int64)
            for k in np.unique(kinds).tolist():
                own = batch.column(0).filter(pa.array(kinds == k)) if block else batch.column(0)
                for _, data, offsets in pieces(own):
                    held.setdefault(k, _Held()).add(grams(data, offsets, order))
                if held.get(k) and held[k].full():
                    yield from out(k)
        for k in list(held):
            yield from out(k)
        release()

    columns = ["text", "block"] if block else ["text"]
    return texts.select(*columns).mapInArrow(run, "g long, block long" if block else "g long").distinct()


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of types seen once, twice, three and four times."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return PLAIN
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d < i + 1 else p for i, (d, p) in enumerate(zip(found, PLAIN, strict=True)))


#: Levels of class ``c`` and order ``k`` are numbered ``OWN * (c + 1) + k``; shared levels just ``k``.
OWN = 100


@dataclass
class Model:
    """``grams(k, g, kept)`` and ``contexts(k, h, gamma, total)`` by level: orders up to ``shared`` for all classes, the rest by class."""

    order: int
    classes: int
    shared: int
    grams: DataFrame
    contexts: DataFrame


def _mask(k: int) -> int:
    return (1 << 8 * k) - 1


def fit(rows: DataFrame, order: int, classes: int = 1, shared: int | None = None) -> Model:
    """A model of ``rows(text, cls)``; by default all orders below the highest are shared. No rows give a uniform model."""
    shared = order - 1 if shared is None else shared
    top = stored(count_grams(rows, order, classes), "kn-counts")
    # A level below the highest order counts the types of one more byte by their last k bytes.
    wanted = [(k, F.lit(True)) for k in range(1, shared + 1)] + [(OWN * (c + 1) + k, F.col(f"c{c}") > 0) for c in range(classes) for k in range(shared + 1, order)]
    suffixes = F.array(*[F.when(some, F.struct(F.lit(k).alias("k"), F.col("g").bitwiseAND(F.lit(_mask(k % OWN + 1))).alias("t"))) for k, some in wanted])
    types = top.select(F.explode(suffixes).alias("s")).where("s IS NOT NULL").select("s.k", "s.t").distinct()
    masks = F.element_at(F.array(*[F.lit(_mask(k)) for k in range(1, order)]), F.col("k") % OWN)
    lower = types.groupBy("k", F.col("t").bitwiseAND(masks).alias("g")).agg(F.count(F.lit(1)).alias("c"))
    own = top.select("g", F.explode(F.array(*[F.struct(F.lit(OWN * (c + 1) + order).alias("k"), F.col(f"c{c}").alias("c")) for c in range(classes)])).alias("s")).select("s.k", "g", "s.c").where("c > 0")
    levels = stored(lower.select("k", "g", "c").union(own), "kn-levels")
    found: dict[int, dict[int, int]] = {k: {} for k, _ in wanted} | {OWN * (c + 1) + order: {} for c in range(classes)}
    for k, c, n in levels.groupBy("k", F.least("c", F.lit(5)).alias("c")).count().collect():  # five rows a level
        found[k][c] = n
    by_level = {k: discounts(n) for k, n in found.items()}
    table = F.map_from_arrays(F.array(*[F.lit(k) for k in by_level]), F.array(*[F.array(*map(F.lit, d)) for d in by_level.values()]))
    d = F.element_at(F.element_at(table, F.col("k")), F.least(F.col("c"), F.lit(3)).cast("int"))
    cut = levels.select("k", "g", F.shiftright("g", 8).alias("h"), F.col("c").cast("double").alias("c"), d.alias("d"))
    sums = cut.groupBy("k", "h").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
    contexts = stored(sums.select("k", "h", "total", (F.col("left") / F.col("total")).alias("gamma")), "kn-contexts")
    return Model(order, classes, shared, cut.select("k", "g", (F.col("c") - F.col("d")).alias("kept")), contexts)


def values(model: Model, wanted: DataFrame) -> DataFrame:
    """``(g, v0, ...)``: the natural logarithm of every wanted n-gram's probability, by class."""
    n, shared = model.order, model.shared
    levels = [*range(1, shared + 1), *(OWN * (c + 1) + k for c in range(model.classes) for k in range(shared + 1, n + 1))]
    wanted = stored(wanted.select(F.col("g").alias("q")), "kn-wanted")
    size = F.col("k") % OWN

    def found(some: list[int], grams: DataFrame, contexts: DataFrame) -> DataFrame:
        parts = [F.struct(F.lit(k).alias("k"), F.col("q").bitwiseAND(F.lit(_mask(k % OWN))).alias("g")) for k in some]
        asked = wanted.select("q", F.explode(F.array(*parts)).alias("s")).select("q", "s.k", "s.g", F.shiftright("s.g", 8).alias("h"))
        return asked.join(grams, ["k", "g"], "left").join(contexts, ["k", "h"], "left").select("q", "k", "kept", "total", "gamma")

    # An n-gram of one or two bytes, and a context of up to two, are keys that very many of the wanted n-grams share:
    # these have 256 ** 2 rows a level at most and are broadcast; the others are dealt by key.
    few_grams, many_grams = F.broadcast(model.grams.where(size <= 2)), model.grams.where(size > 2)
    few_contexts, many_contexts = F.broadcast(model.contexts.where(size <= 3)), model.contexts.where(size > 3)
    by_size = [([k for k in levels if k % OWN <= 2], few_grams, few_contexts), ([k for k in levels if k % OWN == 3], many_grams, few_contexts), ([k for k in levels if k % OWN > 3], many_grams, many_contexts)]
    met = reduce(DataFrame.union, [found(*x) for x in by_size if x[0]])
    one = F.struct("k", F.coalesce(F.col("kept") / F.col("total"), F.lit(0.0)).alias("a"), F.coalesce("gamma", F.lit(1.0)).alias("gamma"))
    folded = met.groupBy("q").agg(F.sort_array(F.collect_list(one)).alias("steps"))  # one entry per level

    def along(start, first: int, count: int):
        return F.aggregate(F.slice("steps", first, count), start, lambda p, s: s["a"] + s["gamma"] * p)

    low = folded.select("q", "steps", (along(F.lit(1 / 256), 1, shared) if shared else F.lit(1 / 256)).alias("p"))
    return low.select(F.col("q").alias("g"), *[F.log(along(F.col("p"), shared + c * (n - shared) + 1, n - shared)).cast("float").alias(f"v{c}") for c in range(model.classes)])


class Lookup:
    """An open hash table of n-grams that are all present, as arrays."""

    def __init__(self, keys: np.ndarray, found: np.ndarray):
        self.bits = max(4, math.ceil(math.log2(max(1, len(keys)) * 1.5)))
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        place = np.maximum.accumulate(slot[order] - np.arange(len(keys))) + np.arange(len(keys)) if len(keys) else slot
        size = max(1 << self.bits, int(place[-1]) + 1 if len(keys) else 0) + 1
        self.keys = np.full(size, -1, np.int64)
        self.found = np.zeros(size, np.float32)
        self.keys[place], self.found[place] = keys[order], found[order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        slot = self._slot(wanted)
        rest = np.flatnonzero(self.keys[slot] != wanted)
        while len(rest):
            slot[rest] += 1
            if slot[rest].max(initial=0) >= len(self.keys):
                raise KeyError("an n-gram without a value")
            rest = rest[self.keys[slot[rest]] != wanted[rest]]
        return self.found[slot]


#: What a task computes from the values at each byte and the texts' offsets: one number per text for each column.
Summary = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]


def _scored(texts: pa.Array, order: int, lookup: Lookup, summary: Summary) -> list[np.ndarray]:
    parts = [summary(lookup(grams(data, offsets, order)), offsets) for _, data, offsets in pieces(texts)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


class Scorer:
    """Values of the n-grams of ``texts`` under a model, ready to score any rows whose texts are among them.

    ``value`` makes ``(g, v)`` of the table of ``values``.
    """

    def __init__(self, texts: DataFrame, model: Model, value: Callable[[DataFrame], DataFrame], *, text_col: str = "text", limit: int = BROADCAST_GRAMS):
        self.order, self.text_col = model.order, text_col
        self.table = stored(value(values(model, distinct_grams(texts.select(F.col(text_col).alias("text")), self.order))), "kn-values")
        self.shared = None
        if self.table.count() <= limit:
            found = self.table.toArrow()
            self.shared = texts.sparkSession.sparkContext.broadcast((found["g"].to_numpy(), found["v"].to_numpy()))

    def score(self, docs: DataFrame, summary: Summary, columns: list[str], text: bool = True) -> DataFrame:
        """``docs``, without the text if that is not wanted, with the summary's columns (doubles); one row per row."""
        at, order, shared = docs.columns.index(self.text_col), self.order, self.shared
        kept = [i for i in range(len(docs.columns)) if text or i != at]
        schema = ", ".join([*(f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}" for i in kept), *(f"`{c}` double" for c in columns)])
        names = [*(docs.columns[i] for i in kept), *columns]

        def rows(batch, lookup: Lookup) -> list[pa.Array]:
            texts = batch.column(at)
            texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
            made = _scored(texts, order, lookup, summary) if len(batch) else [np.zeros(0)] * len(columns)
            return [pa.array(m, pa.float64()) for m in made]

        if shared is not None:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                lookup = None
                for batch in batches:
                    lookup = lookup or Lookup(*shared.value)
                    yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *rows(batch, lookup)], names=names)
                release()

            return docs.mapInArrow(run, schema)
        total = docs.agg(F.sum(F.octet_length(self.text_col))).first()[0] or 0
        blocks = max(1, math.ceil(total / BLOCK_BYTES))
        key = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
        dealt = docs.withColumn("__block", F.pmod(key, F.lit(blocks)))
        asked = distinct_grams(dealt.select(F.col(self.text_col).alias("text"), F.col("__block").alias("block")).repartition(blocks, "block"), order, block=True)
        answers = asked.join(self.table, "g").withColumnRenamed("block", "__block")

        def block(part: pa.Table, own: pa.Table) -> pa.Table:
            own = own.combine_chunks()
            part = part.drop_columns(["__block"])
            return pa.Table.from_arrays([*(part.column(i) for i in kept), *rows(part, Lookup(own["g"].to_numpy(), own["v"].to_numpy()))], names=names)

        return dealt.groupBy("__block").cogroup(answers.groupBy("__block")).applyInArrow(block, schema)
