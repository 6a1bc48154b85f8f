"""The basket scenario's chain over cells that come by stretches of rows: a worker has whole stretches and looks the rest up.

A stretch is a run of consecutive rows of one time, each sharing a warm candidate with
the row before, whatever their sources. Islands of the chain model, triples, pairs and
runs all lie within a stretch, so rows are dealt by parts that end where a stretch does:
about ``tables.ROWS`` rows, or a whole stretch beyond that, at some 300 bytes a cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import written
from ..sources.stored import Stored, entries, found_at, groups_in_order, weights_at
from ..sources.tables import ROWS
from .byblock import _block, _warm
from .slatecells import TINY, Rows

#: Rows at the beginning of a block among which a stretch's end is sought at first; else in the whole block.
EDGE = 32
Place = Callable[[DataFrame], DataFrame]


def _told(cells: DataFrame) -> list:
    """A cell without its nulls: ``(row_id, pos, flags, src, time, cand)``."""
    flags = F.col("src").isNotNull().cast("int") + 2 * F.col("time").isNotNull().cast("int") + 4 * F.col("cand").isNotNull().cast("int")
    zero = F.lit(0).cast("long")
    return [F.col("row_id"), F.col("pos"), flags.alias("flags"), F.coalesce("src", zero).alias("src"), F.coalesce("time", F.lit(0.0)).alias("time"), F.coalesce("cand", zero).alias("cand")]


def _code(time):
    """A whole number for each time, equal where times are: whole times from 0 on stay, so that days are small."""
    import numpy as np

    time = np.where(np.isnan(time), np.nan, time + 0.0)
    small = (time >= 0) & (time < 2**31) & (time == np.floor(time))
    # No number that is not a NaN has bits that become a small one here.
    return np.where(small, np.where(small, time, 0).astype(np.int64), time.view(np.int64) ^ 0x7FF4000000000000)


def _sorted(value):
    """The stable order of the values; where a value and a place fit into one number, these are sorted, which is faster."""
    import numpy as np

    bits = len(value).bit_length()
    low, high = (int(value.min()), int(value.max())) if len(value) else (0, 0)
    if (high - low + 1) << bits >= 2**63:
        return np.argsort(value, kind="stable")
    return np.sort((value - low) << bits | np.arange(len(value))) & ((1 << bits) - 1)


class _Slates:
    """Slates of consecutive rows: what rows share with the next, the labels that follow, and the runs of warm candidates."""

    def __init__(self, warm, row_id, flags, src, time, cand):
        import numpy as np

        rows = self.rows = Rows(row_id)
        n, first = len(rows.start), rows.start
        self.told, self.timed = (flags[first] & 1) > 0, (flags[first] & 2) > 0
        self.src, self.time, number = src[first], time[first], row_id[first]
        self.at = _code(self.time)
        self.known, self.cand = (flags & 4) > 0, cand
        # Whether a row comes right after the one before, at its time; and from another source.
        after = np.append(False, (number[1:] == number[:-1] + 1) & self.timed[1:] & self.timed[:-1] & (self.at[1:] == self.at[:-1]))[:n]
        apart = np.append(False, self.told[1:] & self.told[:-1] & (self.src[1:] != self.src[:-1]))[:n]
        order = _sorted(cand) if self.known.all() else np.lexsort((cand, self.known))
        c, r, k = cand[order], rows.of[order], self.known[order]
        new = np.append(True, (c[1:] != c[:-1]) | (r[1:] != r[:-1]) | (k[1:] != k[:-1]))[: len(c)]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(c)))
        self.double = np.zeros(len(cand), bool)
        self.double[order] = np.repeat(size > 1, size)
        keep = k[start] & warm(c[start])
        #: Candidate, row, and last cell of each warm (row, candidate).
        self.c, self.r, self.last = c[start[keep]], r[start[keep]], order[(start + size - 1)[keep]]
        m = len(self.c)
        #: The warm cells, with their (row, candidate).
        self.cell, self.entry = order[np.repeat(keep, size)], np.repeat(np.arange(m), size[keep])
        #: Whether it goes on from the row before, and the run that it is in; runs are consecutive.
        self.follows = np.append(False, (self.c[1:] == self.c[:-1]) & (self.r[1:] == self.r[:-1] + 1) & after[self.r[1:]])[:m]
        self.first = np.flatnonzero(~self.follows)
        self.size = np.diff(np.append(self.first, m))
        self.run = np.cumsum(~self.follows) - 1
        self.goes_on = np.zeros(n, bool)
        self.goes_on[self.r[self.follows]] = True
        #: What is shared by coupled rows, and how many candidates a row shares with the one before.
        self.shared = np.flatnonzero(self.follows & apart[self.r])
        self.n_shared = np.bincount(self.r[self.shared], minlength=n)

    def _agreed(self, rows, cand):
        """Which rows have votes for one candidate only, and it."""
        import numpy as np

        n = len(self.rows.start)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, rows, cand)
        np.maximum.at(high, rows, cand)
        return low == high, high

    def triples(self):
        """``(labelled, label)`` by row, as ``rules.triple_rule``."""
        import numpy as np

        e = np.flatnonzero(self.follows[1:-1] & self.follows[2:]) if len(self.follows) > 2 else np.zeros(0, np.int64)
        r, s, t = self.r[e], self.src, self.told
        e = e[t[r] & t[r + 1] & t[r + 2] & (s[r] != s[r + 1]) & (s[r + 1] != s[r + 2]) & (s[r] != s[r + 2])]
        e = e[np.bincount(self.r[e], minlength=1)[self.r[e]] == 1]
        r = self.r[e]
        return self._agreed(np.concatenate([r, r + 1, r + 2]), np.tile(self.c[e], 3))

    def answers(self, labelled, label):
        """``(labelled, label)`` by row, of the triples and, between rows that have none, of the pairs, as ``rules.answer_labels``."""
        import numpy as np

        e = self.shared[self.n_shared[self.r[self.shared]] == 1]
        e = e[~labelled[self.r[e]] & ~labelled[self.r[e] - 1]]
        paired, other = self._agreed(np.concatenate([self.r[e], self.r[e] - 1]), np.tile(self.c[e], 2))
        return labelled | paired, np.where(labelled, label, other)

    def beliefs(self, prior, strength: float):
        """Beliefs as ``crf.infer_island`` with its defaults has them: all islands at once, row after row."""
        import numpy as np

        n, of, e = len(self.rows.start), self.rows.of, self.shared
        coupled, index = self.n_shared > 0, np.arange(n)
        depth = index - np.maximum.accumulate(np.where(coupled, 0, index)) if n else index
        goes_on = np.append(coupled[1:], False)[:n]
        height = np.minimum.accumulate(np.where(goes_on, n, index)[::-1])[::-1] - index if n else index
        # Before: every cell of the candidate hears of its last place in the row before. Behind: only its last place hears.
        mine = np.zeros(len(self.c), bool)
        mine[e] = True
        mine = mine[self.entry]
        own, there = self.cell[mine], self.last[self.entry[mine] - 1]
        out = prior.copy()
        total = self.rows.total(prior)
        total = np.where(total > 0, total, 1.0)
        for own, there, level in ((own, there, depth[of[own]]), (self.last[e - 1], self.last[e], height[of[self.last[e - 1]]])):
            order = np.argsort(level, kind="stable")
            own, there, level = own[order], there[order], level[order]
            edges = np.append(np.flatnonzero(np.append(True, level[1:] != level[:-1])), len(level)) if len(level) else []
            now, sums = prior.copy(), total.copy()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                x, y = own[a:b], there[a:b]
                message = 1.0 + strength * now[y] / sums[of[y]]
                out[x] *= message
                now[x] = prior[x] * message
                np.add.at(sums, of[x], now[x] - prior[x])
        return out


def _slices(batches, columns: int, cuts):
    """Arrays of whole parts from batches whose first columns are ``row_id`` and ``pos``."""
    import numpy as np
    import pyarrow as pa

    def parted():
        for batch in batches:
            part = np.searchsorted(cuts.value, batch.column(0).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], names=["part", *batch.schema.names])

    for found in groups_in_order(parted(), columns + 1, order=3):
        yield found[1:]


def _cuts(cells: DataFrame, known: Stored):
    """Sorted row ids at which parts begin: in each block the first row that does not go on, if there is one.

    One number for each block goes to the driver. Cells come by blocks and in order.
    """
    import numpy as np

    told = cells.select(_block(F.col("row_id")).alias("block"), *_told(cells))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        warm = _warm(known)
        for block, row_id, _, flags, src, time, cand in groups_in_order(batches, 7, order=3):
            s = _Slates(warm, row_id, flags, src, time, cand)
            number = row_id[s.rows.start]
            blocks, first = np.unique(block[s.rows.start], return_index=True)
            ends = ~s.goes_on
            ends[first] &= number[first] != blocks * ROWS  # what comes before the block is not seen here
            at = np.minimum.reduceat(np.where(ends, number, np.iinfo(np.int64).max), first)
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(at)], names=["block", "at"])

    found = told.where(F.pmod(F.col("row_id"), F.lit(ROWS)) < EDGE).mapInArrow(run, "block long, at long").toArrow()  # one row per block
    block, at = (found.column(n).to_numpy() for n in ("block", "at"))
    open_ = at == np.iinfo(np.int64).max
    if open_.any():
        some = F.broadcast(cells.sparkSession.createDataFrame([(int(b),) for b in block[open_]], "block long"))
        rest = told.join(some, "block", "left_semi").sortWithinPartitions("block", "row_id", "pos")  # a join lets the order before it go
        more = rest.mapInArrow(run, "block long, at long").toArrow().column("at").to_numpy()
        at = np.concatenate([at[~open_], more[more < np.iinfo(np.int64).max]])
    return np.sort(at)


def _place(cuts) -> Place:
    def place(rows: DataFrame) -> DataFrame:
        """``rows`` with the ``part`` of their ``row_id``."""
        k = rows.columns.index("row_id")

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                part = np.searchsorted(cuts.value, batch.column(k).to_numpy(), "right")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("part", LongType())]))

    return place


def _listed(table: DataFrame, key: str, *values: str) -> DataFrame:
    """``(id, values)``: each key's values in turn, in order of the first."""
    each = F.sort_array(F.collect_list(F.struct(*values)))
    return table.groupBy(F.col(key).alias("id")).agg(F.flatten(F.transform(each, lambda x: F.array(*[x[v] for v in values]))).alias("values"))


def ds2_chain(cells: DataFrame, log: DataFrame, deal: Callable[[Place], DataFrame] | None = None, tau: float = 0.20, strength: float = 70.0) -> DataFrame:
    """``(row_id, pos, score)``: chain model, min-max, triple promotion, demotions, cross-time decoding, as in ``crf`` and ``rules``.

    With ``deal`` the cells come dealt by blocks of ``tables.ROWS`` rows, in order of
    ``row_id`` and ``pos``, and ``deal(place)`` gives the same cells dealt by the ``part``
    that ``place`` adds to rows, in that order too: none are shuffled then. Sources'
    answers, the longest runs and the times that keep a candidate are stored and looked
    up. Scores are written once, a row's in a list, until it is known which rows swap.
    """
    spark = cells.sparkSession
    ids = written(log.where("dst IS NOT NULL").select("dst").distinct(), "ids")
    known = Stored(ids.select(F.col("dst").alias("id"), F.array("dst").alias("values")), ids.count())
    names = ["row_id", "src", "time", "pos", "cand", "score"]
    if deal is None:
        plain = cells.select(*names)
        cells = plain.withColumn("block", _block(F.col("row_id"))).repartition("block").sortWithinPartitions("block", "row_id", "pos").drop("block")
        deal = lambda place: place(plain).repartition("part").sortWithinPartitions("part", "row_id", "pos")
    cuts = spark.sparkContext.broadcast(_cuts(cells, known))
    dealt = deal(_place(cuts))

    def observed(batches):
        import numpy as np
        import pyarrow as pa

        warm = _warm(known)
        for row_id, _, flags, src, time, cand in _slices(batches, 6, cuts):
            s = _Slates(warm, row_id, flags, src, time, cand)
            labelled, label = s.answers(*s.triples())
            a = np.flatnonzero(labelled & s.told & s.timed)
            run = np.flatnonzero(s.size >= 2)
            e = s.first[run]
            parts = (np.repeat([True, False], [len(a), len(e)]), np.append(s.src[a], s.c[e]), np.append(label[a], s.size[run]), np.append(s.at[a], s.at[s.r[e]]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["answer", "id", "value", "at"])

    seen = written(dealt.select(*_told(dealt)).mapInArrow(observed, "answer boolean, id long, value long, at long"), "seen")
    n = {r["answer"]: r["count"] for r in seen.groupBy("answer").count().collect()}  # two rows
    # Of each answer of a source its first and last time: a cell of another time differs from one of them.
    given = seen.where("answer").select("id", F.col("value").alias("cand"), "at").repartition("id").groupBy("id", "cand").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    answers = Stored(_listed(given, "id", "cand", "low", "high"), 3 * n.get(True, 0))
    longest = seen.where("NOT answer").repartition("id").groupBy("id", "at").agg(F.max("value").alias("n"))
    tops = Stored(entries(longest, "id", "at", "n"), 2 * n.get(False, 0))

    def score(batches):
        import pyarrow as pa

        warm = _warm(known)
        for row_id, pos, flags, src, time, cand, value in _slices(batches, 7, cuts):
            s = _Slates(warm, row_id, flags, src, time, cand)
            value = _scores(s, value, answers, tops, tau, strength)
            yield _best(s, row_id, pos, value, pa)

    told = [*_told(dealt), F.col("score").cast("double").alias("score")]
    rows = written(dealt.select(*told).mapInArrow(score, "row_id long, src long, time double, at long, cand long, margin double, first int, second int, pos array<long>, score array<double>"), "rows")
    each = rows.where("src IS NOT NULL AND time IS NOT NULL AND cand IS NOT NULL").select("src", "cand", "time", "at", "margin").repartition("src").groupBy("src", "cand", "time", "at").agg(F.max("margin").alias("margin"))
    keeper = F.min(F.struct(F.col("margin").isNull(), (-F.col("margin")).alias("less"), "time", "at"))
    kept = each.groupBy("src", "cand").agg(F.count(F.lit(1)).alias("times"), keeper.alias("keeper")).where("times >= 2").select("src", "cand", F.col("keeper.at").alias("at"))
    kept = written(kept, "kept")
    keepers = Stored(entries(kept, "src", "cand", "at"), 2 * kept.count())

    def swapped(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            there = np.ones(batch.num_rows, bool)
            for name in ("src", "time", "cand"):
                there &= column(name).is_valid().to_numpy(zero_copy_only=False)
            asked = np.flatnonzero(there)
            src, cand = (column(n).fill_null(0).to_numpy()[asked] for n in ("src", "cand"))
            at = column("at").to_numpy()[asked]
            acts = np.zeros(len(asked), bool)
            for own, place, flat in found_at(keepers, src, cand, 2):
                acts[own] = flat[place + 1] != at[own]
            acts = asked[acts]
            lists, places = column("score"), column("pos")
            value, size = lists.flatten().to_numpy(zero_copy_only=False).copy(), np.diff(lists.offsets.to_numpy())
            start = np.cumsum(size) - size
            second = column("second").to_numpy()[acts]
            value[start[acts[second < 0]]] = np.nan  # as in the rule, a lone cell gets the second's score, which is none
            acts, second = acts[second >= 0], second[second >= 0]
            x, y = start[acts] + column("first").to_numpy()[acts], start[acts] + second
            value[x], value[y] = value[y], value[x]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(column("row_id").to_numpy(), size)), places.flatten(), pa.array(value, from_pandas=True)], names=["row_id", "pos", "score"])

    return rows.mapInArrow(swapped, "row_id long, pos long, score double")


def _scores(s: _Slates, value, answers: Stored, tops: Stored, tau: float, strength: float):
    """Scores after the chain model, the min-max, the promotion and the demotions; NaN for null, which counts for no maximum or sum."""
    import numpy as np

    rows, of = s.rows, s.rows.of
    there = ~np.isnan(value)
    high = rows.most(np.where(there, value, -np.inf))
    e = np.exp((np.where(there, value, high[of]) - np.where(np.isfinite(high), high, 0.0)[of]) / tau) * there
    total = rows.total(e)
    value = s.beliefs(e / np.where(total > 0, total, 1.0)[of], strength)
    low, high = rows.least(np.where(there, value, np.inf)), rows.most(np.where(there, value, -np.inf))
    span = high - low
    wide = (span > TINY)[of]
    value = np.where(wide, np.where(there, value - np.where(np.isfinite(low), low, 0.0)[of], np.nan) / np.where(span > TINY, span, 1.0)[of], 0.5)

    labelled, label = s.triples()
    own = labelled[of] & s.known & (s.cand == label[of])
    first = rows.first_where(own)
    acts = first >= 0
    high = np.where(rows.most(wide), 1.0, 0.5)
    room = high + 1e-4 <= 1.0
    value = np.where((acts & ~room)[of], value * (0.9998 / high)[of], value)
    value[first[acts]] = np.where(room, high + 1e-4, 0.9999)[acts]

    # Demotions; the first kind of them has the higher level. A row's own triple label is spared.
    level = np.where(s.double, 1, 0)
    of_cell = of[s.cell]
    short = (s.size < weights_at(tops, s.c[s.first], s.at[s.r[s.first]])) & s.timed[s.r[s.first]]
    level[s.cell[short[s.run[s.entry]]]] = 1
    asked = np.flatnonzero((s.told & s.timed)[of_cell])
    cell, row = s.cell[asked], of_cell[asked]
    for hit, at, flat in found_at(answers, s.src[row], s.cand[cell], 3):
        now = s.at[row[hit]]
        level[cell[hit[(flat[at + 1] != now) | (flat[at + 2] != now)]]] = 2
    level[own] = 0
    touched = rows.most(level) > 0
    return np.where(touched[of], np.where(level > 0, 0.001 * level, 0.01 + 0.9899 * value), value)


def _best(s: _Slates, row_id, pos, value, pa):
    """A row for each slate: its best candidate, the margin to the second, their places in the lists, and the scores."""
    import numpy as np

    start = s.rows.start
    first, second = s.rows.top_two(np.where(np.isnan(value), -np.inf, value))
    # Rounded, as softmaxes of shifted slates are equal but for the last bits, and ties go to the smallest time.
    margin = np.where(second >= 0, np.round(value[first] - value[second], 12) + 0.0, np.nan)
    offsets = pa.array(np.append(start, len(value)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(pos), pa.array(value, from_pandas=True))]
    columns = [pa.array(row_id[start]), pa.array(s.src, mask=~s.told), pa.array(s.time, mask=~s.timed), pa.array(s.at), pa.array(s.cand[first], mask=~s.known[first]), pa.array(margin, from_pandas=True), pa.array((first - start).astype(np.int32)), pa.array(np.where(second >= 0, second - start, -1).astype(np.int32)), *lists]
    return pa.RecordBatch.from_arrays(columns, names=["row_id", "src", "time", "at", "cand", "margin", "first", "second", "pos", "score"])
