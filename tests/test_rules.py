"""Rules on random slates against plain versions that look at one row, pair or group at a time."""

import random
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.functions import scores as S
from kairograph.operators import crf, feedback, history, popularity, replay, reports, rules


def cells(spark, slates, scores=None, srcs=None, times=None, labels=None):
    """Slates as long cells; without scores, earlier positions are better."""
    rows = []
    for r, slate in enumerate(slates):
        for p, c in enumerate(slate):
            s = scores[r][p] if scores else 1.0 / (1 + p)
            rows.append((r, srcs[r] if srcs else 1, float(times[r] if times else 0), p, c, s, int(bool(labels) and labels[r] == p)))
    return spark.createDataFrame(rows, "row_id long, src long, time double, pos long, cand long, score double, label int")


def log(spark, edges):
    return spark.createDataFrame([(a, b, float(t)) for a, b, t in edges], "src long, dst long, time double")


@dataclass
class Row:
    src: int
    time: float
    slate: list
    scores: list
    label: int

    def ranked(self):
        """Positions, best first; of equal scores the earlier."""
        return sorted(range(len(self.slate)), key=lambda p: (-self.scores[p], p))


class World:
    """Rows in order of time, and a log, with ids few enough that everything happens."""

    def __init__(self, spark, seed, n=260, ids=14, sources=9, width=5):
        r = random.Random(seed)
        times = sorted(float(r.randrange(12)) for _ in range(n))
        self.rows = rows = [Row(r.randrange(sources), t, [r.randrange(ids) for _ in range(width)], [r.randrange(40) / 40 for _ in range(width)], r.randrange(width)) for t in times]
        self.edges = [(r.randrange(sources), r.randrange(ids - 4), float(r.randrange(12))) for _ in range(60)]
        self.pairs = Counter((a, b) for a, b, _ in self.edges)
        self.warm = {b for _, b, _ in self.edges}
        self.cells = cells(spark, [x.slate for x in rows], [x.scores for x in rows], [x.src for x in rows], [x.time for x in rows], [x.label for x in rows])
        self.log = log(spark, self.edges)

    def warm_set(self, k):
        return {c for c in self.rows[k].slate if c in self.warm}

    def coupled(self, a, b):
        return 0 <= a < len(self.rows) and 0 <= b < len(self.rows) and self.rows[a].time == self.rows[b].time and self.rows[a].src != self.rows[b].src

    def triples(self):
        votes = defaultdict(set)
        for k in range(len(self.rows) - 2):
            if self.coupled(k, k + 1) and self.coupled(k + 1, k + 2) and self.coupled(k, k + 2):
                common = self.warm_set(k) & self.warm_set(k + 1) & self.warm_set(k + 2)
                if len(common) == 1:
                    for j in range(3):
                        votes[k + j] |= common
        return {k: min(v) for k, v in votes.items() if len(v) == 1}

    def pair_answers(self, triples):
        votes = defaultdict(set)
        for k in range(len(self.rows) - 1):
            common = self.warm_set(k) & self.warm_set(k + 1) if self.coupled(k, k + 1) else set()
            if len(common) == 1 and k not in triples and k + 1 not in triples:
                votes[k] |= common
                votes[k + 1] |= common
        return {k: min(v) for k, v in votes.items() if len(v) == 1}


@pytest.fixture(scope="module")
def world(spark):
    return World(spark, 11)


def acted(df):
    return {(r.row_id, r.pos) for r in df.where("acted").collect()}


def lifted(row, p):
    """The row's scores with position ``p`` (if any) lifted over the others, by its maximum."""
    s = list(row.scores)
    if p is not None:
        s[p] = max(s) + max(max(s) - min(s), 1.0) + 1.0
    return [x / max(s) for x in s] if max(s) > 0 else [0.5] * len(s)


def by_cell(df, column="score"):
    return {(r["row_id"], r["pos"]): r[column] for r in df.collect()}


def same_scores(df, want):
    got = by_cell(df)
    assert got == {(k, p): pytest.approx(v) for k, row in want.items() for p, v in enumerate(row)}


def test_slate_recurrence(world):
    """The candidate that its source's slates repeat most is lifted, unless history, a tie or the top place forbids it."""
    times = Counter((x.src, c) for x in world.rows for c in x.slate)
    want = {}
    for k, x in enumerate(world.rows):
        fresh = {p: times[x.src, c] - 1 for p, c in enumerate(x.slate) if not world.pairs[x.src, c]}
        most = max(fresh.values(), default=0)
        places = [p for p, n in fresh.items() if n == most]
        top = x.ranked()[0]
        if not world.pairs[x.src, x.slate[top]] and most >= 2 and len(places) == 1 and places[0] != top:
            want[k] = places[0]
    out = rules.source_slate_recurrence(world.cells, world.log)
    assert acted(out) == set(want.items()) and 10 < len(want) < len(world.rows) - 10
    same_scores(out, {k: lifted(x, want.get(k)) for k, x in enumerate(world.rows)})
    counts = {(r.row_id, r.pos): r.recur for r in popularity.slate_recurrence(world.cells).collect()}
    assert counts == {(k, p): times[x.src, c] - 1 for k, x in enumerate(world.rows) for p, c in enumerate(x.slate)}


def test_reciprocity(world):
    """The second candidate is lifted if slates name the source to it, not to the first, and neither is history."""
    named = {(x.src, c) for x in world.rows for c in x.slate}
    want = {}
    for k, x in enumerate(world.rows):
        first, second = x.ranked()[:2]
        a, b = x.slate[first], x.slate[second]
        if not world.pairs[x.src, a] and not world.pairs[x.src, b] and (b, x.src) in named and (a, x.src) not in named:
            want[k] = second
    out = rules.graph_reciprocity(world.cells, world.log)
    assert acted(out) == set(want.items()) and want
    same_scores(out, {k: lifted(x, want.get(k)) for k, x in enumerate(world.rows)})


def test_history_goes_one_way(world):
    masked, counted, back = (by_cell(f, c) for f, c in ((history.history_mask(world.cells, world.log), "in_history"), (history.history_count(world.cells, world.log), "n_hist"), (history.reverse_edge(world.cells), "is_reverse")))
    named = {(x.src, c) for x in world.rows for c in x.slate}
    for k, x in enumerate(world.rows):
        for p, c in enumerate(x.slate):
            assert (masked[k, p], counted[k, p], back[k, p]) == (world.pairs[x.src, c] > 0, world.pairs[x.src, c], (c, x.src) in named)


def groups_of(world):
    """Rows by (source, top candidate), and of each the time that keeps it if there are several."""
    groups = defaultdict(list)
    for k, x in enumerate(world.rows):
        groups[x.src, x.slate[x.ranked()[0]]].append(k)
    keeper = {}
    for g, ks in groups.items():
        if len({world.rows[k].time for k in ks}) > 1:
            margin = lambda k: world.rows[k].scores[world.rows[k].ranked()[0]] - world.rows[k].scores[world.rows[k].ranked()[1]]
            best = max(margin(k) for k in ks)
            keeper[g] = min(world.rows[k].time for k in ks if margin(k) == best)
    return groups, keeper


def test_exclusivity_keeps_one_time(world):
    groups, keeper = groups_of(world)
    want = {k for g, t in keeper.items() for k in groups[g] if world.rows[k].time != t}
    out = rules.cross_time_exclusivity(world.cells)
    assert {k for k, _ in acted(out)} == want and 0 < len(want) < len(world.rows)
    swapped = {}
    for k, x in enumerate(world.rows):
        swapped[k] = list(x.scores)
        if k in want:
            a, b = x.ranked()[:2]
            swapped[k][a], swapped[k][b] = x.scores[b], x.scores[a]
    same_scores(out, swapped)


def test_census(world):
    groups, keeper = groups_of(world)
    sizes = {g: Counter(world.rows[k].time for k in ks) for g, ks in groups.items()}
    found = rules.exclusivity_census(world.cells).first().asDict()
    rows_in = sum(len(groups[g]) for g in keeper)
    kept = sum(sizes[g][t] for g, t in keeper.items())
    assert found == {
        "n_rows": len(world.rows),
        "src_top1_groups": len(groups),
        "groups_multirow": sum(len(ks) > 1 for ks in groups.values()),
        "groups_multirow_same_time_only": sum(len(ks) > 1 and len(sizes[g]) == 1 for g, ks in groups.items()),
        "violation_groups": len(keeper),
        "rows_in_violation_groups": rows_in,
        "guaranteed_wrong": rows_in - sum(max(sizes[g].values()) for g in keeper),
        "planned_action_rows": rows_in - kept,
        "keeper_rows": kept,
        "max_violation_group_size": max(len(groups[g]) for g in keeper),
    }
    assert rules.census_faults(found, found) == []
    for name in found:
        assert rules.census_faults(found | {name: found[name] + 1}, found)
    assert any("broken" in x for x in rules.census_faults(found | {"keeper_rows": 0}, {}))


@pytest.mark.parametrize("seed", [1, 2])
def test_structural_labels(spark, seed):
    w = World(spark, seed)
    sets = rules.slate_sets(w.cells, w.log)
    assert {r.row_id: set(r.warm) for r in sets.collect()} == {k: w.warm_set(k) for k in range(len(w.rows))}
    triples = w.triples()
    pairs = w.pair_answers(triples)
    found = rules.triple_rule(sets)
    assert {r.row_id: r.cand for r in found.collect()} == triples and triples
    assert {r.row_id: r.cand for r in rules.pair_labels(sets, found).collect()} == pairs and pairs
    assert {r.row_id: (r.cand, r.from_triple) for r in rules.structural_labels(sets).collect()} == {k: (c, False) for k, c in pairs.items()} | {k: (c, True) for k, c in triples.items()}
    band = {(k, d, c) for d in (1, 2, 3) for k in range(len(w.rows)) if w.coupled(k, k + d) for c in w.warm_set(k) & w.warm_set(k + d)}
    assert {(r.row_id, r.distance, r.cand) for r in rules.band_shared(sets, 3).collect()} == band


def test_demotions(world, spark):
    triples = world.triples()
    labels = world.pair_answers(triples) | triples
    want = {}
    for k, x in enumerate(world.rows):
        for p, c in enumerate(x.slate):
            if triples.get(k) == c:
                continue
            if x.slate.count(c) > 1:
                want[k, p] = 1
            if any(world.rows[j].src == x.src and world.rows[j].time != x.time and a == c for j, a in labels.items()):
                want[k, p] = 2
    frames = [spark.createDataFrame(sorted(d.items()), "row_id long, cand long") for d in (labels, triples)]
    found = rules.zero_repeat_demotions(world.cells, *frames)
    assert {(r.row_id, r.pos): r.level for r in found.collect()} == want and set(want.values()) == {1, 2}
    touched = {k for k, _ in want}
    squeezed = {k: [0.001 * want[k, p] if (k, p) in want else 0.01 + 0.9899 * v if k in touched else v for p, v in enumerate(x.scores)] for k, x in enumerate(world.rows)}
    same_scores(rules.apply_demotions(world.cells, found), squeezed)


def test_runs(world, spark, monkeypatch):
    monkeypatch.setattr(rules, "RUN_BLOCK", 3)
    runs = defaultdict(list)
    for k, x in enumerate(world.rows):
        for c in world.warm_set(k):
            own = runs[x.time, c]
            if own and own[-1][-1] == k - 1:
                own[-1].append(k)
            else:
                own.append([k])
    short = {(k, c) for (_, c), own in runs.items() for run in own if len(run) < max(map(len, own)) >= 2 for k in run}
    spared = set(sorted(short)[::4])
    want = {(k, p) for k, c in short - spared for p, x in enumerate(world.rows[k].slate) if x == c}
    found = rules.run_exclusion(world.cells, world.log, spark.createDataFrame(sorted(spared), "row_id long, cand long"))
    assert {(r.row_id, r.pos) for r in found.collect()} == want and want


def random_rows(seed, n=120):
    """Score rows of all kinds: positive, negative, mixed, constant, zero."""
    r = random.Random(seed)
    kinds = (lambda: r.random(), lambda: -r.random(), lambda: r.uniform(-1, 1), lambda: 0.0)
    out = []
    for _ in range(n):
        kind, same = r.choice(kinds), r.random() < 0.2
        first = kind()
        out.append([first if same else kind() for _ in range(4)])
    return out


def over_top(v):
    return [x / max(v) for x in v] if max(v) > 1e-12 else v


def between(v):
    return [(x - min(v)) / (max(v) - min(v)) for x in v] if max(v) - min(v) > 1e-12 else [0.5] * len(v)


def softmax(v):
    e = np.exp(np.array(v) / 0.3)
    return (e / e.sum()).tolist()


@pytest.mark.parametrize(("f", "plain"), [(S.rownorm, over_top), (S.row_minmax, between), (S.row_max_normalise, lambda v: over_top(v) if max(v) > 1e-12 else between(v)), (lambda c: S.row_softmax(c, 0.3), softmax), (S.promoted_value, lambda v: [max(v) + max(max(v) - min(v), 1) + 1] * len(v))])
def test_normalisations(spark, f, plain):
    rows = random_rows(7)
    df = cells(spark, [[0, 1, 2, 3]] * len(rows), rows)
    same_scores(df.withColumn("score", f(F.col("score"))), {k: plain(v) for k, v in enumerate(rows)})


def test_promotion_within_the_unit(spark):
    """The chosen cell is the row's only best; all cells stay in [0, 1]; the others keep their order, and their values if there is room."""
    r = random.Random(9)
    rows = [[r.choice([r.random(), 1.0, 0.99995, 0.0]) for _ in range(4)] for _ in range(200)]
    chosen = [r.randrange(5) for _ in rows]
    df = cells(spark, [[0, 1, 2, 3]] * len(rows), rows).join(spark.createDataFrame(list(enumerate(chosen)), "row_id long, at int"), "row_id")
    got = by_cell(df.withColumn("score", S.promote_in_unit(F.col("score"), F.col("pos") == F.col("at"))))
    for k, (v, at) in enumerate(zip(rows, chosen, strict=True)):
        new = [got[k, p] for p in range(4)]
        if at == 4:
            assert new == v
            continue
        rest = [p for p in range(4) if p != at]
        assert all(0 <= x <= 1 for x in new) and all(new[at] > new[p] for p in rest)
        assert all((v[p] < v[q]) == (new[p] < new[q]) for p in rest for q in rest)
        if max(v) <= 0.9998:
            assert [new[p] for p in rest] == [v[p] for p in rest] and new[at] == pytest.approx(max(v) + 1e-4)


def test_history_before_time_is_strict(world, spark):
    queries = [(k, x.src, x.time) for k, x in enumerate(world.rows)]
    found = {r.row_id: r.hist for r in history.history_before_time(spark.createDataFrame(queries, "row_id long, src long, time double"), world.log).collect()}
    want = {k: [b for t, b in sorted((t, b) for a, b, t in world.edges if a == src and t < time)] for k, src, time in queries}
    assert found == {k: h for k, h in want.items() if h}


@pytest.mark.parametrize("by", ["src", "dst", None])
def test_cooccurrence(world, by):
    """Both orders of the product give the sums of three nested loops."""
    w = world.pairs
    sources, total = {a for a, _ in w}, Counter(b for _, b, _ in world.edges)
    found = {(r.src, r.cand): r.cooc for r in history.cooc_cf(world.cells, world.log, by).collect()}
    assert found.keys() == {(x.src, c) for x in world.rows for c in x.slate}
    for (s, c), v in found.items():
        want = sum(w[s, d] * w[u, d] * w[u, c] for u in sources if u != s for d in world.warm)
        assert v == pytest.approx(want / (total[c] + 1) ** 0.5)


def test_rank_metric_is_pessimistic(world):
    ranks = [1 + sum(v >= x.scores[x.label] for p, v in enumerate(x.scores) if p != x.label) for x in world.rows]
    row = replay.mrr(world.cells).first()
    assert row.n_rows == len(ranks) and row.mrr == pytest.approx(sum(1 / k for k in ranks) / len(ranks), abs=1e-6)
    assert popularity.tie_baseline(3) == pytest.approx((1 + 1 / 2 + 1 / 3) / 3)


def test_numbers_are_dense_and_in_order(spark):
    from kairograph.sources import tables

    r = random.Random(4)
    rows = [(r.randrange(-30, 30), r.randrange(30), float(r.randrange(4))) for _ in range(300)]
    df = spark.createDataFrame(rows, "src long, dst long, time double")
    ids = {(x.src, x.dst): x.gid for x in popularity.dense_group_ids(df, "src", "dst", block=7).collect()}
    assert ids == {k: i for i, k in enumerate(sorted({x[:2] for x in rows}))}
    order = sorted({(t, d, s) for s, d, t in rows})
    found = {(x.time, x.dst, x.src): (x.row_id, x.rn) for x in tables.numbered(df).collect()}
    firsts = {t: i for i, (t, _, _) in reversed(list(enumerate(order)))}
    assert found == {k: (i, i - firsts[k[0]]) for i, k in enumerate(order)}


def test_the_tail_and_what_is_before_it(spark):
    rows = [(1, 5, 2.0), (1, 5, 2.0), (1, 4, 2.0), (1, 9, 1.0), (2, 3, 0.0)]
    df = log(spark, rows)
    tail = [tuple(x) for x in popularity.tail_split(df).collect()]
    left = [tuple(x) for x in popularity.before_tail(df).select("src", "dst", "time").collect()]
    assert sorted(tail) == [(1, 5, 2.0), (2, 3, 0.0)] and sorted(tail + left) == sorted(rows)
    assert [x.dst for x in popularity.clip_ids(log(spark, [(0, -4, 0), (0, 2, 0), (0, 9, 0)]), "dst", 4).collect()] == [0, 2, 3]


def test_windows_are_trailing(world):
    span = (min(t for *_, t in world.edges), max(t for *_, t in world.edges))
    for r in popularity.popularity_windows(world.log, 0.2, 0.5).collect():
        short, long = (sum(b == r.dst and t >= span[1] - f * (span[1] - span[0]) for _, b, t in world.edges) for f in (0.2, 0.5))
        assert (r.pop_short, r.pop_long) == (pytest.approx(np.log1p(short)), pytest.approx(np.log1p(long)))


def test_matrix_difference(spark):
    old, r = random_rows(21, 60), random.Random(5)
    new = [[x if r.random() < 0.7 else r.random() for x in v] for v in old]
    row = reports.matrix_diff(cells(spark, [list(range(4))] * 60, old), cells(spark, [list(range(4))] * 60, new)).first()
    order = lambda v: sorted(range(4), key=lambda p: (-v[p], p))
    both = list(zip(old, new, strict=True))
    changed = [sum(x != y for x, y in zip(a, b, strict=True)) for a, b in both]
    assert (row.changed_rows, row.changed_cells) == (sum(n > 0 for n in changed), sum(changed))
    assert (row.top1_changes, row.order_changed_rows) == (sum(order(a)[0] != order(b)[0] for a, b in both), sum(order(a) != order(b) for a, b in both))
    pairs = [b[i] - b[j] for a, b in both for i in range(4) for j in range(4) if a[i] > a[j]]
    assert (row.strict_inversions, row.collapsed_pairs) == (sum(d < 0 for d in pairs), sum(d == 0 for d in pairs))


def test_matrix_gate(spark):
    good = cells(spark, [[1, 2], [3, 4]])
    reports.validate_matrix(good, 2, 2)
    for bad in (good.where("row_id = 0"), good.where("NOT (row_id = 1 AND pos = 1)"), good.withColumn("score", F.col("score") * 2), good.withColumn("score", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            reports.validate_matrix(bad, 2, 2)


@pytest.mark.parametrize("end", ["\n", "\r\n", ""])
def test_tokens_swap_as_text(spark, end):
    r = random.Random(2)
    lines = [[f"{r.random():.{r.randrange(1, 7)}f}" for _ in range(4)] for _ in range(20)]
    swaps = {k: r.sample(range(4), 2) for k in range(0, 20, 3)}
    df = spark.createDataFrame([(k, ",".join(x) + end) for k, x in enumerate(lines)], "row_id long, line string")
    found = {x.row_id: x.line for x in reports.token_swap(df, spark.createDataFrame([(k, *v) for k, v in swaps.items()], "row_id long, c1 int, c2 int")).collect()}
    for k, (a, b) in swaps.items():
        lines[k][a], lines[k][b] = lines[k][b], lines[k][a]
    assert found == {k: ",".join(x) + end for k, x in enumerate(lines)}


def test_chain_messages_by_hand():
    beliefs = crf.infer_island([[1, 2], [3, 1]], [[0.0, 0.0], [0.0, 0.0]], [[True, False], [False, True]], 1.0, 70.0)
    assert np.allclose(beliefs[1], [0.5, 0.5 * 36])
    assert np.allclose(beliefs[0], [0.5 * 36, 0.5])


@pytest.mark.parametrize(("width", "power", "eta"), [(1, 1.0, 0.0), (3, 0.5, 0.0), (2, 1.0, 1.0)])
def test_chain_over_islands_is_that_over_the_whole_table(world, width, power, eta, monkeypatch):
    """The whole table as one sequence, with all its couplings, against islands in groups and blocks of few rows."""
    monkeypatch.setattr(crf, "BLOCK", 7)
    monkeypatch.setattr(crf, "TOGETHER", 5)
    rows, belief, boost = world.rows, [], {}
    for row in rows:
        e = np.exp((np.array(row.scores) - max(row.scores)) / 0.2)
        belief.append(e / e.sum())
    if eta:
        sets = rules.slate_sets(world.cells, world.log)
        boost = {x.cand: x.factor for x in rules.candidate_factors(world.cells, sets, eta).collect()}
        assert set(boost.values()) <= {x.factor for x in rules.reliability_bins(world.cells, sets, eta).collect()} and len(set(boost.values())) > 1

    def told(k, other):
        """Places in row k and in the other row of what they share, if they are coupled; of doubles the last place counts."""
        if not world.coupled(k, other):
            return {}
        early, late = rows[min(k, other)], rows[max(k, other)]
        last = {c: i for i, c in enumerate(early.slate)}
        there = {j: last[c] for j, c in enumerate(late.slate) if c in world.warm and c in last}
        return there if k > other else {i: j for j, i in there.items()}

    def sweep(order, step):
        now, out = [b.copy() for b in belief], [np.ones(len(b)) for b in belief]
        for k in order:
            for d in range(1, width + 1):
                for j, i in told(k, k - step * d).items():
                    out[k][j] *= 1 + 70 * boost.get(rows[k].slate[j], 1.0) * (now[k - step * d][i] / now[k - step * d].sum()) ** power
            now[k] = belief[k] * out[k]
        return out

    ahead, behind = sweep(range(len(rows)), 1), sweep(range(len(rows) - 1, -1, -1), -1)
    found = by_cell(crf.equality_crf(world.cells, world.log, width=width, power=power, eta=eta))
    assert len(found) == sum(len(b) for b in belief)
    for k, b in enumerate(belief):
        assert np.allclose([found[k, p] for p in range(len(b))], b * ahead[k] * behind[k])


def test_feedback_leaves_out_the_own_row(spark):
    c = cells(spark, [[1, 2, 3], [4, 5, 6]], [[0.9, 0.5, 0.1]] * 2, [1, 1], [0, 0])
    v = spark.createDataFrame([(k, [float(k == 1 or k == 4), float(k != 1 and k != 4)]) for k in range(1, 7)], "id long, vec array<double>")
    got = {(r.row_id, r.pos): (r.fb_max, r.fb_mean) for r in feedback.basket_feedback_dense(c, v).collect()}
    e = np.exp(np.array([0.9, 0.5, 0.1]) - 0.9)
    assert got[0, 0] == pytest.approx((e[0] / e.sum(),) * 2)
    labels = spark.createDataFrame([(1, 5)], "row_id long, cand long")
    assert {(r.row_id, r.pos): r.fb_max for r in feedback.basket_feedback_dense(c, v, labels).collect()}[0, 1] == pytest.approx(1.0)
