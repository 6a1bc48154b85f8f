"""All registered queries: what each computes with the operators, and its SQL where SQL expresses it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import byblock, bysource, bystretch, crf, embedding, feedback, history, models, popularity, replay, reports, rules
from ..sources import tables as T
from ..sources.shared import written
from . import chains
from . import features as P
from .oracle import _norm, statement

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The tables that a query may ask for, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str, kind: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.numbered: DataFrame | None = None
        self.log = T.events_log(spark, sf_dir) if kind == "events" else T.orders_log(spark, sf_dir)

    def once(self) -> Inputs:
        """The same with the log written to the shared folder: plans that read it many times join its tables once."""
        self.log = written(self.log, "log")
        return self

    def numbered_once(self) -> Inputs:
        """The same with the numbered rows written too: plans that go over the cells several times number them once."""
        self.once().numbered = written(T.numbered(self.test), "rows")
        return self

    @property
    def train(self) -> DataFrame:
        return T.train_part(self.log)

    @property
    def test(self) -> DataFrame:
        return T.test_part(self.log)

    @property
    def slates(self) -> DataFrame:
        return T.slates(self.log)

    @property
    def cells(self) -> DataFrame:
        return T.scored(self.slates)

    @property
    def by_source(self) -> DataFrame:
        """The cells, dealt by source."""
        return T.scored(T.slates(self.log, by="src", rows=self.numbered))

    @property
    def by_block(self) -> DataFrame:
        """The slates, dealt by blocks of rows."""
        return T.slates(self.log, by="block", rows=self.numbered)

    @property
    def rows(self) -> DataFrame:
        return T.numbered(self.test)

    @property
    def vectors(self) -> DataFrame:
        return T.vectors(self.spark, self.sf_dir)

    @property
    def sets(self) -> DataFrame:
        return rules.slate_sets(self.slates, self.train)

    @property
    def labelled(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Triple labels, pair labels, and both; sets and triples are read several times, and so are written once."""
        sets = written(self.sets, "sets")
        triples = written(rules.triple_rule(sets), "triples")
        pairs = rules.pair_labels(sets, triples)
        return triples, pairs, rules.answer_labels(triples, pairs)


def _query(name: str, kind: str, sql: str | None = None):
    def add(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir, kind))
        if sql is not None:
            ORACLES[name] = statement(kind, sql)
        return build

    return add


def _r(df: DataFrame, *columns: str, places: int = 6, shift: float = 0.0) -> DataFrame:
    """Rounded columns; a small shift keeps exact decimal halves, which engines round differently, off the edge."""
    return df.withColumns({c: F.round(F.col(c) + shift if shift else F.col(c), places) for c in columns})


def _with_labels(i: Inputs, rule: Callable[..., DataFrame]) -> DataFrame:
    triples, _, labels = i.labelled
    return rule(i.cells, labels, triples)


E, O = "events", "orders"
CELL = ["row_id", "pos"]

# Scans, cuts and profiles.
_query("log_scan_events", E, "SELECT src, dst, time FROM log")(lambda i: i.log)
_query("log_scan_orders", O, "SELECT src, dst, time FROM log")(lambda i: i.log)
_query("embedding_scan", O, "SELECT id, len(vec) AS dim, round(list_sum(list_transform(vec, lambda v: v * v)), 6) AS square FROM emb")(lambda i: i.vectors.select("id", F.size("vec").cast("long").alias("dim"), F.round(S.dot(F.col("vec"), F.col("vec")), 6).alias("square")))
_query("slate_unpivot", O, "SELECT row_id, src, time, pos, cand, label FROM slates")(lambda i: i.slates)
_query("cut_split", E, "SELECT (time > cut) AS after_cut, count(*) AS n, count(DISTINCT src) AS n_src FROM log, cutv GROUP BY 1")(lambda i: i.log.join(F.broadcast(T.cut_time(i.log))).groupBy((F.col("time") > F.col("cut")).alias("after_cut")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("n_src")))
_query("time_cutoff", O, "SELECT src, dst, time FROM train")(lambda i: i.train)
_query("graph_profile", E, "SELECT count(*) AS rows, min(time) AS min_time, max(time) AS max_time, count(*) FILTER (src = dst) AS self_loops, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst, (SELECT count(*) FROM (SELECT src FROM log INTERSECT SELECT dst FROM log)) AS n_both, (SELECT count(*) FROM (SELECT src FROM log INTERSECT SELECT dst FROM log)) = 0 AS bipartite FROM log")(lambda i: popularity.graph_profile(i.log))
_query("geometry", O, "SELECT (SELECT count(DISTINCT row_id) FROM slates) AS n_rows, 21 AS width, (SELECT greatest(max(src), max(dst)) + 1 FROM log) AS num_entity")(lambda i: reports.geometry(i.slates, i.log))
_query("repeat_rate", E, "SELECT count(*) AS rows, count(*) - count(DISTINCT (src, dst)) AS repeats, (count(*) - count(DISTINCT (src, dst))) / count(*) AS rate FROM log")(lambda i: popularity.repeat_rate(i.log))
_query("reciprocity_rate", E, "SELECT count(*) AS pairs, count(*) FILTER (r) AS reciprocal, count(*) FILTER (r) / count(*) AS rate FROM (SELECT p.*, EXISTS (SELECT 1 FROM log b WHERE b.src = p.dst AND b.dst = p.src) AS r FROM (SELECT DISTINCT src, dst FROM log WHERE src <> dst) p)")(lambda i: popularity.reciprocity_rate(i.log))

# Aggregates.
_query("dedup_interactions", O, "SELECT DISTINCT src, dst, time FROM log")(lambda i: popularity.dedup_interactions(i.log))
_query("pair_weights", E, "SELECT src, dst, count(*) AS w FROM log GROUP BY src, dst")(lambda i: history.pair_weights(i.log))
_query("first_occurrence", E, "SELECT src, dst, min(time) AS time FROM log GROUP BY src, dst")(lambda i: popularity.first_occurrence(i.log))
_query("dst_popularity", O, "SELECT dst, n + 1 AS pop, round(ln(1 + n + 1), 6) AS pop_log FROM popd")(lambda i: _r(popularity.dst_popularity(i.train), "pop_log"))
_query("recent_popularity", O, "SELECT dst, round(rpop, 6) AS rpop FROM rpops")(lambda i: _r(popularity.recent_popularity(i.train), "rpop"))
_query("popularity_windows", O, "SELECT dst, round(pop_short, 6) AS pop_short, round(pop_long, 6) AS pop_long, round(pop_short - pop_long, 6) AS pop_diff FROM wins")(lambda i: _r(popularity.popularity_windows(i.train), "pop_short", "pop_long", "pop_diff"))
_query("graph_recency", O, "SELECT dst, round(recency, 6) AS recency FROM wins")(lambda i: _r(popularity.graph_recency(i.train), "recency"))
_query("source_last_gap", O, "SELECT row_id, round((time - coalesce(last, lo)) / 365.0, 6) AS last_gap FROM q LEFT JOIN (SELECT src, max(time) AS last FROM train GROUP BY src) USING (src), spanv")(lambda i: _r(popularity.source_last_gap(i.rows, i.train), "last_gap"))
_query("candidate_frequency", O, "SELECT cand, freq, round(freq_log, 6) AS freq_log FROM freqs")(lambda i: _r(popularity.candidate_frequency(i.slates), "freq_log"))
_query("popularity_ratio", O, "SELECT cand, round((coalesce(n, 0) + 1) / (freq + 1), 6) AS ratio FROM freqs LEFT JOIN popd ON dst = cand")(lambda i: _r(popularity.popularity_ratio(i.slates, i.train), "ratio"))
_query("slate_recurrence", O, "SELECT row_id, pos, count(*) OVER (PARTITION BY src, cand) - 1 AS recur FROM slates")(lambda i: popularity.slate_recurrence(i.slates).select(*CELL, "recur"))
_query("candidate_pool", E, "SELECT src, cand FROM pool")(lambda i: popularity.candidate_pool(i.slates))
_query("dense_group_ids", E, "SELECT src, dst, dense_rank() OVER (ORDER BY src, dst) - 1 AS gid FROM (SELECT DISTINCT src, dst FROM log)")(lambda i: popularity.dense_group_ids(i.log, "src", "dst"))
_query("recency_cdf", O, "SELECT time, n, round(sum(wt) OVER (ORDER BY time) / sum(wt) OVER (), 6) AS cdf FROM (SELECT time, count(*) AS n, count(*) * exp(-(any_value(hi) - time) / (0.25 * (any_value(hi) - any_value(lo)))) AS wt FROM train, spanv GROUP BY time)")(lambda i: _r(popularity.recency_cdf(i.train), "cdf"))
_query("degree_cdf", O, "SELECT dst, round(sum(wt) OVER (ORDER BY dst) / sum(wt) OVER (), 6) AS cdf FROM (SELECT dst, pow(n + 1, 0.75) AS wt FROM popd)")(lambda i: _r(popularity.degree_cdf(i.train), "cdf"))
_query("bidirectional_edges", E, "SELECT src, dst FROM log UNION ALL SELECT dst, src FROM log")(lambda i: popularity.bidirectional_edges(i.log))
_query("source_union", O, "SELECT src FROM train UNION SELECT src FROM test")(lambda i: i.train.select("src").union(i.test.select("src")).distinct())
_query("tail_split", E, "SELECT src, dst, time FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY time DESC, dst DESC) AS r FROM log) WHERE r = 1")(lambda i: popularity.tail_split(i.log))
_query("virtual_edge_harvest", O, "SELECT DISTINCT src, cand AS dst FROM flagged WHERE rank <= 2 AND score > 0.97 AND NOT in_history")(lambda i: rules.virtual_edge_harvest(i.cells, i.train))
_query("virtual_edge_union", O, "SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, CAST(w AS DOUBLE) AS w FROM w UNION ALL SELECT DISTINCT src, cand, 1.0 FROM flagged WHERE rank <= 2 AND score > 0.97 AND NOT in_history) GROUP BY src, dst")(lambda i: popularity.virtual_edge_union(i.train, rules.virtual_edge_harvest(i.cells, i.train)))

# History and joins.
_query("history_mask", E, "SELECT row_id, pos, in_history FROM flagged")(lambda i: history.history_mask(i.slates, i.train).select(*CELL, "in_history"))
_query("history_count", E, "SELECT row_id, pos, n_hist FROM flagged")(lambda i: history.history_count(i.slates, i.train).select(*CELL, "n_hist"))
_query("history_before_time", O, "SELECT q.row_id, count(*) AS n, string_agg(CAST(l.dst AS VARCHAR), ',' ORDER BY l.time, l.dst) AS hist FROM q JOIN log l ON l.src = q.src AND l.time < q.time GROUP BY q.row_id")(lambda i: history.history_before_time(i.rows, i.log).select("row_id", F.size("hist").cast("long").alias("n"), F.concat_ws(",", F.col("hist").cast("array<string>")).alias("hist")))
_query("warm_flag", O, "SELECT row_id, pos, dst IS NOT NULL AS warm FROM slates LEFT JOIN warmd ON dst = cand")(lambda i: history.warm_flag(i.slates, i.train).select(*CELL, "warm"))
_query("reverse_edge", E, "SELECT row_id, pos, EXISTS (SELECT 1 FROM pool p WHERE p.src = s.cand AND p.cand = s.src) AS is_reverse FROM slates s")(lambda i: history.reverse_edge(i.slates).select(*CELL, "is_reverse"))
_query("cooc_cf", O, "SELECT src, cand, round(cooc, 6) AS cooc FROM coocs")(lambda i: _r(history.cooc_cf(i.once().by_source, i.train), "cooc"))
_query("cooc_cf_events", E, "SELECT src, cand, round(cooc, 6) AS cooc FROM coocs")(lambda i: _r(history.cooc_cf(i.once().by_source, i.train), "cooc"))
_query("similar_users_topk", O, "SELECT src, nbr, rank, round(weight, 6) AS weight FROM nbrs")(lambda i: _r(history.similar_users_topk(i.slates, i.vectors), "weight"))
_query("user_cf", E, "SELECT src, cand, round(collab, 6) AS collab FROM collab")(lambda i: _r(history.user_cf(i.slates, history.similar_users_topk(i.slates, i.vectors), i.train), "collab"))
_query("item_cf", O, "SELECT p.src, p.cand, round(coalesce(icf_mean, 0), 6) AS icf_mean, round(coalesce(icf_top3, 0), 6) AS icf_top3 FROM wanted p LEFT JOIN icf i ON i.src = p.src AND i.cand = p.cand")(lambda i: _r(history.item_cf(i.slates, i.train, i.vectors), "icf_mean", "icf_top3"))
_query("l2_normalise", O, "SELECT id, round(list_sum(list_transform(vec, lambda v: v * v)), 6) AS one, round(vec[1], 6) AS first FROM unit")(lambda i: history.unit_vectors(i.vectors).select("id", F.round(S.dot(F.col("vec"), F.col("vec")), 6).alias("one"), F.round(F.col("vec")[0], 6).alias("first")))
_query("dot_score_ensemble", E, f"SELECT row_id, pos, round(({_norm('dot_a')} + {_norm('dot_b')}) / 2, 6) AS score FROM slates JOIN dots USING (src, cand)")(lambda i: _dots(i).select(*CELL, F.round((S.rownorm(F.col("dot_a")) + S.rownorm(F.col("dot_b"))) / 2, 6).alias("score")))
_query("innovation_score", E, f"SELECT row_id, pos, round(CASE WHEN w.w IS NOT NULL THEN 0 ELSE {_norm('dot_b')} END, 6) AS after_norm, round({_norm('(CASE WHEN w.w IS NOT NULL THEN 0 ELSE dot_b END)')}, 6) AS before_norm FROM slates s JOIN dots USING (src, cand) LEFT JOIN w ON w.src = s.src AND w.dst = s.cand")(lambda i: _innovation(i))
_query("basket_siblings", O, "SELECT row_id, sib FROM sib")(lambda i: feedback.basket_siblings(i.slates))


def _dots(i: Inputs) -> DataFrame:
    half = i.vectors.select("id", F.slice("vec", 1, 32).alias("vec"))
    s = i.slates
    return s.join(history.dot_score(s, i.vectors).withColumnRenamed("dot", "dot_a"), ["src", "cand"]).join(history.dot_score(s, half).withColumnRenamed("dot", "dot_b"), ["src", "cand"])


def _innovation(i: Inputs) -> DataFrame:
    d = history.history_mask(_dots(i), i.train)
    after = F.when(F.col("in_history"), 0.0).otherwise(S.rownorm(F.col("dot_b")))
    return d.withColumn("masked", F.when(F.col("in_history"), 0.0).otherwise(F.col("dot_b"))).select(*CELL, F.round(after, 6).alias("after_norm"), F.round(S.rownorm(F.col("masked")), 6).alias("before_norm"))


# Row functions and ranks.
_SHIFTED = "(score * 3.1 - 1)"
_LOW, _HIGH = (f"{f}({_SHIFTED}) OVER (PARTITION BY row_id)" for f in ("min", "max"))
_query("rownorm", O, f"SELECT row_id, pos, round({_norm(_SHIFTED)}, 6) AS v FROM cells")(lambda i: i.cells.select(*CELL, F.round(S.rownorm(F.col("score") * 3.1 - 1), 6).alias("v")))
_query("row_minmax", O, f"SELECT row_id, pos, round(CASE WHEN {_HIGH} - {_LOW} > 1e-12 THEN ({_SHIFTED} - {_LOW}) / ({_HIGH} - {_LOW}) ELSE 0.5 END, 6) AS v FROM cells")(lambda i: i.cells.select(*CELL, F.round(S.row_minmax(F.col("score") * 3.1 - 1), 6).alias("v")))
_query("row_max_normalise", O, "SELECT row_id, pos, round(CASE WHEN hi > 1e-12 THEN v / hi WHEN hi - lo > 1e-12 THEN (v - lo) / (hi - lo) ELSE 0.5 END, 6) AS v FROM (SELECT *, min(v) OVER (PARTITION BY row_id) AS lo, max(v) OVER (PARTITION BY row_id) AS hi FROM (SELECT row_id, pos, score - 2 * (row_id % 2) AS v FROM cells))")(lambda i: i.cells.select(*CELL, F.round(S.row_max_normalise(F.col("score") - 2 * (F.col("row_id") % 2)), 6).alias("v")))
_query("row_softmax", O, "SELECT row_id, pos, round(e / sum(e) OVER (PARTITION BY row_id), 6) AS v FROM (SELECT row_id, pos, exp((score - max(score) OVER (PARTITION BY row_id)) / 0.2) AS e FROM cells)")(lambda i: i.cells.select(*CELL, F.round(S.row_softmax(F.col("score"), 0.2), 6).alias("v")))
_query("promote_in_unit", O, "SELECT row_id, pos, round(CASE WHEN mx + 1e-4 <= 1.0 THEN CASE WHEN pos = 3 THEN mx + 1e-4 ELSE score END WHEN pos = 3 THEN 0.9999 ELSE score * (0.9998 / mx) END, 6) AS v FROM (SELECT *, max(score) OVER (PARTITION BY row_id) AS mx FROM cells)")(lambda i: i.cells.select(*CELL, F.round(S.promote_in_unit(F.col("score"), F.col("pos") == 3), 6).alias("v")))
_query("clip_to_train_range", O, "SELECT row_id, round(least(greatest(time, lo), hi), 6) AS v FROM q, spanv")(lambda i: i.rows.join(F.broadcast(i.train.agg(F.min("time").alias("lo"), F.max("time").alias("hi")))).select("row_id", F.round(F.least(F.greatest("time", "lo"), F.col("hi")), 6).alias("v")))
_query("time_gap", O, "SELECT row_id, round((time - hi) / 365.0, 6) AS gap FROM q, spanv")(lambda i: i.rows.join(F.broadcast(i.train.agg(F.max("time").alias("hi")))).select("row_id", F.round((F.col("time") - F.col("hi")) / 365.0, 6).alias("gap")))
_query("stable_rank", O, "SELECT row_id, pos, rank FROM ranked")(lambda i: S.stable_rank(i.cells).select(*CELL, "rank"))
_query("top2_margin", O, "SELECT row_id, c1, c2, round(margin, 6) AS margin FROM tops")(lambda i: _r(rules.top_two(i.cells).select("row_id", "c1", "c2", "margin"), "margin"))
_query("softmax_top3", O, "SELECT row_id, cand, round(weight, 6) AS weight FROM top3")(lambda i: _r(feedback.softmax_top3(i.cells).select("row_id", "cand", "weight"), "weight"))
_query("content_digest", O, "SELECT row_id, sha256(concat_ws(',', CAST(src AS VARCHAR), CAST(dst AS VARCHAR))) AS digest FROM q")(lambda i: reports.content_digest(i.rows, "row_id", ["src", "dst"]))
_query("matrix_profile", O, "SELECT count(*) AS n_rows, sum(n) AS n_cells, 0 AS not_finite, min(lo) AS lowest, max(hi) AS highest, count(*) FILTER (lo = hi) AS degenerate_rows, count(*) FILTER (hi = 1.0) AS rows_at_one, count(*) FILTER (tops > 1) AS tied_top_rows FROM (SELECT row_id, count(*) AS n, min(score) AS lo, max(score) AS hi, count(*) FILTER (score = top) AS tops FROM (SELECT *, max(score) OVER (PARTITION BY row_id) AS top FROM cells) GROUP BY row_id)")(lambda i: reports.matrix_profile(i.cells))
_query("token_swap", O, "SELECT row_id, array_to_string(list_transform(range(1, 22), lambda k: toks[CASE WHEN row_id % 3 = 0 AND k = 1 THEN 3 WHEN row_id % 3 = 0 AND k = 3 THEN 1 ELSE k END]), ',') || chr(13) || chr(10) AS line FROM (SELECT row_id, list(printf('%.6f', score) ORDER BY pos) AS toks FROM cells GROUP BY row_id)")(lambda i: reports.token_swap(_lines(i), i.rows.where("row_id % 3 = 0").select("row_id", F.lit(0).alias("c1"), F.lit(2).alias("c2"))))
_query("epochs_from_log", E, "SELECT max(CAST(n AS BIGINT)) AS epochs FROM (SELECT unnest(regexp_extract_all('epoch ' || dst || '/400 done', 'epoch (\\d+)/\\d+', 1)) AS n FROM log)")(lambda i: reports.epochs_from_log(i.log.select(F.concat(F.lit("epoch "), F.col("dst"), F.lit("/400 done")).alias("value"))))


def _lines(i: Inputs) -> DataFrame:
    from ..sources.matrices import score_lines

    return score_lines(i.cells).withColumn("line", F.concat("line", F.lit("\r\n")))


_NEW = "CASE WHEN pos = 5 THEN 1 - score ELSE score END"
_query("matrix_diff", O, f"""SELECT count(*) FILTER (changed > 0) AS changed_rows, sum(changed) AS changed_cells, sum(top) AS top1_changes, count(*) FILTER (moved > 0) AS order_changed_rows, sum(inv) AS strict_inversions, sum(col) AS collapsed_pairs FROM (
  SELECT row_id, count(*) FILTER (x <> y) AS changed, count(*) FILTER (rx = 1 AND ry <> 1) AS top, count(*) FILTER (rx <> ry) AS moved FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY y DESC, pos) AS ry, rank AS rx FROM (SELECT *, score AS x, {_NEW} AS y FROM ranked)) GROUP BY row_id)
  JOIN (SELECT a.row_id, count(*) FILTER (a.x > b.x AND a.y < b.y) AS inv, count(*) FILTER (a.x > b.x AND a.y = b.y) AS col FROM (SELECT row_id, pos, score AS x, {_NEW} AS y FROM cells) a JOIN (SELECT row_id, pos, score AS x, {_NEW} AS y FROM cells) b ON b.row_id = a.row_id GROUP BY a.row_id) USING (row_id)""")(lambda i: reports.matrix_diff(i.cells, i.cells.withColumn("score", F.when(F.col("pos") == 5, 1 - F.col("score")).otherwise(F.col("score")))))
_query("top1_disagreement", O, f"SELECT count(*) AS n_rows, count(*) FILTER (a <> b) AS differ, round(count(*) FILTER (a <> b) / count(*), 6) AS rate FROM (SELECT row_id, arg_max(pos, (score, -pos)) AS a, arg_max(pos, ({_NEW}, -pos)) AS b FROM cells GROUP BY row_id)")(lambda i: replay.top1_disagreement(i.cells, i.cells.withColumn("score", F.when(F.col("pos") == 5, 1 - F.col("score")).otherwise(F.col("score")))))

# Structural rules.
_query("adjacent_shared_candidates", O, "SELECT row_id, len(common) AS n FROM common1")(lambda i: rules.adjacent_shared(i.sets).select("row_id", F.size("common").cast("long").alias("n")))
_query("triple_rule", O, "SELECT row_id, cand FROM triples")(lambda i: i.labelled[0])
_query("pair_labels", O, "SELECT row_id, cand FROM pairs")(lambda i: i.labelled[1])
_query("answer_labels", O, "SELECT row_id, cand, from_triple FROM labels_")(lambda i: i.labelled[2])
_query("structural_labels", O, "SELECT row_id, cand, from_triple FROM labels_")(lambda i: rules.structural_labels(i.sets))
_query("pair_promotion", O, "SELECT target AS row_id, min(c) AS cand FROM (SELECT c.row_id + 1 AS target, a.c1 AS c, b.c1 AS own, common FROM common1 c JOIN tops a ON a.row_id = c.row_id JOIN tops b ON b.row_id = c.row_id + 1 UNION ALL SELECT c.row_id, b.c1, a.c1, common FROM common1 c JOIN tops a ON a.row_id = c.row_id JOIN tops b ON b.row_id = c.row_id + 1) WHERE list_contains(common, c) AND c <> own AND target NOT IN (SELECT row_id FROM triples) GROUP BY target HAVING count(DISTINCT c) = 1")(lambda i: rules.pair_promotion(i.cells, i.sets, i.labelled[0]))
_query("zero_repeat_exclusion", O, "SELECT row_id, pos FROM excluded")(lambda i: _with_labels(i, rules.zero_repeat_exclusion))
_query("zero_repeat_demotions", O, "SELECT row_id, pos, level FROM demoted")(lambda i: _with_labels(i, rules.zero_repeat_demotions))
_query("apply_demotions", O, "SELECT c.row_id, c.pos, round(CASE WHEN count(level) OVER (PARTITION BY c.row_id) = 0 THEN score WHEN level IS NULL THEN 0.01 + 0.9899 * score ELSE 0.001 * level END, 6) AS score FROM cells c LEFT JOIN demoted d ON d.row_id = c.row_id AND d.pos = c.pos")(lambda i: _r(rules.apply_demotions(i.cells, rules.zero_repeat_demotions(i.cells, i.labelled[2], i.labelled[0])).select(*CELL, "score"), "score"))
_query("run_exclusion", O, "SELECT s.row_id, s.pos, 1 AS level FROM slates s JOIN (SELECT *, max(n) OVER (PARTITION BY time, cand) AS top FROM (SELECT *, count(*) OVER (PARTITION BY time, cand, isl) AS n FROM (SELECT *, row_id - row_number() OVER (PARTITION BY time, cand ORDER BY row_id) AS isl FROM (SELECT DISTINCT row_id, time, cand FROM slates JOIN warmd ON dst = cand)))) r ON r.row_id = s.row_id AND r.cand = s.cand WHERE top >= 2 AND n < top AND NOT EXISTS (SELECT 1 FROM triples t WHERE t.row_id = s.row_id AND t.cand = s.cand)")(lambda i: byblock.run_exclusion(i.numbered_once().by_block, i.train, dealt=True))
_query("cross_time_exclusivity", O, "SELECT r.row_id, r.pos, round(CASE WHEN k.times >= 2 AND k.place > 1 THEN CASE WHEN r.pos = t.p1 THEN t.s2 WHEN r.pos = t.p2 THEN t.s1 ELSE r.score END ELSE r.score END, 6) AS score, k.times >= 2 AND k.place > 1 AS acted FROM cells r JOIN tops t ON t.row_id = r.row_id JOIN clusters k ON k.src = t.src AND k.c1 = t.c1 AND k.time = t.time")(lambda i: _r(rules.cross_time_exclusivity(i.cells).select(*CELL, "score", "acted"), "score"))
_query("exclusivity_census", O, "SELECT sum(n) AS n_rows, count(*) AS src_top1_groups, count(*) FILTER (n >= 2) AS groups_multirow, count(*) FILTER (n >= 2 AND times = 1) AS groups_multirow_same_time_only, count(*) FILTER (times >= 2) AS violation_groups, sum(n) FILTER (times >= 2) AS rows_in_violation_groups, sum(n - largest) FILTER (times >= 2) AS guaranteed_wrong, sum(n - keep) FILTER (times >= 2) AS planned_action_rows, sum(keep) FILTER (times >= 2) AS keeper_rows, max(n) FILTER (times >= 2) AS max_violation_group_size FROM (SELECT src, c1, sum(size) AS n, max(size) AS largest, max(times) AS times, sum(size) FILTER (place = 1) AS keep FROM clusters GROUP BY src, c1)")(lambda i: rules.exclusivity_census(i.cells))
_query("history_mask_demote", E, "SELECT row_id, pos, round((v - min(v) OVER (PARTITION BY row_id)) / (max(v) OVER (PARTITION BY row_id) - min(v) OVER (PARTITION BY row_id)), 6) AS score FROM (SELECT *, CASE WHEN in_history THEN min(score) OVER (PARTITION BY row_id) - 1 ELSE score END AS v FROM flagged)")(lambda i: _r(rules.history_mask_demote(i.cells, i.train).select(*CELL, "score"), "score"))

_RECUR = """SELECT *, (NOT topin AND alone = 1 AND best >= 2 AND elig = best AND rank <> 1) AS acted FROM (SELECT *, max(elig) OVER r AS best, sum(CASE WHEN elig = best0 THEN 1 ELSE 0 END) OVER r AS alone, bool_or(in_history AND rank = 1) OVER r AS topin FROM (SELECT *, max(elig) OVER (PARTITION BY row_id) AS best0 FROM (SELECT *, CASE WHEN NOT in_history THEN count(*) OVER (PARTITION BY src, cand) - 1 END AS elig FROM flagged)) WINDOW r AS (PARTITION BY row_id))"""
_LIFT = "SELECT row_id, src, pos, cand, coalesce(acted, false) AS acted, v / max(v) OVER (PARTITION BY row_id) AS score FROM (SELECT *, CASE WHEN acted THEN max(score) OVER r + greatest(max(score) OVER r - min(score) OVER r, 1) + 1 ELSE score END AS v FROM ({}) WINDOW r AS (PARTITION BY row_id))"
_query("source_slate_recurrence", O, f"SELECT row_id, pos, acted, round(score, 6) AS score FROM ({_LIFT.format(_RECUR)})")(lambda i: _r(rules.source_slate_recurrence(i.cells, i.train).select(*CELL, "acted", "score"), "score"))
_RECIP = "SELECT *, (NOT h1 AND NOT h2 AND r2 AND NOT r1 AND rank = 2) AS acted FROM (SELECT *, bool_or(in_history AND rank = 1) OVER r AS h1, bool_or(in_history AND rank = 2) OVER r AS h2, bool_or(rev AND rank = 1) OVER r AS r1, bool_or(rev AND rank = 2) OVER r AS r2 FROM (SELECT f.*, EXISTS (SELECT 1 FROM pool p WHERE p.src = f.cand AND p.cand = f.src) AS rev FROM {} f) WINDOW r AS (PARTITION BY row_id))"
_query("graph_reciprocity", E, f"SELECT row_id, pos, acted, round(score, 6) AS score FROM ({_LIFT.format(_RECIP.format('flagged'))})")(lambda i: _r(rules.graph_reciprocity(i.cells, i.train).select(*CELL, "acted", "score"), "score"))
_CHAIN = f"(SELECT a.* EXCLUDE (acted), row_number() OVER (PARTITION BY row_id ORDER BY score DESC, pos) AS rank, w.w IS NOT NULL AS in_history FROM ({_LIFT.format(_RECUR)}) a LEFT JOIN w ON w.src = a.src AND w.dst = a.cand)"
_query("ds1_chain", O, f"SELECT row_id, pos, round(score, 6) AS score FROM ({_LIFT.format(_RECIP.format(_CHAIN))})")(lambda i: _r(bysource.ds1_chain(i.numbered_once().by_source, i.train, dealt=True), "score"))
_query("reliability_bins", O, """SELECT b AS bin, n1, n5, round(p, 6) AS p, round(least(greatest(exp(lo - sum(lo * n1) OVER () / sum(n1) OVER ()), 0.3), 3.0), 6) AS factor FROM (SELECT *, ln(p / (1 - p)) AS lo FROM (SELECT b, n1, n5, least(greatest(1 - (n5 / e5) / greatest(n1 / e1, 1e-12), 0.02), 0.995) AS p FROM (
  SELECT b, (SELECT count(*) FROM f1, edges WHERE len(list_filter(e, lambda x: x <= f)) = b) AS n1, (SELECT count(*) FROM f5, edges WHERE len(list_filter(e, lambda x: x <= f)) = b) AS n5, (SELECT count(*) FROM common1) AS e1, (SELECT count(*) FROM common5) AS e5 FROM range(5) AS r(b))))""".replace("f1,", "(SELECT freq AS f FROM common1 JOIN freqs ON cand = common[1] WHERE len(common) = 1) f1,").replace("f5,", "(SELECT freq AS f FROM (SELECT list_intersect(a.warm, b.warm) AS common FROM sets a JOIN sets b ON b.row_id = a.row_id + 5 WHERE a.time = b.time AND a.src <> b.src) JOIN freqs ON cand = common[1] WHERE len(common) = 1) f5,").replace("edges WHERE", "(SELECT quantile_cont(freq, [0.2, 0.4, 0.6, 0.8]) AS e FROM common1 JOIN freqs ON cand = common[1] WHERE len(common) = 1) edges WHERE").replace("FROM common5)", "FROM sets a JOIN sets b ON b.row_id = a.row_id + 5 WHERE a.time = b.time AND a.src <> b.src)"))(lambda i: _r(rules.reliability_bins(i.slates, i.sets), "p", "factor"))

# Feedback, features, blends and metrics.
_FB = """SELECT c.row_id, c.pos, round(coalesce(CASE WHEN k < n THEN greatest(m, 0) ELSE m END, 0), 6) AS fb_max, round(coalesce(s / n, 0), 6) AS fb_mean FROM cells c LEFT JOIN (SELECT row_id, count(*) AS n FROM sib GROUP BY row_id) n ON n.row_id = c.row_id
  LEFT JOIN (SELECT row_id, cand, max(v) AS m, sum(v) AS s, count(*) AS k FROM (SELECT c.row_id, sib.sib, c.cand, sum(round(t.weight * x.sim, 12)) AS v FROM (SELECT DISTINCT row_id, cand FROM cells) c JOIN sib ON sib.row_id = c.row_id JOIN top3 t ON t.row_id = sib.sib JOIN ({}) x ON x.a = c.cand AND x.b = t.cand GROUP BY 1, 2, 3) GROUP BY row_id, cand) g ON g.row_id = c.row_id AND g.cand = c.cand"""
_query("basket_feedback", O, _FB.format("SELECT p.dst AS a, r.dst AS b, count(*) / (sqrt(any_value(pn)) * sqrt(any_value(rn))) AS sim FROM (SELECT DISTINCT dst, src, count(DISTINCT src) OVER (PARTITION BY dst) AS pn FROM train) p JOIN (SELECT DISTINCT dst, src, count(DISTINCT src) OVER (PARTITION BY dst) AS rn FROM train) r USING (src) GROUP BY p.dst, r.dst"))(lambda i: _r(feedback.basket_feedback(i.by_source, i.train), "fb_max", "fb_mean"))
_query("basket_feedback_dense", O, _FB.format("SELECT p.id AS a, r.id AS b, list_dot_product(p.vec, r.vec) AS sim FROM unit p, unit r"))(lambda i: _r(feedback.basket_feedback_dense(i.by_source, i.vectors), "fb_max", "fb_mean"))
_DS1 = ["f_collab", "f_rpop", "f_icf_mean", "f_icf_top3", "f_dot", "f_cooc", "recency", "pop_log", "time_gap", "f_short", "f_long", "f_diff", "f_freq", "f_ratio", "last_gap", "f_new"]
_DS2 = ["f_collab", "f_rpop", "f_icf_mean", "f_icf_top3", "f_dot", "blend", "recency", "pop_log", "time_gap", "f_short", "f_long", "f_diff", "f_freq", "f_ratio"]
_MORE = "(SELECT *, f_short - f_long AS f_diff, (time - hi) / 365.0 AS time_gap, (time - last) / 365.0 AS last_gap, CASE WHEN n_hist > 0 THEN 1 ELSE 0 END AS in_hist, count(*) OVER (PARTITION BY row_id) AS width, 0.25 * f_collab + 1.25 * f_rpop + 0.5 * f_icf_mean + 1.0 * f_icf_top3 + 0.7 * f_dot AS blend FROM feats)"
_COOC = f"(SELECT f.*, {_norm('cooc')} AS f_cooc FROM {_MORE} f JOIN coocs USING (src, cand))"
_rounded = lambda names: ", ".join(f"round({n} + 1e-9, 5) AS {n}" for n in names)
_query("features_ds1", E, f"SELECT row_id, pos, cand, label, hist_len, in_hist, n_hist, seen, width, {_rounded(_DS1)} FROM {_COOC}")(lambda i: _r(P.features_ds1(i.slates, i.train, i.vectors), *_DS1, places=5, shift=1e-9))
_query("features_ds2", O, f"SELECT row_id, pos, cand, label, hist_len, in_hist, seen, width, {_rounded(_DS2)} FROM {_MORE}")(lambda i: _r(P.features_ds2(i.once().by_source, i.train, i.vectors), *_DS2, places=5, shift=1e-9))
_query("linear_blend_ds1", E, f"SELECT row_id, pos, cand, label, round(16 * n_hist + 0.5 * f_collab + 1.25 * f_rpop + 2.0 * f_icf_mean + 1.2 * f_icf_top3 + 0.3 * f_cooc + 9.0 * f_dot, 5) AS score FROM {_COOC}")(lambda i: _r(P.linear_blend_ds1(P.features_ds1(i.slates, i.train, i.vectors)), "score", places=5))
_query("linear_blend_ds2", O, f"SELECT row_id, pos, cand, label, round(CASE WHEN in_hist = 1 THEN 0 ELSE blend END, 5) AS score FROM {_MORE}")(lambda i: _r(P.linear_blend_ds2(P.features_ds2(i.once().by_source, i.train, i.vectors)), "score", places=5))
_SIMPLE = f"(SELECT *, 16 * n_hist + 1.25 * ({_norm('rpop')}) AS s FROM (SELECT f.*, coalesce(rpop, 0) AS rpop FROM flagged f LEFT JOIN rpops r ON r.dst = f.cand))"
_MRR = "SELECT count(*) AS n_rows, round(avg(1 / rank), 6) AS mrr FROM (SELECT a.row_id, any_value(1 + (SELECT count(*) FROM {0} b WHERE b.row_id = a.row_id AND b.label = 0 AND b.s >= a.s)) AS rank FROM {0} a WHERE a.label = 1 GROUP BY a.row_id)"
_query("simple_blend", E, f"SELECT row_id, pos, round(s, 6) AS score FROM {_SIMPLE}")(lambda i: _r(P.simple_blend(i.slates, i.train).select(*CELL, "score"), "score"))
_query("mrr", E, f"SELECT count(*) AS n_rows, round(avg(1 / rank), 6) AS mrr FROM (SELECT row_id, 1 + count(*) FILTER (label = 0 AND s >= own) AS rank FROM (SELECT *, max(CASE WHEN label = 1 THEN s END) OVER (PARTITION BY row_id) AS own FROM {_SIMPLE}) GROUP BY row_id)")(lambda i: replay.mrr(P.simple_blend(i.slates, i.train)))
_query("eval_mrr", O, f"SELECT count(*) AS n_rows, round(avg(1 / rank), 6) AS mrr FROM (SELECT row_id, 1 + count(*) FILTER (label = 0 AND s >= own) AS rank FROM (SELECT *, max(CASE WHEN label = 1 THEN s END) OVER (PARTITION BY row_id) AS own FROM (SELECT *, round(CASE WHEN in_hist = 1 THEN 0 ELSE blend END, 9) AS s FROM {_MORE})) GROUP BY row_id)")(lambda i: replay.mrr(_r(P.linear_blend_ds2(P.features_ds2(i.once().by_source, i.train, i.vectors)), "score", places=9), together=True))
_MM = "(score - min(score) OVER (PARTITION BY row_id)) / (max(score) OVER (PARTITION BY row_id) - min(score) OVER (PARTITION BY row_id))"
_query("consensus_blend", O, f"SELECT row_id, pos, round(({_MM} + {_MM.replace('score', 'other')}) / 2 + 1e-9, 6) AS score FROM (SELECT *, ((cand * 31 + pos) % 97) / 96.0 AS other FROM cells)")(lambda i: _r(P.consensus_blend([i.cells, i.cells.withColumn("score", ((F.col("cand") * 31 + F.col("pos")) % 97) / 96.0)]), "score", shift=1e-9))

# Replay.
_REPLAY = "SELECT row_id AS qid, src, dst, time FROM q WHERE src IN (SELECT src FROM pool)"
_NEG = f"SELECT qid, src, time, cand FROM (SELECT p.*, pool.cand, row_number() OVER (PARTITION BY qid ORDER BY md5(concat_ws('-', qid, cand)), cand) AS place FROM ({_REPLAY}) p JOIN pool ON pool.src = p.src WHERE cand <> dst AND cand <> p.src) WHERE place <= 99"
_query("replay_positives", O, _REPLAY)(lambda i: replay.replay_positives(i.rows, i.slates).select(F.col("row_id").alias("qid"), "src", "dst", "time"))
_query("replay_negatives", E, f"SELECT qid, cand FROM ({_NEG})")(lambda i: replay.replay_negatives(i.rows.withColumnRenamed("row_id", "qid"), popularity.candidate_pool(i.slates)))
_query("replay_queries", E, f"SELECT qid, src, time, row_number() OVER (PARTITION BY qid ORDER BY label, cand) - 1 AS pos, cand, label FROM (SELECT *, 0 AS label FROM ({_NEG}) UNION ALL SELECT qid, src, time, dst, 1 FROM ({_REPLAY}))")(lambda i: replay.replay_queries(i.rows, popularity.candidate_pool(i.slates)))
_query("source_folds", O, "SELECT src, CAST('0x' || md5(CAST(src AS VARCHAR))[1:8] AS BIGINT) % 2 AS fold FROM (SELECT DISTINCT src FROM log)")(lambda i: replay.source_folds(i.log))
_query("query_subsample", E, "SELECT row_id AS qid FROM q ORDER BY md5(CAST(row_id AS VARCHAR)), row_id LIMIT 100")(lambda i: replay.query_subsample(i.rows.select(F.col("row_id").alias("qid")), 100))

# Not expressible in SQL, or approximate: checked by tests.
_query("equality_crf", O)(lambda i: _r(crf.equality_crf(written(i.cells, "cells"), i.train).select(*CELL, "score"), "score"))
_query("ds2_chain", O)(lambda i: _r(bystretch.ds2_chain(T.scored(i.numbered_once().by_block), i.train, lambda place: T.scored(T.slates(i.log, by="part", rows=place(i.numbered)))), "score"))
_query("svd_geometry", O)(lambda i: models.svd_geometry(i.train, 128))
_query("bpr_embedding", E)(lambda i: embedding.train_embedding(i.train, "bpr", epochs=3))
_query("line_embedding", E)(lambda i: embedding.train_embedding(i.train, "line", epochs=3, tau=0.25))
_query("equality_crf_band", O)(lambda i: _r(crf.equality_crf(written(i.cells, "cells"), i.train, width=3, power=0.5, eta=1.0).select(*CELL, "score"), "score"))
_BAND = " UNION ALL ".join(f"SELECT a.row_id, {d} AS distance, unnest(list_intersect(a.warm, b.warm)) AS cand FROM sets a JOIN sets b ON b.row_id = a.row_id + {d} WHERE a.time = b.time AND a.src <> b.src" for d in (1, 2, 3))
_query("band_shared_candidates", O, _BAND)(lambda i: rules.band_shared(written(i.sets, "sets"), 3))
_query("before_tail", E, "SELECT src, dst, time FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY time DESC, dst DESC) AS r FROM log) WHERE r > 1")(lambda i: popularity.before_tail(i.log))
_query("clip_ids", E, "SELECT row_id, pos, least(greatest(cand, 0), 49) AS cand FROM slates")(lambda i: popularity.clip_ids(i.slates, "cand", 50).select(*CELL, "cand"))
_query("tie_baseline", O, "SELECT width, round((SELECT sum(1.0 / k) FROM range(1, 22) AS r(k)) / width, 9) AS mrr FROM (SELECT max(pos) + 1 AS width FROM slates)")(lambda i: i.slates.agg((F.max("pos") + 1).alias("width")).select("width", F.lit(round(popularity.tie_baseline(T.WIDTH), 9)).alias("mrr")))
_query("score_matrix_scan", O, "SELECT row_id, pos, round(score, 6) AS score FROM cells")(lambda i: _score_matrix(i))
_query("real_candidate_eval", E)(lambda i: chains.real_candidate_eval(i.log, popularity.candidate_pool(i.slates), P.simple_blend))


def _score_matrix(i: Inputs) -> DataFrame:
    """The scores written as lines of text and read again."""
    from ..sources import matrices
    from ..sources.shared import shared_folder

    path = f"{shared_folder(i.spark)}/matrix-{uuid.uuid4().hex}"
    matrices.write_score_matrix(i.cells, path)
    return matrices.read_score_matrix(i.spark, path, T.WIDTH)


@_query("three_pass", E)
def _three_pass(i: Inputs) -> DataFrame:
    cells = written(i.cells.drop("score"), "cells")
    rows = history.history_count(P.with_candidates(cells, i.train), i.train).select("row_id", "pos", "cand", "label", "n_hist", "rpop", "pop_log", "recency", "freq")
    return replay.mrr(chains.three_pass(cells, i.train, rows, ["n_hist", "rpop", "pop_log", "recency", "freq"], rounds=2, rate=0.3, depth=3))


@_query("lambdamart", E)
def _lambdamart(i: Inputs) -> DataFrame:
    from ..operators.replay import mrr

    freq = P.with_candidates(i.slates, i.train)
    rows = history.history_count(freq, i.train).withColumnRenamed("row_id", "qid").select("qid", "pos", "label", "n_hist", "rpop", "pop_log", "recency", "freq")
    score = models.lambdamart(rows, ["n_hist", "rpop", "pop_log", "recency", "freq"], rounds=3, rate=0.3, depth=3)
    return mrr(score(rows).select(F.col("qid").alias("row_id"), "pos", "label", F.col("prediction").alias("score")))
