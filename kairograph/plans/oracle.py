"""The registered queries in SQL for an independent engine: shared views, and one statement per query."""

from __future__ import annotations

LOGS = {
    "orders": "SELECT o_custkey AS src, l_partkey AS dst, CAST(CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS DOUBLE) AS time FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "events": "SELECT user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst, CAST(CAST(floor(epoch(ts) / 86400) AS BIGINT) AS DOUBLE) AS time FROM events",
}

_VIEWS = {
    "log": None,
    "cutv": "SELECT quantile_cont(time, 0.75) AS cut FROM log",
    "train": "SELECT log.* FROM log, cutv WHERE time <= cut",
    "test": "SELECT log.* FROM log, cutv WHERE time > cut",
    "q": "SELECT *, row_number() OVER (ORDER BY time, dst, src) - 1 AS row_id, row_number() OVER (PARTITION BY time ORDER BY dst, src) - 1 AS rn FROM (SELECT DISTINCT src, dst, time FROM test)",
    "nd": "SELECT max(dst) + 1 AS n FROM log",
    "slates": """SELECT row_id, src, time, j AS pos, CASE WHEN j = row_id % 20 THEN 1 ELSE 0 END AS label,
      CASE WHEN j = row_id % 20 THEN dst WHEN j = 20 THEN n + src % 50
        WHEN j = (row_id + 1) % 20 THEN (CAST(time AS BIGINT) * 7 + (rn // 3) * 5) % n
        ELSE (src * 37 + j * j * 13 + (row_id % 4) * 11 * j) % n END AS cand FROM q, nd, range(21) AS r(j)""",
    "cells": "SELECT *, ((cand * 7919 + row_id * 1047 + pos * 37) % 1009) / 1008.0 AS score FROM slates",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, pos) AS rank FROM cells",
    "w": "SELECT src, dst, count(*) AS w FROM train GROUP BY src, dst",
    "flagged": "SELECT c.*, w.w IS NOT NULL AS in_history, coalesce(w.w, 0) AS n_hist FROM ranked c LEFT JOIN w ON w.src = c.src AND w.dst = c.cand",
    "warmd": "SELECT DISTINCT dst FROM train",
    "sets": "SELECT row_id, src, time, list_sort(list(DISTINCT cand) FILTER (WHERE dst IS NOT NULL)) AS warm FROM slates LEFT JOIN warmd ON dst = cand GROUP BY row_id, src, time",
    "common1": "SELECT a.row_id, list_intersect(a.warm, b.warm) AS common FROM sets a JOIN sets b ON b.row_id = a.row_id + 1 WHERE a.time = b.time AND a.src <> b.src",
    "triple_hits": "SELECT a.row_id, list_intersect(list_intersect(a.warm, b.warm), c.warm) AS common FROM sets a JOIN sets b ON b.row_id = a.row_id + 1 JOIN sets c ON c.row_id = a.row_id + 2 WHERE a.time = b.time AND a.time = c.time AND a.src <> b.src AND a.src <> c.src AND b.src <> c.src",
    "triples": "SELECT row_id + k AS row_id, min(common[1]) AS cand FROM triple_hits, range(3) AS r(k) WHERE len(common) = 1 GROUP BY 1 HAVING count(DISTINCT common[1]) = 1",
    "pairs": "SELECT row_id + k AS row_id, min(common[1]) AS cand FROM common1 c, range(2) AS r(k) WHERE len(common) = 1 AND row_id NOT IN (SELECT row_id FROM triples) AND row_id + 1 NOT IN (SELECT row_id FROM triples) GROUP BY 1 HAVING count(DISTINCT common[1]) = 1",
    "labels_": "SELECT coalesce(t.row_id, p.row_id) AS row_id, coalesce(t.cand, p.cand) AS cand, t.cand IS NOT NULL AS from_triple FROM triples t FULL JOIN pairs p ON p.row_id = t.row_id",
    "excluded": "SELECT DISTINCT c.row_id, c.pos FROM cells c JOIN (SELECT DISTINCT q.src, l.cand, q.time FROM labels_ l JOIN q ON q.row_id = l.row_id) l ON l.src = c.src AND l.cand = c.cand AND l.time <> c.time WHERE NOT EXISTS (SELECT 1 FROM triples t WHERE t.row_id = c.row_id AND t.cand = c.cand)",
    "dups": "SELECT row_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY row_id, cand) AS n FROM cells) c WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM triples t WHERE t.row_id = c.row_id AND t.cand = c.cand)",
    "demoted": "SELECT row_id, pos, max(level) AS level FROM (SELECT row_id, pos, 2 AS level FROM excluded UNION ALL SELECT row_id, pos, 1 FROM dups) GROUP BY row_id, pos",
    "tops": "SELECT row_id, src, time, max(cand) FILTER (rank = 1) AS c1, max(cand) FILTER (rank = 2) AS c2, max(pos) FILTER (rank = 1) AS p1, max(pos) FILTER (rank = 2) AS p2, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS margin FROM ranked GROUP BY row_id, src, time",
    "clusters": "SELECT *, row_number() OVER (PARTITION BY src, c1 ORDER BY top DESC, time) AS place, count(*) OVER (PARTITION BY src, c1) AS times FROM (SELECT src, c1, time, max(margin) AS top, count(*) AS size FROM tops GROUP BY src, c1, time)",
    "emb": "SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings",
    "unit": "SELECT id, list_transform(vec, lambda x: x / greatest(sqrt(list_sum(list_transform(vec, lambda y: y * y))), 1e-8)) AS vec FROM emb",
    "wanted": "SELECT DISTINCT src, cand FROM slates",
    "sims": "SELECT p.src, p.cand, w.dst, w.w, coalesce(round(list_dot_product(a.vec, b.vec), 12), 0.0) AS sim FROM wanted p JOIN w ON w.src = p.src LEFT JOIN unit a ON a.id = p.cand LEFT JOIN unit b ON b.id = w.dst",
    "icf": "SELECT src, cand, greatest(sum(sim * w) / sum(w), 0) AS icf_mean, greatest(sum(sim * part) / sum(part), 0) AS icf_top3 FROM (SELECT *, greatest(0, least(w, 3 - (sum(w) OVER (PARTITION BY src, cand ORDER BY sim DESC, dst ROWS UNBOUNDED PRECEDING) - w))) AS part FROM sims) GROUP BY src, cand",
    "dots": "SELECT p.src, p.cand, coalesce(greatest(list_dot_product(a.vec, b.vec), 0), 0) AS dot_a, coalesce(greatest(list_dot_product(a.vec[1:32], b.vec[1:32]), 0), 0) AS dot_b FROM wanted p LEFT JOIN emb a ON a.id = p.src LEFT JOIN emb b ON b.id = p.cand",
    "nbrs": "SELECT src, nbr, rank, CASE WHEN abs(wt) < 1e-8 THEN 0 ELSE wt END AS weight FROM (SELECT *, CASE WHEN rank <= 5 THEN sim ELSE sim * 0.2 END AS wt FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, nbr) AS rank FROM (SELECT a.id AS src, b.id AS nbr, CASE WHEN a.id = b.id THEN 0.0 ELSE round(list_dot_product(a.vec, b.vec), 9) END AS sim FROM unit a, unit b WHERE a.id IN (SELECT src FROM slates))) WHERE rank <= 20)",
    "collab": "SELECT p.src, p.cand, coalesce(sum(n.weight * w.w), 0) AS collab FROM wanted p LEFT JOIN (nbrs n JOIN w ON w.src = n.nbr) ON n.src = p.src AND w.dst = p.cand GROUP BY p.src, p.cand",
    "popd": "SELECT dst, count(*) AS n FROM train GROUP BY dst",
    "x": "SELECT a.src, b.src AS u, sum(a.w * b.w) AS x FROM w a JOIN w b ON b.dst = a.dst AND b.src <> a.src WHERE a.src IN (SELECT src FROM slates) GROUP BY a.src, b.src",
    "coocs": "SELECT p.src, p.cand, coalesce(sum(x.x * w.w), 0) / sqrt(coalesce(any_value(d.n) + 1, 1)) AS cooc FROM wanted p LEFT JOIN w ON w.dst = p.cand LEFT JOIN x ON x.src = p.src AND x.u = w.src LEFT JOIN popd d ON d.dst = p.cand GROUP BY p.src, p.cand",
    "rpops": "SELECT dst, ln(1 + count(*)) AS rpop FROM train WHERE time >= (SELECT quantile_cont(time, 0.8) FROM train) GROUP BY dst",
    "spanv": "SELECT min(time) AS lo, max(time) AS hi FROM train",
    "wins": "SELECT dst, ln(1 + count(*) FILTER (time >= hi - 0.05 * (hi - lo))) AS pop_short, ln(1 + count(*) FILTER (time >= hi - 0.40 * (hi - lo))) AS pop_long, (max(time) - any_value(lo)) / (any_value(hi) - any_value(lo)) AS recency FROM train, spanv GROUP BY dst",
    "freqs": "SELECT cand, count(*) AS freq, ln(1 + count(*)) AS freq_log FROM slates GROUP BY cand",
    "raw": """SELECT s.row_id, s.src, s.time, s.pos, s.cand, s.label, CASE WHEN d.dst IS NULL THEN 0 ELSE 1 END AS seen, coalesce(d.n + 1, 1) AS pop, ln(1 + coalesce(d.n + 1, 1)) AS pop_log,
      coalesce(rpop, 0) AS rpop, coalesce(pop_short, 0) AS pop_short, coalesce(pop_long, 0) AS pop_long, coalesce(recency, 0) AS recency, freq, freq_log, coalesce(icf_mean, 0) AS icf_mean, coalesce(icf_top3, 0) AS icf_top3,
      dot_a, dot_b, collab, coalesce(w.w, 0) AS n_hist, coalesce(h.n, 0) AS hist_len, coalesce(l.last, lo) AS last, hi
      FROM slates s LEFT JOIN popd d ON d.dst = s.cand LEFT JOIN rpops r ON r.dst = s.cand LEFT JOIN wins ON wins.dst = s.cand JOIN freqs f ON f.cand = s.cand
      LEFT JOIN icf i ON i.src = s.src AND i.cand = s.cand JOIN dots t ON t.src = s.src AND t.cand = s.cand JOIN collab k ON k.src = s.src AND k.cand = s.cand
      LEFT JOIN w ON w.src = s.src AND w.dst = s.cand LEFT JOIN (SELECT src, count(*) AS n FROM train GROUP BY src) h ON h.src = s.src LEFT JOIN (SELECT src, max(time) AS last FROM train GROUP BY src) l ON l.src = s.src, spanv""",
    "sib": "SELECT a.row_id, b.row_id AS sib FROM q a JOIN q b ON b.src = a.src AND b.time = a.time AND b.row_id <> a.row_id",
    "top3": "SELECT row_id, pos, cand, exp(score - max(score) OVER (PARTITION BY row_id)) / sum(exp(score - m)) OVER (PARTITION BY row_id) AS weight FROM (SELECT *, max(score) OVER (PARTITION BY row_id) AS m FROM ranked) WHERE rank <= 3",
    "pool": "SELECT DISTINCT src, cand FROM slates",
}


def _norm(v: str, by: str = "row_id") -> str:
    return f"CASE WHEN max({v}) OVER (PARTITION BY {by}) > 1e-12 THEN {v} / max({v}) OVER (PARTITION BY {by}) ELSE {v} END"


_VIEWS["feats"] = f"""SELECT *, {_norm('collab')} AS f_collab, {_norm('rpop')} AS f_rpop, {_norm('icf_mean')} AS f_icf_mean, {_norm('icf_top3')} AS f_icf_top3, ({_norm('dot_a')} + {_norm('dot_b')}) / 2 AS f_dot,
  {_norm('pop_short')} AS f_short, {_norm('pop_long')} AS f_long, {_norm('freq_log')} AS f_freq, {_norm('(pop / (freq + 1))')} AS f_ratio, CASE WHEN n_hist > 0 THEN 0 ELSE {_norm('dot_b')} END AS f_new FROM raw"""


def statement(kind: str, body: str) -> str:
    """The body with the views that it needs, over the log of that kind."""
    import re

    views = _VIEWS | {"log": LOGS[kind]}
    need: list[str] = []
    met: set[str] = set()

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN|,)\s*[(]?\s*(\w+)", text)):
            if word in views and word not in met:
                met.add(word)
                visit(views[word])
                need.append(word)

    visit(body)
    return ("WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in need) + "\n" if need else "") + body
