"""Embedding trainers for graphs of any size: stochastic gradients over blocks of the adjacency matrix.

Ids are dealt by hash into an odd number P of parts, so many that a part's
vectors and an average block's edges fit a task. An epoch has P rounds. In round r
part a meets part (r - a) mod P: every pair of parts meets once, and no part is in
two blocks of a round, so a round's blocks are trained side by side, each with its
own parts' vectors and edges. After a round all vectors are written, and a lost
executor costs one round's blocks. A small graph has one part and one block; there
is no other method beyond some size. An id with very many edges has them spread
over the P blocks of its part.

Negatives of an edge are drawn from the part of its destination, so every
observed pair that they might hit is an edge of the same block, and is seen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Bytes of vectors in a part, and edges of an average block.
PART_BYTES, BLOCK_EDGES = 64 << 20, 2_000_000
#: Times that a negative is drawn again if it is an edge; what still is one then counts for nothing.
REDRAWS = 30


@dataclass(frozen=True)
class Settings:
    """How to train. ``negatives`` an edge, drawn evenly or by degree ** 0.75; ``tau`` weighs recent edges (a fraction of the span)."""

    kind: str
    dim: int = 16
    epochs: int = 5
    rate: float = 0.05
    batch: int = 4096
    negatives: int = 5
    by_degree: bool = False
    second: float = 0.5
    decay: float = 0.0
    clip: float = 1.0
    tau: float = 0.0
    seed: int = 42

    @property
    def tables(self) -> int:
        return 3 if self.kind == "line" else 1


def settings(kind: str, **given) -> Settings:
    """``line``: first and second order, BCE with five even negatives, three tables. ``bpr``: one table, a pairwise loss with one negative by degree."""
    if kind == "line":
        return Settings("line", **given)
    if kind == "bpr":
        return Settings("bpr", **({"negatives": 1, "by_degree": True, "decay": 1e-6, "clip": 0.0} | given))
    raise ValueError(f"unknown kind {kind}")


class Adam:
    """Rows' vectors with moments of their own; only rows that a batch touches move."""

    def __init__(self, state, tables: int, dim: int):
        size = tables * dim
        self.x, self.m, self.v, self.steps = state[:, :size], state[:, size : 2 * size], state[:, 2 * size : 3 * size], state[:, -1]

    def step(self, rows, grad, given: Settings) -> None:
        import numpy as np

        if given.clip:
            grad *= min(1.0, given.clip / (np.sqrt((grad**2).sum()) + 1e-12))
        if given.decay:
            grad += given.decay * self.x[rows]
        self.steps[rows] += 1
        n = self.steps[rows][:, None]
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * grad
        self.v[rows] = 0.999 * self.v[rows] + 0.001 * grad**2
        self.x[rows] -= given.rate * (self.m[rows] / (1 - 0.9**n)) / (np.sqrt(self.v[rows] / (1 - 0.999**n)) + 1e-8)


def _sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradients(x, u, v, q, ok, given: Settings):
    """Rows, their gradients, and the mean loss of edges ``u, v`` with negatives ``q[edge, k]`` where ``ok``."""
    import numpy as np

    d, n = given.dim, len(u)
    s, t = np.concatenate([u, np.repeat(u, q.shape[1])]), np.concatenate([v, q.ravel()])
    weight = np.concatenate([np.ones(n), ok.ravel().astype(float)])
    rows, place = np.unique(np.concatenate([s, t]), return_inverse=True)
    at, to = place[: len(s)], place[len(s) :]
    own, grad = x[rows].astype(np.float64), np.zeros((len(rows), x.shape[1]))
    if given.kind == "line":
        label = np.concatenate([np.ones(n), np.zeros(q.size)])
        loss = 0.0
        for a, b, share in ((0, 0, 1.0), (1, 2, given.second)):
            left, right = own[at, a * d : (a + 1) * d], own[to, b * d : (b + 1) * d]
            p = _sigmoid((left * right).sum(1))
            g = (share * weight * (p - label) / weight.sum())[:, None]
            np.add.at(grad[:, a * d : (a + 1) * d], at, g * right)
            np.add.at(grad[:, b * d : (b + 1) * d], to, g * left)
            loss += share * float(-(weight * np.log(np.where(label > 0, p, 1 - p) + 1e-12)).sum() / weight.sum())
        return rows, grad, loss
    k = q.shape[1]
    users, good, bad = at[n:], np.repeat(to[:n], k), to[n:]
    diff = own[good] - own[bad]
    w = weight[n:] / max(weight[n:].sum(), 1.0)
    p = _sigmoid((own[users] * diff).sum(1))
    g = (w * (p - 1))[:, None]
    np.add.at(grad, users, g * diff)
    np.add.at(grad, good, g * own[users])
    np.add.at(grad, bad, -g * own[users])
    return rows, grad, float(-(w * np.log(p + 1e-12)).sum())


def draw_negatives(u, v, part, degree, given: Settings, rng):
    """``(q, ok)``: for each edge ids of the destination's part, drawn again while they are edges of ``u`` (pairs in ``u, v``)."""
    import numpy as np

    n = len(part)
    seen = np.unique(u * n + v)
    q, ok = np.zeros((len(u), given.negatives), np.int64), np.zeros((len(u), given.negatives), bool)
    for p in np.unique(part[v]):
        members = np.flatnonzero(part == p)
        weight = (degree[members] + 1.0) ** 0.75 if given.by_degree else np.ones(len(members))
        cdf = np.cumsum(weight) / weight.sum()
        edge = np.flatnonzero(part[v] == p)
        own, rest = np.zeros(len(edge) * given.negatives, np.int64), np.arange(len(edge) * given.negatives)
        source = np.repeat(u[edge], given.negatives)
        for _ in range(REDRAWS + 1):
            own[rest] = members[np.searchsorted(cdf, rng.random(len(rest))).clip(0, len(members) - 1)]
            key = source[rest] * n + own[rest]
            rest = rest[seen[np.searchsorted(seen, key).clip(0, len(seen) - 1)] == key]
            if not len(rest):
                break
        good = np.ones(len(own), bool)
        good[rest] = False
        q[edge], ok[edge] = own.reshape(-1, given.negatives), good.reshape(-1, given.negatives)
    return q, ok


def train_block(ids, part, degree, state, u, v, weight, draws: int, given: Settings, rng) -> float:
    """Trains the rows of ``state`` in place on one epoch of a block's edges; the mean loss."""
    import numpy as np

    if not len(u) or not draws:
        return 0.0
    u, v = np.searchsorted(ids, u), np.searchsorted(ids, v)
    if given.tau:
        cdf = np.cumsum(weight) / weight.sum()
        order = np.searchsorted(cdf, rng.random(draws)).clip(0, len(u) - 1)
    else:
        order = rng.permutation(len(u))
    q, ok = draw_negatives(u, v, part, degree, given, rng)
    table, total = Adam(state, given.tables, given.dim), 0.0
    for a in range(0, len(order), given.batch):
        i = order[a : a + given.batch]
        rows, grad, loss = gradients(table.x, u[i], v[i], q[i], ok[i], given)
        table.step(rows, grad, given)
        total += loss * len(i)
    return total / len(order)


def parts_for(nodes: int, edges: int, given: Settings, part_bytes: int = PART_BYTES, block_edges: int = BLOCK_EDGES) -> int:
    """The least odd number of parts within both bounds."""
    size = (3 * given.tables * given.dim + 4) * 4
    least = max(1, -(-nodes * size // part_bytes), int((edges / block_edges) ** 0.5 + 0.999))
    return least + 1 - least % 2


def train_embedding(log: DataFrame, kind: str = "bpr", *, until: float | None = None, part_bytes: int = PART_BYTES, block_edges: int = BLOCK_EDGES, **given) -> DataFrame:
    """``(id, vec array<double>)`` for every id of the whole log, on either side.

    Edges are the distinct interactions up to ``until``, both ways round for
    ``line``; ids without one keep their first vectors. ``line`` returns first and
    second order one after the other.
    """
    import numpy as np
    import pandas as pd

    s = settings(kind, **given)
    log = log.select("src", "dst", F.col("time").cast("double").alias("time")).distinct()
    ids = log.select(F.col("src").alias("id")).union(log.select("dst")).distinct()
    used = log if until is None else log.where(F.col("time") <= until)
    if kind == "line":
        used = used.union(used.select("dst", "src", "time"))
    shape = used.agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("lo"), F.max("time").alias("hi")).first()
    parts = parts_for(ids.count(), shape["n"], s, part_bytes, block_edges)

    def part(column: str):
        return F.pmod(F.xxhash64(F.col(column), F.lit(s.seed)), F.lit(parts)).cast("int")

    span = (shape["hi"] - shape["lo"]) if shape["n"] else 0.0
    weight = F.exp((F.col("time") - F.lit(shape["hi"])) / (s.tau * span)) if s.tau and span else F.lit(1.0)
    edges = used.select(F.col("src").alias("u"), F.col("dst").alias("v"), weight.alias("w"), F.pmod(part("src") + part("dst"), F.lit(parts)).alias("round"), F.least(part("src"), part("dst")).alias("block"))
    edges = written(edges, "edges", "round")
    whole = edges.agg(F.sum("w")).first()[0] or 1.0
    size = s.tables * s.dim
    bound = (6.0 / (max(1, ids.count()) + s.dim)) ** 0.5
    first = F.transform(F.sequence(F.lit(0), F.lit(3 * size)), lambda i: F.when(i < size, F.xxhash64("id", i, F.lit(s.seed)) / F.lit(2.0**63) * bound).otherwise(0.0).cast("float"))
    degree = used.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    state = written(ids.join(degree, "id", "left").select("id", part("id").alias("part"), F.coalesce("degree", F.lit(0)).alias("degree"), first.alias("x")), "vectors")

    def trainer(epoch: int, turn: int):
        def block(key, nodes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
            nodes = nodes.sort_values("id", ignore_index=True)
            pairs = pairs.sort_values(["u", "v", "w"], ignore_index=True)
            x = np.stack(nodes["x"].to_numpy()).astype(np.float32) if len(nodes) else np.zeros((0, 3 * size + 1), np.float32)
            w = pairs["w"].to_numpy()
            draws = round(shape["n"] * w.sum() / whole) if s.tau else len(pairs)
            rng = np.random.default_rng([s.seed, epoch, turn, int(key[0])])
            train_block(nodes["id"].to_numpy(), nodes["part"].to_numpy(), nodes["degree"].to_numpy(), x, pairs["u"].to_numpy(), pairs["v"].to_numpy(), w, draws, s, rng)
            return pd.DataFrame({"id": nodes["id"], "part": nodes["part"], "degree": nodes["degree"], "x": list(x)})

        return block

    for epoch in range(s.epochs):
        for turn in range(parts):
            met = state.withColumn("block", F.least("part", F.pmod(F.lit(turn) - F.col("part"), F.lit(parts))))
            own = edges.where(F.col("round") == turn).select("u", "v", "w", "block")
            state = written(met.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(trainer(epoch, turn), state.schema), "vectors", instead_of=state)
    shown = 2 * s.dim if kind == "line" else s.dim
    return state.select("id", F.slice("x", 1, shown).cast("array<double>").alias("vec"))
