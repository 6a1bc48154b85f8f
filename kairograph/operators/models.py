"""Models: truncated SVD geometry, and a gradient-boosted ranker on MLlib trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from ..sources.stored import parts
from . import spectral


def svd_geometry(log: DataFrame, k: int = 128) -> DataFrame:
    """``(id, vec)``: the ``k`` leading right singular vectors of the binary source-destination matrix, times the root of the singular values, of length one.

    Parts of the matrix that share no source and no destination have singular vectors of their own. Each is
    solved in a worker, for as many as it may have among the ``k`` leading ones, and again for more if all were.
    Equal values are taken in order of the parts.
    """
    import numpy as np

    spark = log.sparkSession
    known = log.where("src IS NOT NULL AND dst IS NOT NULL")
    least, most = known.agg(F.min("dst"), F.max("dst")).first()
    if most is None:
        return spark.createDataFrame([], "id long, vec array<double>")
    if least < 0:
        raise ValueError("a destination below 0 is no column")
    width, cores = int(most) + 1, spark.sparkContext.defaultParallelism
    k = min(k, max(1, width - 1))
    lists = F.sort_array(F.collect_set(F.col("dst").cast("long")))
    rows = written(known.groupBy("src").agg(lists.alias("dsts")), "matrix")
    linked = rows.select("dsts").coalesce(cores).mapInArrow(spectral.forest, "id int, root int, n int").toArrow()
    ids, near, entries = (linked.column(c).to_numpy() for c in ("id", "root", "n"))
    root = spectral.least_linked(ids, near, width)  # an entry per destination, here and in each worker
    sizes = np.bincount(root[ids], weights=entries, minlength=width).astype(np.int64)
    del linked, ids, near, entries
    want = np.where(sizes > 0, np.minimum(k, 4 + 2 * k * sizes // sizes.sum()), 0).astype(np.int32)

    tables: list[DataFrame] = []
    found: list[tuple] = []
    while True:
        table = written(_solved(rows, root, sizes, want), "vectors")
        tables.append(table)
        best = table.where("id IS NULL").select("comp", "more", F.size("vec").alias("n"), F.posexplode("vec").alias("j", "value")).withColumn("rank", F.round("value", 9))
        found += [(-r["rank"], r["comp"], r["j"], r["value"], r["more"], r["n"], len(tables) - 1) for r in best.orderBy(F.desc("rank"), "comp", "j").limit(k).collect()]
        found = sorted(found)[:k]
        again = {comp: min(k, 4 * n) for _, comp, j, _, more, n, _ in found if more and j == n - 1 and n < k}
        if not again:
            break
        want = np.zeros(width, np.int32)
        for comp, n in again.items():
            want[comp] = n
        found = [x for x in found if x[1] not in again]

    places: dict[tuple[int, int], list] = {}
    for place, (_, comp, _, value, _, _, turn) in enumerate(found):
        places.setdefault((turn, comp), []).append((place, float(np.sqrt(value))))
    known_ids, out = None, None
    for turn, table in enumerate(tables):
        own = {comp: np.array(x) for (t, comp), x in places.items() if t == turn}
        if not own:
            continue
        part = table.where(F.col("id").isNotNull() & F.col("comp").isin(list(own)))
        vecs = part.select("comp", "id", "vec").mapInArrow(spectral.placed(own, len(found)), "id long, vec array<double>")
        known_ids, out = (part.select("id"), vecs) if out is None else (known_ids.union(part.select("id")), out.union(vecs))
    rest = spark.range(width).join(known_ids, "id", "left_anti")
    return out.union(rest.select("id", F.array_repeat(F.lit(0.0), len(found)).alias("vec")))


def _solved(rows: DataFrame, root, sizes, want) -> DataFrame:
    """The parts of which any vectors are wanted, dealt so that small ones share a task."""
    import numpy as np

    spark = rows.sparkSession
    comps = np.flatnonzero(want)
    comps = comps[np.argsort(-sizes[comps], kind="stable")]
    bounds = list(parts(sizes[comps], max(1 << 17, int(sizes[comps].sum()) // (4 * spark.sparkContext.defaultParallelism))))
    turn = np.zeros(len(root), np.int32)
    for n, (a, b) in enumerate(bounds):
        turn[comps[a:b]] = n
    shared = spark.sparkContext.broadcast((root.astype(np.int32), turn, want))

    def dealt(batches):
        import pyarrow as pa

        root, turn, want = shared.value
        for batch in batches:
            lists = batch.column("dsts")
            comp = root[lists.flatten().to_numpy()[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()]]
            out = pa.record_batch({"turn": pa.array(turn[comp]), "comp": pa.array(comp, pa.int64()), "want": pa.array(want[comp]), "src": batch.column("src"), "dsts": lists})
            yield out.filter(pa.array(want[comp] > 0))

    kind = f"turn int, comp long, want int, src {rows.schema['src'].dataType.simpleString()}, dsts array<long>"
    ordered = rows.mapInArrow(dealt, kind).repartitionByRange(len(bounds), "turn").sortWithinPartitions("comp", "src")
    return ordered.select("comp", "want", "dsts").mapInArrow(spectral.solved, "comp long, id long, more boolean, vec array<double>")


def lambdamart(rows: DataFrame, features: list[str], rounds: int = 400, rate: float = 0.05, depth: int = 5, least: int = 100):
    """A ranker of ``rows(qid, pos, label, features...)``; returns ``score(df) -> df with prediction``.

    Each round takes the gradients of NDCG at 10 from pairs within a query
    (bounded by the slate's width), fits one MLlib regression tree to them, and
    sets each leaf by a Newton step. A row is known by its query and position,
    and every round's values are written, so lost executors change nothing and
    plans do not grow with the rounds.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    key = ["qid", "pos"]
    assembler = VectorAssembler(inputCols=features, outputCol="__x")
    data = written(assembler.transform(rows).select(*key, "label", F.col("__x").alias("x")).withColumn("f", F.lit(0.0)), "boosting")
    steps: list[tuple] = []
    target = None
    for _ in range(rounds):
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("f"), "pos"))
        gain = F.when(rank <= 10, 1 / F.log2(rank + 1.0)).otherwise(0.0)
        ranked = data.withColumn("d", gain)
        # One window tells every cell its query's positive: no join, no second pass over the slates.
        slate = Window.partitionBy("qid")
        pairs = ranked.withColumns({"fp": F.max(F.when(F.col("label") == 1, F.col("f"))).over(slate), "dp": F.max(F.when(F.col("label") == 1, F.col("d"))).over(slate)})
        rho, dz = 1 / (1 + F.exp(F.col("fp") - F.col("f"))), F.abs(F.col("dp") - F.col("d"))
        lower = pairs.withColumns({"g0": F.when((F.col("label") == 0) & F.col("fp").isNotNull(), -rho * dz), "h0": F.when((F.col("label") == 0) & F.col("fp").isNotNull(), rho * (1 - rho) * dz)})
        g = F.when(F.col("label") == 1, -F.sum("g0").over(slate)).otherwise(F.col("g0"))
        h = F.when(F.col("label") == 1, F.sum("h0").over(slate)).otherwise(F.col("h0"))
        fresh = lower.withColumns({"g": g, "h": h}).where("g IS NOT NULL").select(*key, "label", "x", "f", "g", "h")
        target = written(fresh.withColumn("y", F.col("g") / (F.col("h") + 1e-6)).withColumn("wt", F.col("h") + 1e-6), "gradients", instead_of=target)
        tree = DecisionTreeRegressor(featuresCol="x", labelCol="y", weightCol="wt", maxDepth=depth, minInstancesPerNode=least, predictionCol="step", leafCol="leaf", seed=7).fit(target)
        placed = tree.transform(target)
        leaves = {r["leaf"]: r["v"] for r in placed.groupBy("leaf").agg((F.sum("g") / (F.sum("h") + 1.0)).alias("v")).collect()}  # at most 2 ** depth leaves
        steps.append((tree, leaves))
        data = written(_stepped(tree, leaves, data, rate), "boosting", instead_of=data)

    def score(df: DataFrame) -> DataFrame:
        out = assembler.transform(df).withColumn("__f", F.lit(0.0))
        for tree, leaves in steps:
            tree.setFeaturesCol("__x")
            out = _stepped(tree, leaves, out, rate, "__f")
        return out.withColumnRenamed("__f", "prediction").drop("__x")

    return score


def _stepped(tree, leaves: dict, df: DataFrame, rate: float, column: str = "f") -> DataFrame:
    value = F.lit(0.0)
    for leaf, v in leaves.items():
        value = F.when(F.col("leaf") == leaf, F.lit(float(v))).otherwise(value)
    return tree.transform(df).withColumn(column, F.col(column) + rate * value).drop("step", "leaf")
