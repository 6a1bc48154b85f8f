"""Stages that keep a note of what made their table, and reuse the table only while the note still holds.

A stage builds a DataFrame; running it writes Parquet under a temporary name, checks
what was written, renames it, and writes the note last. The note is one fingerprint:
the code, configuration, inputs, table and checks. Paths belong to any Hadoop file
system. Nothing is ever repaired: ``outlook`` says what would happen, a stage whose
folder or note does not fit halts the run, and ``set_aside`` moves files away
without deleting them.
"""

from __future__ import annotations

import ast
import hashlib
import importlib
import importlib.util
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = __name__.partition(".")[0]


@dataclass(frozen=True)
class Stage:
    """What makes one table: its inputs (paths of other stages or sources), configuration and builder."""

    name: str
    output: str
    build: Callable[[SparkSession, dict], DataFrame]
    inputs: tuple[str, ...] = ()
    config: dict = field(default_factory=dict)
    validate: Callable[[DataFrame], dict] | None = None

    def place(self, what: str) -> str:
        """Where the stage keeps a thing of ``THINGS``."""
        return self.output + THINGS[what]


#: What a stage may have on disk.
THINGS = {"draft": ".part", "table": "", "note": ".done.json"}
#: What follows from what there is; anything else halts.
FOLLOWS = {frozenset(): "build", frozenset({"table", "note"}): "compare"}


@dataclass(frozen=True)
class Outlook:
    """``build``, ``keep`` or ``halt``, and for a halt everything that does not fit."""

    what: str
    because: tuple[str, ...] = ()


def digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


class Store:
    """The few file operations that stages need, on the file system of each path."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def exists(self, path: str) -> bool:
        files, target = self._at(path)
        return files.exists(target)

    def rename(self, old: str, new: str) -> None:
        files, a = self._at(old)
        _, b = self._at(new)
        files.mkdirs(b.getParent())
        if not files.rename(a, b):
            raise OSError(f"cannot rename {old}")

    def remove(self, path: str) -> None:
        files, target = self._at(path)
        files.delete(target, True)

    def names(self, path: str) -> list[str]:
        files, target = self._at(path)
        return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []

    def read(self, path: str) -> str:
        files, target = self._at(path)
        stream = files.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def concatenate(self, parts: list[str], path: str) -> None:
        """The bytes of all parts, one after another, in one file."""
        files, target = self._at(path)
        io, conf = self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils, self.spark.sparkContext._jsc.hadoopConfiguration()
        out = files.create(target, True)
        try:
            for part in parts:
                source, at = self._at(part)
                stream = source.open(at)
                try:
                    io.copyBytes(stream, out, conf, False)
                finally:
                    stream.close()
        finally:
            out.close()

    def write(self, path: str, text: str) -> None:
        """Under a temporary name first, so a record is whole or absent."""
        files, target = self._at(path + ".part")
        stream = files.create(target, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.rename(path + ".part", path)


def identity(df: DataFrame) -> dict:
    """Schema, row count and an order-free content sum of a table, in one pass."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, low, high = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)), F.coalesce(F.bit_xor(row), F.lit(0))).first()
    return {"schema": df.schema.simpleString(), "rows": n, "content": f"{low}:{high}"}


def modules_of(build: Callable) -> dict[str, str]:
    """Sources of the builder's module and of all modules of this package that it imports, directly or not."""
    found: dict[str, str] = {}
    todo = [build.__module__]
    while todo:
        name = todo.pop()
        if name in found:
            continue
        module = importlib.import_module(name)
        found[name] = source = inspect.getsource(module) if getattr(module, "__file__", None) else ""
        base = name if hasattr(module, "__path__") else name.rpartition(".")[0]
        for node in ast.walk(ast.parse(source)):
            if isinstance(node, ast.Import):
                todo += [x.name for x in node.names if x.name.partition(".")[0] == PACKAGE]
            elif isinstance(node, ast.ImportFrom):
                parent = importlib.util.resolve_name("." * node.level + (node.module or ""), base) if node.level else node.module
                if parent.partition(".")[0] == PACKAGE:
                    todo += [m for m in (parent, *(f"{parent}.{x.name}" for x in node.names)) if importlib.util.find_spec(m) is not None] if hasattr(importlib.import_module(parent), "__path__") else [parent]
    return found


def fingerprint(stage: Stage, spark: SparkSession, table: DataFrame, checks: dict) -> dict:
    """Everything that a note has to say of a stage's table."""
    return {
        "stage": stage.name,
        "build": digest(inspect.getsource(stage.build)),
        **{f"module {name}": digest(source) for name, source in modules_of(stage.build).items()},
        "config": digest(stage.config),
        **{f"input {path}": identity(spark.read.parquet(path)) for path in stage.inputs},
        "table": identity(table),
        "checks": checks,
    }


def outlook(stage: Stage, spark: SparkSession) -> Outlook:
    """What completing the stage would do now."""
    store = Store(spark)
    there = frozenset(t for t in THINGS if store.exists(stage.place(t)))
    follows = FOLLOWS.get(there)
    if follows == "build":
        return Outlook("build")
    if follows is None:
        return Outlook("halt", tuple(f"{t} {'is there' if t in there else 'is missing'}" for t in THINGS))
    try:
        noted = json.loads(store.read(stage.place("note")))["fingerprint"]
        checks = noted["checks"]
    except (ValueError, KeyError, TypeError) as problem:
        return Outlook("halt", (f"the note cannot be read: {problem!r}",))
    present = fingerprint(stage, spark, spark.read.parquet(stage.output), checks)
    changed = tuple(sorted(k for k in present.keys() | noted.keys() if present.get(k) != noted.get(k)))
    return Outlook("halt", changed) if changed else Outlook("keep")


def complete(stage: Stage, spark: SparkSession) -> DataFrame:
    """The stage's table: kept, or built, checked, renamed and noted in that order."""
    found = outlook(stage, spark)
    if found.what == "halt":
        raise RuntimeError(f"{stage.name}: {', '.join(found.because)}")
    if found.what == "keep":
        return spark.read.parquet(stage.output)
    store, draft = Store(spark), stage.place("draft")
    try:
        stage.build(spark, stage.config).write.parquet(draft)
        checks = (stage.validate or (lambda df: {}))(spark.read.parquet(draft))
    except BaseException:
        if store.exists(draft):
            store.remove(draft)
        raise
    store.rename(draft, stage.output)
    out = spark.read.parquet(stage.output)
    note = {"fingerprint": fingerprint(stage, spark, out, json.loads(json.dumps(checks))), "at": datetime.now(timezone.utc).isoformat(timespec="seconds")}
    store.write(stage.place("note"), json.dumps(note, indent=2, sort_keys=True))
    return out


def set_aside(spark: SparkSession, root: str, stage: Stage, reason: str) -> str:
    """Moves what the stage has on disk into the next numbered folder under ``root`` and says why; deletes nothing."""
    store = Store(spark)
    number = 1 + max([0, *(int(n) for n in store.names(root) if n.isdigit())])
    slot = f"{root}/{number:03d}"
    moved = [t for t in THINGS if store.exists(stage.place(t))]
    for t in moved:
        store.rename(stage.place(t), f"{slot}/{t}")
    store.write(f"{slot}/reason.json", json.dumps({"reason": reason, "moved": moved, "from": stage.output}))
    return slot


def preview(stages: list[Stage], spark: SparkSession) -> list[tuple[str, Outlook]]:
    """Each stage with what would happen to it, without running any."""
    return [(s.name, outlook(s, spark)) for s in stages]


def run(stages: list[Stage], spark: SparkSession) -> dict[str, DataFrame]:
    """All stages in their order; a stage may read the outputs of earlier ones."""
    return {s.name: complete(s, spark) for s in stages}


def ranking_stages(root: str, sf_dir: str) -> list[Stage]:
    """Log to chained scores and their metrics: a whole path as a list of stages."""
    from ..operators import replay, reports, rules
    from ..sources import tables as T
    from . import features as P

    at = {n: f"{root}/{n}" for n in ("log", "train", "slates", "sets", "triples", "labels", "demotions", "scores", "chain", "metric", "chain_metric")}

    def plain(name: str, inputs: tuple[str, ...], build: Callable[..., DataFrame], validate: Callable[[DataFrame], dict] | None = None) -> Stage:
        def read(spark: SparkSession, config: dict) -> DataFrame:
            return build(*[spark.read.parquet(config[i]) for i in inputs])

        return Stage(name, at[name], read, tuple(at[i] for i in inputs), {i: at[i] for i in inputs}, validate)

    def log(spark: SparkSession, config: dict) -> DataFrame:
        return T.orders_log(spark, config["sf_dir"])

    def whole(df: DataFrame) -> dict:
        rows = df.select("row_id").distinct().count()
        reports.validate_matrix(df, rows, T.WIDTH)
        return {"rows": rows}

    def squeezed(slates: DataFrame, train: DataFrame) -> DataFrame:
        from ..functions.scores import row_minmax

        return P.simple_blend(slates, train).withColumn("score", row_minmax(F.col("score")))

    return [
        Stage("log", at["log"], log, (), {"sf_dir": sf_dir}),
        plain("train", ("log",), T.train_part),
        plain("slates", ("log",), T.slates),
        plain("sets", ("slates", "train"), rules.slate_sets),
        plain("triples", ("sets",), rules.triple_rule),
        plain("labels", ("sets", "triples"), lambda sets, triples: rules.answer_labels(triples, rules.pair_labels(sets, triples))),
        plain("demotions", ("slates", "labels", "triples"), rules.zero_repeat_demotions),
        plain("scores", ("slates", "train"), squeezed, whole),
        plain("chain", ("scores", "train"), P.ds2_chain, whole),
        plain("metric", ("scores",), replay.mrr),
        plain("chain_metric", ("chain", "slates"), lambda chain, slates: replay.mrr(chain.join(slates.select("row_id", "pos", "label"), ["row_id", "pos"]))),
    ]
