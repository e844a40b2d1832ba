"""The registry: datasets, runs, checks and lineage edges as append-only Parquet tables.

A save writes all its rows to new files and then one small manifest, by an atomic rename; only
files that a manifest names count, so a save that fails leaves nothing behind. The latest row
of an id is the one that holds. Older tables lack newer columns, which read as null.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.model import RECORD, Dataset, State, Verdict, now, to_json
from terraloom.operators.spatial import small
from terraloom.plans.session import cut

SCHEMAS = {
    "datasets": T.StructType([*RECORD.fields, T.StructField("version", T.LongType())]),
    "runs": "id string, operator string, status string, inputs array<string>, output string, params string, error string, submitted_at timestamp, started_at timestamp, finished_at timestamp, version long",
    "checks": "owner string, owner_kind string, name string, state string, message string, checked_at timestamp, version long",
    "lineage": "parent string, child string, operation string, created_at timestamp, version long",
}


@dataclass(frozen=True)
class Run:
    """What an operator did: pending, running, completed, failed or cancelled."""

    operator: str
    inputs: tuple[str, ...] = ()
    params: dict[str, Any] = field(default_factory=dict)
    status: str = "pending"
    output: Dataset | None = None
    checks: tuple[Verdict, ...] = ()
    error: str | None = None
    submitted_at: datetime = field(default_factory=now)
    started_at: datetime | None = None
    finished_at: datetime | None = None
    id: str = field(default_factory=lambda: str(uuid.uuid4()))


class Registry:
    """Tables below a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))

    # Files.

    def _commit(self, rows: dict[str, list[tuple] | DataFrame]) -> None:
        version = time.time_ns()
        name = f"{version:020d}-{uuid.uuid4().hex}"
        files = {}
        for table, values in rows.items():
            if isinstance(values, DataFrame):
                columns = self.spark.createDataFrame([], SCHEMAS[table]).schema
                given = {f.name: F.col(f.name).cast(f.dataType) if f.name in values.columns else F.lit(None).cast(f.dataType) for f in columns}
                frame = values.select(*[c.alias(n) for n, c in (given | {"version": F.lit(version)}).items()])
            elif values:
                frame = self.spark.createDataFrame([(*v, version) for v in values], SCHEMAS[table]).coalesce(1)
            else:
                continue
            files[table] = f"{table}/{name}"
            frame.write.parquet(f"{self.path}/{files[table]}")
        staged = self._path(f"{self.path}/manifests/.{name}")
        out = self._fs.create(staged)
        out.write(bytearray(json.dumps(files).encode()))
        out.close()
        if not self._fs.rename(staged, self._path(f"{self.path}/manifests/{name}.json")):
            raise OSError(f"{name} couldn't be committed")

    def save_frames(self, **tables: DataFrame) -> None:
        """Many rows at once, all or nothing: tables by name, of which columns that aren't given are null. Nothing goes through the driver."""
        self._commit(tables)

    def table(self, name: str) -> DataFrame:
        """All committed rows of a table."""
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/manifests"))]
        if not any(x.endswith(".json") for x in found):
            return self.spark.createDataFrame([], SCHEMAS[name])
        manifests = self.spark.read.schema(", ".join(f"{t} string" for t in SCHEMAS)).json(f"{self.path}/manifests/*.json")
        paths = [f"{self.path}/{r[0]}" for r in manifests.where(F.col(name).isNotNull()).select(name).collect()]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def _latest(self, name: str, *keys: str) -> DataFrame:
        w = Window.partitionBy(*(keys or ("id",))).orderBy(F.desc("version"))
        return self.table(name).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    # Datasets.

    @staticmethod
    def _checks(owner: str, kind: str, checks: tuple[Verdict, ...]) -> list[tuple]:
        return [(owner, kind, c.check, c.state.name, c.note, c.at or now()) for c in checks]

    @staticmethod
    def _edges(d: Dataset) -> list[tuple]:
        return [(p, d.id, d.operation, d.made_at) for p in d.inputs] if d.operation else []

    def save_dataset(self, d: Dataset) -> None:
        self._commit({"datasets": [d.row()], "checks": self._checks(d.id, "dataset", d.verdicts), "lineage": self._edges(d)})

    def datasets(self, kind: str | None = None, limit: int | None = 100) -> DataFrame:
        """The latest row of each dataset, the newest datasets first. limit None: all, in no order."""
        rows = self._latest("datasets")
        rows = rows.where(F.col("kind") == kind) if kind else rows
        return rows if limit is None else rows.orderBy(F.desc("created_at"), "id").limit(limit)

    def get_dataset(self, dataset_id: str) -> Dataset | None:
        found = self._latest("datasets").where(F.col("id") == dataset_id).collect()
        if not found:
            return None
        return Dataset.of(found[0], [Verdict(c["name"], State[c["state"]], c["message"], c["checked_at"]) for c in self.checks(dataset_id).collect()])

    # Runs.

    def save_run(self, run: Run) -> None:
        """The run, its checks, its output, the output's checks and edges: all or nothing."""
        out = run.output
        rows = {
            "runs": [(run.id, run.operator, run.status, list(run.inputs), out and out.id, to_json(run.params), run.error, run.submitted_at, run.started_at, run.finished_at)],
            "checks": self._checks(run.id, "run", run.checks),
        }
        if out is not None:
            rows |= {"datasets": [out.row()], "lineage": self._edges(out)}
            rows["checks"] = rows["checks"] + self._checks(out.id, "dataset", out.verdicts)
        self._commit(rows)

    def runs(self, status: str | None = None, limit: int = 100) -> DataFrame:
        rows = self._latest("runs")
        return (rows.where(F.col("status") == status) if status else rows).orderBy(F.desc("submitted_at"), "id").limit(limit)

    def get_run(self, run_id: str) -> DataFrame:
        return self._latest("runs").where(F.col("id") == run_id)

    # Checks and lineage.

    def save_check(self, owner: str, check: Verdict, owner_kind: str = "dataset") -> None:
        self._commit({"checks": self._checks(owner, owner_kind, (check,))})

    def checks(self, owner: str) -> DataFrame:
        """The checks of a dataset or run as last saved together, in the order in which they were made."""
        rows = self.table("checks").where(F.col("owner") == owner)
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy("owner", "name").orderBy(F.desc("version")))).where("_n = 1").drop("_n").orderBy("checked_at", "name")

    def save_lineage(self, parent: str, child: str, operation: str) -> None:
        self._commit({"lineage": [(parent, child, operation, now())]})

    def lineage(self) -> DataFrame:
        """Edges, each once, as first saved."""
        w = Window.partitionBy("parent", "child", "operation").orderBy("version")
        return self.table("lineage").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def parents(self, dataset_id: str) -> DataFrame:
        edges = self.lineage().where(F.col("child") == dataset_id).select(F.col("parent").alias("id"))
        return self._latest("datasets").join(edges, "id").orderBy("created_at", "id")

    def children(self, dataset_id: str) -> DataFrame:
        edges = self.lineage().where(F.col("parent") == dataset_id).select(F.col("child").alias("id"))
        return self._latest("datasets").join(edges, "id").orderBy("created_at", "id")

    def full_lineage(self, dataset_id: str) -> DataFrame:
        """(parent, child, operation, depth): every edge above a dataset once, at its least depth."""
        return ancestry(self.table("lineage"), dataset_id)

    def counts(self) -> DataFrame:
        """(what, of, n): datasets by kind, runs by status, verdicts by state, edges by operation."""
        parts = (("datasets", self._latest("datasets"), "kind"), ("runs", self._latest("runs"), "status"), ("checks", self.table("checks"), "state"), ("edges", self.lineage(), "operation"))
        tally = [df.groupBy(F.col(key).alias("of")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "of", "n") for what, df, key in parts]
        return tally[0].unionByName(tally[1]).unionByName(tally[2]).unionByName(tally[3])

    def stats(self) -> dict[str, Any]:
        found: dict[str, dict[str, int]] = {"datasets": {}, "runs": {}, "checks": {}, "edges": {}}
        for r in self.counts().collect():
            found[r["what"]][r["of"]] = r["n"]
        return {k: sum(v.values()) for k, v in found.items()} | {"by_kind": found["datasets"], "by_status": found["runs"]}


def ancestry(edges: DataFrame, node: object) -> DataFrame:
    """(parent, child, operation, depth) of every edge above a node, each at its least depth; circles come to an end.

    Level by level, to the last however deep; each node is visited once. A level's edges are written
    to the checkpoint folder, so plans don't grow from level to level and nothing is kept in memory.
    Edges are read once a level and not sorted or shuffled while a level's nodes are few; equal ones are made one in a level.
    """
    spark = edges.sparkSession
    edges = edges.select("parent", "child", "operation")
    frontier = spark.createDataFrame([(node,)], f"node {dict(edges.dtypes)['child']}")
    seen, levels = frontier, []
    while True:
        step = cut(edges.join(small(frontier), F.col("child") == F.col("node"), "left_semi").distinct().withColumn("depth", F.lit(len(levels) + 1)))
        if not step.take(1):
            break
        levels.append(step)
        frontier = cut(step.select(F.col("parent").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(frontier)
    out = edges.withColumn("depth", F.lit(0)).limit(0)
    for step in levels:
        out = out.unionByName(step)
    return out
