"""Runs and models under version.

A run's models and tables are written to a folder of its own; the last thing
written is its line in the manifest, so a run that broke off is never read.
``latest`` gives the newest complete run, ``Run.model`` and ``Run.table`` what
it holds.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run_id string, version long, kind string, models array<string>, tables array<string>, record string"


@dataclass(frozen=True)
class Run:
    """A complete run: what its manifest line says."""

    spark: SparkSession
    folder: str
    run_id: str
    version: int
    models: list
    tables: list
    record: dict

    def model(self, name: str) -> PipelineModel:
        return PipelineModel.load(f"{self.folder}/models/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/tables/{name}")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """All complete runs."""
    path = f"{root.rstrip('/')}/manifest"
    spark.createDataFrame([], MANIFEST).write.mode("append").json(path)
    return spark.read.schema(MANIFEST).json(path)


def save(spark: SparkSession, root: str, kind: str, models: dict, tables: dict[str, DataFrame], record: dict) -> Run:
    """Store a run; it exists from the moment its manifest line is written."""
    run_id = f"{kind}-{uuid.uuid4().hex[:12]}"
    folder = f"{root.rstrip('/')}/runs/{run_id}"
    for name, model in models.items():
        model.write().overwrite().save(f"{folder}/models/{name}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/tables/{name}")
    version = 1 + (manifest(spark, root).where(F.col("kind") == kind).agg(F.max("version")).first()[0] or 0)
    line = (run_id, version, kind, sorted(models), sorted(tables), json.dumps(record, default=str, ensure_ascii=False))
    spark.createDataFrame([line], MANIFEST).coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/manifest")
    return Run(spark, folder, run_id, version, sorted(models), sorted(tables), record)


def latest(spark: SparkSession, root: str, kind: str) -> Run | None:
    """The complete run of the highest version; of two with the same one, the larger id."""
    best = manifest(spark, root).where(F.col("kind") == kind).orderBy(F.col("version").desc(), F.col("run_id").desc()).first()
    if best is None:
        return None
    return Run(spark, f"{root.rstrip('/')}/runs/{best['run_id']}", best["run_id"], best["version"], best["models"], best["tables"],
               json.loads(best["record"]))
