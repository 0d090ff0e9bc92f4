"""Dataset versions: copies of the configured tables with a JSON manifest."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.sources.tables import path_exists, read_table

MANIFEST_SCHEMA = (
    "dataset_version string, environment string, config_name string, created_at_utc string, seed int, "
    "target_column string, id_columns array<string>, sources map<string,string>, snapshots map<string,string>, digests map<string,string>, effective_config string"
)


def make_version(moment: datetime | None = None) -> str:
    return (moment or datetime.now(timezone.utc)).strftime("ds_%Y%m%d_%H%M%S")


def snapshot(
    spark: SparkSession,
    base: str,
    sources: dict[str, str],
    version: str | None = None,
    environment: str = "dev",
    seed: int = 42,
    target_column: str = "Churn",
    id_columns: tuple[str, ...] = ("customerID",),
    config: dict | None = None,
) -> dict:
    """Keep each source that exists under ``base/<version>/<name>/`` and append the manifest row.

    A table whose content an earlier version has already is not copied: the manifest names that copy (see ``content_digest``). ``config`` is kept as
    ``effective_config``, so that a run can be repeated with it.
    """
    if not sources:
        raise ValueError("There is no table to take a snapshot of.")
    version = version or make_version()
    copied, digests = {}, {}
    kept = _kept(spark, base)
    for name, path in sources.items():
        copied[name] = f"{base}/{version}/{name}/{path.rstrip('/').split('/')[-1]}"
        if path_exists(spark, path):
            fmt = "csv" if path.endswith(".csv") else "parquet"
            table = read_table(spark, path, fmt)
            digests[name] = content_digest(table)
            if (name, digests[name]) in kept:
                copied[name] = kept[name, digests[name]]
                continue
            writer = table.write.mode("overwrite")
            writer.parquet(copied[name]) if fmt == "parquet" else writer.option("header", True).csv(copied[name])
    manifest = {
        "dataset_version": version,
        "environment": environment,
        "config_name": f"{environment}.yaml",
        "created_at_utc": datetime.now(timezone.utc).isoformat(),
        "seed": seed,
        "target_column": target_column,
        "id_columns": list(id_columns),
        "sources": sources,
        "snapshots": copied,
        "digests": digests,
        "effective_config": json.dumps(config or {}, sort_keys=True),
    }
    line = spark.createDataFrame([(json.dumps(manifest),)], "value string")
    line.write.mode("append").text(f"{base}/manifests")
    return manifest


def content_digest(table: DataFrame) -> str:
    """A digest of a table's rows and columns that does not depend on their order in files: sums of two hashes of each row, from one aggregate."""
    columns = sorted(table.columns)
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"h{seed}") for seed in (1, 2)]
    found = table.agg(F.count("*").alias("n"), *sums).first()
    text = json.dumps([sorted(table.dtypes), found.n, found.h1, found.h2])
    return hashlib.sha256(text.encode()).hexdigest()


def _kept(spark: SparkSession, base: str) -> dict[tuple[str, str], str]:
    """(name, digest) to the path of the copy, over all manifests: one entry per distinct content of a named table."""
    if not path_exists(spark, f"{base}/manifests"):
        return {}
    rows = manifests(spark, base).select(F.explode("digests").alias("name", "digest"), "snapshots", "dataset_version")
    first = rows.groupBy("name", "digest").agg(F.min_by(F.col("snapshots")[F.col("name")], "dataset_version").alias("path"))
    return {(r.name, r.digest): r.path for r in first.collect()}


def manifests(spark: SparkSession, base: str) -> DataFrame:
    """All manifests as a table."""
    if not path_exists(spark, f"{base}/manifests"):
        raise FileNotFoundError(f"There is no manifest under {base}/manifests")
    return spark.read.text(f"{base}/manifests").select(F.from_json("value", MANIFEST_SCHEMA).alias("m")).select("m.*")


def latest_manifest(spark: SparkSession, base: str) -> dict:
    row = manifests(spark, base).orderBy(F.desc("dataset_version"), F.desc("created_at_utc")).first()
    return row.asDict(recursive=True)


def manifest_paths(manifest: dict) -> dict[str, str]:
    """``<name>_file`` paths of a manifest, with the training and validation splits under short names."""
    snapshots = manifest["snapshots"]
    return {
        "train_file": snapshots["split_train"],
        "val_file": snapshots["split_val"],
        **{f"{name}_file": path for name, path in snapshots.items()},
    }


def splits_from_manifest(spark: SparkSession, manifest: dict) -> tuple[DataFrame, DataFrame]:
    """Training and validation tables named by a manifest, for a repeat of a training run."""
    paths = manifest_paths(manifest)
    return read_table(spark, paths["train_file"], "parquet"), read_table(spark, paths["val_file"], "parquet")
