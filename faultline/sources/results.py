"""Result sinks and the consolidation of per-experiment outputs."""

from __future__ import annotations

import csv
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import cut_lineage

# The file-name pattern of per-experiment results.
EDGE_PATTERN = r"rca_edges_(hybrid_)?(EXP_[A-Z]+)_n=(\d+)"
NODE_PATTERN = r"rca_node_details_(EXP_[A-Z]+)_n=(\d+)"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        cut_lineage(spark.range(1))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def write_results(df: DataFrame, path: str, run_name: str, fmt: str = "parquet") -> None:
    """Append a ranked table under ``run_name=<...>``, so one read sees every run."""
    out = df.withColumn("run_name", F.lit(run_name)).write.mode("append").partitionBy("run_name")
    out.option("header", True).format(fmt).save(path)


def write_reports(metrics: dict[str, float | str | None], spark: SparkSession, path: str) -> None:
    """One JSON row per metric."""
    rows = [
        (k, float(v) if isinstance(v, (int, float)) else None, None if v is None else str(v))
        for k, v in metrics.items()
    ]
    spark.createDataFrame(rows, "metric string, value double, text string").coalesce(1).write.mode(
        "append"
    ).json(path)


def write_experiment_csv(df: DataFrame, base: str, kind: str, experiment: str, n: int) -> None:
    """Write one experiment's nodes or edges under the conventional name."""
    stem = {
        "nodes": f"rca_node_details_{experiment}",
        "edges": f"rca_edges_{experiment}",
        "hybrid": f"rca_edges_hybrid_{experiment}",
    }[kind]
    df.write.mode("append").option("header", True).csv(f"{base}/{stem}_n={n}.csv")


def consolidate_runs(spark: SparkSession, base: str, kind: str) -> DataFrame:
    """Union the per-experiment files below ``base``; experiment and graph type from the name.

    Runs may differ in columns: files are grouped by their header line, each group is
    one scan, and missing columns become NULL. All values are read as strings. Files
    without a line give no rows; if there are no others, only the added columns are left.
    """
    stem = "rca_node_details_*" if kind == "nodes" else "rca_edges_*"
    lines = spark.read.option("recursiveFileLookup", True).text(f"{base}/{stem}")
    # One row per distinct header: Spark writes the header as each file's first line.
    first = (
        lines.withColumn("path", F.col("_metadata.file_path"))
        .where(F.col("_metadata.file_block_start") == 0)
        .groupBy("path")
        .agg(F.first("value").alias("header"))
        .groupBy("header")
        .agg(F.collect_list("path").alias("paths"))
        .collect()
    )
    parts = []
    for row in first:
        names = next(csv.reader([row["header"]]))
        part = (
            spark.read.option("header", True)
            .schema(", ".join(f"`{n}` string" for n in names))
            .csv(row["paths"])
        )
        parts.append(part.withColumn("_path", F.col("_metadata.file_path")))
    if not parts:
        parts = [spark.createDataFrame([], "_path string")]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # Paths are URL-encoded.
    path = F.regexp_replace("_path", "%3D", "=")
    if kind == "nodes":
        return out.withColumn("Experiment", F.regexp_extract(path, NODE_PATTERN, 1)).drop("_path")
    hybrid = F.regexp_extract(path, EDGE_PATTERN, 1) == "hybrid_"
    return (
        out.withColumn("Experiment", F.regexp_extract(path, EDGE_PATTERN, 2))
        .withColumn("Graph_Type", F.when(hybrid, "Hybrid").otherwise("Standard"))
        .drop("_path")
    )
