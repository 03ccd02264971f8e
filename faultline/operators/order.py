"""Seeded ranks and exact n-of-N samples without a global sort.

The leading hex digits of the row's md5 are a uniform, ordered bucket number. Rank =
rows in earlier buckets (a small table) + rank inside the bucket, so the work spreads
evenly over ``16**digits`` groups whatever the data looks like.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.seeded import seeded_hash
from faultline.session import cut_lineage


def _with_bucket_offsets(
    df: DataFrame, by: Sequence[str], seed: int | str, id_col: str, digits: int
) -> DataFrame:
    by = list(by)
    hashed = df.withColumn("_h", seeded_hash(seed, id_col)).withColumn(
        "_b", F.substring("_h", 1, digits)
    )
    sizes = hashed.groupBy(*by, "_b").agg(F.count("*").alias("_bn"))
    # 16**digits rows per group at most; with many groups that isn't small, so no hint to broadcast it.
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_k_{c}") for c in by],
        F.col("_b").alias("_kb"),
        "_bn",
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"),
    )
    cond = F.col("_b") == F.col("_kb")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return hashed.join(offsets, cond)


def seeded_rank(
    df: DataFrame,
    by: Sequence[str] = (),
    seed: int | str = 42,
    id_col: str = "row_id",
    out: str = "rank",
    digits: int = 3,
) -> DataFrame:
    """1-based rank of each row in seeded order within ``by`` (a small number of groups)."""
    staged = _with_bucket_offsets(df, by, seed, id_col, digits)
    w = Window.partitionBy(*by, "_b").orderBy("_h", id_col)
    return staged.withColumn(out, F.col("_off") + F.row_number().over(w)).select(*df.columns, out)


def seeded_take(
    df: DataFrame,
    n: int | Column,
    by: Sequence[str] = (),
    seed: int | str = 42,
    id_col: str = "row_id",
    digits: int = 3,
) -> DataFrame:
    """Exactly the first ``n`` rows (per ``by`` group) in seeded order.

    ``n`` may be a column of ``df``, constant within a group. Whole buckets pass
    without a shuffle; only the bucket in which ``n`` falls is ranked.
    """
    n = F.lit(n) if isinstance(n, int) else n
    staged = _with_bucket_offsets(df, by, seed, id_col, digits).withColumn("_want", n)
    whole = staged.where(F.col("_off") + F.col("_bn") <= F.col("_want"))
    edge = staged.where(
        (F.col("_off") < F.col("_want")) & (F.col("_off") + F.col("_bn") > F.col("_want"))
    )
    w = Window.partitionBy(*by, "_b").orderBy("_h", id_col)
    edge = edge.withColumn("_r", F.col("_off") + F.row_number().over(w)).where(
        F.col("_r") <= F.col("_want")
    )
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def dense_positions(df: DataFrame, out: str = "position") -> tuple[DataFrame, int]:
    """``df`` with positions 0..n-1 in the order of its stored rows, and n; no exchange of rows.

    The rows are written once with the number of their task and place in it; the sizes of
    the tasks before, one row per task, are added.
    """
    numbered = cut_lineage(df.withColumn("_m", F.monotonically_increasing_id()))
    task = F.shiftright("_m", 33)
    sizes = sorted(tuple(r) for r in numbered.groupBy(task.alias("t")).agg(F.count("*")).collect())
    starts, n = [], 0
    for t, size in sizes:
        starts.append((t, n))
        n += size
    offsets = df.sparkSession.createDataFrame(starts, "_t long, _start long")
    # One row per task that wrote rows.
    placed = numbered.withColumn("_t", task).join(F.broadcast(offsets), "_t")
    return placed.withColumn(out, F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, out), n
