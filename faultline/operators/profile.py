"""Column profiles, column roles, and filters driven by them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.numeric import finite_or_null
from faultline.operators.prefix import long_form


def profile_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, n_rows, na_share, n_distinct)`` with exact distinct counts."""
    return (
        long_form(df, cols, drop_null=False)
        .groupBy("feature", "value")
        .agg(F.count("*").alias("n"))
        .groupBy("feature")
        .agg(
            F.sum("n").alias("n_rows"),
            (F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("na_share"),
            F.count("value").alias("n_distinct"),
        )
    )


def column_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, na_share, is_constant)`` in one aggregation without a shuffle of values."""
    wide = df.agg(
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"na_{i}") for i, c in enumerate(cols)],
        *[
            F.coalesce(F.min(c) == F.max(c), F.lit(False)).alias(f"const_{i}")
            for i, c in enumerate(cols)
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"na_{i}").alias("na_share"),
                F.col(f"const_{i}").alias("is_constant"),
            )
            for i, c in enumerate(cols)
        ]
    )
    return wide.select(F.inline(rows))


def kept_columns(df: DataFrame, cols: Sequence[str], max_na: float = 0.7) -> list[str]:
    """Columns with NA share <= ``max_na`` and not exactly one distinct value."""
    bad = {
        r["feature"]
        for r in column_summary(df, cols)
        .where((F.col("na_share") > max_na) | F.col("is_constant"))
        .collect()
    }
    return [c for c in cols if c not in bad]


def drop_sparse_constant(df: DataFrame, cols: Sequence[str], max_na: float = 0.7) -> DataFrame:
    keep = set(kept_columns(df, cols, max_na))
    return df.select(*[c for c in df.columns if c not in cols or c in keep])


def na_strategy(df: DataFrame, cols: Sequence[str], max_na: float = 0.7, low_na: float = 0.15) -> DataFrame:
    """``(feature, na_share, strategy)``: none, median or iterative, for kept columns."""
    return (
        column_summary(df, cols)
        .where((F.col("na_share") <= max_na) & ~F.col("is_constant"))
        .select(
            "feature",
            "na_share",
            F.when(F.col("na_share") == 0, "none")
            .when(F.col("na_share") <= low_na, "median")
            .otherwise("iterative")
            .alias("strategy"),
        )
    )


def drop_incomplete_rows(df: DataFrame, cols: Sequence[str], max_share: float = 0.04) -> DataFrame:
    """Drop rows with NULL in any column whose NA share lies in (0, ``max_share``]."""
    rare = [
        r["feature"]
        for r in column_summary(df, cols)
        .where((F.col("na_share") > 0) & (F.col("na_share") <= max_share))
        .collect()
    ]
    return df.dropna(subset=rare) if rare else df


def split_column_roles(columns: Sequence[str]) -> dict[str, object]:
    """Partition names into histogram bins by family, numeric columns and missing flags.

    A family is a prefix (before ``_``) shared by two or more columns that end in a digit.
    """
    by_prefix = defaultdict(list)
    for c in columns:
        if "is_missing" not in c and c[-1].isdigit():
            by_prefix[c.split("_")[0]].append(c)
    families = {p for p, members in by_prefix.items() if len(members) > 1}
    roles = {"families": {p: [] for p in sorted(families)}, "numeric": [], "flags": []}
    for c in sorted(columns):
        if "is_missing" in c:
            roles["flags"].append(c)
        elif c.split("_")[0] in families:
            roles["families"][c.split("_")[0]].append(c)
        else:
            roles["numeric"].append(c)
    return roles


def role_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column roles with the number of non-null rows behind each."""
    roles = split_column_roles(columns)
    pairs = [(c, f, "histogram") for f, cs in roles["families"].items() for c in cs]
    pairs += [(c, None, "numeric") for c in roles["numeric"]]
    pairs += [(c, None, "flag") for c in roles["flags"]]
    spark = df.sparkSession
    counts = long_form(df, [p[0] for p in pairs]).groupBy("feature").agg(F.count("*").alias("n_present"))
    return spark.createDataFrame(pairs, "feature string, family string, role string").join(
        counts, "feature", "left"
    )


def project_selected(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ("row_id", "label")) -> DataFrame:
    """Keep ids and selected features; raise if a feature is absent."""
    absent = [f for f in features if f not in df.columns]
    if absent:
        raise ValueError(f"selected features absent from the table: {absent}")
    return df.select(*[i for i in ids if i in df.columns], *features)


def complete_filter_inf(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Long form without NaN, infinities or NULLs, per column."""
    return long_form(df, cols, ids)


def clean_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Map NaN and infinities to NULL once, at ingest."""
    return df.withColumns({c: finite_or_null(c) for c in cols})


def subset_by_class(df: DataFrame, cls: int, label: str = "label") -> DataFrame:
    return df.where(F.col(label) == cls)


def filter_redundant_globals(
    groups: DataFrame, preferred: Sequence[str] = ("aa_000", "ci_000")
) -> DataFrame:
    """From ``(run_id, position, feature, feature_group)`` keep one Global feature per run.

    The first preferred name wins, else the first by position.
    """
    pref = F.lit(len(preferred))
    for i, p in reversed(list(enumerate(preferred))):
        pref = F.when(F.col("feature") == p, i).otherwise(pref)
    w = Window.partitionBy("run_id", "feature_group").orderBy(pref, "position")
    return (
        groups.withColumn("_r", F.row_number().over(w))
        .where((F.col("feature_group") != "Global") | (F.col("_r") == 1))
        .drop("_r")
    )


def high_risk_rows(scores: DataFrame, threshold: float, k: int = 5, id_col: str = "row_id") -> DataFrame:
    """Top ``k`` rows by probability among those at or above the threshold."""
    return scores.where(F.col("prob") >= threshold).orderBy(F.desc("prob"), id_col).limit(k)
