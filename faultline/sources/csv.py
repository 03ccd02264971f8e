"""Labelled CSV scan and label audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from faultline.functions.numeric import finite_or_null

# The class names of the input and their codes.
CLASS_CODES = {"neg": 0, "pos": 1}


def label_code(c: Column) -> Column:
    """neg -> 0, pos -> 1, anything else NULL."""
    out = F.lit(None).cast("int")
    for name, code in CLASS_CODES.items():
        out = F.when(c == name, F.lit(code)).otherwise(out)
    return out


def ingest_labelled_csv(
    spark: SparkSession, path: str, schema: StructType, target: str = "class", missing: str = "na"
) -> DataFrame:
    """Read a CSV whose missing literal is ``na`` and whose target is neg/pos.

    The schema is given, not inferred, so the file is read once. The target becomes
    an INT column ``label``; NaN and infinities become NULL.
    """
    if target not in schema.fieldNames():
        raise ValueError(f"target column '{target}' not in {schema.fieldNames()}")
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("nullValue", missing)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return raw.select(
        label_code(F.col(target)).alias("label"),
        *[
            finite_or_null(f.name).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
            for f in schema
            if f.name != target
        ],
    )


def label_audit(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label; a NULL row counts the unmapped labels."""
    return df.groupBy(label).agg(F.count("*").alias("n_rows"))
