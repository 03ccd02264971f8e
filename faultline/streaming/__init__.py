"""Fitted plans on streams.

There are no streaming operators of our own: a fitted ``Prep``, scaler or histogram plan
is a stateless projection, so its ``transform`` takes a streaming DataFrame as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from faultline.operators.histograms import Families, engineer_histograms
from faultline.plans.prep import Prep


def prepare_stream(
    stream: DataFrame, prep: Prep, families: Families, ids: Sequence[str] = ("row_id",), mileage: str = "aa_000"
) -> DataFrame:
    """Impute with fitted constants and add histogram features; no state, no watermark."""
    ready = prep.transform(stream, ids)
    return engineer_histograms(ready, families, mileage, keep=[*ids, *prep.output_columns()])
