from pyspark.sql import functions as F

from faultline.operators.histograms import engineer_histograms
from faultline.plans.prep import fit_prep
from faultline.sources import fixtures as X
from faultline.streaming import prepare_stream


def test_stream_equals_batch(spark, cust, tmp_path):
    cols = ["aa_000", *X.AG, "na_low", "na_mid", "na_high"]
    prep = fit_prep(cust, cols, mice_rounds=2)
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    cust.select("row_id", *cols).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    query = (
        prepare_stream(stream, prep, {"ag": X.AG}).writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    batch = engineer_histograms(prep.transform(cust, ["row_id"]), {"ag": X.AG}, keep=["row_id", *prep.output_columns()])
    got = spark.read.parquet(out)
    assert got.count() == cust.count()
    assert got.exceptAll(batch.select(got.columns)).count() == 0
