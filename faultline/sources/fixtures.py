"""Feature tables derived from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.session import spread

AG = [f"ag_{i:03d}" for i in range(10)]
AY = [f"ay_{i:03d}" for i in range(11)]
CN = [f"cn_{i:03d}" for i in range(12)]
BA = [f"ba_{i:03d}" for i in range(5)]
GAPPY = ["na_low", "na_mid", "na_high", "na_drop"]
FAMILIES = {"ag": AG, "ay": AY, "cn": CN, "ba": BA}
HOURS = [f"hr_{i:03d}" for i in range(24)]
VALUES = [f"val_{i:03d}" for i in range(8)]
EMB = [f"e_{i:02d}" for i in range(64)]
ITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]

# Rows of a task where lines meet their orders, and where orders meet their customers.
LINES_TASK, CUSTOMERS_TASK = 500_000, 50_000

_CACHE: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Build a feature table once per session and keep it for the operators that rescan it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _CACHE:
        df = build(spark, sf_dir).persist()
        df.count()
        _CACHE[key] = df
    return _CACHE[key]


def build_cust_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: order counters, four histogram families, gappy columns."""
    li = table(spark, sf_dir, "lineitem")
    qbin = F.floor((F.col("l_quantity") - 1) / 5)
    dbin = F.round(F.col("l_discount") * 100)
    q, flag, status = F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linestatus")
    rf, no, ao = (
        (flag == a) & (status == b) for a, b in (("R", "F"), ("N", "O"), ("A", "O"))
    )
    gaps = {
        "na_low": (F.max, rf, "l_tax"),
        "na_mid": (F.max, rf & (q > 40), "l_tax"),
        "na_high": (F.max, (flag == "N") & (q > 47), "l_discount"),
        "na_drop": (F.min, ao & (q > 49), "l_extendedprice"),
    }
    n_lines = li.count()
    li = li.select("l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_tax", "l_extendedprice")
    # Lines collapse to one row per order before the join, orders to one per customer.
    per_order = spread(li, "l_orderkey", LINES_TASK, n_lines).groupBy("l_orderkey").agg(
        *[F.count_if(qbin == i).alias(c) for i, c in enumerate(AG)],
        *[F.count_if(dbin == i).alias(c) for i, c in enumerate(AY)],
        *[fn(F.when(cond, F.col(c))).alias(k) for k, (fn, cond, c) in gaps.items()],
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    orders = spread(orders, "o_orderkey", LINES_TASK, n_lines)
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    n_cust = cust.count()
    both = spread(orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left"), "o_custkey", CUSTOMERS_TASK, n_cust)
    month, prio = F.month("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    per_cust = both.groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("aa_000"),
        *[F.sum(c).cast("double").alias(c) for c in AG + AY],
        *[F.count_if(month == i + 1).cast("double").alias(c) for i, c in enumerate(CN)],
        *[F.count_if(prio == str(i + 1)).cast("double").alias(c) for i, c in enumerate(BA)],
        *[fn(k).alias(k) for k, (fn, _, _) in gaps.items()],
    )
    cust = spread(cust, "c_custkey", CUSTOMERS_TASK, n_cust)
    counters = ["aa_000", *AG, *AY, *CN, *BA]
    return cust.join(per_cust, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("row_id"),
        (F.col("c_acctbal") < 0).cast("int").alias("label"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in counters],
        *GAPPY,
    )


def cust_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "cust", build_cust_features)


def build_emb_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") == 0).cast("int").alias("label"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(EMB)],
    )


def emb_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_emb_features(spark, sf_dir)


def item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        *[F.col(c).cast("double").alias(c) for c in ITEM],
    )


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a deterministic pseudo-score; ``label`` is NULL where unlabelled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    prob = F.pmod(F.col("doc_id") * 7919, F.lit(1009)) / F.lit(1009.0)
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        F.col("toxic").cast("int").alias("label"),
        # Toxic rows score higher on average, so the curves have a shape.
        F.when(F.col("toxic") == 1, F.sqrt(prob)).otherwise(prob * prob).alias("prob"),
        F.col("n_chars").cast("double").alias("n_chars"),
    )


def build_user_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    hour = F.hour("ts")
    vbin = F.least(F.lit(7), F.floor(F.col("value") / 20))
    per_user = ev.groupBy("user_id").agg(
        *[F.count_if(hour == i).cast("double").alias(c) for i, c in enumerate(HOURS)],
        *[F.count_if(vbin == i).cast("double").alias(c) for i, c in enumerate(VALUES)],
        (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("_share"),
    )
    from faultline.operators.prefix import quantiles

    median = quantiles(per_user, ["_share"], [0.5]).select("value").scalar()
    return per_user.select(
        F.col("user_id").alias("row_id"),
        (F.col("_share") > median).cast("int").alias("label"),
        *HOURS,
        *VALUES,
    )


def user_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "user", build_user_hist)


def edge_table(spark: SparkSession, sf_dir: str, algo: str = "LiNGAM") -> DataFrame:
    """Weighted directed edges, one graph per nation, counted from the orders.

    Order keys and prices pick source and target among seven fixed node names; the
    frequent pairs of a nation become its edges, with a signed share as the weight.
    """
    names = ["aa_000", "f1", "f2", "f3", "f4", "f5", "class"]
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    salt = 1 if algo == "LiNGAM" else 5
    node = F.array(*[F.lit(n) for n in names])
    pick = lambda k: F.get(node, F.pmod(F.col("o_orderkey") * k + salt, F.lit(7)).cast("int"))
    src, dst = pick(3), F.get(node, F.pmod(F.floor(F.col("o_totalprice")) + salt, F.lit(7)).cast("int"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("long").alias("run_id"), src.alias("src"), dst.alias("dst"),
    )
    counts = j.where("src <> dst").groupBy("run_id", "src", "dst").agg(F.count("*").alias("n"))
    totals = counts.groupBy("run_id").agg(F.max("n").alias("top"))
    # One row per run.
    return (
        counts.join(F.broadcast(totals), "run_id")
        .where(F.col("n") * 10 >= F.col("top") * 7)
        .select(
            "run_id", "src", "dst",
            (F.when(F.pmod(F.col("n"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
             * (F.col("n") - F.floor(F.col("top") * 0.7)) / F.col("top") * 0.2).alias("weight"),
        )
    )


LABELLED_SCHEMA = T.StructType(
    [T.StructField("class", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ["aa_000", *AG, *GAPPY]]
)
