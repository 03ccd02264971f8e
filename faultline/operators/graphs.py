"""Relational operators on discovered graphs, for many graphs at once.

An edge table is ``(run_id, src, dst, ...)``: one graph per experiment, segment or
replicate. Graphs are small (tens of nodes); runs are many and partition the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut_lineage

TARGET, TIME = "class", "aa_000"
# Tiers of feature groups; a higher tier cannot cause a lower one.
TIERS = {"Global": 0, "Secondary": 1, "Diagnostic": 2}
TIER_DEFAULT = 3


def prior_matrix(
    groups: DataFrame, class_sink: bool = True, time_source: bool = True, mediation: bool = True,
    target: str = TARGET, time: str = TIME,
) -> DataFrame:
    """``(run_id, effect, cause, forbidden)`` from ``(run_id, feature, feature_group)``.

    -1 forbids cause -> effect. Pairs are formed inside a run, over its few variables.
    """
    tier = F.lit(TIER_DEFAULT)
    for g, t in TIERS.items():
        tier = F.when(F.col("feature_group") == g, t).otherwise(tier)
    nodes = groups.select("run_id", "feature", tier.alias("tier"))
    e = nodes.select("run_id", F.col("feature").alias("effect"), F.col("tier").alias("te"))
    c = nodes.select("run_id", F.col("feature").alias("cause"), F.col("tier").alias("tc"))
    no = F.lit(False)
    if class_sink:
        no = no | (F.col("cause") == target)
    if time_source:
        no = no | (F.col("effect") == time)
    if mediation:
        no = no | ((F.col("effect") == target) & (F.col("cause") == time))
    plain = ~F.col("effect").isin(target, time) & ~F.col("cause").isin(target, time)
    no = no | (plain & (F.col("effect") != F.col("cause")) & (F.col("tc") > F.col("te")))
    return e.join(c, "run_id").select("run_id", "effect", "cause", F.when(no, -1).otherwise(0).alias("forbidden"))


def edge_cleanup(
    edges: DataFrame, class_sink: bool = True, time_source: bool = True, mediation: bool = True,
    min_weight: float = 0.01, target: str = TARGET, time: str = TIME,
) -> DataFrame:
    """Drop weak edges, turn edges out of the class and into time, drop time -> class.

    The class rule is applied before the time rule, and that before mediation.
    """
    s, d = F.col("src"), F.col("dst")
    from_class = F.lit(class_sink) & (s == target)
    to_time = F.lit(time_source) & (d == time)
    gone = (from_class & F.lit(mediation) & (d == time)) | (
        ~from_class & ~to_time & F.lit(mediation) & (s == time) & (d == target)
    )
    return (
        edges.where((F.abs("weight") >= min_weight) & ~gone)
        .select(
            "run_id",
            F.when(from_class, d).when(to_time, F.lit(time)).otherwise(s).alias("src"),
            F.when(from_class, F.lit(target)).when(to_time, s).otherwise(d).alias("dst"),
        )
        .distinct()
    )


def edge_strength_list(edges: DataFrame, min_weight: float = 0.001, target: str = TARGET, time: str = TIME) -> DataFrame:
    """Raw edges with |w| above the cut, strongest first, with marks for links to the class."""
    mark = F.when((F.col("src") == time) & (F.col("dst") == target), "DIRECT TIME LINK (To Class)").when(
        F.col("dst") == target, "(To Class)"
    ).otherwise("")
    return (
        edges.where(F.abs("weight") > min_weight)
        .select("run_id", "src", "dst", F.abs("weight").alias("strength"), mark.alias("mark"))
        .orderBy("run_id", F.desc("strength"), "src", "dst")
    )


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select("run_id", F.explode(F.array("src", "dst")).alias("node")).distinct()


_HOPS = 4  # hops searched in one job


def _distances(edges: DataFrame, target: str) -> DataFrame:
    """``(run_id, node, hops)``: edges on the shortest way to the target, by breadth-first search.

    Joins on ``(run_id, node)`` go on until no node is new, however long the paths are.
    """
    e = cut_lineage(edges.select("run_id", "src", F.col("dst").alias("node")).distinct())
    found = e.select("run_id", F.lit(target).alias("node"), F.lit(0).alias("hops")).distinct()
    frontier, depth = found, 0
    while True:
        step, seen = frontier, None
        for _ in range(_HOPS):
            step = step.join(e, ["run_id", "node"]).select("run_id", F.col("src").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
            seen = step if seen is None else seen.unionByName(step)
        fresh = cut_lineage(seen.groupBy("run_id", "node").agg(F.min("hops").alias("hops")).join(found, ["run_id", "node"], "left_anti"))
        found, depth = found.unionByName(fresh), depth + _HOPS
        # Only nodes at the rim can have further ones behind them.
        frontier = fresh.where(F.col("hops") == depth)
        if not frontier.limit(1).count():
            return found


def node_roles(edges: DataFrame, nodes: DataFrame | None = None, target: str = TARGET, time: str = TIME) -> DataFrame:
    """Unconnected, Physical Root (no parents, or only time) or Mediator, by reach of the class."""
    nodes = nodes if nodes is not None else nodes_of(edges)
    reach = _distances(edges, target).select("run_id", "node", F.lit(1).alias("hit"))
    parents = edges.select("run_id", F.col("dst").alias("node"), "src").distinct().groupBy("run_id", "node").agg(
        F.count("*").alias("n_in"), F.max((F.col("src") == time).cast("int")).alias("by_time")
    )
    n_in = F.coalesce("n_in", F.lit(0))
    root = (n_in == 0) | ((n_in == 1) & (F.col("by_time") == 1))
    role = F.when(F.col("hit").isNull(), "Unconnected").when(root, "Physical Root").otherwise("Mediator")
    return (
        nodes.where(~F.col("node").isin(target, time))
        .join(reach, ["run_id", "node"], "left")
        .join(parents, ["run_id", "node"], "left")
        .select("run_id", "node", role.alias("role"))
    )


def graph_structure(edges: DataFrame, target: str = TARGET) -> DataFrame:
    """Ancestors of the target as root (in-degree 0) or mediator, and whether a direct parent."""
    reach = _distances(edges, target).where(F.col("node") != target)
    n_in = edges.select("run_id", F.col("dst").alias("node"), "src").distinct().groupBy("run_id", "node").agg(F.count("*").alias("n_in"))
    return reach.join(n_in, ["run_id", "node"], "left").select(
        "run_id", "node",
        F.when(F.coalesce("n_in", F.lit(0)) == 0, "root").otherwise("mediator").alias("kind"),
        (F.col("hops") == 1).cast("int").alias("is_parent"),
    )


def hybrid_graph(
    lingam: DataFrame, pc: DataFrame, time_source: bool = True, target: str = TARGET, time: str = TIME
) -> DataFrame:
    """All LiNGAM edges, and PC edges between pairs LiNGAM leaves unconnected.

    ``pc`` may carry ``pos_src, pos_dst`` (label positions); the first edge of an
    unordered pair wins. The time turn precedes the class turn.
    """
    pair = [F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")]
    order = ["pos_src", "pos_dst"] if "pos_src" in pc.columns else ["src", "dst"]
    w = Window.partitionBy("run_id", "p", "q").orderBy(*order)
    rescued = (
        pc.select("*", *pair)
        .join(lingam.select("run_id", *pair).distinct(), ["run_id", "p", "q"], "left_anti")
        .withColumn("_r", F.row_number().over(w))
        .where("_r = 1")
    )
    turn = F.lit(time_source) & (F.col("dst") == time)
    rescued = rescued.select(
        "run_id", F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"),
        F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"),
    )
    back = F.col("src") == target
    rescued = rescued.select(
        "run_id", F.when(back, F.col("dst")).otherwise(F.col("src")).alias("src"),
        F.when(back, F.col("src")).otherwise(F.col("dst")).alias("dst"),
    )
    return (
        lingam.select("run_id", "src", "dst").distinct().withColumn("type", F.lit("LiNGAM")).withColumn("weight", F.lit(2))
        .unionByName(rescued.withColumn("type", F.lit("PC_Rescue")).withColumn("weight", F.lit(1)))
    )


def hybrid_layers(edges: DataFrame, target: str = TARGET, time: str = TIME) -> DataFrame:
    """1 time; 2 its children with a child other than the class; 3 their other children; 4 class."""
    e = edges.select("run_id", "src", "dst").distinct()
    runs = e.select("run_id").distinct()
    busy = e.where(F.col("dst") != target).select("run_id", F.col("src").alias("node")).distinct()
    second = (
        e.where((F.col("src") == time) & (F.col("dst") != target))
        .select("run_id", F.col("dst").alias("node"))
        .distinct()
        .join(busy, ["run_id", "node"], "left_semi")
    )
    third = (
        e.join(second.withColumnRenamed("node", "src"), ["run_id", "src"], "left_semi")
        .where(F.col("dst") != target)
        .select("run_id", F.col("dst").alias("node"))
        .distinct()
        .join(second, ["run_id", "node"], "left_anti")
    )
    ends = runs.select("run_id", F.lit(time).alias("node"), F.lit(1).alias("layer")).unionByName(
        runs.select("run_id", F.lit(target).alias("node"), F.lit(4).alias("layer"))
    )
    return ends.unionByName(second.withColumn("layer", F.lit(2))).unionByName(third.withColumn("layer", F.lit(3)))


def path_depth(edges: DataFrame, nodes: DataFrame | None = None, target: str = TARGET) -> DataFrame:
    """Layer = 10 - nodes on the shortest path to the class; class 10, no path 0."""
    nodes = nodes if nodes is not None else nodes_of(edges)
    hops = _distances(edges, target)
    layer = F.when(F.col("node") == target, 10).when(F.col("hops").isNull(), 0).otherwise(10 - (F.col("hops") + 1))
    return nodes.join(hops, ["run_id", "node"], "left").select("run_id", "node", layer.cast("int").alias("layer"))
