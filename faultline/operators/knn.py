"""Exact k-nearest-neighbour self join.

1. Identical vectors collapse to one, keeping the k+1 smallest ids (enough for any
   top-k that may have to skip the row itself), so a huge group of copies is one point.
2. Points go to the cells of a two-level pivot tree: as many cells as the square root of the
   points, found in as many steps as the square root of the cells.
3. A cell is cut into chunks by the distance to its pivot, so a chunk is a ring of known bounds.
4. Every point finds its neighbours inside its own cell, which bounds the search radius.
5. Beyond it only chunks are searched that the radius can reach: the triangle inequality
   rules out subtrees, cells and rings.

A task compares a bounded number of points with one chunk. All candidates are kept by an exact bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.order import seeded_take
from faultline.operators.prefix import fitted_cuts, with_slice
from faultline.session import cut_lineage

CHUNK = 512  # points of a ring
QUERIES = 4096  # points compared with a chunk in one task


def _squared(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed axis by axis: the same bits whatever the blocking."""
    out = np.zeros((len(q), len(b)))
    for i in range(q.shape[1]):
        d = q[:, i, None] - b[None, :, i]
        out += d * d
    return out


def _stack(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=float)


def _block(k: int):
    """Best k (distance, id) of each query against one chunk."""

    def best(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(base):
            return pd.DataFrame({"vid": np.zeros(0, "int64"), "nbr": np.zeros(0, "int64"), "d2": np.zeros(0)})
        sizes = base["ids"].map(len).to_numpy()
        ids, vids, b = np.concatenate(base["ids"].to_list()), queries["vid"].to_numpy(), _stack(base["vec"])
        found = []
        for a in range(0, len(queries), 256):
            d2 = _squared(_stack(queries["vec"].iloc[a : a + 256]), b)
            # Every vector brings at least one id, so k vectors and their ties suffice.
            cut = np.partition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, min(k, d2.shape[1]) - 1]
            row, col = np.nonzero(d2 <= cut[:, None])
            each = sizes[col]
            first = np.cumsum(sizes) - sizes
            nbr = ids[np.repeat(first[col], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
            row, near = np.repeat(row, each), np.repeat(d2[row, col], each)
            order = np.lexsort((nbr, near, row))
            row, near, nbr = row[order], near[order], nbr[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            kept = rank < k
            found.append((vids[a : a + 256][row[kept]], nbr[kept], near[kept]))
        return pd.DataFrame(dict(zip(("vid", "nbr", "d2"), map(np.concatenate, zip(*found)))))

    return best


def _search(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """``(vid, nbr, d2)`` of queries, each paired with a ``(cell, ring)`` of base points."""
    keys = ["cell", "ring"]
    load = queries.groupBy(*keys).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    fresh = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  both sides come from one table
    q = queries.join(load, keys).select(*fresh("vid", "vec", *keys), F.pmod(F.xxhash64("vid"), "parts").cast("int").alias("part"))
    b = base.join(load, keys).select(*fresh("vec", "ids", *keys), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    keys.append("part")
    return q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(_block(k), "vid long, nbr long, d2 double")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("vid").orderBy("d2", "nbr")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


class PivotTree:
    """Pivots in two levels: every second-level pivot belongs to its nearest first-level one."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.top = pivots[: max(1, int(np.sqrt(len(pivots))))]
        parent = np.concatenate([_squared(pivots[a : a + 1024], self.top).argmin(axis=1) for a in range(0, len(pivots), 1024)])
        self.children = [np.flatnonzero(parent == t) for t in range(len(self.top))]
        self.children = [c if len(c) else np.array([t]) for t, c in enumerate(self.children)]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Subtree, cell, and the distances to both pivots, of each point."""
        d2 = _squared(x, self.top)
        top = d2.argmin(axis=1)
        cell, near = np.zeros(len(x), int), np.zeros(len(x))
        for t in np.unique(top):
            rows, own = np.flatnonzero(top == t), self.children[t]
            inside = _squared(x[rows], self.pivots[own])
            at = inside.argmin(axis=1)
            cell[rows], near[rows] = own[at], inside[np.arange(len(rows)), at]
        return top, cell, np.sqrt(d2[np.arange(len(x)), top]), np.sqrt(near)

    def reached(self, x: np.ndarray, theta: np.ndarray, wide: np.ndarray, radius: dict[tuple[int, int], float]):
        """Rows and cells whose ball a row's radius can touch, with the distance to the cell's pivot."""
        gap = np.sqrt(_squared(x, self.top)) - wide
        for t in range(len(self.top)):
            own = np.array([c for c in self.children[t] if (t, c) in radius], dtype=int)
            rows = np.flatnonzero(gap[:, t] <= theta)
            if not len(rows) or not len(own):
                continue
            d = np.sqrt(_squared(x[rows], self.pivots[own]))
            r, c = np.nonzero(d - np.array([radius[t, i] for i in own]) <= theta[rows, None])
            yield rows[r], own[c], d[r, c]


def knn_self(
    points: DataFrame, k: int, id_col: str = "row_id", vec_col: str = "vec", seed: int = 42,
    chunk: int = CHUNK, pivots: int | None = None, counted: list | None = None,
) -> DataFrame:
    """``(id, nbr, dist, nn)``: the k nearest other rows; ties go to the smaller id.

    ``points`` holds a LONG id and an ARRAY<DOUBLE> without NULLs. ``pivots`` is the square root of the
    distinct vectors unless given. ``counted`` receives the numbers of comparisons inside and beyond
    the cells, for measurements.
    """
    want = k + 1
    pts = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    # Rank-limited window: Spark keeps only the first ids per vector before the shuffle.
    w = Window.partitionBy("vec").orderBy("id")
    reps = (
        pts.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= want)
        .groupBy("vec")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.get("ids", F.lit(0)).alias("vid"), "vec", "ids")
    )
    reps = cut_lineage(reps)
    n = reps.count()
    if n == 0:
        return points.sparkSession.createDataFrame([], "id long, nbr long, dist double, nn int")
    m = max(1, round(np.sqrt(n))) if pivots is None else pivots
    tree = PivotTree(np.array([r["vec"] for r in seeded_take(reps, m, (), seed, "vid").select("vec").collect()]))

    def assign(batches):
        for pdf in batches:
            top, cell, far, near = tree.assign(_stack(pdf["vec"]))
            yield pdf.assign(top=top.astype("int32"), cell=cell.astype("int32"), dt=far, dc=near)

    cells = reps.mapInPandas(assign, "vid long, vec array<double>, ids array<long>, top int, cell int, dt double, dc double")
    cuts = fitted_cuts(cells, ["cell"], [F.col("dc")], chunk)[0]
    sliced = cells.withColumn("slice", F.lit(0)) if cuts is None else with_slice(cells, ["cell"], F.col("dc"), cuts, "slice")
    # Points at one distance make one slice, however many they are: it is cut by their hash.
    heavy = sliced.groupBy("cell", "slice").agg(F.ceil(F.count("*") / (2 * chunk)).cast("int").alias("_parts"))
    ring = F.struct("slice", F.pmod(F.xxhash64("vid"), "_parts").cast("int").alias("part"))
    placed = cut_lineage(sliced.join(heavy, ["cell", "slice"]).withColumn("ring", ring).drop("slice", "_parts"))
    rings = placed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("dc").alias("low"), F.max("dc").alias("high"))
    # One row per cell: as many as pivots.
    radius = {(r["top"], r["cell"]): r["r"] for r in placed.groupBy("top", "cell").agg(F.max("dc").alias("r")).collect()}
    wide = np.full(len(tree.top), -np.inf)
    for r in placed.groupBy("top").agg(F.max("dt").alias("r")).collect():
        wide[r["top"]] = r["r"]

    home = placed.select("vid", "vec", "cell").join(rings.select("cell", "ring"), "cell")
    own = cut_lineage(_top(_search(home, placed, want), want))
    reach = own.groupBy("vid").agg(
        F.when(F.count("*") >= want, F.sqrt(F.max("d2"))).otherwise(F.lit(float("inf"))).alias("theta")
    )

    def spread(batches):
        for pdf in batches:
            x, vids, vecs, home_ = _stack(pdf["vec"]), pdf["vid"].to_numpy(), pdf["vec"].to_numpy(), pdf["cell"].to_numpy()
            limit = pdf["theta"].to_numpy() * (1 + 1e-9) + 1e-9
            for row, cell, d in tree.reached(x, limit, wide, radius):
                out = cell != home_[row]
                if out.any():
                    row, cell, d = row[out], cell[out], d[out]
                    yield pd.DataFrame({"vid": vids[row], "vec": vecs[row], "cell": cell.astype("int32"), "dq": d, "limit": limit[row]})

    abroad = placed.join(reach, "vid").select("vid", "vec", "cell", "theta").mapInPandas(
        spread, "vid long, vec array<double>, cell int, dq double, limit double"
    )
    # A ring is no nearer than the difference of the distances to the pivot.
    near = F.greatest(F.col("dq") - F.col("high"), F.col("low") - F.col("dq")) <= F.col("limit")
    pairs = abroad.join(rings, "cell").where(near).select("vid", "vec", "cell", "ring")
    if counted is not None:
        for found in (home, pairs):
            counted.append(found.join(rings.select("cell", "ring", "n"), ["cell", "ring"]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    best = _top(own.unionByName(_search(pairs, placed, want)), want)
    lists = best.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("d2", "nbr"))).alias("near"))
    per_vec = placed.select("vid", "vec").join(lists, "vid").select("vec", "near")
    joined = pts.join(per_vec, "vec")
    others = F.slice(F.filter("near", lambda e: e["nbr"] != F.col("id")), 1, k)
    return joined.select("id", F.posexplode(others).alias("pos", "e")).select(
        "id", F.col("e.nbr").alias("nbr"), F.sqrt("e.d2").alias("dist"), (F.col("pos") + 1).alias("nn")
    )
