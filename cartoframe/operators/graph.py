"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoframe.runtime import Scratch


def _in_one_task(pairs: DataFrame) -> DataFrame:
    """(id, component) by union-find over all pairs (u, v) in one task."""
    import pyarrow as pa

    def run(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        ids = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], ["id", "component"])

    return pairs.repartition(1).mapInArrow(run, "id long, component long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, one_task_edges: int = 0) -> DataFrame:
    """(id, component) for every vertex of an undirected edge table; component is the smallest vertex id reachable.

    Alternates the large-star and small-star contractions of Kiveris et al.
    (2014): each round points every vertex at the least vertex of its
    neighbourhood, until the edges form stars.  A round is two aggregations with
    map-side combination and two joins that AQE can split on a hub; its edges
    become a scratch table, so lineage stays short and a lost executor costs one
    round.  Edges with a null end are ignored; self-loops keep their vertex.
    Graphs of up to `one_task_edges` edges are solved in one task instead.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    vertices = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    now = scratch.table(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    if one_task_edges and before[0] <= one_task_edges:
        return _in_one_task(now.union(vertices.select("id", F.col("id").alias("v"))))
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = scratch.table(small)
        scratch.drop(now)
        now, last, before = after, before, mark(after)
        if last == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return vertices.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


#: Edges that are folded into stars at once.
FOLDED_EDGES = 1_000_000
#: Stars up to which they are folded in one task.
ONE_TASK_STARS = 50_000_000


def _folded(batches):
    """(id, component) that connects what all edges (u, v) connect, holding the nodes and a few edges at a time."""
    import numpy as np
    import pyarrow as pa

    from cartoframe.operators.search import joined

    ids = low = np.empty(0, dtype=np.int64)
    us, vs, n = [], [], 0

    def fold():
        u, v = np.concatenate([ids, *us]), np.concatenate([low, *vs])
        known, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
        ends = ends.astype(np.int32)
        return known, known[joined(len(known), ends[: len(u)], ends[len(u) :])]

    for batch in batches:
        us.append(batch.column(0).to_numpy())
        vs.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n >= FOLDED_EDGES:
            ids, low = fold()
            us, vs, n = [], [], 0
    ids, low = fold()
    for k in range(0, len(ids), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 100_000]), pa.array(low[k : k + 100_000])], ["id", "component"])


def component_stars(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(id, component) as connected_components.  Each task folds its edges into a star for each component it sees, one task folds these stars; more than it can hold are left to the rounds."""
    scratch = Scratch(edges.sparkSession, "stars")
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    stars = scratch.table(pairs.coalesce(edges.sparkSession.sparkContext.defaultParallelism).mapInArrow(_folded, "id long, component long"))
    if stars.count() <= ONE_TASK_STARS:
        return stars.repartition(1).mapInArrow(_folded, "id long, component long")
    return connected_components(stars, "id", "component")
