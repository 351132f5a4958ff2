"""Exact top-k search with multi-resolution segment statistics.

Vectors are cut into 1, 4, 16, ... segments.  For a query q and a vector x with
segment means m and deviations s (of segments of w components),

    <q, x> <= sum over segments of w * (m_q m_x + s_q s_x)

by Cauchy-Schwarz, which is the lower bound |q - x|^2 >= sum w ((m_q - m_x)^2 +
(s_q - s_x)^2) of the distance, given the norms.  Bounds are taken coarse to
fine against the query's running k-th best score; survivors are scored exactly.

Only the queries travel: they are broadcast in slices of at most SLICE_BYTES (in
the mean), and each task streams its own vectors, in blocks, past a slice (a
stated query set against all rows).  A first pass over one vector in SEED_SHARE
gives every query a k-th best to begin with, so that a task of the second pass
returns only scores that can still be among the best: about k * SEED_SHARE for
each query, however many tasks there are.

Scores are integers: components are floor(scale * x), products are summed in
64-bit floats while sums stay below 2**52, else in Python integers.

Defined cases: vectors that are null, or hold null or non-finite components,
take no part; rows without id neither.  Vectors of different lengths are not
compared.  Every row is a candidate of its own, and every query row a query of
its own that meets all rows but itself: of two rows with one id each is the
other's candidate, and both have their ranks 1 to k.  Ties go to the smaller id.
Scores beyond 64 bits count as the nearest number of 64 bits.  Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartoframe.runtime import Scratch

#: Vectors in a block; bytes of query components in a slice; one vector in so many is in the first pass.
BLOCK, SLICE_BYTES, SEED_SHARE = 4096, 16 << 20, 64
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(segment sums of means, of deviations), both scaled by the root of the segment's width], coarse to fine."""
    out, segments = [], 1
    while segments <= max(1, x.shape[1] // 4):
        parts = np.array_split(np.arange(x.shape[1]), segments)
        width = np.sqrt([max(1, len(p)) for p in parts])
        mean = np.stack([x[:, p].mean(1) if len(p) else np.zeros(len(x)) for p in parts], 1)
        dev = np.stack([x[:, p].std(1) if len(p) else np.zeros(len(x)) for p in parts], 1)
        out.append((mean * width, dev * width))
        segments *= 4
    return out


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers; a product beyond the floats is taken in integers (such floats are whole)."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * x)
    out = [int(s) if np.isfinite(s) else scale * int(v) for s, v in zip(scaled.ravel(), x.ravel(), strict=True)]
    return np.array(out, object).reshape(x.shape)


class Vectors:
    """Vectors of one length: components as they are (`raw`), scaled, and their bounds; `far` if bounds would leave the floats."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, scale: int):
        self.ids, self.raw, self.scale = ids, raw, scale
        with np.errstate(over="ignore"):
            self.x = np.floor(scale * raw)
        self.top = float(np.abs(self.x).max(initial=0.0))
        self.far = not self.top < 1e100
        if not self.far:
            self.levels = _levels(self.x)
            self.norm = np.sqrt((self.x**2).sum(1))


def _scores(q: Vectors, i: int, x: Vectors, rows: np.ndarray) -> np.ndarray:
    """Exact scores of query i with some vectors, cut to 64 bits."""
    if not (q.far or x.far) and q.top * x.top * max(1, q.x.shape[1]) < 2**52:
        return (x.x[rows] @ q.x[i]).astype(np.int64)
    one = _whole(q.raw[i], q.scale)
    return np.array([min(_MOST, max(_LEAST, int((one * v).sum()))) for v in _whole(x.raw[rows], x.scale)], np.int64)


def search(q: Vectors, x: Vectors, k: int, best: list[list[tuple[int, int]]], least: np.ndarray) -> None:
    """Takes a block of vectors into `best`, each query's k best as sorted (-score, id); scores below `least` are not wanted."""
    bounded = not (q.far or x.far)
    for i in range(len(q.ids)):
        own = best[i]
        floor = max(int(least[i]), -own[-1][0] if len(own) == k else _LEAST)
        rows = np.arange(len(x.ids))
        if bounded and floor > _LEAST:
            for (mq, dq), (mx, dx) in zip(q.levels, x.levels, strict=True):
                bound = mx[rows] @ mq[i] + dx[rows] @ dq[i]
                rows = rows[bound + 1e-9 * x.norm[rows] * q.norm[i] + 1e-6 >= floor]
                if not len(rows):
                    break
        if not len(rows):
            continue
        s = _scores(q, i, x, rows)
        rows, s = rows[s >= floor], s[s >= floor]
        order = np.lexsort((x.ids[rows], -s.astype(object) if (s == _LEAST).any() else -s))[:k]
        best[i] = sorted([*own, *((-int(s[r]), int(x.ids[rows[r]])) for r in order)])[:k]


def read_vectors(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, components) of the usable rows, those of one length together."""
    known = np.flatnonzero(pc.and_(ids.is_valid(), vectors.is_valid()).to_numpy(zero_copy_only=False))
    vectors = vectors.take(pa.array(known))
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(vectors.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        data = values[start[rows][:, None] + np.arange(n)]
        usable = np.isfinite(data).all(1)
        if usable.any():
            yield known[rows[usable]], data[usable]


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[Vectors]:
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    count: dict[int, int] = {}

    def take(n: int) -> Vectors:
        parts = held.pop(n)
        count.pop(n)
        return Vectors(np.concatenate([i for i, _ in parts]), np.concatenate([d for _, d in parts]), scale)

    for batch in batches:
        for rows, data in read_vectors(batch.column(0), batch.column(1)):
            ids, n = batch.column(0).take(pa.array(rows)).to_numpy(), data.shape[1]
            for at in range(0, len(ids), BLOCK):
                held.setdefault(n, []).append((ids[at : at + BLOCK], data[at : at + BLOCK]))
                count[n] = count.get(n, 0) + len(ids[at : at + BLOCK])
                if count[n] >= BLOCK:
                    yield take(n)
    for n in list(held):
        yield take(n)


class Queries:
    """A slice of distinct queries (id, v, copies): by length their numbers, ids, components and copies."""

    def __init__(self, table: pa.Table):
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.count = 0
        if table.num_rows:
            ids, vectors, copies = (c.combine_chunks() for c in table.columns)
            for rows, data in read_vectors(ids, vectors):
                self.by[data.shape[1]] = (self.count + np.arange(len(rows)), ids.take(pa.array(rows)).to_numpy(), data, copies.take(pa.array(rows)).to_numpy())
                self.count += len(rows)

    def named(self, scale: int) -> Iterator[tuple[int, int, int, int]]:
        """(number, id, copies, score with itself)"""
        for numbers, ids, raw, copies in self.by.values():
            q = Vectors(ids, raw, scale)
            for i in range(len(ids)):
                yield int(numbers[i]), int(ids[i]), int(copies[i]), int(_scores(q, i, q, np.array([i]))[0])


def _pass(vectors: DataFrame, sent, least, k: int, scale: int) -> DataFrame:
    """number, vec_id, score: of every task, each query's k best of its vectors, those of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floors, state = sent.value, least.value if least is not None else None, {}
        for x in _blocks(batches, scale):
            n = x.raw.shape[1]
            if n not in queries.by:
                continue
            if n not in state:
                numbers, ids, raw, _ = queries.by[n]
                state[n] = (Vectors(ids, raw, scale), [[] for _ in numbers], np.full(len(numbers), _LEAST) if floors is None else floors[numbers])
            q, best, floor = state[n]
            search(q, x, k, best, floor)
        for n, (_, best, _) in state.items():
            numbers = queries.by[n][0]
            for at in range(0, len(best), 1000):
                flat = [(int(numbers[i]), v, -s) for i in range(at, min(at + 1000, len(best))) for s, v in best[i]]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat, strict=True)], ["number", "vec_id", "score"])

    return vectors.mapInArrow(run, "number long, vec_id long, score long")


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of `vectors` by integer inner product.  `queries` are rows of `vectors`."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    x, q = pick(vectors), pick(queries).where("id is not null and v is not null").where(usable)
    q = scratch.table(q.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies")))  # equal rows are asked once
    size = q.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))).first()[0]
    slices = max(1, -(-size // SLICE_BYTES))
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame, n: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    out = None
    for part in range(slices):
        own = q if slices == 1 else q.where(F.pmod(F.xxhash64("id", "v"), F.lit(slices)) == part)
        asked = Queries(own.toArrow())  # SLICE_BYTES in the mean
        sent = spark.sparkContext.broadcast(asked)
        # a query's own row is among all rows: one more is asked for, and that row left out
        seed = ranked(_pass(x.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SEED_SHARE)) == 0), sent, None, k + 1, scale), k + 1).where(F.col("rank") == k + 1)
        floors = np.full(asked.count, _LEAST)
        for r in seed.select("number", "score").collect():  # one row for each query of the slice
            floors[r.number] = r.score
        found = scratch.table(ranked(_pass(x, sent, spark.sparkContext.broadcast(floors), k + 1, scale), k + 1))
        named = spark.createDataFrame(list(asked.named(scale)), "number long, query_id long, copies long, own long")
        found = found.join(F.broadcast(named), "number")
        itself = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("rank"))).over(Window.partitionBy("number"))
        found = found.withColumn("itself", F.coalesce(itself, F.lit(k + 1))).where("rank <> itself").withColumn("rank", F.col("rank") - (F.col("rank") > F.col("itself")).cast("int"))
        found = found.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
        out = found if out is None else out.unionByName(found)
    return out


def op6_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 best of `embeddings` for every vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, vectors.where("vec_id % 100 = 0"))
