"""Exact top-k search by inner product: a KD-tree per shard.

Vectors are dealt to shards by a hash of their id. A shard's tree splits at the median of its widest
dimension and keeps the tight bounding box of every node. A query visits nodes best first, by the largest
inner product that the node's box allows, until no bound reaches its k-th score so far; that score is
carried from shard to shard, so later shards are cut short.

A block of queries meets each shard once. Vectors that are null or hold null or non-finite components,
and those of another length than the query, take no part. Scores are exact integers; those past the range
of a long count as its ends. Repeated ids are rows of their own: each is a candidate, and a query's own id
never is. Ties go to the smaller id. Columns other than key and vector are not looked at, whatever their
names. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Vectors a shard and a leaf, and queries a block.
SHARD, LEAF, BLOCK = 8192, 256, 1024
#: Sums of products below this are exact in floating point; larger scores are summed as Python integers.
EXACT = float(1 << 53)
#: The largest score of a long that has a negative.
TOP = (1 << 63) - 1


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Nodes in heap order; rows of a node lie together. A node of at most ``leaf`` rows is not split."""
    order, spans = np.arange(len(ids)), {0: (0, len(ids))}
    todo, low, high, inner = [0], {}, {}, {}
    while todo:
        node = todo.pop()
        a, b = spans[node]
        part = vectors[order[a:b]]
        low[node], high[node] = part.min(0), part.max(0)
        inner[node] = b - a > leaf and bool((high[node] > low[node]).any())
        if inner[node]:
            split = int(np.argmax(high[node].astype(np.float64) / 2 - low[node].astype(np.float64) / 2))
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, split], mid, kind="introselect")]
            for child, span in ((2 * node + 1, (a, a + mid)), (2 * node + 2, (a + mid, b))):
                spans[child] = span
                todo.append(child)
    names = sorted(spans)
    at = {n: k for k, n in enumerate(names)}
    return {
        "ids": ids[order],
        "vectors": vectors[order],
        "low": np.stack([low[n] for n in names]),
        "high": np.stack([high[n] for n in names]),
        "spans": np.array([spans[n] for n in names]),
        "children": np.array([(at[2 * n + 1], at[2 * n + 2]) if inner[n] else (-1, -1) for n in names]),
    }


def bounds(tree: dict[str, np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Largest inner product of each query with any point of each node's box."""
    q = queries.astype(np.float64)
    return np.maximum(q, 0) @ tree["high"].T.astype(np.float64) + np.minimum(q, 0) @ tree["low"].T.astype(np.float64)


def margin(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """More than what floating-point products of the two may be off; infinite where they overflow."""
    return np.nan_to_num(np.abs(queries.astype(np.float64)) @ np.abs(vectors.astype(np.float64)).T * 1e-12, nan=np.inf)


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    q = [int(x) for x in query]
    return np.array([max(-TOP, min(TOP, sum(int(x) * y for x, y in zip(v, q, strict=True)))) for v in vectors.tolist()], np.int64)


class Best:
    """The k best of each query of a block so far, over all shards seen. A candidate below a query's k-th
    score can't be among them."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.own, self.queries, self.k = ids, queries.astype(np.float64), k
        self.kth: list[float] = [float("-inf")] * len(ids)
        self.ids = [np.zeros(0, np.int64)] * len(ids)
        self.scores = [np.zeros(0, np.int64)] * len(ids)

    def search(self, tree: dict[str, np.ndarray]) -> None:
        """Best first through a shard's tree, for each query, until no box reaches its k-th score."""
        vectors = tree["vectors"].astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            plain = float(np.abs(self.queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1]) < EXACT
            reach = bounds(tree, self.queries)
            if not plain:
                reach = np.nan_to_num(reach + margin(self.queries, np.maximum(np.abs(tree["low"].astype(np.float64)), np.abs(tree["high"].astype(np.float64)))), nan=np.inf, posinf=np.inf)
        spans, children = tree["spans"].tolist(), tree["children"].tolist()
        for q, own in enumerate(self.own):
            limit, row, best_ids, best = self.kth[q], reach[q].tolist(), self.ids[q], self.scores[q]
            heap = [(-row[0], 0)]
            while heap and -heap[0][0] >= limit:
                _, node = heapq.heappop(heap)
                left, right = children[node]
                if left >= 0:
                    for child in (left, right):
                        if row[child] >= limit:
                            heapq.heappush(heap, (-row[child], child))
                    continue
                a, b = spans[node]
                ids = tree["ids"][a:b]
                if plain:
                    scores = vectors[a:b] @ self.queries[q]
                    at = np.flatnonzero((scores >= limit) & (ids != own))
                    scores = scores[at].astype(np.int64)
                else:  # what may reach the k-th score is summed again, in whole numbers
                    with np.errstate(over="ignore", invalid="ignore"):
                        about = np.nan_to_num(vectors[a:b] @ self.queries[q] + margin(self.queries[q], vectors[a:b]), nan=np.inf, posinf=np.inf)
                    at = np.flatnonzero((about >= limit) & (ids != own))
                    scores = exact_scores(self.queries[q], vectors[a:b][at])
                if len(at):
                    best, best_ids = np.concatenate((best, scores)), np.concatenate((best_ids, ids[at]))
                    if len(best) > self.k:
                        top = np.lexsort((best_ids, -best))[: self.k]
                        best, best_ids = best[top], best_ids[top]
                    if len(best) == self.k:
                        limit = max(limit, int(best.min()))
            self.kth[q], self.ids[q], self.scores[q] = limit, best_ids, best

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query_id, vec_id, score."""
        n = [len(x) for x in self.ids]
        return np.repeat(self.own, n), np.concatenate(self.ids), np.concatenate(self.scores)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """part, data: rows of one partition in runs of at most ``size``, pickled arrays of ids and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, width = [], [], None

        def put() -> pa.RecordBatch:
            whole = np.array(vectors, np.float64).reshape(len(ids), -1)
            small = bool((np.abs(whole) < 1 << 31).all())
            data = pickle.dumps((np.array(ids, np.int64), whole.astype(np.int32) if small else whole))
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([data], pa.binary())], names=["width", "data"])

        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    width = len(v)
                    yield put()
                    held[width] = ([], [])
        for width, (ids, vectors) in held.items():  # noqa: B007
            if ids:
                yield put()

    return rows.mapInArrow(run, "width int, data binary")


def _shards(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [pickle.dumps(build(*pickle.loads(x))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.binary())], names=["width", "tree"])

    return _packed(rows, SHARD).mapInArrow(run, "width int, tree binary")


def quantised(table: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """id and v (integers floor(scale * x), as doubles, which hold them exactly) of the vectors that take part.
    A component whose product overflows counts as the largest double."""
    x = F.col(vector).cast("array<double>")
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    largest = 1.7976931348623157e308

    def floored(c):
        y = F.least(F.greatest(c * float(scale), F.lit(-largest)), F.lit(largest))
        return F.when(F.abs(y) >= float(1 << 52), y).otherwise(F.floor(F.when(F.abs(y) < float(1 << 52), y)).cast("double"))

    return table.where(whole & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(x, floored).alias("v"))


def top_k(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score. Both frames: id, v.

    Work grows with queries times shards, as asked. Shards are dealt to groups by number, and every block of
    queries goes to every group; a task takes a block through its group's shards, which share the k-th
    scores, and returns at most k rows a query. Groups are as many as tasks can run, so a block's copies don't
    grow with the shards. Shards and blocks are written once, so a task that is run again meets the same ones.
    """
    spark = base.sparkSession
    shards = max(1, -(-base.count() // SHARD))
    blocks = max(1, -(-queries.count() // BLOCK))
    groups = min(shards, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(_shards(base.repartition(shards, F.xxhash64("id"))).withColumn("group", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(groups))), "shards")
    asked = written(_packed(queries.repartition(blocks, F.xxhash64("id")), BLOCK), "blocks").withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    met = asked.join(dealt.hint("merge"), ["group", "width"]).select("data", "tree")  # blocks with shards, not rows with rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best = b"", None

        def put() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in best.rows()], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for n in range(batch.num_rows):
                data = batch.column(0)[n].as_py()
                if data != last:
                    if best is not None:
                        yield put()
                    last, best = data, Best(*pickle.loads(data), k)
                best.search(pickle.loads(batch.column(1)[n].as_py()))
        if best is not None:
            yield put()

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
