"""Exact top-k search by inner product with M-trees.

Vectors are scaled to integers. Padding each with sqrt(M^2 - |x|^2) turns the inner product into
a Euclidean distance, |q - x|^2 = |q|^2 + M^2 - 2 q.x, so nearest means highest score. Rows are dealt
to shards; a shard's tree has pages of at most ``PAGE`` entries with covering radii and
distances to the parent, and is searched best-first, by ``BLOCK`` queries at a time: a query leaves out a page, mostly
without computing its distance, when the triangle inequality puts it beyond the k-th best so far.
One matrix product gives the distances of a page's entries for all queries that still reach it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from channelspark.llm.common import by_key
from channelspark.session import stored

PAGE, FANOUT = 64, 16
NEAR = PAGE * FANOUT  # rows that a query's first bound is taken from, at most
SHARD = 8192  # rows that a tree has at least, if there are as many
COMPONENTS = 2**21  # of a larger tree at most
BLOCK = 2048
EXACT = 2.0**53  # below, a double holds every integer
UNIT_BITS = 400  # longer integers are measured in a larger unit, so that squares stay doubles
SLACK = 1e-3


def square_lengths(vectors: np.ndarray) -> np.ndarray:
    """Squared lengths of integer vectors, as Python integers if 64 bits might not hold them."""
    largest = max(-int(vectors.min(initial=0)), int(vectors.max(initial=0)))
    exact = vectors.astype(object) if vectors.shape[1] * largest**2 >= 2**63 else vectors
    return (exact * exact).sum(1)


def exact_type(most: int) -> type:
    """The type with the fastest matrix product that is exact while no sum exceeds ``most``."""
    return np.float32 if most < 2**24 else np.float64 if most < EXACT else np.int64 if most < 2**63 else object


@dataclass
class Node:
    """A page: its entries' points, distances to the page's own pivot, what lies below, and all rows there."""

    rows: np.ndarray
    to_parent: np.ndarray
    below: np.ndarray
    radius: np.ndarray | None = None
    children: list = field(default_factory=list)


class MTree:
    """Bulk-loaded tree over integer vectors (int64, or Python integers).

    Distances are doubles in units of 1, or of a power of two that is at least ``largest`` (of all vectors and queries) over 2^UNIT_BITS.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: int = 0):
        self.unit = 1 << max(0, largest.bit_length() - UNIT_BITS)
        self.ids, self.vectors = ids, vectors.astype(object) if self.unit > 1 else vectors
        norms = square_lengths(self.vectors)
        self.bound = int(norms.max(initial=0))
        self.points = np.column_stack([self._double(self.vectors), np.sqrt(self._double(self.bound - norms, 2))])
        self.random = np.random.default_rng(11)
        self.root = self._page(np.arange(len(ids)), np.zeros(vectors.shape[1] + 1))
        self.computed = 0

    def _double(self, values: np.ndarray, power: int = 1) -> np.ndarray:
        return (values if self.unit == 1 else values / self.unit**power).astype(np.float64)

    def _distance(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - point) ** 2).sum(1))

    def _page(self, rows: np.ndarray, pivot: np.ndarray) -> Node:
        if len(rows) <= PAGE:
            return Node(rows, self._distance(rows, pivot), rows)
        pivots = self.random.choice(rows, min(FANOUT, -(-2 * len(rows) // PAGE)), replace=False)  # leaves are half full on average
        apart = np.array([self._distance(rows, self.points[p]) for p in pivots])
        nearest = apart.argmin(0)
        if np.bincount(nearest).max() > 0.9 * len(rows):  # too alike for pivots: cut evenly
            nearest = np.arange(len(rows)) % len(pivots)
        used = np.unique(nearest)
        radius = np.array([apart[i][nearest == i].max() for i in used])
        children = [self._page(rows[nearest == i], self.points[pivots[i]]) for i in used]
        return Node(pivots[used], self._distance(pivots[used], pivot), rows, radius, children)

    def _apart(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distances to points, from the queries' squared lengths and their scores."""
        return np.sqrt(self._double(np.maximum(norms + self.bound - 2 * scores, 0), 2))

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) by score, then smaller id, without the id ``own``."""
        _, scores, keys = self.search_block(query[None], np.array([own]), k)
        return list(zip(scores.tolist(), keys.tolist()))

    def search_block(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of the queries, scores and ids of all that ``search`` finds for each of them.

        A page is read once, for all queries that it can still serve, and pages come by the least distance at which one
        of their queries can find something. The first bounds are those of the pages to which the nearest pivots lead.
        """
        norms = square_lengths(queries)
        most = 4 * max(self.bound, int(norms.max(initial=0)))  # bounds scores, squared distances and all sums on the way
        kind = object if self.unit > 1 else exact_type(most)
        vectors, queries, norms = self.vectors.astype(kind), queries.astype(kind), norms.astype(kind)
        lengths = np.sqrt(self._double(norms, 2))
        slack = np.maximum(SLACK, 2.0**-50 * (queries.shape[1] + 5) * (lengths + math.sqrt(self.bound / self.unit**2)))  # rounding of distances
        # a score that each query's k-th best has at least, the largest id of use at this score, and its distance with slack
        worst, last, far = np.full(len(queries), -most - 1, kind), np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), np.inf)

        def scores_of(asks: np.ndarray, rows: np.ndarray) -> np.ndarray:
            self.computed += len(asks) * len(rows)
            return queries[asks] @ vectors[rows].T

        down = [(self.root, np.arange(len(queries)))]
        while down:
            node, asks = down.pop()
            if len(node.below) > NEAR:
                nearest = scores_of(asks, node.rows).argmax(1)
                down += [(child, asks[nearest == i]) for i, child in enumerate(node.children) if (nearest == i).any()]
            elif len(node.below) > k:
                scores = scores_of(asks, node.below)
                scores[self.ids[node.below] == own[asks, None]] = -most - 1
                worst[asks] = np.partition(scores, -k, axis=1)[:, -k]
        some = np.flatnonzero(worst > -most - 1)
        far[some] = self._apart(norms[some], worst[some]) + slack[some]

        found, pending = [(np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, self.ids.dtype))], 0

        def settle() -> None:
            """Keep the k best of what was found, and tighten the bounds of queries that have as many."""
            asks, scores, keys = (np.concatenate(column) for column in zip(*found))
            by = np.lexsort((keys, -scores, asks))
            asks, scores, keys = asks[by], scores[by], keys[by]
            place = np.arange(len(asks)) - np.searchsorted(asks, asks)
            found[:] = [(asks[place < k], scores[place < k], keys[place < k])]
            full, kth = asks[place == k - 1], place == k - 1
            worst[full], last[full] = scores[kth], keys[kth]
            far[full] = self._apart(norms[full], worst[full]) + slack[full]

        order = count()
        todo = [(0.0, next(order), self.root, np.arange(len(queries)), lengths, np.zeros(len(queries)))]
        while todo:
            _, _, node, asks, d, low = heapq.heappop(todo)
            bound = far[asks]
            if not (low <= bound).all():
                needed = np.flatnonzero(low <= bound)
                if not len(needed):
                    continue
                asks, d, bound = asks[needed], d[needed], bound[needed]
            # the entries whose distances from the page's pivot are within reach of those of the queries
            reach = node.radius if node.children else 0.0
            entries = np.flatnonzero((node.to_parent - reach <= (d + bound).max()) & ((d - bound).min() <= node.to_parent + reach))
            if not len(entries):
                continue
            rows = node.rows[entries]
            scores = scores_of(asks, rows)
            if node.children:
                apart = self._apart(norms[asks], scores.T)
                low = np.maximum(apart - node.radius[entries, None], 0.0)
                for i, least, own_apart, own_low in zip(entries.tolist(), low.min(1).tolist(), apart, low):
                    heapq.heappush(todo, (least, next(order), node.children[i], asks, own_apart, own_low))
                continue
            at, column = np.divmod(np.flatnonzero(scores >= worst[asks, None]), len(rows))
            asks, scores, keys = asks[at], scores[at, column], self.ids[rows[column]]
            better = ((scores > worst[asks]) | (keys <= last[asks])) & (keys != own[asks])
            found.append((asks[better], scores[better], keys[better]))
            pending += len(found[-1][0])
            if pending > k * len(queries) // 2:
                settle()
                pending = 0
        settle()
        asks, scores, keys = found[0]
        return asks, scores if kind is object else scores.astype(np.int64), keys


def fitting(score: int) -> tuple[int, int]:
    """A score as a 64-bit integer and 0, or 0 and the side on which it exceeds one."""
    return (score, 0) if -(2**63) <= score < 2**63 else (0, 1 if score > 0 else -1)


def scaled(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id`` and ``v``, the vector's components as floor(scale * x); unusable rows are left out.

    A vector with a component that no double scales exactly has its plain components in ``wide`` instead.
    """
    least, most = (F.coalesce(end, F.lit(0.0)) for end in (F.array_min("x"), F.array_max("x")))  # NaN is above all numbers
    usable = ~F.exists("x", lambda c: c.isNull()) & (least > -math.inf) & (most < math.inf)
    fits = (least > -EXACT / scale) & (most < EXACT / scale)
    return (
        df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
        .where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(usable)
        .select("id", F.when(fits, F.transform("x", lambda c: F.floor(c * scale))).alias("v"), F.when(~fits, F.col("x")).alias("wide"))
    )


def integer(x: float, scale: int) -> int:
    """floor(scale * x) of any finite double."""
    return math.floor(x * scale) if abs(x) < EXACT else int(x) * scale


def integers(rows: pa.Table, width: int, scale: int) -> np.ndarray:
    """The rows' vectors as integers, int64 or (if one is wide) Python integers, padded with zeros."""
    v = rows["v"].combine_chunks()
    matrix = np.zeros((len(rows), width), np.int64)
    sizes = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    matrix[np.arange(width) < sizes[:, None]] = v.flatten().to_numpy()
    wide = np.flatnonzero(rows["wide"].is_valid().to_numpy())
    if len(wide):
        matrix = matrix.astype(object)
        for i in wide.tolist():
            own = rows["wide"][i].as_py()
            matrix[i, : len(own)] = [integer(x, scale) for x in own]
    return matrix


def exact_top_k(
    vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k best rows of each query.

    Queries are the rows whose id is divisible by ``every`` (rows that share an id ask together); every row
    with another id is a candidate, all of them if there are fewer than k. Equal scores go to the smaller id, and repeated rows count
    as often as they occur. Rows without an id, without a vector, or with a null or non-finite component take no part. Shorter vectors count as padded with zeros. A score
    among the best that is no 64-bit integer is an error.
    """
    rows = stored(scaled(vectors, id_col, vector_col, scale), "vectors")
    asking = F.col("id") % every == 0
    size, asked, width, *ends = rows.agg(
        F.count(F.lit(1)), F.count_if(asking), F.max(F.greatest(F.array_size("v"), F.array_size("wide"))), F.min(F.array_min("wide")), F.max(F.array_max("wide")),
    ).first()
    width, largest = width or 0, max((abs(integer(x, scale)) for x in ends if x is not None), default=0)
    # trees as large as they may be, but whole waves of tasks
    cores, largest_tree = vectors.sparkSession.sparkContext.defaultParallelism, max(SHARD, COMPONENTS // max(1, width))
    shards = max(1, min(-(-size // SHARD), cores * -(-size // (cores * largest_tree))))
    blocks = max(1, -(-asked // BLOCK))
    # a point goes to one shard, copies too; a query goes to every shard, where its block comes after the points
    points = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"), F.lit(0).cast("bigint").alias("block"), "id", "v", "wide")
    queries = rows.where(asking).distinct().repartition(shards).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), (F.pmod(F.xxhash64("id", "v", "wide"), F.lit(blocks)) + 1).alias("block"), "id", "v", "wide")
    both = points.union(queries).select("shard", (F.col("shard") * F.lit(blocks + 1).cast("bigint") + F.col("block")).alias("key"), "id", "v", "wide")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = None, None
        for rows in by_key(batches):
            shard, block = divmod(rows["key"][0].as_py(), blocks + 1)
            ids, matrix = rows["id"].to_numpy(), integers(rows, width, scale)
            if block == 0:
                tree, of = MTree(ids, matrix, largest), shard
            elif of == shard:
                asks, scores, others = tree.search_block(matrix, ids, k)
                fits = np.array([fitting(score) for score in scores.tolist()], np.int64).reshape(-1, 2)
                columns = ids[asks], others, fits[:, 0], fits[:, 1]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score", "beyond"])

    found = both.repartitionById(shards, "shard").sortWithinPartitions("key").mapInArrow(
        search, "query_id bigint, vec_id bigint, score bigint, beyond bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), "vec_id"))
    score = F.when(F.col("beyond") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score exceeds 64 bits")).cast("bigint"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", score.alias("score"))
