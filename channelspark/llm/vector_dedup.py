"""Embedding near-dedup with spherical-cap filters.

A filter is a direction; a vector passes if its inner product with it exceeds a height. Directions come
from random product codes: after a random rotation, one of ``CODES`` short vectors for each half,
so that a vector's scores with CODES^2 directions are sums of 2 CODES products and the exceeding
ones are list-decoded from the sorted halves. Vectors meet in the filters that both pass and are verified
by cosine in double precision. A link is counted in the first filter that both ends pass, so
no pair needs to be written down: a filter emits each vector's number of links and a chain through each class.

The height is set so that a random vector of the same dimension passes ``LISTED`` of the filters on average.
Two vectors at cosine 0.9 then share 11 on average, and none in about 0.4 % of cases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelspark.llm.common import by_key, in_slices
from channelspark.llm.components import connected_components
from channelspark.session import stored

ROUNDS, CODES = 16, 32
LISTED = 26
LEAST_DIM = 16
BUCKET = 2048


@lru_cache(maxsize=4)
def product_codes(width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotations (round, width, width), codes (round, half, code, width / 2) and the height to exceed."""
    random = np.random.default_rng(width)
    turns = np.array([np.linalg.qr(random.normal(size=(width, width)))[0] for _ in range(ROUNDS)])
    codes = random.normal(size=(ROUNDS, 2, CODES, width // 2))
    codes /= np.linalg.norm(codes, axis=3, keepdims=True) * np.sqrt(2)
    x = random.normal(size=(2048, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scores = [first[:, :, None] + second[:, None, :] for r in range(ROUNDS)
              for first, second in [halves(x[r::ROUNDS] @ turns[r], codes[r])]]
    return turns, codes, float(np.quantile(np.concatenate(scores), 1 - LISTED / (ROUNDS * CODES**2)))


def halves(turned: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of rotated vectors with the codes of each half."""
    half = turned.shape[1] // 2
    return turned[:, :half] @ codes[0].T, turned[:, half:] @ codes[1].T


def decode(vectors: np.ndarray) -> list[np.ndarray]:
    """Sorted numbers of the filters that each vector passes."""
    n, width = vectors.shape
    padded = np.zeros((n, max(LEAST_DIM, width + width % 2)))
    padded[:, :width] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turns, codes, height = product_codes(padded.shape[1])
    rows, filters = [], []
    for r in range(ROUNDS):
        first, second = halves(padded @ turns[r], codes[r])
        # a first half is worth listing only if it reaches the height with the best second half
        row, a = np.nonzero(first + second.max(1, keepdims=True) >= height)
        at, b = np.nonzero(first[row, a][:, None] + second[row] >= height)
        rows.append(row[at])
        filters.append((r * CODES + a[at]) * CODES + b)
    row, found = np.concatenate(rows), np.concatenate(filters)
    order = np.lexsort((found, row))
    return np.split(found[order].astype(np.int64), np.cumsum(np.bincount(row, minlength=n))[:-1])


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def links_in(name: int, vectors: np.ndarray, filters: list[np.ndarray], tree: np.ndarray, cosine: float) -> np.ndarray:
    """Which members of one filter are linked, without links that an earlier filter has too."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    if not tree.all():  # two slices: only across
        linked &= tree[:, None] != tree[None, :]
    some = np.flatnonzero(linked.any(1))
    earlier = [filters[i][filters[i] < name] for i in some]
    names, at = np.unique(np.concatenate(earlier), return_inverse=True) if len(some) else ([], [])
    passed = np.zeros((len(some), len(names)), np.float32)
    passed[np.repeat(np.arange(len(some)), [len(e) for e in earlier]), at] = 1
    linked[np.ix_(some, some)] &= passed @ passed.T == 0
    return linked


def chain(linked: np.ndarray) -> np.ndarray:
    """For each member another of its class, so that classes hang together; itself for the last one."""
    after, todo = np.arange(len(linked)), set(np.flatnonzero(linked.any(1)).tolist())
    while todo:
        last = todo.pop()
        front, reached = [last], [last]
        while front:
            new = [i for i in np.flatnonzero(linked[front].any(0)).tolist() if i in todo]
            todo.difference_update(new)
            reached += new
            front = new
        after[reached[:-1]] = reached[1:]
    return after


def near_vectors(
    vectors: DataFrame, cosine: float = 0.9, bucket: int = BUCKET, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``id``, ``n_links`` and ``component``, the smallest id reachable over links, per row.

    Rows whose vector is null, zero, or holds null or non-finite components link with nothing, and
    vectors of different length do not link. Equal vectors are compared once and link with each
    other; repeated rows and rows without an id count as rows. Where no row of a component has an id,
    ``component`` is null. Links below ``cosine`` are never made; see the module for the share found.
    """
    x = F.col("x")
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = stored(
        vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"))
        .withColumn("x", F.when(F.coalesce(usable, F.lit(False)), x)), "vectors")
    distinct = stored(
        rows.where(x.isNotNull()).groupBy("x").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                named = pa.array([f + (int(size) << 32) for f in decode(unit_rows(part.column("x")))], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("node", "copies", "x")], named], ["node", "copies", "x", "filters"])

    kind = distinct.schema["x"].dataType.simpleString()
    coded = stored(distinct.select("node", "copies", "x").mapInArrow(passes, f"node bigint, copies bigint, x {kind}, filters array<bigint>"), "filters")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches):
            if len(rows) < 2:
                continue
            filters = [np.array(f) for f in rows["filters"].to_pylist()]
            linked = links_in(rows["name"][0].as_py(), unit_rows(rows["x"]), filters, rows["tree"].to_numpy(), cosine)
            some = np.flatnonzero(linked.any(1))
            if len(some):
                node = rows["node"].to_numpy()
                links = linked @ rows["copies"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[chain(linked)][some])],
                                                 ["node", "links", "other"])

    pairs = coded.select(F.explode("filters").alias("key"), "node", "copies", "x", "filters")
    keyed = in_slices(pairs.withColumn("name", F.col("key")), F.col("node"), bucket)
    found = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(
        verify, "node bigint, links bigint, other bigint"), "vector-links")
    member = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = (
        distinct.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    )
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select(
        F.col("x").alias("vector"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    linked = rows.where(x.isNotNull()).join(named, x == F.col("vector")).select("id", "n_links", "component")
    alone = rows.where(x.isNull()).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone)
