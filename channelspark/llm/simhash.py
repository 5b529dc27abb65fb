"""SimHash near-dedup with BK-trees.

Fingerprints within ``RADIUS`` = 3 bits agree on at least one of four equal blocks of their bits, so a
tree per block value (a shard) meets every link. Trees go to the fingerprints that can match them
by the shared block instead of to every executor, because all trees together grow with the data.
A shard with more than ``SHARD`` fingerprints is split anew on its other bits, up to three times, and
what is still larger is cut into slices whose trees are met by every other slice. A shard emits a
chain through each of its classes rather than its pairs, which grows no faster than its size.

``near_copies`` links texts by the true Jaccard similarity of their word shingles. At 0.8 fingerprints differ in
about 10 bits, too many for blocks of bits, so its shards are bands of min-hashes; their trees' links only
say which texts meet, and each link that counts is verified on the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelspark.llm.common import by_key, in_slices, packed, text_of
from channelspark.llm.components import connected_components
from channelspark.session import stored

RADIUS = 3
SHARD = 2048
PIECE = 65_536
#: A pair of similarity 0.8 shares no band of 5 min-hashes of 20 with a chance of 0.0004, and exceeds 24 bits more rarely.
BANDS, BAND, WIDE = 20, 5, 24
MEET = 512
FACTORS = np.random.default_rng(17).integers(0, 1 << 63, (2, BANDS * BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit majority vote over XXH64 (seed 42) of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    ones, total, digest = np.zeros(64, np.int64), len(words) - size + 1, xxhash.xxh64_intdigest
    for first in range(0, total, PIECE):
        part = words[first : first + PIECE + size - 1]
        line, ends = b" ".join(part), np.cumsum([len(w) + 1 for w in part]) - 1
        starts = np.append(0, ends[:-1] + 1)[: len(part) - size + 1].tolist()
        h = np.array([digest(line[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist())], "<u8")
        at = h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        ones += (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``part`` (a hash of the text) and ``fp``, the fingerprint as a signed long."""

    @F.pandas_udf("bigint")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))

    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("part"), run(text).alias("fp"))


class BKTree:
    """Nodes whose children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.nodes: list[tuple[int, dict]] = []

    def add(self, code: int) -> None:
        new = (code, {})
        if self.nodes:
            at = self.nodes[0]
            while (below := at[1].get(d := (code ^ at[0]).bit_count())) is not None:
                at = below
            at[1][d] = new
        self.nodes.append(new)

    def within(self, code: int, radius: int) -> list[int]:
        """Stored codes within ``radius``; only edges from d - radius to d + radius are followed."""
        out, todo = [], self.nodes[:1]
        while todo:
            value, edges = todo.pop()
            d = (code ^ value).bit_count()
            if d <= radius:
                out.append(value)
            if edges:
                todo += [c for e, c in edges.items() if -radius <= e - d <= radius]
        return out


def shard_links(trees: list[int], queries: list[int] | None = None, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Chains through the classes of a shard, or of one slice's tree and the queries of another."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def join(code: int) -> None:
        for other in tree.within(code, radius):
            parent[root(code)] = root(other)

    tree = BKTree()
    for code in trees:
        if queries is None:
            join(code)
        tree.add(code)
    for code in queries or ():
        join(code)
    classes: dict[int, list[int]] = {}
    for code in parent:
        classes.setdefault(root(code), []).append(code)
    for members in classes.values():
        yield from zip(members, members[1:])


def _match(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links of shards: rows (key, tree, fp) with one key's rows next to each other."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(key: tuple, fps: np.ndarray, trees: np.ndarray) -> Iterator[tuple[int, int]]:
        codes = fps.view(np.uint64)
        if trees.all():
            return shard_links(codes.tolist(), None, radius)
        return shard_links(codes[trees].tolist(), codes[~trees].tolist(), radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
        for batch in chain(batches, [None]):
            if batch is not None:
                new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                held = [np.concatenate([h, n.astype(np.int64)]) for h, n in zip(held, new)]
            key, tree, fp = held
            cuts = np.flatnonzero(np.diff(key)) + 1
            ends = np.append(cuts, len(key)) if batch is None else cuts
            starts = np.append(0, cuts)[: len(ends)]
            pairs: list[tuple[int, int]] = []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                pairs += links(key[s], fp[s:e], tree[s:e].astype(bool))
            done = int(ends[-1]) if len(ends) else 0
            held = [h[done:] for h in held]
            if pairs:
                out = np.array(pairs, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], schema=schema)

    return rows.select("key", F.col("tree").cast("bigint"), "fp").mapInArrow(run, "a long, b long")


def near_links(prints: DataFrame, shard: int = SHARD) -> DataFrame:
    """Links (``a``, ``b``) that join all distinct fingerprints ``fp`` within three bits of each other."""
    found, bits = [], 64
    rows = prints.select(F.lit(0).cast("bigint").alias("key"), "fp", F.col("fp").alias("rest"))
    for _ in range(3):
        rows, bits = _split(rows, bits), bits * 3 // 4
        large = stored(rows.groupBy("key").count().where(F.col("count") > shard), "large")
        small = rows.join(large, "key", "left_anti").select("key", F.lit(True).alias("tree"), "fp")
        found.append(_match(small.repartition("key").sortWithinPartitions("key")))
        if large.isEmpty():
            return reduce(DataFrame.union, found)
        rows = rows.join(large, "key").select("key", "fp", "rest")
    sliced = in_slices(rows.select("key", "fp"), F.col("fp"), shard)
    found.append(_match(sliced.repartition("key").sortWithinPartitions("key")))
    return reduce(DataFrame.union, found)


def _split(rows: DataFrame, bits: int) -> DataFrame:
    """Rows under a key for each quarter of ``rest``, which keeps the other three quarters."""
    width = bits // 4
    parts = []
    for i in range(4):
        low = F.col("rest").bitwiseAND(F.lit((1 << i * width) - 1))
        high = F.shiftleft(F.shiftrightunsigned("rest", (i + 1) * width), i * width) if i < 3 else F.lit(0)
        value = F.shiftrightunsigned("rest", i * width).bitwiseAND(F.lit((1 << width) - 1))
        parts.append(F.struct(F.xxhash64("key", F.lit(bits), F.lit(i), value).alias("key"), low.bitwiseOR(high).alias("rest")))
    return rows.select("fp", F.explode(F.array(*parts)).alias("p")).select("p.key", "fp", "p.rest")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``part``, ``fp`` and ``component``: the smallest id reachable over links of three bits.

    One row per input row. Null texts and texts without words have the fingerprint zero and link
    like any other. Rows without an id take part; where no row of a component has one, ``component``
    is null. Repeated rows share a component.
    """
    rows = stored(with_fingerprints(docs, id_col, text_col), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    member = connected_components(near_links(prints.select("fp")))
    labelled = prints.join(member.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component"))
    named = labelled.select("fp", "root").join(least, "root").select("fp", "component")
    return rows.join(named, "fp").select("id", "part", "fp", "component")


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted XXH64 hashes of the distinct word shingles; all words are one shingle if there are fewer than ``size``."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    parts = []
    for first in range(0, len(words) - size + 1, PIECE):
        part = words[first : first + PIECE + size - 1]
        line, ends = b" ".join(part), np.cumsum([len(w) + 1 for w in part]) - 1
        starts = np.append(0, ends[:-1] + 1)[: len(part) - size + 1].tolist()
        parts.append(np.array([xxhash.xxh64_intdigest(line[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist())], np.uint64))
    return np.unique(np.concatenate(parts))


def sketch(found: np.ndarray) -> tuple[int, int, list[int]]:
    """A digest, the majority fingerprint and the keys of the bands of min-hashes of a set of shingles."""
    ones, least = np.zeros(64, np.int64), np.full(BANDS * BAND, (1 << 64) - 1, np.uint64)
    for first in range(0, len(found), 2048):
        h = found[first : first + 2048]
        at = h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        ones += (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()
        least = np.minimum(least, (h[:, None] * FACTORS[0] + FACTORS[1]).min(0))
    fp = int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])
    bands = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, BAND))]
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 1)).view(np.int64)), fp, np.array(bands, np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets reaches ``similarity``."""
    few, many = sorted((len(a), len(b)))
    if few < similarity * many - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def verified_links(keys: list[int], sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Links of alike sets that join every class; sets that are joined already are not compared."""
    classes: list[list[int]] = []
    for i, own in enumerate(sets):
        mine, others = [i], []
        for members in classes:
            if (j := next((j for j in members if alike(own, sets[j], similarity)), None)) is None:
                others.append(members)
            else:
                yield keys[i], keys[j]
                mine = members + mine
        classes = [mine, *others]


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id``, ``part`` and ``component`` as in ``near_duplicates``, over links of texts whose sets of ``size``-word
    shingles have a Jaccard similarity of at least ``similarity`` (not below 0.8, for which the bands are sized).
    """
    text = text_of(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, fp, bands = zip(*(sketch(shingles(t, size)) for t in batch.column("text").to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), pa.array(digest, pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "part", "node", "fp", "bands"])

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("part"), text.alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    rows = stored(source.mapInArrow(run, f"id {kind}, part bigint, node bigint, fp bigint, bands array<bigint>"), "sketches")
    nodes = stored(rows.groupBy("node").agg(F.min("id").alias("least"), F.min("part").alias("part"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), "sets")
    shards = in_slices(nodes.select(F.explode("bands").alias("key"), "fp").distinct(), F.col("fp"), SHARD)
    coarse = connected_components(_match(shards.repartition("key").sortWithinPartitions("key"), WIDE))
    group = nodes.join(coarse.withColumnRenamed("node", "fp"), "fp", "left").select("node", "part", F.coalesce("root", "fp").alias("key"))
    meet = stored(group.join(group.groupBy("key").count().where("count > 1"), "key").select("key", "node", "part"), "meet")
    texts = source.join(meet, "part").groupBy("part", "node", "key").agg(F.first("text").alias("text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_key(batches):
            links = list(verified_links(held["node"].to_pylist(), [shingles(t, size) for t in held["text"].to_pylist()], similarity))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    met = in_slices(texts.select("key", "node", "text"), F.col("node"), MEET).select("key", "node", "text")
    member = connected_components(met.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a bigint, b bigint"))
    labelled = nodes.join(member, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component"))
    named = labelled.select("node", "root").join(least, "root").select("node", "component")
    return rows.join(named, "node").select("id", "part", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies=near_duplicates) -> DataFrame:
    """The input rows with the smallest id of each component; one of several rows with that id and text.

    A component without ids keeps one row of each text.
    """
    kept = (
        copies(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("component")))
        .select(F.col("id").alias("kept_id"), F.col("part").alias("kept_part")).distinct()
    )
    rows = docs.select(packed(docs).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("part"))
    match = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("part") == F.col("kept_part"))
    return rows.join(kept, match).groupBy("id", "part").agg(F.first("row").alias("row")).select("row.*")
