"""Language-model scores from a causal self-attention model over subword ids.

A text is its words with A-Z in lower case, then one end. Its byte-level BPE ids fall into classes: the
most frequent ids are classes of their own, the others are clustered by what they follow. The model
attends from the last token to the tokens before it; what an attended token contributes is not a vector
but the distribution of the next class after it (at that distance), counted by Spark over all training
documents. A mixture of distributions is a distribution, so no softmax over the vocabulary is needed:

    A(id | before) = sum_j attention(last, j) * T[distance, class_j, class(id)] * P(id | class(id))

Where the last two ids begin an id triple of the training texts, the triples' counts, less a discount,
come first, and the attention's answer shares what the discount frees:

    P(id | a, b, ...) = (max(n(a, b, id) - D, 0) + D * kinds(a, b) * A(id | before)) / n(a, b)

The counts of all triples stay with Spark. Pieces of the corpus send their distinct triples to shards by the
first two ids, and each shard sends back the counts of what a piece asked for, so a task holds a piece or a shard.

Queries, keys and a bias per distance are trained in numpy by Adam: each task takes all windows of every
document it holds, and the tasks' parameters are averaged by Spark after each round. Windows of
2 * HOP tokens overlap by HOP, so that each token is scored once, with HOP to 2 * HOP - 1 tokens before it
(fewer at the start of a text).

Words are split, counted and looked up in slices of texts by Arrow; only the distinct words of a slice are encoded.
The base score needs the count of every word. At most ``HEAD`` of the most frequent words travel to the tasks
(a bounded table); only the others are joined.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelspark.llm.common import TOKENIZERS, by_key, text_of, written
from channelspark.session import stored

IDS = 50_257
END = 50_256
HOP = 8
WINDOW = 2 * HOP
OWN, SHARED, SIGNS = 384, 128, 32
CLASSES = OWN + SHARED
DEPTH = 8
LAGS = (1, 2, 3)  # the table of the last distance serves all beyond it
FAR = (3, 5, 9)  # distances that are counted for it
PRIOR = 5.0
DISCOUNT = 0.75
PIECE = 1 << 20
SLICE, COUNTED = 1 << 24, 1 << 25  # bytes of text whose words are looked up, or counted, together
HEAD, HEAD_BYTES = 1 << 20, 64
TOGETHER = 1 << 15  # words that are encoded together
BATCH = 2048  # windows that are scored together
FIRST_STEP, STEP = 256, 4096  # windows of one training step
#: How the vocabulary splits a text before it merges bytes (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def words_in(texts: pa.Array) -> pa.ListArray:
    """``words_of`` each text; no words are one empty word."""
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))


class Subwords:
    """Byte-level BPE ids of words, each with the space before it."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.begins = np.zeros(IDS, bool)
        self.begins[[rank for piece, rank in ranks.items() if piece.startswith(b" ")]] = True

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each word has."""
        found, long = [np.empty(0, np.uint16)], []
        for some in (words[s : s + TOGETHER] for s in range(0, len(words), TOGETHER)):
            text = b" ".join(some).decode("utf-8", "replace")
            if len(text.split()) == len(some):  # every space before a word begins a token, and no token crosses it
                ids = np.array(self.encode(" " + text), np.uint16)
                starts = np.flatnonzero(self.begins[ids])
                if len(starts) != len(some):
                    raise RuntimeError("the ids of words run into each other")
                long.extend(np.diff(starts, append=len(ids)).tolist())
            else:  # an empty word, or white space that does not part words
                each = [self.encode(" " + w.decode("utf-8", "replace")) if w else [] for w in some]
                ids = np.array([i for e in each for i in e], np.uint16)
                long.extend(map(len, each))
            found.append(ids)
        return np.concatenate(found), np.array(long, np.int64)


@lru_cache(maxsize=1)
def subwords(path: str) -> Subwords:
    return Subwords(path)


@dataclass
class Model:
    """Class of each id, P(id | class), class tables, attention parameters and the triples at hand."""

    kind: np.ndarray
    inside: np.ndarray
    table: np.ndarray  # (distance, class before, class)
    query: np.ndarray
    key: np.ndarray
    bias: np.ndarray  # by distance - 1
    triples: np.ndarray  # sorted keys of id triples
    times: np.ndarray
    pairs: np.ndarray  # sorted keys of the first two ids
    total: np.ndarray
    freed: np.ndarray

    def parameters(self) -> np.ndarray:
        return np.concatenate([self.query.ravel(), self.key.ravel(), self.bias])

    def replaced(self, flat: np.ndarray) -> Model:
        size = CLASSES * DEPTH
        query, key = flat[: 2 * size].reshape(2, CLASSES, DEPTH).astype(np.float32)
        return replace(self, query=query, key=key, bias=flat[2 * size :].astype(np.float32))

    @cached_property
    def scores(self) -> np.ndarray:
        """Attention before the softmax, without the distance's bias, by class of the last token and of an earlier one."""
        return (self.query @ self.key.T).ravel()

    def attend(self, places: np.ndarray, first: int):
        """Probabilities of the classes of windows (WINDOW, n) at the places from ``first`` on.

        Place by place, so that a distance is a shift. Also the sum of each softmax, by distance the row of its first
        place, its weights and its values, and where in ``scores`` all of them are; these hold until the next call.
        """
        n = places.shape[1]
        firsts = [max(first, lag) for lag in range(1, WINDOW)]
        ends = np.cumsum([0, *((WINDOW - p) * n for p in firsts)]).tolist()
        room = _room(max(ends[-1], STEP * (WINDOW - HOP) * WINDOW))
        wide, found = places * CLASSES, []
        top = np.full((WINDOW - first, n), -np.inf, np.float32)
        for lag, p, s, e in zip(range(1, WINDOW), firsts, ends, ends[1:]):
            at, weight, value = (r[s:e].reshape(WINDOW - p, n) for r in room)
            np.add(wide[p - lag : WINDOW - lag], places[p:], out=at)
            self.table[min(lag, len(LAGS)) - 1].ravel().take(at, out=value, mode="clip")
            np.add(wide[p - 1 : -1], places[p - lag : WINDOW - lag], out=at)
            self.scores.take(at, out=weight, mode="clip")
            weight += self.bias[lag - 1]
            np.maximum(top[p - first :], weight, out=top[p - first :])
            found.append((p - first, weight, value))
        total, chance, one = np.zeros_like(top), np.zeros_like(top), np.empty_like(top)
        for row, weight, value in found:
            weight -= top[row:]
            np.exp(weight, out=weight)
            total[row:] += weight
            chance[row:] += np.multiply(weight, value, out=one[row:])
        chance /= total
        return chance, total, found, room[0][: ends[-1]], room[2][: ends[-1]]

    def log10(self, ids: list[np.ndarray], counted: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of id sequences that begin and end with END.

        ``counted`` holds the ``shares`` of the triple at each inner place, if they are known already.
        """
        length = np.array([len(i) for i in ids])
        flat = np.concatenate([*ids, np.zeros(WINDOW, np.uint16)])
        kinds = self.kind[flat]
        begin = np.cumsum(length) - length
        places = np.zeros(len(flat))
        hops = np.maximum(-(-(length - WINDOW) // HOP), 0)
        later = np.repeat(np.arange(len(ids)), hops)
        nth = np.arange(len(later)) - np.repeat(np.cumsum(hops) - hops, hops) + 1
        for start, end, first in ((begin, begin + length, 1), (begin[later] + nth * HOP, (begin + length)[later], HOP)):
            for s in range(0, len(start), BATCH):
                at = start[s : s + BATCH] + np.arange(WINDOW)[:, None]
                chance = self.attend(kinds.take(at, mode="clip"), first)[0]
                own = at[first:] < end[s : s + BATCH]
                places[at[first:][own]] = chance[own]
        own = np.repeat(np.arange(len(ids)), length)
        inner = np.ones(len(own), bool)
        inner[begin] = False
        chance = places[: len(own)][inner] * self.inside[flat[: len(own)][inner]]
        known = shares(*self.lookup(triple_keys(flat[: len(own)], inner))) if counted is None else counted
        chance *= known[:, 1]
        chance += known[:, 0]
        return np.bincount(own[inner], np.log10(chance), minlength=len(ids))

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``n``, ``total`` and ``freed`` of triples (0 where they are not known)."""
        if not len(self.triples):
            return (np.zeros(len(keys)),) * 3
        at = np.minimum(np.searchsorted(self.pairs, keys >> 16), len(self.pairs) - 1)
        place = np.minimum(np.searchsorted(self.triples, keys), len(self.triples) - 1)
        known = self.pairs[at] == keys >> 16
        return tuple(np.where(k, x, 0) for k, x in ((self.triples[place] == keys, self.times[place]), (known, self.total[at]), (known, self.freed[at])))

    def step(self, windows: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss of windows and its gradient; ``real`` marks the places that count.

        Where no place before HOP counts, attention is worked out from HOP on only.
        """
        first = 1 if real[:, 1:HOP].any() else HOP
        chance, total, found, at, slopes = self.attend(np.ascontiguousarray(windows.T), first)
        counts = real.T[first:]
        n = max(1, int(counts.sum()))
        scale = counts / (chance * total * np.float32(n))
        bias = []
        for row, weight, value in found:  # values give way to the slopes of the scores
            np.subtract(chance[row:], value, out=value)
            value *= weight
            value *= scale[row:]
            bias.append(value.sum())
        every = np.zeros(CLASSES**2, np.float32)
        np.add.at(every, at, slopes)
        every = every.reshape(CLASSES, CLASSES)
        flat = np.concatenate([(every @ self.key).ravel(), (every.T @ self.query).ravel(), bias])
        return float(-(np.log(chance) * counts).sum() / n), flat


@lru_cache(maxsize=1)
def _room(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays that are used again and again, because fresh memory costs more than the arithmetic."""
    return np.empty(size, np.int64), np.empty(size, np.float32), np.empty(size, np.float32)


def shares(n: np.ndarray, total: np.ndarray, freed: np.ndarray) -> np.ndarray:
    """What the counts of triples give, and what they leave to the attention: all of it where the first two ids are unknown."""
    return np.column_stack([np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1), np.where(total > 0, freed / np.maximum(total, 1), 1)])


def triple_keys(flat: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """One integer per inner place for its id and the two before it (END before the start)."""
    wide = flat.astype(np.int64)
    keys = wide.copy()
    keys[1:] += wide[:-1] << 16
    first = np.flatnonzero(~inner[:-1]) + 1
    alone = keys[first] + (END << 32)
    keys[2:] += wide[:-2] << 32
    keys[first] = alone
    return keys[inner]


def train_here(model: Model, ids: Iterator[np.ndarray], seed: int) -> tuple[np.ndarray, int]:
    """Parameters after Adam over all windows of all sequences, each place once, and the number of windows.

    A batch holds first windows only or later ones only, because of the latter just the places from HOP on count.
    Batches are small until a task has seen its first ``PIECE // 4`` ids, so that a small corpus gets its steps too.
    """
    random = np.random.default_rng(seed)
    flat = model.parameters()
    m, v, t, total = np.zeros_like(flat), np.zeros_like(flat), 0, 0
    for held in _gathered(ids, PIECE // 4):
        length = np.array([len(h) for h in held])
        kinds = np.concatenate([model.kind[np.concatenate(held)], np.zeros(WINDOW, np.int64)])
        end = np.cumsum(length)
        hops = np.maximum(-(-(length - WINDOW) // HOP), 0) + 1
        of = np.repeat(np.arange(len(held)), hops)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(hops) - hops, hops)
        start, stop = (end - length)[of] + nth * HOP, end[of]
        order, size = random.permutation(len(of)), STEP if total else FIRST_STEP
        batches = [some[i : i + size] for some in (order[nth[order] == 0], order[nth[order] > 0]) for i in range(0, len(some), size)]
        for b in random.permutation(len(batches)):
            some = batches[b]
            at = start[some] + np.arange(WINDOW)[:, None]
            real = at < stop[some]
            windows = kinds.take(at, mode="clip")
            if nth[some[0]]:
                real[:HOP] = False
            g = model.replaced(flat).step(windows.T, real.T.astype(np.float32))[1].astype(np.float32)
            t += 1
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            flat -= np.float32(0.02 / (1 - 0.9**t)) * m / (np.sqrt(v * np.float32(1 / (1 - 0.99**t))) + np.float32(1e-8))
        total += len(order)
    return flat.astype(np.float64), total


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint16) for b in batch.column("ids").to_pylist()]


def _gathered(ids: Iterator[np.ndarray], size: int) -> Iterator[list[np.ndarray]]:
    """Whole sequences of about ``size`` ids together."""
    held, length = [], 0
    for sequence in ids:
        if held and length + len(sequence) > size:
            yield held
            held, length = [], 0
        held.append(sequence)
        length += len(sequence)
    if held:
        yield held


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sequences of about ``PIECE`` ids together, with the number of each id's sequence."""
    for held in _gathered((s for batch in batches for s in _sequences(batch)), PIECE):
        yield np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])


def _tally(tokens: DataFrame, size: int, keys_of) -> np.ndarray:
    """Counts over all sequences of the integer keys below ``size`` that ``keys_of`` draws from one batch; ``size`` is no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for flat, own in _pieces(batches):
            total += np.bincount(keys_of(flat, own).ravel(), minlength=size + 1)[:size]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["key", "n"])

    out = np.zeros(size)
    sums = tokens.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most `size` rows
    out[sums["key"].to_numpy()] = sums["n"].to_numpy()
    return out


def _apart(doc: np.ndarray, lags: tuple[int, ...], none: int, key) -> np.ndarray:
    """``key`` of all places and the places ``lag`` before them, one row per lag; ``none`` where no such place is in the same sequence."""
    keys = np.full((len(lags), len(doc)), none)
    for row, lag in zip(keys, lags):
        if lag < len(doc):
            row[lag:] = key(lag, slice(lag, None), slice(None, -lag))
            row[lag:][doc[lag:] != doc[:-lag]] = none
    return keys


def _shards(pairs: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each pair of ids."""
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Integers below 256 ** width by byte and compressed, after their number."""
    planes = values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _values(planes: bytes, width: int) -> np.ndarray:
    size = int.from_bytes(planes[:8], "little")
    out = np.zeros((size, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(planes[8:], size * width, codec="zstd"), np.uint8).reshape(width, -1).T
    return out.view("<i8").ravel()


def _order(keys: np.ndarray) -> np.ndarray:
    """The stable order of triples, by one id after the other from the last, because sorting by 16 bits is quick."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    for bits in (16, 32):
        order = order[np.argsort((keys >> bits).astype(np.uint16)[order], kind="stable")]
    return order


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where the first two ids of neighbouring triples change."""
    return np.flatnonzero(np.append(True, np.diff(keys >> 16) != 0)) if len(keys) else np.empty(0, np.int64)


def _triples_of(ids: list[np.ndarray], train: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct triples of sequences by shard, their counts where ``train``, and the ends of the shards.

    Within a shard they ascend.
    """
    own = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    inner = np.append(False, own[1:] == own[:-1])
    both = (triple_keys(np.concatenate(ids), inner) << 1) + train[own[inner]]
    both.sort()
    start = np.flatnonzero(np.append(True, np.diff(both >> 1) != 0))
    keys, n = both[start] >> 1, np.add.reduceat(both & 1, start)
    shard = _shards(keys >> 16, shards)
    order = np.argsort(shard, kind="stable")  # quick for 16 bits
    return keys[order], n[order], np.cumsum(np.bincount(shard.astype(np.int64), minlength=shards))


def triple_counts(tokens: DataFrame, shards: int) -> DataFrame:
    """What the training rows of all ``tokens`` say on the triples of each piece.

    One row per shard and run (``first`` to ``last`` row) of a piece, in the order of ``_triples_of``: ``n`` of each triple,
    ``total`` and ``kinds`` of each first two ids.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_key(batches):
            rows, train = held["row"].to_numpy(), ~held["held_out"].to_numpy()
            cuts = np.flatnonzero(np.diff(rows) != 1) + 1  # a scan may begin or end inside a piece
            ids = [np.frombuffer(b, np.uint16) for b in held["ids"].to_pylist()]
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
                keys, n, ends = _triples_of(ids[s:e], train[s:e], shards)
                starts = np.append(0, ends[:-1])
                some = np.flatnonzero(ends > starts)
                bounds = list(zip(starts[some].tolist(), ends[some].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), *(pa.array(np.full(len(some), x, np.int64)) for x in (held["key"][0].as_py(), rows[s], rows[e - 1])),
                     pa.array([_planes(np.diff(keys[i:j], prepend=0), 6) for i, j in bounds], pa.binary()), pa.array([_planes(n[i:j], 4) for i, j in bounds], pa.binary())],
                    ["key", "piece", "first", "last", "triples", "n"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_key(batches):
            asked = [np.cumsum(_values(b, 6)) for b in held["triples"].to_pylist()]
            every = np.concatenate(asked)
            order = _order(every)
            new = np.append(True, np.diff(every[order]) != 0)
            keys, at = every[order][new], np.empty(len(every), np.int64)
            at[order] = np.cumsum(new) - 1
            times = np.bincount(at, np.concatenate([_values(b, 4) for b in held["n"].to_pylist()]), minlength=len(keys)).astype(np.int64)
            heads = _heads(keys)
            total, kinds = np.add.reduceat(times, heads), np.add.reduceat((times > 0).astype(np.int64), heads)
            of = np.cumsum(np.bincount(heads, minlength=len(keys))) - 1
            ends = np.cumsum([len(a) for a in asked])
            found = []
            for a, end in zip(asked, ends.tolist()):
                mine = at[end - len(a) : end]
                pairs = of[mine[_heads(a)]]
                found.append((_planes(times[mine], 5), _planes(total[pairs], 5), _planes(kinds[pairs], 2)))
            yield from pa.Table.from_arrays(
                [*(held[c] for c in ("piece", "first", "last", "key")), *(pa.array(x, pa.binary()) for x in zip(*found))],
                ["key", "row", "last", "shard", "n", "total", "kinds"]).combine_chunks().to_batches()

    asked = tokens.select(F.col("piece").alias("key"), "row", "held_out", "ids").mapInArrow(
        ask, "key bigint, piece bigint, first bigint, last bigint, triples binary, n binary")
    return asked.repartition("key").sortWithinPartitions("key").mapInArrow(
        answer, "key bigint, row bigint, last bigint, shard bigint, n binary, total binary, kinds binary")


def scored(tokens: DataFrame, model: Model, shards: int) -> DataFrame:
    """``tokens`` (``piece``, ``row``, ``held_out``, ``ids`` and more) with their ``score`` instead of ``ids`` and ``piece``."""
    kept = [c for c in tokens.columns if c not in ("piece", "ids")]
    texts = tokens.withColumnRenamed("piece", "key").withColumn("text", F.lit(True))
    both = triple_counts(tokens, shards).withColumn("text", F.lit(False)).unionByName(texts, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_key(batches):
            is_text = held["text"].to_numpy()
            texts, counts = held.filter(pa.array(is_text)), held.filter(pa.array(~is_text)).select(["row", "last", "n", "total", "kinds"]).to_pylist()
            rows, ids = texts["row"].to_numpy(), [np.frombuffer(b, np.uint16) for b in texts["ids"].to_pylist()]
            scores = np.full(len(rows), np.nan)
            for (first, last), found in groupby(counts, lambda c: (c["row"], c["last"])):
                s, e = np.searchsorted(rows, [first, last + 1]).tolist()
                counted = _counted(ids[s:e], list(found), shards)
                ends = np.cumsum([0, *(len(i) - 1 for i in ids[s:e])])
                for i in range(s, e, 64):
                    j = min(i + 64, e)
                    scores[i:j] = model.log10(ids[i:j], counted[ends[i - s] : ends[j - s]])
            yield from texts.select(kept).append_column("score", pa.array(scores)).combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name in kept)
    return both.repartition("key").sortWithinPartitions("key", "text", "row", "shard").mapInArrow(run, f"{schema}, score double")


def _counted(ids: list[np.ndarray], counts: list[dict], shards: int) -> np.ndarray:
    """``shares`` at each inner place of ``ids``, from ``counts`` that come by shard."""
    own = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    each = triple_keys(np.concatenate(ids), np.append(False, own[1:] == own[:-1]))
    order = _order(each)
    each = each[order]
    new = np.append(True, each[1:] != each[:-1]) if len(each) else np.empty(0, bool)
    keys = each[new]
    by_shard = np.argsort(_shards(keys >> 16, shards), kind="stable")  # as _triples_of orders them
    heads = _heads(keys[by_shard])
    n, total, kinds = (np.concatenate([_values(c[name], width) for c in counts]) for name, width in (("n", 5), ("total", 5), ("kinds", 2)))
    if len(n) != len(keys) or len(total) != len(heads):
        raise RuntimeError("the counts of a piece do not fit its triples")
    pair = np.cumsum(np.bincount(heads, minlength=len(keys))) - 1
    found, out = np.empty(len(keys), np.complex128), np.empty(len(each), np.complex128)  # both shares in one number
    found[by_shard] = shares(n, total[pair], DISCOUNT * kinds[pair]).view(np.complex128).ravel()
    out[order] = np.repeat(found, np.diff(np.flatnonzero(new), append=len(each)))
    return out.view(np.float64).reshape(-1, 2)


def _clusters(signs: np.ndarray, count: int) -> np.ndarray:
    """K-means of rows on the unit sphere."""
    unit = np.sqrt(signs / np.maximum(signs.sum(1, keepdims=True), 1))
    random = np.random.default_rng(5)
    centre = unit[random.choice(len(unit), min(count, len(unit)), replace=False)]
    for _ in range(12):
        at = (unit @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, at, unit)
        centre = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return at


def fit(tokens: DataFrame, rounds: int = 2) -> Model:
    """Learn all but the triples from ``tokens`` (``ids``), all rows of it. Without rows, every id is equally likely in its class."""
    tokens = tokens.select("ids")
    counts = _tally(tokens, IDS, lambda flat, doc: flat)
    order = np.argsort(-counts, kind="stable")
    own = order[:OWN]
    sign = np.full(IDS, SIGNS - 1)
    sign[order[: SIGNS - 1]] = np.arange(SIGNS - 1)

    def signs_of(flat: np.ndarray, doc: np.ndarray) -> np.ndarray:
        wide, signed = flat.astype(np.int64) * SIGNS, sign[flat]
        return _apart(doc, (1, 2, 3, 4), IDS * SIGNS, lambda lag, here, before: wide[here] + signed[before])

    signs = _tally(tokens, IDS * SIGNS, signs_of).reshape(IDS, SIGNS)
    kind = np.full(IDS, CLASSES - 1)
    kind[own] = np.arange(OWN)
    rest = np.flatnonzero((counts > 0) & (kind >= OWN))
    if len(rest):
        kind[rest] = OWN + _clusters(signs[rest], SHARED - 1)
    size = np.bincount(kind, minlength=CLASSES)
    inside = ((counts + 0.5) / (np.bincount(kind, counts, minlength=CLASSES) + 0.5 * size)[kind])

    def pairs_of(flat: np.ndarray, doc: np.ndarray) -> np.ndarray:
        kinds = kind[flat]
        wide = kinds * CLASSES
        return _apart(doc, (*LAGS[:-1], *FAR), len(LAGS) * CLASSES**2,
                      lambda lag, here, before: wide[before] + kinds[here] + (min(lag, len(LAGS)) - 1) * CLASSES**2)

    pairs = _tally(tokens, len(LAGS) * CLASSES**2, pairs_of).reshape(len(LAGS), CLASSES, CLASSES)
    share = (np.bincount(kind, counts, minlength=CLASSES) + 0.5 * (size > 0)) / (counts.sum() + 0.5 * (size > 0).sum())
    table = (pairs + PRIOR * share) / (pairs.sum(2, keepdims=True) + PRIOR)
    random = np.random.default_rng(3)
    start = random.normal(0, 0.1, (2, CLASSES, DEPTH)).astype(np.float32)
    none = np.empty(0)
    model = Model(
        kind, inside, table.astype(np.float32), start[0], start[1], -np.log(np.arange(1, WINDOW)).astype(np.float32),
        none.astype(np.int64), none, none.astype(np.int64), none, none)
    for turn in range(rounds):
        model = model.replaced(_averaged(tokens, model, turn))
    return model


def _averaged(tokens: DataFrame, model: Model, turn: int) -> np.ndarray:
    """Parameters of the tasks' models, averaged by their number of windows."""
    small = replace(model, inside=np.empty(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, n = train_here(small, (s for batch in batches for s in _sequences(batch)), turn)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * n), pa.array(np.full(len(flat), n))], ["at", "value", "n"])

    out = model.parameters().astype(np.float64)
    sums = tokens.mapInArrow(run, "at bigint, value double, n bigint").groupBy("at").agg((F.sum("value") / F.sum("n")).alias("value")).toArrow()
    out[sums["at"].to_numpy()] = sums["value"].to_numpy()
    return out


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where their ``text`` has about ``size`` bytes; a row stays whole."""
    for batch in batches:
        part = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(s, e - s) for s, e in zip(cuts, cuts[1:]) if e > s)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (binary) and its count ``c`` over all rows of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0
        for batch in _slices(batches, COUNTED):
            held.append(words_in(batch.column("text")).flatten().cast(pa.binary()))
            size += held[-1].nbytes
            if size > COUNTED:
                yield _counted_words(held)
                held, size = [], 0
        if held:
            yield _counted_words(held)

    return texts.select("text").mapInArrow(run, "word binary, c bigint").where(F.octet_length("word") > 0).groupBy("word").agg(F.sum("c").alias("c"))


def _counted_words(held: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(pa.chunked_array(held).value_counts().flatten(), ["word", "c"])


def _head(counts: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """At most ``HEAD`` most frequent words and their counts; of equally frequent ones all or none."""
    level = F.floor(64 * F.log2("c"))  # a few thousand at most
    short = counts.where(F.octet_length("word") <= HEAD_BYTES)
    sizes = sorted(((r.level, r.n) for r in short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    fit = [least for (least, _), total in zip(sizes, accumulate(n for _, n in sizes)) if total <= HEAD]
    found = short.where(level >= (fit[-1] if fit else 64 * 64)).toArrow().combine_chunks()
    return found["word"].combine_chunks(), found["c"].to_numpy()


def score_documents(
    docs: DataFrame, held_out: Column, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Scores of all rows under counts and a model learnt from the rows that are not ``held_out``.

    Columns ``id``, ``held_out``, ``n_tokens`` (words and the end), ``n_known`` (those seen in training),
    ``train_tokens``, ``base_score`` and ``score``. Null and empty texts are just an end. Repeated rows count
    each time. Without training rows the base score is 0 and the model knows nothing but its classes.
    """
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = stored(word_counts(source.where(~F.col("held_out"))), "word-counts")
    ends = source.where(~F.col("held_out")).count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + ends, v + (ends > 0)
    floor = n + 0.5 * (v + 1)
    end = math.log10((ends + 0.5) / floor)
    head, c = _head(counts)
    logs = np.append(np.log10((c + 0.5) / floor), 0)  # at last for words that are not in the head

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = subwords(path)
        edge = np.array([END], np.uint16).tobytes()
        part = size = 0
        for batch in _slices(batches, SLICE):
            rows = batch.num_rows
            lists = words_in(batch.column("text"))
            coded = lists.flatten().cast(pa.binary()).dictionary_encode()
            at, distinct = coded.indices.to_numpy().astype(np.intp), coded.dictionary
            filled = pc.binary_length(distinct).to_numpy() > 0
            place = pc.fill_null(pc.index_in(distinct, head), len(head)).to_numpy()
            rare = (place == len(head)) & filled
            base = logs[place]
            ids, long = own.ids(distinct.to_pylist())
            each, begin = long[at], np.cumsum(long) - long
            pieces = []  # ids of all rows, one after the other
            for s in range(0, len(at), TOGETHER):
                n = each[s : s + TOGETHER]
                shift = begin[at[s : s + TOGETHER]] - (np.cumsum(n) - n)
                pieces.append(ids[np.repeat(shift, n) + np.arange(n.sum())].tobytes())
            ids = b"".join(pieces)
            of = np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy()))
            cuts = np.append(0, 2 * np.cumsum(np.bincount(of, each, minlength=rows).astype(np.int64))).tolist()
            whole = [edge + ids[s:e] + edge for s, e in zip(cuts, cuts[1:])]
            parts = []
            for text in whole:
                if size > 4 * PIECE:  # bytes
                    part, size = part + 1, 0
                size += len(text)
                parts.append(part)
            # words that are not in the head, by row
            some = np.flatnonzero(rare[at])
            keys, tf = np.unique(of[some] * len(distinct) + at[some], return_counts=True)
            edges = pa.array(np.searchsorted(keys, np.arange(rows + 1) * len(distinct)).astype(np.int32))
            tokens = np.bincount(of, filled[at], minlength=rows).astype(np.int64)
            known = tokens - np.bincount(of[some], minlength=rows) + (ends > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(tokens + 1), pa.array(known, pa.int64()), pa.array(np.bincount(of, base[at], minlength=rows) + end),
                 pa.ListArray.from_arrays(edges, distinct.take(pa.array(keys % len(distinct)))), pa.ListArray.from_arrays(edges, pa.array(tf, pa.int64())),
                 pa.array(whole, pa.binary()), pa.array(parts, pa.int64())],
                ["id", "held_out", "n_tokens", "known", "base", "rare", "tf", "ids", "part"])

    kind = source.schema["id"].dataType.simpleString()
    tokens = written(
        source.mapInArrow(tokenise, f"id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, rare array<binary>, tf array<bigint>, ids binary, part bigint")
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("piece", F.shiftleft(F.spark_partition_id().cast("bigint"), 32) + F.col("part")).drop("part"), "lm-tokens")
    size = tokens.agg(F.sum(F.octet_length("ids") / 2)).first()[0] or 0
    model = fit(tokens.where(~F.col("held_out")))
    chance = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / floor)
    rare = (
        tokens.select("row", F.explode(F.arrays_zip("rare", "tf")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.tf").alias("tf"))
        .join(counts, "word", "left").groupBy("row")
        .agg(F.sum(F.col("tf") * chance).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"))
    )
    scores = scored(tokens.select("piece", "row", "id", "held_out", "n_tokens", "known", "base", "ids"), model, max(1, math.ceil(size / (2 * PIECE))))
    return scores.join(rare, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
