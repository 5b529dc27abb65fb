"""Toxicity by weak supervision.

Voters are words and word beginnings that a significance test finds over-represented in toxic
documents. A generative label model estimates each voter's accuracy by expectation maximisation,
discounts voters by how far they fire together beyond what the label explains, and gives every
training document a posterior label; a linear classifier over the votes learns those posteriors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelspark.llm.common import packed, text_of
from channelspark.session import stored

LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 8)
MEMO_ENTRIES = 150_000


def names_of(word: str) -> list[str]:
    """Names of the voters that a word can make fire."""
    return ["w:" + word, *("p:" + word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    """Weights of the voters (``w:word`` or ``p:beginning``) and the bias."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0

    def scorer(self):
        memo: dict[str, tuple] = {}

        def votes(word: str) -> tuple:
            if len(memo) >= MEMO_ENTRIES:
                memo.clear()
            memo[word] = found = tuple(n for n in names_of(word) if n in self.weights)
            return found

        def score(text: str) -> float:
            fired: set[str] = set()
            for word in set(LETTERS.findall(text.lower())):
                found = memo.get(word)
                fired.update(votes(word) if found is None else found)
            z = self.bias + math.fsum(self.weights[n] for n in fired)
            return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

        return score


def _minima(words: list[str]) -> list[int]:
    """Three minimum hashes over word triples: documents that share one are taken for copies."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    with np.errstate(over="ignore"):
        if len(h) > 2:
            h = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        out = []
        for seed in (1, 2, 3):
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * seed)
            x ^= x >> np.uint64(32)
            out.append(int(x.min() >> np.uint64(1)) if len(x) else -1)
    return out


def _sample(docs: DataFrame, labels: DataFrame, limit: int, id_col: str, text_col: str, name: str) -> DataFrame:
    """Distinct words and minimum hashes of a bounded sample of labelled documents."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(name).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg((F.avg(name) >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(limit)
    )
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            each = [LETTERS.findall(t.lower()) for t in batch["text"]]
            low = np.array([_minima(w) for w in each], np.int64).reshape(-1, 3)
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "words": [sorted(set(w)) for w in each],
                                "m1": low[:, 0], "m2": low[:, 1], "m3": low[:, 2]})

    # at most `limit` rows of an id and a label: a proven bound for the broadcast
    return stored(
        source.join(F.broadcast(chosen), "id")
        .mapInPandas(words, "id long, y int, words array<string>, m1 long, m2 long, m3 long"),
        "labelled",
    )


def _distinct(sample: DataFrame) -> DataFrame:
    """One document of each group of copies, so that copies don't lend their words significance."""
    one = sample
    for m in ("m1", "m2", "m3"):
        one = one.groupBy(m).agg(F.min_by(F.struct(*one.columns), F.struct("id", "m1", "m2", "m3")).alias("r")).select("r.*")
    return one


def _voters(word: Column) -> Column:
    """The word and its beginnings."""
    starts = [F.when(F.char_length(word) >= n, F.concat(F.lit("p:"), F.substring(word, 1, n))) for n in PREFIXES]
    return F.array_compact(F.array(F.concat(F.lit("w:"), word), *starts))


def _mine(distinct: DataFrame, max_voters: int, chance: float) -> list[str]:
    """Voters that fire in toxic documents more often than chance allows, strongest first."""
    share = distinct.agg(F.avg("y")).first()[0]
    if not share or share >= 1:
        return []
    counts = stored(
        distinct.select("y", F.explode(F.array_distinct(F.flatten(F.transform("words", _voters)))).alias("voter"))
        .groupBy("voter").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")),
        "votes",
    )
    support = np.zeros(distinct.count() + 2)
    for n, times in counts.groupBy("n").count().collect():  # one row per support, at most the sample's size
        support[n] = times
    tests = support[::-1].cumsum()[::-1]
    rate = F.col("pos") / F.col("n")
    clean = F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    gain = F.col("n") * (rate * F.log(rate / share) + clean)
    found = (
        counts.where((F.col("pos") >= 3) & (rate > max(0.5, share)))
        .withColumn("gain", gain).where(F.col("gain") > -math.log(chance))
        .orderBy(F.desc("gain"), "voter").limit(20 * max_voters).collect()
    )
    return [r.voter for r in found if math.exp(-r.gain) * tests[r.n] < chance][:max_voters]


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior labels, voter weights and the log odds of a document without votes.

    ``votes`` is documents x voters, ``start`` the labels that start the estimation. A voter's
    silence says nothing by itself; a document on which all are silent has its own accuracy.
    """
    none = ~votes.any(1)
    fires = votes.sum(0)
    p = start.astype(float)
    for _ in range(rounds):
        prior = (p.sum() + 1) / (len(p) + 2)
        base = math.log(prior / (1 - prior))
        hit = votes.T.astype(np.float32) @ p.astype(np.float32)
        accuracy = (hit + prior) / (fires + 1)
        evidence = np.log(accuracy / (1 - accuracy)) - base
        expected = np.outer(p, hit / max(p.sum(), 1e-9)) + np.outer(1 - p, (fires - hit) / max((1 - p).sum(), 1e-9))
        rest = (votes - expected).astype(np.float32)
        rest /= np.sqrt((rest**2).sum(0)) + 1e-9
        together = np.maximum(rest.T @ rest, 0) ** 2
        weights = evidence / np.maximum(together.sum(1), 1)
        silent = (p[none].sum() + prior) / (none.sum() + 1)
        silent = math.log(silent / (1 - silent))
        z = np.where(none, silent, base + votes @ weights)
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        moved, p = np.abs(new - p).max(), new
        if moved < 1e-4:
            break
    return p, weights, silent


def linear(votes: np.ndarray, target: np.ndarray, weights: np.ndarray, bias: float, l2: float = 1e-3, steps: int = 300):
    """Logistic regression on soft labels, started from the label model's weights."""
    x = votes.astype(np.float32)
    w, b = weights.astype(np.float64).copy(), float(np.clip(bias, -6, 6))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30)))
        error = (p - target) / len(target)
        g = np.append(x.T @ error.astype(np.float32) + l2 / len(target) * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_labelled: int = 20_000, max_voters: int = 512, chance: float = 0.5,
) -> Model:
    """Learn from ``labels`` (id, label), of which at most ``max_labelled`` rows by hash are used.

    Null labels and ids are ignored; repeated labels of an id are averaged. Without a toxic or a
    clean example, or without a significant voter, the model scores every text near 0.
    """
    sample = _sample(docs, labels, max_labelled, id_col, text_col, label_col)
    distinct = stored(_distinct(sample), "labelled-distinct")
    names = _mine(distinct, max_voters, chance)
    if not names:
        return Model()
    index = {n: i for i, n in enumerate(names)}

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            fired = [sorted({index[f] for w in words for f in names_of(w) if f in index})
                     for words in batch["words"]]
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "fired": fired})

    rows = distinct.mapInPandas(votes, "id long, y int, fired array<int>").orderBy("id").collect()  # <= max_labelled rows
    matrix = np.zeros((len(rows), len(names)), bool)
    for i, r in enumerate(rows):
        matrix[i, r.fired] = True
    posterior, weights, silent = label_model(matrix, np.array([r.y for r in rows]))
    weights, bias = linear(matrix, posterior, weights, silent)
    return Model(dict(zip(names, weights.tolist())), bias)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (the input row) and ``score`` from 0 to 1; null text counts as empty.

    Rows are scored one by one without a shuffle, so repeated rows score alike.
    """

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for batch in texts:
            yield pd.Series([score(t) for t in batch], dtype="float64")

    source = docs.select(packed(docs).alias("row"), text_of(text_col).alias("text"))
    return source.select("row", run("text").alias("score"))
