"""Language identification with hyperdimensional profiles.

Letters are random vectors of +1 and -1. A letter trigram binds (multiplies) the vectors of its
letters, permuted by their place; a text bundles (adds) its trigrams, a language its texts. A text's
language is the prototype with the largest cosine. Bundles of documents are sums, so a language's
prototype is added up by Spark from partial sums and has the same size for any corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelspark.llm.common import packed, text_of

DIM = 1024
SLOTS = 128
CHUNK_CHARS = 1 << 18
CHUNK_DOCS = 128
SLICE = 8192


@lru_cache(maxsize=1)
def letter_slots() -> np.ndarray:
    """Slot of every code point: 0 for what is no letter, 1-26 for a-z, the others shared by hash."""
    slots = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)
    points = np.flatnonzero(slots)
    slots[points] = 27 + (points * 2654435761 >> 7) % (SLOTS - 27)
    slots[97:123] = np.arange(1, 27)
    return slots


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letter vectors as the first, second and third letter of a trigram."""
    own = np.random.default_rng(20_24).choice(np.array([-1, 1], np.int8), (SLOTS, DIM))
    return np.roll(own, 2, axis=1), np.roll(own, 1, axis=1), own


def bind(codes: np.ndarray) -> np.ndarray:
    """Trigram vectors of trigram codes."""
    first, second, third = letters()
    return (first[codes >> 14] * second[codes >> 7 & 127] * third[codes & 127]).astype(np.float32)


def trigrams(text: str) -> np.ndarray:
    """Trigram codes of a text; runs of what is no letter are one word boundary."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    slots = letter_slots()[points]
    slots = np.concatenate([[0], slots, [0]])
    slots = slots[(slots > 0) | np.append(True, slots[:-1] > 0)].astype(np.int32)
    if len(slots) < 3:  # no letter
        return np.empty(0, np.int32)
    return slots[:-2] << 14 | slots[1:-1] << 7 | slots[2:]


def chunks(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Bounded runs of texts: first, last, their distinct trigram codes and a count matrix."""
    first, held, size = 0, [], 0
    for i, text in enumerate([*texts, None]):
        if held and (text is None or len(held) == CHUNK_DOCS or size + len(text) > CHUNK_CHARS):
            every = np.concatenate(held)
            seen = np.zeros(SLOTS**3, bool)
            seen[every] = True
            codes = np.flatnonzero(seen)
            at = np.zeros(SLOTS**3, np.int32)
            at[codes] = np.arange(len(codes))
            rows = np.repeat(np.arange(len(held)), [len(h) for h in held])
            counts = np.bincount(rows * len(codes) + at[every], minlength=len(held) * len(codes))
            yield first, i, codes, counts.reshape(len(held), len(codes)).astype(np.float32)
            first, held, size = i, [], 0
        if text is not None:
            held.append(trigrams(text))
            size += len(text)


def bundle(counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of trigram vectors, a slice of the trigrams at a time."""
    out = np.zeros((len(counts), DIM), np.float32)
    for s in range(0, len(codes), SLICE):
        out += counts[:, s : s + SLICE] @ bind(codes[s : s + SLICE])
    return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A unit prototype per language, from rows with a text and a language; others are skipped.

    Every text counts alike, whatever its length. Only DIM numbers per language reach the driver.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_numpy()
            for first, last, codes, counts in chunks(batch["text"].tolist()):
                counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1)
                names, which = np.unique(langs[first:last].astype(str), return_inverse=True)
                by = np.zeros((len(names), len(codes)), np.float32)
                np.add.at(by, which, counts)
                for name, vector in zip(names, bundle(by, codes)):
                    total[name] = total.get(name, 0) + vector.astype(np.float64)
        if total:
            yield pd.DataFrame({"lang": list(total), "vector": list(total.values())})

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    summed = (
        rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .mapInPandas(sums, "lang string, vector array<double>")
        .select("lang", F.posexplode("vector").alias("at", "value"))
        .groupBy("lang", "at").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("vector"))
    )
    found = {r.lang: np.array([v.value for v in r.vector]) for r in summed.orderBy("lang").collect()}
    return {k: v / np.linalg.norm(v) for k, v in found.items() if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``row`` (the input row), ``lang_pred`` and ``score``, the cosine cut off below 0.

    ``und`` with score 0 for null texts, texts without a letter, and if no language was learned.
    Equal cosines go to the name that sorts first.
    """
    names = np.array(sorted(prototypes), object)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), DIM)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            pred = np.full(len(batch), "und", object)
            score = np.zeros(len(batch))
            for first, last, codes, counts in chunks(batch.tolist()) if len(names) else ():
                vectors = bundle(counts, codes)
                cosine = vectors @ matrix.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                best = cosine.argmax(1)
                lettered = counts.any(1)
                pred[first:last] = np.where(lettered, names[best], "und")
                score[first:last] = np.where(lettered, cosine.max(1).clip(0, 1), 0)
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    source = docs.select(packed(docs).alias("row"), text_of(text_col).alias("text"))
    return source.select("row", run("text").alias("out")).select("row", "out.lang_pred", "out.score")
