"""The parts of the attention model that its cost hangs on."""

import math

import numpy as np
import pyarrow as pa
import pytest

from channelspark.llm import attention_lm as lm

ODD = ["", " \t ", "Plain words, twice: plain words", "a\x0bB\x1cc\n\nd ", "x\xa0 \xa0 y\x85 　z", "it's 'S 12a3 日本 ÀÉ 😀x", "\xa0 \xa0"]


def test_words_and_ids_of_odd_texts():
    lists = lm.words_in(pa.array(ODD))
    assert [[w.encode() for w in words if w] for words in lists.to_pylist()] == [lm.words_of(t) for t in ODD]
    own = lm.subwords(f"{lm.TOKENIZERS}/byte_bpe_50k.tiktoken")
    words = [b"", *(w for t in ODD for w in lm.words_of(t))]
    ids, long = own.ids(words)
    each = [own.encode(" " + w.decode()) if w else [] for w in words]
    assert long.tolist() == [len(e) for e in each] and ids.tolist() == [i for e in each for i in e]


def test_distinct_words_are_encoded_together(monkeypatch):
    own, calls = lm.subwords(f"{lm.TOKENIZERS}/byte_bpe_50k.tiktoken"), []
    encode = own.encode
    monkeypatch.setattr(own, "encode", lambda text: calls.append(text) or encode(text))
    words = [f"word{i},".encode() for i in range(1000)]
    ids, long = own.ids(words)
    assert len(calls) == 1 and len(long) == 1000 and long.sum() == len(ids)
    assert ids.tolist() == [i for w in words for i in encode(" " + w.decode())]


def test_counts_travel_compressed():
    r = np.random.default_rng(4)
    values = np.sort(r.integers(0, 1 << 30, 5000))
    steps = np.diff(values, prepend=0)
    assert np.array_equal(lm._values(lm._planes(steps, 6), 6), steps) and len(lm._values(lm._planes(steps[:0], 6), 6)) == 0
    assert len(lm._planes(steps, 6)) < 3 * len(steps)


def test_order_of_triples_is_stable():
    r = np.random.default_rng(5)
    keys = (r.integers(0, 50_257, 4000) << 32) + (r.integers(0, 3, 4000) << 16) + r.integers(0, 5, 4000)
    keys = np.concatenate([keys, keys[::-1]])
    assert np.array_equal(lm._order(keys), np.argsort(keys, kind="stable"))


@pytest.mark.parametrize("first", [1, lm.HOP])
def test_attention_of_far_scores(first):
    """Softmax over all earlier places, where scores lie tens apart too; pairs of a place and a later one are not worked out."""
    r = np.random.default_rng(6)
    table = r.random((3, lm.CLASSES, lm.CLASSES)).astype(np.float32)
    query, key = (r.normal(0, 3, (lm.CLASSES, lm.DEPTH)).astype(np.float32) for _ in range(2))
    none = np.empty(0)
    m = lm.Model(none, none, table, query, key, r.normal(size=lm.WINDOW - 1).astype(np.float32), none, none, none, none, none)
    places = r.integers(0, lm.CLASSES, (lm.WINDOW, 3))
    chance, *_, at, _ = m.attend(places, first)
    assert len(at) == 3 * sum(range(first, lm.WINDOW))
    for w in range(3):
        for p in range(first, lm.WINDOW):
            x, lag = places[:p, w], np.arange(p, 0, -1)
            logit = key[x].astype(float) @ query[x[-1]] + m.bias[lag - 1]
            a = np.exp(logit - logit.max())
            want = (a * table[np.minimum(lag, 3) - 1, x, places[p, w]]).sum() / a.sum()
            assert math.isclose(chance[p - first, w], want, rel_tol=1e-3, abs_tol=1e-6)


def test_head_takes_equally_frequent_words_together(spark, monkeypatch):
    counts = spark.createDataFrame([(bytearray(w.encode()), c) for w, c in [("a", 9), ("b", 5), ("c", 5), ("d", 1), ("e" * 65, 99)]], "word binary, c bigint")
    for most, want in ((0, []), (1, ["a"]), (2, ["a"]), (3, ["a", "b", "c"]), (9, ["a", "b", "c", "d"])):
        monkeypatch.setattr(lm, "HEAD", most)
        words, times = lm._head(counts)
        assert sorted(w.decode() for w in words.to_pylist()) == want and len(times) == len(want)
