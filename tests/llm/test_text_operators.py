"""Operators on single documents and lines, against libraries and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from channelspark.llm import attention_lm, bpe, language, line_dedup, token_counts, toxicity
from channelspark.llm.common import TOKENIZERS

ODD = [None, "", " ", "\n", "\n\n", "a", "ÀÉ ß İΣσ", "x" * 3000, "word " * 3000, "it's <|endoftext|> ' '", "é é​ 1½ -- 😀\x00"]


@pytest.fixture(scope="module")
def odd(docs_of):
    return docs_of([(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "\n")])


def test_automaton_equals_the_library():
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    theirs, ours = Tokenizer.from_file(path), bpe.Tokenizer(path)
    random.seed(4)
    parts = ["a", "b", "the", "ing", "ation", "'s", "'", " ", "\n", "1", "½", "é", "é", "Σ", "İ", "中", "😀", "<|endoftext|>", "</w>", "--", "\x1c", "　"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(random.choices("abcdeinorst", k=random.randint(1, 30))) for _ in range(3000)]
    for text in texts:
        want = theirs.encode(text, add_special_tokens=False)
        got = ours.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text
        assert ours.decode(got) == theirs.decode(want.ids, skip_special_tokens=False)


def test_every_code_point_encodes_as_the_library_does():
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    library, own = Tokenizer.from_file(path), bpe.Tokenizer(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b1{c}" for c in points[i : i + 256]) for i in range(0, len(points), 256)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want.ids


def test_automaton_follows_merges_in_order():
    merges = [("a", "a"), ("aa", "a"), ("b", "a"), ("aa", "ba")]
    vocab = {t: i for i, t in enumerate(["a", "b", "aa", "aaa", "ba", "aaba"])}
    ours, names = bpe.Automaton(vocab, merges), list(vocab)

    def merged(word):
        parts = list(word)
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return parts

    for n in range(1, 9):
        for bits in range(2**n):
            word = "".join("ab"[bits >> i & 1] for i in range(n))
            assert [names[i] for i in ours.encode(word)] == merged(word), word
    with pytest.raises(ValueError):
        bpe.Automaton(vocab, [*merges, ("a", "aa")])


def test_encode_documents(odd):
    theirs = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    rows = bpe.encode_documents(odd).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        ids = theirs.encode(r.row.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes()
        assert r.decoded == theirs.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_token_counts_equal_the_library(byte_fallback):
    pieces = token_counts.vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    theirs = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    theirs.pre_tokenizer = pre_tokenizers.Metaspace()
    ours = token_counts.Counter(pieces, byte_fallback)
    random.seed(5)
    parts = ["a", "b", "the", "▁", " ", "  ", "\n", "中", "梦", "😀", "é", "<0x41>", "<unk>", "<s>", "͸", "ing"]
    for _ in range(4000):
        text = "".join(random.choices(parts, k=random.randint(0, 12)))
        assert ours.text(text)[0] == len(theirs.encode(text, add_special_tokens=False).ids), text


def test_token_counts_ties_and_odd_rows(odd):
    tie = token_counts.Counter([("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("▁", 0.0)])
    assert tie.word("aaa") == (2, -3.0)  # aa ends first; of equal scores the earlier start wins
    rows = {r.row.doc_id: r for r in token_counts.count_tokens(odd.limit(11)).collect()}
    assert (rows[0].n_tokens, rows[1].n_tokens, rows[0].score) == (0, 0, 0.0)
    assert token_counts.count_tokens(odd.limit(0)).collect() == []


def lines_by_hand(rows, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    found = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20 and doc is not None:
                found.setdefault(key(line), set()).add(doc)
    keeper = {k: max(d) for k, d in found.items() if len(d) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(docs_of):
    random.seed(6)
    pool = [f"a line that is long enough {i}" for i in range(8)] + ["short", "", "  A LINE that is long enough 1\t", "x" * 20, "x" * 19, "É" * 20]
    rows = [(i % 70, "\n".join(random.choices(pool, k=random.randint(0, 6)))) for i in range(90)]
    rows += [(None, pool[0]), (500, None), (501, ""), (502, "\n\n"), (7, pool[0] + "\n" + pool[0])]
    got = line_dedup.drop_repeated_lines(docs_of(rows)).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=str) == lines_by_hand(rows)
    assert line_dedup.drop_repeated_lines(docs_of(rows).limit(0)).count() == 0


def test_line_dedup_stays_in_the_engine(docs_of):
    plan = line_dedup.drop_repeated_lines(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_language(docs_of, words):
    random.seed(8)
    other = [w.replace("a", "ö").replace("i", "ü") for w in words]
    rows = [(i, " ".join(random.choices((words, other)[i % 2], k=40)), ("aa", "bb")[i % 2]) for i in range(120)]
    prototypes = language.learn(docs_of(rows[:80]))
    got = {r.row.doc_id: r for r in language.identify(docs_of(rows[80:]), prototypes).collect()}
    assert all(got[i].lang_pred == lang and 0 < got[i].score <= 1 for i, _, lang in rows[80:])
    texts = [(1, None), (2, ""), (3, "123 -- \n"), (4, "中文字"), (None, words[0]), (5, words[1] * 9000)]
    odd = {r.row.doc_id: r for r in language.identify(docs_of(texts), prototypes).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[4].lang_pred in prototypes and odd[5].score > 0
    none = language.learn(docs_of([(1, "text", None), (2, None, "aa"), (3, "12", "bb")]))
    assert none == {} and language.identify(docs_of([(1, "a")]), none).first().lang_pred == "und"


def test_language_vectors_by_hand():
    a, b, c = language.letters()
    codes = language.trigrams("Ab, c")
    assert len(codes) == 4  # _ab ab_ b_c _c_, with one boundary between
    one = language.bind(codes[:1])[0]
    assert np.array_equal(one, np.roll(c[0], 2) * np.roll(c[1], 1) * c[2])
    counts = np.arange(6, dtype=np.float32).reshape(1, 6)
    assert np.allclose(language.bundle(counts[:, :4], codes), counts[:, :4] @ language.bind(codes))


def toxic_rows(words, n=400, seed=9):
    pick = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = [pick.choice(words) for _ in range(60)]
        bad = i % 7 == 0
        if bad:
            text[5], text[30] = pick.choice(["grumsk", "zlofty"]), "vexi" + pick.choice(words)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, docs_of, words):
    rows, labels = toxic_rows(words)
    model = toxicity.fit(docs_of(rows[:300]), spark.createDataFrame(labels[:300] + [(None, 1), (5, None)], "doc_id long, toxic int"))
    got = {r.row.doc_id: r.score for r in toxicity.score_documents(docs_of(rows[300:] + [(None, "grumsk vexilo"), (901, None), (902, "")]), model).collect()}
    assert all((got[i] >= 0.5) == bool(bad) for i, bad in labels[300:])
    assert got[None] >= 0.5 and got[901] == got[902] < 0.5


def test_toxicity_without_examples(spark, docs_of):
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)], [(1, None)]):
        model = toxicity.fit(docs_of([(1, "a b"), (2, None)]), spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert toxicity.score_documents(docs_of([(1, "a b")]), model).first().score < 0.5


def test_copies_lend_no_significance(spark, docs_of, words):
    rows, labels = toxic_rows(words)
    copies = [(1000 + i, "grumsk " + " ".join(words[:50]) + " onlyhere") for i in range(100)]
    model = toxicity.fit(docs_of(rows + copies), spark.createDataFrame(labels + [(i, 1) for i, _ in copies], "doc_id long, toxic int"))
    assert "w:grumsk" in model.weights and "w:onlyhere" not in model.weights


def test_label_model_discounts_correlated_voters():
    random_ = np.random.default_rng(3)
    y = random_.random(2000) < 0.2
    own = np.array([(random_.random(2000) < np.where(y, 0.6, 0.05)) for _ in range(3)]).T
    votes = np.column_stack([own, own[:, :1], own[:, :1]])  # the first voter, three times
    _, weights, silent = toxicity.label_model(votes, y)
    assert weights[0] == pytest.approx(weights[3]) and weights[0] < 0.6 * weights[1] and silent < 0


def brute_base(rows, held):
    count, ends = Counter(), 0
    for i, text in rows:
        if not held(i):
            count.update(attention_lm.words_of(text))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    p = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    return n, {i: (sum(p(count[w]) for w in attention_lm.words_of(t)) + p(ends), sum(w in count for w in attention_lm.words_of(t)) + (ends > 0)) for i, t in rows}


def test_lm_scores(spark, docs_of, words, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(attention_lm, "HEAD", 20)  # the join gets work
    random.seed(2)
    rows = [(i, " ".join(random.choices(words, k=30))) for i in range(150)] + [(200, None), (201, ""), (202, "new Words only"), (203, words[0] * 500)]
    got = {r.id: r for r in attention_lm.score_documents(docs_of(rows), F.col("doc_id") % 5 == 1).collect()}
    n, base = brute_base(rows, lambda i: i % 5 == 1)
    for i, text in rows:
        assert got[i].base_score == pytest.approx(base[i][0]) and got[i].n_known == base[i][1] and got[i].train_tokens == n
        assert got[i].n_tokens == len((text or "").split()) + 1 and math.isfinite(got[i].score) and got[i].score < 0
    assert sum(got[i].score for i, _ in rows if i % 5 == 1 and i < 150) > 3 * sum(base[i][0] for i, _ in rows if i % 5 == 1 and i < 150)
    assert attention_lm.score_documents(docs_of(rows).limit(0), F.lit(False)).count() == 0
    assert attention_lm.score_documents(docs_of(rows[:3]), F.lit(True)).first().base_score == 0


def tiny_model(seed=0):
    r = np.random.default_rng(seed)
    kinds, ids = attention_lm.CLASSES, attention_lm.IDS
    kind, weight = r.integers(0, kinds, ids), r.random(ids)
    table = r.random((3, kinds, kinds)) * (np.bincount(kind, minlength=kinds) > 0)
    triples = np.unique((r.integers(0, 5, 300) << 32) + (r.integers(0, 5, 300) << 16) + r.integers(0, 50, 300))
    times = r.integers(2, 9, len(triples)).astype(float)
    pairs, at = np.unique(triples >> 16, return_inverse=True)
    return attention_lm.Model(
        kind, weight / np.bincount(kind, weight, minlength=kinds)[kind], (table / table.sum(2, keepdims=True)).astype(np.float32),
        *r.normal(size=(2, kinds, attention_lm.DEPTH)).astype(np.float32), r.normal(size=attention_lm.WINDOW - 1).astype(np.float32),
        triples, times, pairs, np.bincount(at, times), attention_lm.DISCOUNT * np.bincount(at))


def by_hand(m, seq):
    total, end, window, hop = 0.0, attention_lm.END, attention_lm.WINDOW, attention_lm.HOP
    for t in range(1, len(seq)):
        start = 0 if t < window else -(-(t + 1 - window) // hop) * hop
        x, lag = m.kind[seq[start:t]], np.arange(t - start, 0, -1)
        a = np.exp(m.key[x] @ m.query[x[-1]] + m.bias[lag - 1])
        p = (a / a.sum() * m.table[np.minimum(lag, 3) - 1, x, m.kind[seq[t]]]).sum() * m.inside[seq[t]]
        pair = (int(seq[t - 2] if t > 1 else end) << 16) + int(seq[t - 1])
        if pair in m.pairs:
            i, triple = np.searchsorted(m.pairs, pair), (pair << 16) + int(seq[t])
            n = m.times[np.searchsorted(m.triples, triple)] - attention_lm.DISCOUNT if triple in m.triples else 0
            p = (n + m.freed[i] * p) / m.total[i]
        total += math.log10(p)
    return total


def test_lm_windows_by_hand_and_sum_to_one():
    m, r = tiny_model(), np.random.default_rng(1)
    end = attention_lm.END
    seqs = [np.concatenate([[end], r.integers(0, 6, n), [end]]).astype(np.uint16) for n in (0, 1, 5, 7, 8, 9, 14, 15, 16, 17, 40, 257)]
    assert np.allclose(m.log10(seqs), [by_hand(m, s) for s in seqs], atol=1e-4)
    start = np.array([end, 3, 4, 1], np.uint16)
    every = m.log10([np.append(start, i).astype(np.uint16) for i in range(attention_lm.IDS)]) - m.log10([start])[0]
    assert (10**every).sum() == pytest.approx(1, abs=1e-5)


def test_lm_counts_all_triples(spark, docs_of, words, monkeypatch):
    """Singletons and rare continuations count; pieces and shards do not change the scores."""
    from pyspark.sql import functions as F

    kept, scored = {}, attention_lm.scored
    monkeypatch.setattr(attention_lm, "PIECE", 300)
    monkeypatch.setattr(attention_lm, "scored", lambda tokens, model, shards: kept.update(tokens=tokens, model=model, shards=shards) or scored(tokens, model, shards))
    random.seed(14)
    rows = [(i, " ".join(random.choices(words[:30], k=random.randint(0, 60)))) for i in range(80)]
    got = {r.id: r.score for r in attention_lm.score_documents(docs_of(rows), F.col("doc_id") % 5 == 1).collect()}
    tokens = [(r.id, r.held_out, np.frombuffer(r.ids, np.uint16)) for r in kept["tokens"].collect()]
    assert kept["shards"] > 3 and kept["tokens"].select("piece").distinct().count() > 3
    n, end = Counter(), attention_lm.END
    for _, held_out, seq in tokens:
        for a, b, c in zip([end, *seq.tolist()], seq.tolist(), seq[1:].tolist()):
            n[(a << 32) + (b << 16) + c] += not held_out
    keys = np.array(sorted(k for k in n if n[k]))
    times = np.array([n[k] for k in keys.tolist()], float)
    pairs, at = np.unique(keys >> 16, return_inverse=True)
    assert (times == 1).any()
    m = attention_lm.replace(kept["model"], triples=keys, times=times, pairs=pairs, total=np.bincount(at, times), freed=attention_lm.DISCOUNT * np.bincount(at))
    want = dict(zip([i for i, *_ in tokens], m.log10([seq for *_, seq in tokens])))
    assert len(got) == 80 and all(got[i] == pytest.approx(want[i]) for i in got)


def test_lm_trains_on_every_place(monkeypatch):
    m, r = tiny_model(), np.random.default_rng(3)
    seqs = [r.integers(0, 60, n).astype(np.uint16) for n in (2, 15, 16, 17, 24, 25, 900)]
    seen, step = [], attention_lm.Model.step
    monkeypatch.setattr(attention_lm, "PIECE", 16 * 60)
    monkeypatch.setattr(attention_lm.Model, "step", lambda self, windows, real: seen.append((windows[:, 1:][real[:, 1:] > 0], len(windows))) or step(self, windows, real))
    flat, n = attention_lm.train_here(m, iter(seqs), 0)
    assert n == sum(k for _, k in seen) == sum(1 + max(0, -(-(len(s) - 16) // 8)) for s in seqs) and np.isfinite(flat).all()
    want = np.bincount(np.concatenate([m.kind[s[1:]] for s in seqs]), minlength=attention_lm.CLASSES)
    assert np.array_equal(np.bincount(np.concatenate([k for k, _ in seen]), minlength=attention_lm.CLASSES), want)


def test_lm_gradient():
    m, r = tiny_model(), np.random.default_rng(2)
    windows, real = m.kind[r.integers(0, 60, (4, attention_lm.WINDOW))], np.ones((4, attention_lm.WINDOW), np.float32)
    real[1, 9:] = 0
    flat = m.parameters().astype(float)
    _, g = m.replaced(flat).step(windows, real)
    for i in np.argsort(-np.abs(g))[:5]:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert (m.replaced(up).step(windows, real)[0] - m.replaced(down).step(windows, real)[0]) / 2e-2 == pytest.approx(g[i], rel=0.05, abs=1e-4)


def test_sha_is_of_utf8(docs_of):
    from pyspark.sql import functions as F

    row = line_dedup.drop_repeated_lines(docs_of([(1, "é\nß")])).select(F.sha2("kept", 256).alias("h")).first()
    assert row.h == hashlib.sha256("é\nß".encode()).hexdigest()


def test_texts_without_newer_letters_are_not_searched_for_them():
    """The search through the long class of newer letters only runs where one of them could be."""
    import types

    from channelspark.llm import bpe

    own = bpe.Tokenizer(f"{bpe.TOKENIZERS}/word_bpe_49k.json")
    seen, search = [], own.newer.search
    own.newer = types.SimpleNamespace(search=lambda text: seen.append(text) or search(text))
    own.encode("größer als señales, façade")
    assert not seen
    assert own.encode("ꟋA") == own.encode("ɤA") and len(seen) >= 1
    assert own.automaton.encode("the" + own.automaton.suffix[:0]) == [own.automaton.vocab["the" + own.automaton.suffix]]
