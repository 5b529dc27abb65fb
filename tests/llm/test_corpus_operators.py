"""Operators over whole tables (joins, graphs, mixtures) and the pipeline, against brute force."""

import math
import os
import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from channelspark.llm import common, components, mixing, simhash, top_k, vector_dedup

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, near):
    """Smallest index reachable from each."""
    root = list(range(n))
    for i in range(n):
        for j in near(i):
            a, b = i, j
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    for i in range(n):
        root[i] = root[root[i]]
    return root


def test_fingerprints(words, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 50)
    random.seed(1)
    texts = [None, "", " \n", "one", "Two words", "a b c", "É é\x0bx y", " ".join(random.choices(words, k=400))]
    for text in texts:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_bk_tree():
    random.seed(2)
    codes = [random.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for c in codes:
        tree.add(c)
    for q in codes[:40]:
        assert sorted(tree.within(q, 3)) == sorted(c for c in codes if (c ^ q).bit_count() <= 3)
    assert simhash.BKTree().within(5, 3) == []


@pytest.mark.parametrize("shard", [8, 4000])
def test_near_links_join_every_class(spark, shard):
    random.seed(3)
    codes = {0, (1 << 64) - 1}
    for _ in range(40):
        code = random.getrandbits(64)
        for _ in range(12):
            codes.add(code)
            for bit in random.sample(range(64), random.randint(1, 4)):
                code ^= 1 << bit
    codes = sorted(codes)
    want = groups(len(codes), lambda i: [j for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 3])
    signed = np.array(codes, np.uint64).view(np.int64)
    links = simhash.near_links(spark.createDataFrame([(int(c),) for c in signed], "fp bigint"), shard)
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    classes = {}
    for c, w in zip(signed.tolist(), want):
        classes.setdefault(w, set()).add(got.get(c, c))
    assert all(len(c) == 1 for c in classes.values()) and len({*map(min, classes.values())}) == len(classes)


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(5, 5)] + [(i, i + 1) for i in range(400, 450)]
    root = groups(500, lambda i: [b for a, b in edges if a == i] + [a for a, b in edges if b == i])
    root = [root[root[r]] for r in root]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges for x in (a, b) if a != b}
    assert got == {i: root[i] for i in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows(words):
    random.seed(5)
    base = random.choices(words, k=300)
    rows = [(i, " ".join(random.choices(words, k=80))) for i in range(40)]
    for i in range(40, 60):
        text = list(base)
        text[random.randrange(300)] = "edit"
        rows.append((i, " ".join(text)))
    return rows + [(70, None), (71, ""), (72, " \n"), (None, " ".join(base)), (None, "alone here"), (3, rows[3][1]), (80, "x" * 50_000)]


def test_near_duplicates(docs_of, words):
    rows = near_rows(words)
    prints = [brute_fingerprint(t) for _, t in rows]
    want = groups(len(rows), lambda i: [j for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    want = [want[want[w]] for w in want]
    least = {}
    for (i, _), w in zip(rows, want):
        least[w] = min((x for x in (least.get(w), i) if x is not None), default=None)
    got = simhash.near_duplicates(docs_of(rows)).select("id", "component").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, least[w]) for (i, _), w in zip(rows, want)), key=str)
    kept = simhash.one_of_each(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted(set(least.values()), key=str)
    assert simhash.near_duplicates(docs_of(rows).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [6, 2000])
def test_stage_finds_edited_copies(spark, docs_of, words, monkeypatch, limit):
    monkeypatch.setattr(simhash, "SHARD", limit)
    monkeypatch.setattr(simhash, "MEET", limit)
    random.seed(15)
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    rows = []
    for b in range(12):
        base = random.choices(words, k=300)
        rows.append((100 * b, " ".join(base)))
        for i, edits in enumerate([1, 2, 3, 4, 5, 6, 6, 7, 9, 14]):
            text = list(base)
            for n in range(edits):
                text[10 + 20 * n] = f"edit{b}x{i}x{n}"
            rows.append((100 * b + i + 1, " ".join(text)))
    rows += [(5000, rows[0][1].upper()), (5001, "a b"), (5002, "A  b"), (5003, "a c")]
    sets = [grams(t.lower()) or {tuple(t.lower().split())} for _, t in rows]
    alike = [[j for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    assert any(0.8 <= len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.83 for i in range(len(rows)) for j in alike[i])
    root = groups(len(rows), lambda i: alike[i])
    root = [root[root[w]] for w in root]
    kept = corpus_pipeline.dedup_near(spark, docs_of(rows), SF).collect()
    assert sorted(r.doc_id for r in kept) == sorted({rows[w][0] for w in root}) and 12 < len(kept) < 60


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, label int, x string, node int")


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD", 100)
    monkeypatch.setattr(top_k, "BLOCK", 2)
    r = np.random.default_rng(6)
    centres = r.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + r.normal(scale=0.1, size=8)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, [0.5] * 8) for i in range(60)] + [(500, [0.0] * 8), (500, [1.0] * 8), (77, rows[77][1])]
    bad = [(600, None), (601, [math.nan] * 8), (602, [math.inf] + [0.0] * 7), (603, [None] + [0.0] * 7), (None, [1.0] * 8)]
    got = sorted(map(tuple, top_k.exact_top_k(vectors(spark, rows + bad)).collect()))
    ints = [(i, np.floor(1024 * np.float64(np.float32(v))).astype(int)) for i, v in rows]
    want = []
    for query in sorted({i for i, _ in rows if i % 100 == 0}):
        found = sorted((-int(a @ b), j) for i, a in ints if i == query for j, b in ints if j != query)[:10]
        want += [(query, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    assert got == want
    assert top_k.exact_top_k(vectors(spark, [(100, [1.0, 2.0]), (1, [1.0])])).collect()[0].score == 1024 * 1024
    assert top_k.exact_top_k(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("repeats", [2, 12])
def test_top_k_of_a_repeated_query(spark, repeats):
    """The query's own rows take no places from the ids that hold the same vector."""
    rows = [(100, [2.0, 1.0])] * repeats + [(i, [2.0, 1.0]) for i in range(101, 115)] + [(1, [1.0, 1.0]), (2, [0.0, 1.0])]
    got = sorted((r["rank"], r.vec_id) for r in top_k.exact_top_k(vectors(spark, rows)).collect())
    assert got == [(n + 1, 101 + n) for n in range(10)]
    many = [(100, [2.0, 1.0]), *[(101, [2.0, 1.0])] * 4, *[(102, [2.0, 1.0])] * 20, (103, [2.0, 1.0])]
    got = sorted((r["rank"], r.vec_id) for r in top_k.exact_top_k(vectors(spark, many)).collect())
    assert got == [(n + 1, 101 if n < 4 else 102) for n in range(10)]


@pytest.mark.parametrize("size", [20_000.0, 1e6])
def test_top_k_of_large_components(spark, size):
    """Components over 16,384, with integers that fit 64 bits and (for parts of the products) do not."""
    r = np.random.default_rng(16)
    rows = [(i, (r.normal(size=8) * (size if i % 3 == 0 else 1)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(301, [-3e9] + [0.0] * 7), (302, [float(2**40)] + [0.0] * 7)] if size > 1e5 else []
    rows = [(i, [0.0] + v[1:] if i % 100 == 0 else v) for i, v in rows]
    ints = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows]
    want = []
    for query, a in ints:
        if query % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in ints if j != query)[:10]
            want += [(query, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    assert sorted(map(tuple, top_k.exact_top_k(vectors(spark, rows)).collect())) == want
    assert {j % 3 for _, _, j, _ in want} & {0}
    with pytest.raises(Exception, match="64 bits"):
        top_k.exact_top_k(vectors(spark, [(100, [1e12]), (1, [1e12])])).collect()


def test_top_k_of_any_finite_component(spark):
    """Components of any size take part; only a best score beyond 64 bits is an error."""
    huge = 1.7e308
    rows = [(0, [0.0, 1.0, 0.0]), (100, [0.0, 0.0, 2.0**-10]), (1, [1e16, 2.0, 1.0]), (2, [1.0, 1.0, 3.0]), (3, [-huge, 3.0, 0.0]), (4, [huge, -1.0, 5.0]), (5, [0.0, -huge, 7.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k.exact_top_k(table, k=3).collect()}
    assert [got[0, n] for n in (1, 2, 3)] == [(3, 3 << 20), (1, 2 << 20), (2, 1 << 20)]
    assert [got[100, n] for n in (1, 2, 3)] == [(5, 7 << 10), (4, 5 << 10), (2, 3 << 10)]
    assert top_k.integer(-1.5e16, 1024) == -15 * 10**15 * 1024 and top_k.integer(-0.3, 1024) == -308


def test_m_tree_leaves_distances_out():
    r = np.random.default_rng(7)
    points = (1000 * (r.normal(size=(20, 1, 6)) + r.normal(scale=0.02, size=(20, 200, 6)))).reshape(-1, 6).astype(np.int64)
    tree = top_k.MTree(np.arange(4000), points)
    tree.search(points[0], 0, 10)
    assert tree.computed < 2000
    flat = top_k.MTree(np.arange(500), np.ones((500, 3), np.int64))
    assert flat.search(np.ones(3, np.int64), 0, 3) == [(3, 1), (3, 2), (3, 3)]


@pytest.mark.parametrize("bucket", [16, 2048])
def test_near_vectors(spark, bucket):
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 16))
    x = np.concatenate([x, x[:40] + 0.02 * r.normal(size=(40, 16)), x[:1] + 0.05 * r.normal(size=(30, 16)), np.repeat(x[5:6], 25, 0)]).astype(np.float32)
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [math.nan] * 16), (903, [math.inf] * 16), (904, [None] * 16), (905, x[0].tolist()[:15]), (1, rows[0][1])]
    unit = np.float64(np.concatenate([x, x[:1]]))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    ids = [*range(1, len(x) + 1), 1]
    got = sorted((q.id, q.n_links, q.component) for q in vector_dedup.near_vectors(vectors(spark, rows + odd), bucket=bucket).collect())
    root = groups(len(ids), lambda i: np.flatnonzero(linked[i]).tolist())
    root = [root[root[w]] for w in root]
    want = sorted([(i, int(n), root[k] + 1) for k, (i, n) in enumerate(zip(ids, linked.sum(1)))] + [(900 + i, 0, 900 + i) for i in range(6)])
    assert sum(a != b for a, b in zip(got, want)) <= 0.01 * len(want) and len(got) == len(want)
    assert not vector_dedup.near_vectors(vectors(spark, [])).count()


def test_filters_find_links_at_the_limit():
    """Recall at a cosine of exactly 0.9, in several dimensions."""
    r = np.random.default_rng(9)
    for width in (16, 33, 64):
        x = r.normal(size=(1500, width))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = r.normal(size=x.shape)
        z -= (z * x).sum(1, keepdims=True) * x
        y = 0.9 * x + math.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
        found = [bool(set(a) & set(b)) for a, b in zip(vector_dedup.decode(x), vector_dedup.decode(y))]
        assert np.mean(found) > 0.98


def test_filters_listed_are_those_exceeded():
    r = np.random.default_rng(10)
    x = r.normal(size=(20, 16))
    turns, codes, height = vector_dedup.product_codes(16)
    for row, listed in zip(x / np.linalg.norm(x, axis=1, keepdims=True), vector_dedup.decode(x)):
        want = [(t * vector_dedup.CODES + a) * vector_dedup.CODES + b
                for t in range(vector_dedup.ROUNDS) for a in range(vector_dedup.CODES) for b in range(vector_dedup.CODES)
                if (row @ turns[t])[:8] @ codes[t, 0, a] + (row @ turns[t])[8:] @ codes[t, 1, b] >= height]
        assert listed.tolist() == want


def mixture(docs, **how):
    rows = mixing.mix_sources(docs, **how).select("row.doc_id", "row.source", "tokens", "epoch", "place").collect()
    spent, epochs = {}, {}
    for r in rows:
        spent[r.source] = spent.get(r.source, 0) + r.tokens
        epochs[r.source] = max(epochs.get(r.source, 0), r.epoch)
    return rows, spent, epochs


def source_rows(words):
    random.seed(11)
    return [(i, " ".join(random.choices(words, k=random.randint(1, 30))), None, random.choice(["big"] * 8 + ["mid", "mid", "tiny", None])) for i in range(600)]


def test_mixing_to_a_repetition_limit(docs_of, words):
    rows = source_rows(words)
    got, spent, epochs = mixture(docs_of(rows + [(700, None, None, "void"), (701, "", None, "void")]), repeat_limit=1.5)
    assert {r.doc_id for r in got} == {*range(600), 700, 701}  # nothing is lost
    size = {s: sum(len(t.split()) for _, t, _, x in rows if x == s) for s in {x for *_, x in rows}}
    assert max(spent[s] / size[s] for s in size) <= 1.5 and epochs["big"] == 1 and max(epochs.values()) == 2
    assert spent["tiny"] / size["tiny"] > 1.5 - 40 / size["tiny"] or spent[None] / size[None] > 1.5 - 40 / size[None]
    for source in size:
        places = sorted(r.place for r in got if r.source == source and r.epoch == 1)
        assert len(set(places)) == len(places)


def test_mixing_to_an_entropy(docs_of, words):
    rows = source_rows(words)
    size = {s: sum(len(t.split()) for _, t, _, x in rows if x == s) for s in {x for *_, x in rows}}
    budget = sum(size.values())
    _, spent, _ = mixture(docs_of(rows), budget="corpus", entropy=1.2)
    share = np.array([spent[s] / sum(spent.values()) for s in size])
    assert -(share * np.log(share)).sum() == pytest.approx(1.2, abs=0.03) and abs(sum(spent.values()) - budget) < 4 * 30
    _, even, _ = mixture(docs_of(rows), budget="corpus", entropy=9.0)  # out of reach: even weights
    assert max(even.values()) - min(even.values()) <= 30
    with pytest.raises(ValueError):
        mixing.mix_sources(docs_of(rows))


def test_mixing_empty_and_repeated(docs_of):
    assert mixture(docs_of([]), repeat_limit=2.0)[0] == []
    rows, *_ = mixture(docs_of([(1, "a b c", None, "s")] * 3 + [(None, "a", None, "s")]), repeat_limit=2.0)
    assert len([r for r in rows if r.doc_id == 1 and r.epoch == 1]) == 3


def test_slices_meet_once(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, i) for i in range(3)], "key long, v long")
    met = {}
    for r in common.in_slices(rows, rows.v, 12).groupBy("key").agg({"v": "collect_list", "tree": "collect_list"}).collect():
        values, trees = r["collect_list(v)"], r["collect_list(tree)"]
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if a < b and (all(trees) or trees[i] != trees[j]):
                    met[a, b] = met.get((a, b), 0) + 1
    assert len(met) == 50 * 49 // 2 and all(met[p] == 1 for p in met if p[1] >= 3)


def test_pipeline_stages(spark, docs_of, words):
    random.seed(12)
    shared = "this line is found in very many documents"
    rows = [(i, "\n".join([" ".join(random.choices(words, k=50)), shared, " ".join(random.choices(words, k=40))]), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "  "), "en", "s0") for i in range(10)] + [(200, None, None, None), (201, "", "en", "s1"), (5, rows[5][1], "en", "s2")]
    docs = docs_of(rows)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "near dedup", "mixing", "BPE encoding"]
    lined = stages["line dedup"](spark, docs, SF)
    assert lined.schema.names == docs.columns and lined.count() == docs.count()
    assert [r.doc_id for r in lined.where(lined.text.contains(shared)).collect()] == [59]
    near = stages["near dedup"](spark, docs, SF)
    kept = [r.doc_id for r in near.collect()]
    assert near.columns == docs.columns and sorted(kept) == [*range(60), 200]
    mixed = stages["mixing"](spark, near, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == set(kept)
    assert stages["BPE encoding"](spark, mixed, SF).count() == mixed.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_queries_over_the_smallest_tables(spark):
    import verify

    fns, sql = queries(), oracle_sql()
    names = [n for n in fns if n == "pipeline" or n.startswith("op") and n[2].isdigit()]
    assert sorted(n.split("_")[0] for n in names) == sorted([*(f"op{i}" for i in range(1, 11)), "pipeline"])
    for name in names:
        ok, note, _ = verify.compare(spark, verify.connect(SF), fns[name], sql.get(name), SF)
        assert ok, (name, note)
