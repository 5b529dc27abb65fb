"""Cross-tokenizer alignment against loops over bytes."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from channelspark.llm import token_alignment as ta
from channelspark.llm.bpe import byte_symbols

PLAIN = {c: bytes([b]) for b, c in enumerate(byte_symbols())}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def piece_bytes(piece):
    byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


def brute(texts, libraries):
    a, b = libraries
    docs = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [b"".join(PLAIN[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [piece_bytes(b.id_to_piece(i)) for i in ids_b]
        want = b" " + text.encode() if text else b""
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            ids_a = ids_b = bytes_a = bytes_b = []
        cover = []
        for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
            cover.append([n for n, p in enumerate(parts) for _ in p])
        links = sorted(set(zip(*cover)))
        ends = [{sum(map(len, parts[: n + 1])): n for n in range(len(parts))} for parts in (bytes_a, bytes_b)]
        groups, at = [], (0, 0)
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = (ends[0][end] + 1, ends[1][end] + 1)
            groups.append("|".join(",".join(map(str, ids[x:y])) for ids, x, y in zip((ids_a, ids_b), at, to)))
            at = to
        docs.append((len(ids_a), len(ids_b), groups, [(ids_a[i], ids_b[j]) for i, j in links]))
    counts = Counter(pair for *_, links in docs for pair in set(links))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [(na, nb, len(g), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), ";".join(g)) for na, nb, g, links in docs]


def result(df):
    return {r.id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect()}


def test_against_loops(spark, docs_of, words, libraries, monkeypatch):
    texts = [
        None, "", " ", "a", "Hello world, hello!", "  two  spaces\n\nand\tlines ", "café naïve 你好 \U0001f600\U0001f468‍\U0001f469",
        "a▁b", "<s> </s> <unk> <|endoftext|> <0x41>", "é ﬁ   　", "1234567890 3.14e-10", "\x00\x01", "tie tie tie", "tie tie tie",
        *[" ".join(words[i % 400] for i in range(k * 13, k * 13 + k * 9 % 70)) for k in range(60)], " ".join(words) * 20,
    ]
    docs = docs_of(list(enumerate(texts))).repartition(3)
    got = result(ta.align(docs))
    want = dict(enumerate(brute(texts, libraries)))
    assert got == want
    assert got[7][:3] == (0, 0, 0) and got[8][0] > 0
    hashed = result(ta.align(docs, groups="sha256"))
    assert all(hashed[i][-1] == (hashlib.sha256(g[-1].encode()).hexdigest() if g[-1] else "") for i, g in want.items())


def test_ranks_are_the_same_vocabulary(libraries):
    """Every code point of the first planes in a few surroundings, a stride of the rest."""
    ranks, whole = ta.Ranks(public_tokenizers.path(ta.BYTE_RANKS)), ta.ByteLevel(public_tokenizers.path(ta.BYTE_BPE))
    points = [c for c in [*range(0x3400), *range(0xE000, 0x20000, 5), *range(0x20000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b1{chr(c)} {chr(c)}'s" for c in points]
    assert ranks.encode(texts) == whole.encode(texts)
    assert ranks.pieces.to_pylist() == whole.pieces.to_pylist()[: len(ranks.pieces)]


@pytest.mark.parametrize("name", [ta.BYTE_RANKS, ta.BYTE_BPE, ta.PIECE_BPE])
def test_words_stand_for_texts(words, name):
    """No token goes on after a space that a word follows."""
    side = ta.sides(name, name)[0]
    some = [*words, "don't", "a\n", "b\u3000", "\U0001f600", "x" * 300, "1,234.5\n\ny", "é\t", "<0x41>", "<|endoftext|>"] * 3
    flat = side.encode_words(pa.array(some, pa.large_string()))
    assert sum(flat.to_pylist(), []) == side.encode([" ".join(some)])[0]
    assert flat.to_pylist() == side.encode(some)


def test_small_slices_and_pieces_give_the_same(spark, docs_of, words, libraries):
    """Pieces of a few documents: partial counts meet in Spark."""
    texts = [" ".join(words[(k * 7 + i) % 400] for i in range(k % 30)) for k in range(120)]
    rows = docs_of([(i, t) for i, t in enumerate(texts)]).repartition(17)
    assert result(ta.align(rows)) == dict(enumerate(brute(texts, libraries)))


def test_pieces_within_a_task(words, libraries):
    """A task that fills several pieces numbers their pairs anew."""
    texts = [" ".join(words[k : k + 9]) for k in range(40)] + ["", None]
    a, b = ta.sides(ta.BYTE_RANKS, ta.PIECE_BPE)
    aligned = ta.Aligned(*ta.tokens_of(pa.array(texts), a, b))
    want = brute([t or "" for t in texts], libraries)
    assert aligned.texts().to_pylist() == [w[6] for w in want]
    assert aligned.groups.tolist() == [w[2] for w in want]


def test_empty_table_and_repeated_rows(spark, docs_of, libraries):
    assert ta.align(docs_of([])).count() == 0
    twice = docs_of([(1, "same text"), (1, "same text"), (None, "other")])
    rows = sorted((r.id or 0, r.count_sum, r.n_links) for r in ta.align(twice).collect())
    assert rows == sorted((i, w[5], w[3]) for i, w in zip((1, 1, 0), brute(["same text", "same text", "other"], libraries)))
