"""BPE encoding and decoding with a tokenization automaton.

The automaton's states are "the last token read", its arcs are labelled with tokens, and it accepts
exactly the correct tokenizations. It grows by one gadget per merge (u, v -> w): w gets the arcs
into u and the arcs out of v as they are at that moment, and the arc u -> v goes. Written out, the
arcs of a large vocabulary are its square, so a gadget is kept as what it copies (its parts and
its time) and an arc is looked up by following the copies back; looked-up arcs fill the
transition table. A word is read left to right: each prefix has one correct tokenization, so a
position keeps one state. Decoding emits the arc labels.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelspark.llm.common import TOKENIZERS, packed

#: Unicode white space, as the pattern's own engine reads it (fixed values).
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of the newest Unicode versions that the library's tables do not know yet (fixed values).
UNKNOWN = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Capitals of the newest Unicode versions, which the library lower-cases (fixed values).
NEWER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
TABLE_ENTRIES = 400_000
WORD_ENTRIES = 600_000
ROWS = 256


class Automaton:
    """Transitions ``state --token--> state`` compiled from an ordered list of merges."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.longest = max((len(t) - len(suffix) * t.endswith(suffix) for t in vocab), default=1)
        self.born, self.left, self.right = ({i: 0 for i in vocab.values()}, {}, {})
        self.merged: dict[tuple[int, int], int] = {}
        for time, (u, v) in enumerate(merges, 1):
            self._gadget(time, vocab[u], vocab[v], vocab[u + v])
        self.table: dict[int, bool] = {}

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        if self.born[w] or w in (u, v):
            raise ValueError("every merge must make a token of its own, after its parts")
        self.born[w], self.left[w], self.right[w] = time, u, v
        self.merged[u, v] = time

    def arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow ``state``."""
        key = state << 32 | token
        if key not in self.table:
            if len(self.table) >= TABLE_ENTRIES:
                self.table.clear()
            self.table[key] = self._follow(state, token)
        return self.table[key]

    def _follow(self, p: int, x: int) -> bool:
        before = len(self.merged) + 1
        while True:
            if self.merged.get((p, x), before) < before:
                return False
            if self.born[p] > self.born[x]:
                before, p = self.born[p], self.right[p]
            elif self.born[x]:
                before, x = self.born[x] + 1, self.left[x]  # a gadget's own removal counts too
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word."""
        n, get, known = len(word), self.vocab.get, self.table.get
        marked = word + self.suffix
        whole = get(marked) if n else None
        if whole is not None:  # no longer token could end here
            return [whole]
        last: list[int] = [-1] * (n + 1)
        start = [0] * (n + 1)
        for end in range(1, n + 1):
            stop = end if end < n else None
            for begin in range(max(0, end - self.longest), end):
                token = get(marked[begin:stop])
                if token is None:
                    continue
                if begin:
                    state = last[begin]
                    if state < 0:
                        continue
                    follows = known(state << 32 | token)
                    if not (self.arc(state, token) if follows is None else follows):
                        continue
                last[end], start[end] = token, begin
                break
        if n and last[n] < 0:
            raise ValueError("the vocabulary lacks a symbol of the word")
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    kept = set(own)
    return [chr(b if b in kept else next(spare)) for b in range(256)]


class Tokenizer:
    """Normaliser, pre-split and automaton of a byte-level word BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.labels = {i: t for t, i in model["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {i: t for t, i in added.items()}
        self.added = {t: np.uint32(i).tobytes() for t, i in added.items()}
        names = sorted(map(regex.escape, added), key=len, reverse=True)
        self.special = regex.compile(f"({'|'.join(names)})") if names else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        plain = pattern.replace(r"\s", SPACE)
        self.pattern = regex.compile(plain)
        self.later = re.compile("[\u0558-\U0010ffff]")  # from the first of the newer ones on; quick to rule out
        self.newer = regex.compile(f"[{UNKNOWN}{''.join(map(chr, NEWER_LOWER))}]")
        self.exact = regex.compile(plain.replace(r"\p{L}", rf"[\p{{L}}--[{UNKNOWN}]]"), regex.V1)
        self.bytes = byte_symbols()
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        if len(self.words) >= WORD_ENTRIES:
            self.words.clear()
        symbols = "".join(self.bytes[b] for b in word.encode("utf-8", "replace"))
        ids = self.words[word] = np.array(self.automaton.encode(symbols), "<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return b"".join(self.added[p] if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        known, make = self.words.get, self.word
        pattern = self.pattern
        if not text.isascii() and self.later.search(text) and self.newer.search(text):
            text, pattern = text.translate(NEWER_LOWER), self.exact
        return b"".join([known(w) or make(w) for w in pattern.findall(text)])

    def decode(self, ids: bytes) -> str:
        """Arc labels joined by a space, as files without a decoder ask for."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker, compiled on first use."""
    return Tokenizer(path)


def encode_documents(
    docs: DataFrame, path: str = f"{TOKENIZERS}/word_bpe_49k.json", text_col: str = "text"
) -> DataFrame:
    """Encode whole texts and decode them again.

    Returns ``row`` (the input row), ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``.
    Null and empty texts have no ids and decode to the empty text. Every row is encoded by itself,
    so repeated rows, ties and other columns do not matter; nothing is shuffled.
    """
    source = docs.select(packed(docs).alias("row"), F.col(text_col).cast("string").alias("text"))

    @F.pandas_udf("struct<ids: binary, decoded: string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path)
        for batch in texts:
            for first in range(0, len(batch), ROWS):  # decoded texts are large
                ids = [own.encode(t) if t else b"" for t in batch[first : first + ROWS]]
                yield pd.DataFrame({"ids": ids, "decoded": [own.decode(i) for i in ids]})

    return source.select("row", run("text").alias("out")).select("row", "out.ids", "out.decoded")
