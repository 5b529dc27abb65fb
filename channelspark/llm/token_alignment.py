"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Arrow does the work inside a task. The id lists of a slice of documents are flattened with their parent indices; token
lengths are looked up and summed up within each document to byte ends; an Acero hash join on (document, end) finds where
tokens of both sides end together, which cuts the document into groups; ``Table.group_by`` counts in how many of its documents
each pair of ids is linked. Spark adds up those partial counts and hands them back to the pieces that asked.

A *piece* is a run of documents with up to ``PIECE`` bytes of text (one document, if that is longer) that one task reads
together. Its pairs are numbered, so a document keeps one small number per link, and counts are asked for and answered once
per piece and pair, not once per link. A pair of ids that every document holds is counted inside pieces first, and the
join that answers has one row per piece for it, so it can be split. Nothing about pairs is gathered or broadcast as a whole.

Defined cases: texts that are null, empty, or whose joined token bytes differ from a space and the text, have no tokens and
zeros; repeated rows are documents of their own; very long texts are taken whole; an empty table gives an empty result; ties for the
highest count all count as best; columns other than the id and the text are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelspark.llm.bpe import byte_symbols
from channelspark.session import work_path

#: The first vocabulary as ranks, four times as fast to read with as the same one in ``byte_bpe_50k.json``; tests hold the ids equal.
BYTE_RANKS, BYTE_BPE, PIECE_BPE = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: White space in the sense of any of the tokenizers (fixed values).
SPACES = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: Single spaces cut a text into words if no word starts with white space or is empty.
UNCUT = f"(^| )([{SPACES}]|$)"
WORDS = 2_000
#: Bytes of text that are tokenised together, and that share one list of pairs.
SLICE, PIECE = 1 << 20, 1 << 23
WORD_START = "▁"
COLUMNS = [
    *[(name, pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")], ("groups", pa.string()), ("link", pa.list_(pa.int32())),
    ("number", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("docs", pa.int64()),
]


class Side:
    """A tokenizer and the bytes of its tokens."""

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def __init__(self, pieces: list[bytes]):
        self.pieces = pa.array(pieces, pa.large_binary())
        self.lengths = pa.array([len(p) for p in pieces], pa.int64())

    def encode_words(self, words: pa.LargeStringArray) -> pa.LargeListArray:
        """Ids of words as they stand after a space: they are read as one text of ``WORDS`` and cut where the words end."""
        starts = np.append(np.arange(0, len(words), WORDS), len(words))
        texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts), words).cast(pa.list_(pa.large_string())), pa.scalar(" ", pa.large_string()))
        ids = pa.array(np.concatenate([np.zeros(0, np.int64), *self.encode(texts.to_pylist())]), pa.int64())
        ends = np.cumsum(pc.binary_length(words).to_numpy() + 1)  # each has its space before it
        cuts = np.searchsorted(np.cumsum(self.lengths.take(ids).to_numpy()), ends)
        if len(cuts) and cuts[-1] >= len(ids):  # a side that spells some text differently: word by word
            return list_array(self.encode(words.to_pylist()))
        return pa.LargeListArray.from_arrays(pa.array(np.append(0, cuts + 1)), ids)


class ByteLevel(Side):
    """A byte-level vocabulary of the tokenizers library; reads a space and the text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        values = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
        pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            pieces[i] = b"".join(values.get(c, c.encode()) for c in token)
        super().__init__(pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Ranks(Side):
    """A byte-level vocabulary as ranks; reads a space and the text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            pieces[i] = token
        super().__init__(pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class PieceLevel(Side):
    """A sentencepiece model with byte fallback; adds the leading space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        one = self.model
        super().__init__([
            bytes([int(one.id_to_piece(i)[3:5], 16)]) if one.is_byte(i) else one.id_to_piece(i).replace(WORD_START, " ").encode()
            for i in range(one.get_piece_size())
        ])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def sides(a: str, b: str) -> tuple[Side, Side]:
    """Both tokenizers, by the kind of their files, once per Python worker."""
    kinds = {"json": ByteLevel, "tiktoken": Ranks, "model": PieceLevel}
    return tuple(kinds[name.rsplit(".", 1)[1]](public_tokenizers.path(name)) for name in (a, b))


class Tokens:
    """All tokens of one side in a slice: flat ids, the document of each, and byte ends within the document."""

    def __init__(self, side: Side, lists: pa.ListArray):
        self.ids = pc.list_flatten(lists)
        self.doc = pc.list_parent_indices(lists)
        total = pc.cumulative_sum(side.lengths.take(self.ids))
        offsets = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        upto = np.append(0, total.to_numpy())[offsets]  # bytes before each document
        self.offsets, self.bytes = offsets, np.diff(upto)
        self.end = pc.subtract(total, pa.array(upto[:-1]).take(self.doc))

    def keys(self) -> pa.Table:
        return pa.table({"doc": self.doc, "end": self.end, "at": pa.array(np.arange(len(self.ids)))})


def list_array(lists: list[list[int]]) -> pa.LargeListArray:
    return pa.array(lists, pa.large_list(pa.int64()))


def tokens_of(texts: pa.Array, a: Side, b: Side) -> tuple[Tokens, Tokens]:
    """Tokens of both sides; documents that one of them does not spell exactly have none.

    Neither vocabulary has a token that goes on after a space, so texts are cut at single spaces, and each different
    word is encoded once. Texts with other runs of white space are encoded whole.
    """
    known = pc.fill_null(texts.cast(pa.large_string()), "")
    whole = pc.match_substring_regex(known, UNCUT)
    cut = pc.split_pattern(known.filter(pc.invert(whole)), " ")
    words = pc.list_flatten(cut).dictionary_encode()
    counts = np.zeros(len(known), np.int64)
    counts[~whole.to_numpy(zero_copy_only=False)] = pc.list_value_length(cut).to_numpy()
    rest = known.filter(whole).to_pylist()
    want = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), known, pa.scalar(" ", pa.large_string())).cast(pa.large_binary())
    right = pc.greater(pc.binary_length(known), 0)
    both = []
    for side in (a, b):
        by_word = side.encode_words(words.dictionary).take(words.indices)
        lists = regrouped(by_word, counts)
        if rest:
            lists = merged_lists(lists, list_array(side.encode(rest)), whole)
        right = pc.and_(right, pc.equal(spelled(side, lists), want))
        both.append(lists)
    if not pc.all(right).as_py():
        none = list_array([[]] * pc.sum(pc.invert(right)).as_py())
        both = [merged_lists(lists, none, pc.invert(right)) for lists in both]
    return tuple(Tokens(side, lists) for side, lists in zip((a, b), both))


def regrouped(lists: pa.LargeListArray, counts: np.ndarray) -> pa.LargeListArray:
    """Join each run of ``counts[i]`` lists to one list."""
    offsets = lists.offsets.to_numpy()[np.append(0, np.cumsum(counts))]
    return pa.LargeListArray.from_arrays(pa.array(offsets), lists.values)


def merged_lists(lists: pa.LargeListArray, others: pa.LargeListArray, other: pa.Array) -> pa.LargeListArray:
    """``lists`` with those where ``other`` holds taken, in order, from ``others``."""
    mask = other.to_numpy(zero_copy_only=False)
    places = np.arange(len(lists))
    places[mask] = len(lists) + np.arange(len(others))
    return pa.concat_arrays([lists, others]).take(pa.array(places))


def spelled(side: Side, lists: pa.LargeListArray) -> pa.Array:
    offsets = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
    pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), side.pieces.take(pc.list_flatten(lists)))
    return pc.binary_join(pieces, pa.scalar(b"", pa.large_binary()))


class Aligned:
    """Groups and links of a slice."""

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        both = a.keys().join(b.keys(), ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False)
        self.cut_a, self.cut_b = np.sort(both["at"].to_numpy()), np.sort(both["at_b"].to_numpy())
        n = len(a.offsets) - 1
        per_doc = both.group_by("doc", use_threads=False).aggregate([("end", "count")])
        self.groups = np.zeros(n, np.int64)
        self.groups[per_doc["doc"].to_numpy()] = per_doc["end_count"].to_numpy()
        # A link per stretch between neighbouring ends of either side: documents follow each other in one line of bytes.
        ends_a, ends_b = (np.cumsum(np.append(0, t.bytes))[:-1][t.doc.to_numpy()] + t.end.to_numpy() for t in (a, b))
        ends = np.sort(np.concatenate([ends_a, np.delete(ends_b, self.cut_b)]), kind="stable")
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        self.link_doc = a.doc.to_numpy()[at_a]
        self.pairs = a.ids.to_numpy()[at_a] << 32 | b.ids.to_numpy()[at_b]

    def counted(self) -> pa.Table:
        """In how many documents of the slice each pair is linked."""
        links = pa.table({"doc": self.link_doc, "pair": self.pairs})
        once = links.group_by(["doc", "pair"], use_threads=False).aggregate([])
        return once.group_by("pair", use_threads=False).aggregate([("doc", "count")])

    def texts(self) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` for every document."""
        halves = []
        for tokens, cuts in ((self.a, self.cut_a), (self.b, self.cut_b)):
            groups = pa.ListArray.from_arrays(pa.array(np.append(0, cuts + 1), pa.int32()), tokens.ids.cast(pa.string()))
            halves.append(pc.binary_join(groups, ","))
        starts = pa.array(np.append(0, np.cumsum(self.groups)), pa.int32())
        both = pc.binary_join_element_wise(*halves, "|")
        return pc.binary_join(pa.ListArray.from_arrays(starts, both), ";")


class Piece:
    """Documents of one piece: their columns, and their links as numbers of the piece's pairs."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.columns: list[dict[str, list]] = []
        self.links: list[np.ndarray] = []
        self.counts: list[pa.Table] = []

    def add(self, ids: pa.Array, texts: pa.Array, size: int, tokenizers: tuple[str, str], groups: str) -> None:
        aligned = Aligned(*tokens_of(texts, *sides(*tokenizers)))
        written = aligned.texts()
        if groups == "sha256":
            written = pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in written.to_pylist()], pa.string())
        links = np.bincount(aligned.link_doc, minlength=len(texts))
        self.columns.append({
            "id": ids, "n_a": np.diff(aligned.a.offsets), "n_b": np.diff(aligned.b.offsets), "n_groups": aligned.groups,
            "n_links": links, "groups": written,
        })
        self.links.append(aligned.pairs)
        self.counts.append(aligned.counted())
        self.bytes += size

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Document rows, then a row for every pair."""
        coded = pa.array(np.concatenate(self.links)).dictionary_encode()
        pairs, numbers = coded.dictionary.to_numpy(), coded.indices
        first = 0
        for c in self.columns:
            offsets = np.append(0, np.cumsum(c["n_links"]))
            links = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), numbers.slice(first, offsets[-1]))
            first += offsets[-1]
            yield self._batch(len(c["id"]), schema, c | {"link": links})
        total = pa.concat_tables(self.counts).group_by("pair", use_threads=False).aggregate([("doc_count", "sum")])
        docs = np.zeros(len(pairs), np.int64)
        docs[pc.index_in(total["pair"], coded.dictionary).to_numpy()] = total["doc_count_sum"].to_numpy()
        yield self._batch(len(pairs), schema, {
            "number": np.arange(len(pairs)), "a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "docs": docs,
        })

    def _batch(self, n: int, schema: pa.Schema, have: dict) -> pa.RecordBatch:
        have["piece"] = np.full(n, self.number)
        return pa.RecordBatch.from_arrays([
            pa.nulls(n, f.type) if f.name not in have else pa.array(have[f.name]).cast(f.type) for f in schema
        ], schema=schema)


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizers: tuple[str, str], groups: str) -> DataFrame:
    """Rows of documents (``id`` to ``link``) and of pairs (``number, a, b, docs``), each with its ``piece``."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        piece, schema = Piece(number), None
        for batch in batches:
            schema = schema or pa.schema([("piece", pa.int64()), batch.schema.field("id"), *COLUMNS])
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + SLICE, "right")))
                part = batch.slice(at, end - at)
                piece.add(part.column("id"), part.column("text"), int(sizes[end - 1] - before), tokenizers, groups)
                at = end
                if piece.bytes >= PIECE:
                    yield from piece.batches(schema)
                    number += 1
                    piece = Piece(number)
        if piece.columns:
            yield from piece.batches(schema)

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(
        run, f"piece bigint, id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, link array<int>, "
        "number int, a bigint, b bigint, docs bigint")


def pair_counts(asked: DataFrame) -> DataFrame:
    """``a, b, count, best``: documents that link the pair, and whether none of the pairs of ``a`` has more."""
    counts = asked.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # at most one row per token of the first vocabulary
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def answered(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Documents with ``n_best`` and ``count_sum``; a task holds the counts of one piece at a time."""
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts, best = None, np.zeros(0, np.int64), np.zeros(0, bool)
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            piece = batch.column("piece").to_numpy()
            for start, end in zip(cuts := np.append(0, np.flatnonzero(np.diff(piece)) + 1), [*cuts[1:], len(piece)]):
                part = batch.slice(int(start), int(end - start))
                if piece[start] != current:
                    current, parts = piece[start], []
                asks = pc.is_valid(part.column("number"))
                if pc.any(asks).as_py():
                    parts.append(part.filter(asks).select(["count", "best"]))
                docs = part.filter(pc.invert(asks))
                if docs.num_rows:
                    if parts:
                        table, parts = pa.Table.from_batches(parts), []
                        counts, best = (table[c].to_numpy() for c in ("count", "best"))
                    links = docs.column("link")
                    flat, doc = pc.list_flatten(links).to_numpy(), pc.list_parent_indices(links).to_numpy()
                    sums = [np.bincount(doc, minlength=docs.num_rows, weights=best[flat]).astype(np.int64), np.zeros(docs.num_rows, np.int64)]
                    np.add.at(sums[1], doc, counts[flat])
                    yield pa.RecordBatch.from_arrays([*[docs.column(c) for c in names], *map(pa.array, sums)], names=[*names, "n_best", "count_sum"])

    none = {c: F.lit(None) for c in ("number", "count", "best")}
    asked = answers.select("piece", "number", "count", "best", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in [*names, "link"]])
    both = asked.unionByName(rows.select("piece", *names, "link").withColumns(none))
    return both.repartition("piece").sortWithinPartitions("piece", F.asc_nulls_last("number")).mapInArrow(
        run, f"id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, n_best bigint, count_sum bigint")


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] = (BYTE_RANKS, PIECE_BPE), groups: str = "text",
) -> DataFrame:
    """One row per document: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    ``groups`` is ``text`` for the groups' ids in full, or ``sha256`` for their digest (the text is about
    three times as long as the document's, so the digest is taken where it is made).
    """
    spark = docs.sparkSession
    made = pieces(docs, id_col, text_col, tokenizers, groups)
    path = work_path(spark, "aligned")
    made.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(made.schema).parquet(path)
    asked = rows.where("number IS NOT NULL").select("piece", "number", "a", "b", "docs")
    answers = asked.join(pair_counts(asked), ["a", "b"]).select("piece", "number", "count", "best")
    return answered(rows.where("number IS NULL"), answers)
