"""Encoding with a public byte-level BPE as a monoid: pieces are encoded apart and joined up a tree.

A text is cut into leaves. Where a leaf can end at a place that no match of the splitting pattern crosses (a clean seam),
both sides' tokens are final. Only within a long run of one class of characters, such as a text without spaces, a seam
lies inside a match; there the join encodes a window of tokens about the seam again and lets it grow until the tokens
outside provably stay: a row of tokens is the encoding of its bytes if every two neighbours are that of theirs.

Texts of up to SPREAD characters are reduced by their task. Longer ones become rows of leaves that are encoded by many
tasks; leaves that hang together by inner seams are joined level by level.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.session import stored

#: Where the vocabulary files are, unless a path is given.
TOKENIZERS = os.environ.get("TERRAFOLD_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf within a task; and of one that is a row of its own, as texts above SPREAD are cut.
LEAF, FAR_LEAF, SPREAD = 256, 1 << 20, 1 << 22
#: Tokens on either side of a seam that are encoded again at first.
WINDOW = 8

_LOADED: dict[str, "Encoder"] = {}
_SPLIT = regex.compile(PATTERN)
#: A place that no match crosses: before a space after anything else, or between classes, but for what may be a contraction.
_CLEAN = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=')(?=\p{N})")


@dataclass
class Piece:
    """Tokens of a piece of text; how many belong to its first and its last match, and whether these are one."""

    ids: np.ndarray
    head: int
    tail: int
    single: bool


_ONE_CLASS = regex.compile(r"\p{L}+|\p{N}+|\s+|[^\s\p{L}\p{N}]+")
#: Least reach of the search for a clean place, and how far a leaf that ends within a match ends from its edges.
REACH, MARGIN = 32, 4


def cut(text: str, leaf: int) -> list[tuple[int, bool]]:
    """(end, whether clean) of every leaf of about ``leaf`` characters; the last ends with the text.

    A clean place is sought about a quarter of a leaf around. A stretch without any is of one class of characters, or of
    two (a space or an apostrophe before others), so the leaf ends well within a match at one of a few places in it.
    """
    ends, last = [], 0
    reach = max(leaf // 4, REACH)
    while last + leaf + reach < len(text):
        at = last + leaf
        m = _CLEAN.search(text, max(last + 1, at - reach), at + reach)
        if m:
            last = m.start()
        else:
            last = next(x for x in (at, at + reach // 4, at + reach // 2) if x >= MARGIN and _ONE_CLASS.fullmatch(text, x - MARGIN, x + MARGIN))
        ends.append((last, bool(m)))
    return [*ends, (len(text), True)]


class Encoder:
    """byte_bpe_50k without special tokens: their strings in a text are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        """The token ids of a text by tree reduction; an empty text has none."""
        if len(text) <= leaf:
            return np.array(self.core.encode_ordinary(text), np.int32)
        ends = cut(text, leaf)
        starts = [0, *(e for e, _ in ends)]
        inner = [not clean for _, clean in ends]
        pieces = [self.piece(text[a:b], i and inner[i - 1], inner[i]) for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False))]
        while len(pieces) > 1:
            seams = inner[0 : len(pieces) - 1 : 2]
            joined = [self.join(pieces[2 * i], pieces[2 * i + 1], s) for i, s in enumerate(seams)]
            inner = inner[1::2]
            pieces = [*joined, *pieces[2 * len(joined) :]]
        return pieces[0].ids

    def piece(self, text: str, inner_before: bool, inner_after: bool) -> Piece:
        """A leaf; its first and last matches are measured only at inner seams."""
        ids = np.array(self.core.encode_ordinary(text), np.int32)
        head = tail = 0
        single = False
        if len(ids) and (inner_before or inner_after):
            first = _SPLIT.match(text).end()
            single = first == len(text)
            head = tail = len(ids) if single else self.tokens_in(ids, len(text[:first].encode()))
            if inner_after and not single:
                safe = max((i for i in (text.rfind(" "), text.rfind("\n")) if i > 0 and not text[i - 1].isspace()), default=0)
                last = 0
                for m in _SPLIT.finditer(text, safe):
                    last = m.start()
                tail = self.tokens_in(ids[::-1], len(text[last:].encode()))
        return Piece(ids, head, tail, single)

    def join(self, a: Piece, b: Piece, inner: bool) -> Piece:
        """The piece of both texts. At an inner seam the last match of a and the first of b are one."""
        if not inner:
            return Piece(np.concatenate([a.ids, b.ids]), a.head, b.tail, False)
        k = WINDOW
        while True:
            i, j = min(k, a.tail), min(k, b.head)
            left, right = a.ids[len(a.ids) - i :], b.ids[:j]
            new = np.array(self.core._encode_single_piece(self.text_of(left) + self.text_of(right)), np.int32)
            stays = i == a.tail or self.fits(a.ids[len(a.ids) - i - 1], new[0])
            if stays and (j == b.head or self.fits(new[-1], b.ids[j])):
                break
            k *= 2
        ids = np.concatenate([a.ids[: len(a.ids) - i], new, b.ids[j:]])
        run = a.tail - i + len(new) + b.head - j
        return Piece(ids, run if a.single else a.head, run if b.single else b.tail, a.single and b.single)

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        return self.core._encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]

    def text_of(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, from those of both halves."""
        if len(ids) <= 64:
            return b"".join([self.bytes[i] for i in ids])
        return self.text_of(ids[: len(ids) // 2]) + self.text_of(ids[len(ids) // 2 :])

    def tokens_in(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many of the ids make up exactly n_bytes."""
        n = size = 0
        while size < n_bytes:
            size += len(self.bytes[ids[n]])
            n += 1
        if size != n_bytes:
            raise AssertionError("a match does not end at a token")
        return n

    def decode(self, ids: np.ndarray) -> str:
        return self.text_of(ids).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    """The encoder of a rank file, loaded once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _lists(lists: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)])
    flat = np.concatenate([np.asarray(x, np.int32) for x in lists]) if lists else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode_column(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k", leaf: int = LEAF, spread: int = SPREAD, far_leaf: int = FAR_LEAF) -> DataFrame:
    """(key, ids): the token ids of every text; an empty list for null and empty texts.

    One row out for each row in, repeated keys included; other columns are ignored. Texts of up to ``spread`` characters
    are encoded where they are, without a shuffle; longer ones in leaves of about ``far_leaf``, by many tasks.
    """
    path = os.path.join(tokenizers, f"{name}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([enc.encode(t or "", leaf) for t in b.column(1).to_pylist()])], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, docs[text].cast("string").alias("__text"))
    long = F.coalesce(F.length("__text") > spread, F.lit(False))
    near = rows.where(~long).mapInArrow(run, f"{key} {kind}, ids array<int>")
    if rows.where(long).isEmpty():  # one look at the lengths saves most corpora the rest
        return near
    return near.unionAll(_encoded_apart(rows.where(long), key, path, far_leaf))



def _encoded_apart(rows: DataFrame, key: str, path: str, leaf: int) -> DataFrame:
    """The same for long texts (key, __text): leaves are rows, chains of leaves with inner seams are joined level by level."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ends = cut(text, leaf)
                starts = [0, *(e for e, _ in ends)]
                chain = place = 0
                for i, (end, clean) in enumerate(ends):
                    before = bool(i) and not ends[i - 1][1]
                    chain, place = (chain, place + 1) if before else (i, 0)
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (uid, chain, place, before, not clean, text[starts[i] : end])], ["uid", "chain", "place", "before", "inner", "piece"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for uid, chain, place, before, inner, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = enc.piece(text, before, inner)
                yield pa.RecordBatch.from_arrays([*(pa.array([v]) for v in (uid, chain)), pa.array([place], pa.int32()), pa.array([inner]), _lists([p.ids]), *(pa.array([v], pa.int32()) for v in (p.head, p.tail)), pa.array([p.single])], names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            p = Piece(np.array(held[0]["ids"], np.int32), held[0]["head"], held[0]["tail"], held[0]["single"])
            for r in held[1:]:
                p = enc.join(p, Piece(np.array(r["ids"], np.int32), r["head"], r["tail"], r["single"]), True)
            first, last = held[0], held[-1]
            return pa.RecordBatch.from_arrays([*(pa.array([first[c]]) for c in ("uid", "chain")), pa.array([first["place"] // 2], pa.int32()), pa.array([last["inner"]]), _lists([p.ids]), *(pa.array([v], pa.int32()) for v in (p.head, p.tail)), pa.array([p.single])], names)

        for b in batches:
            for row in b.to_pylist():
                if held and (held[0]["uid"], held[0]["chain"], held[0]["place"] // 2) != (row["uid"], row["chain"], row["place"] // 2):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    schema = "uid long, chain long, place int, inner boolean, ids array<int>, head int, tail int, single boolean"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    # the number of a row has to stay the same for all that follows, so rows are stored with it
    numbered = stored(rows.withColumn("uid", F.monotonically_increasing_id()))
    leaves = stored(numbered.select("uid", "__text").mapInArrow(cut_up, "uid long, chain long, place long, before boolean, inner boolean, piece string"))
    deepest = leaves.agg(F.max("place")).first()[0] or 0
    nodes = leaves.repartition("uid", "chain", "place").mapInArrow(encoded, schema)
    while deepest:
        half: Column = F.floor(F.col("place") / 2)
        nodes = nodes.repartition("uid", "chain", half).sortWithinPartitions("uid", "chain", "place").mapInArrow(joined, schema)
        deepest //= 2
    whole = nodes.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("chain", "ids"))).alias("parts"))  # of one text
    return whole.join(numbered.drop("__text"), "uid").select(key, F.flatten(F.col("parts.ids")).alias("ids"))


def decode_column(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, text): the texts of token ids, bytes being joined up a tree; null and empty lists give empty texts."""
    path = os.path.join(tokenizers, f"{name}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(np.array(x or (), np.int32)) for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"{key} {encoded.schema[key].dataType.simpleString()}, text string")


def token_counts(docs: DataFrame, columns: list[str], text: str = "text", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k", leaf: int = LEAF) -> DataFrame:
    """The given columns and n_tokens, the length of the text's encoding."""
    path = os.path.join(tokenizers, f"{name}.tiktoken")
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns) + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode(t or "", leaf)) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(n, pa.int64())], [*columns, "n_tokens"])

    return docs.select(*columns, docs[text].cast("string").alias("__text")).mapInArrow(run, schema)
