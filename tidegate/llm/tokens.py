"""Encoding of the whole corpus with a public tokenizer (problem 8).

The vocabulary is a file of byte-level merge ranks; its path is a parameter and every executor reads
it from there.  A text is cut into words by the vocabulary's pattern; the tokens of a word depend on
nothing else.  The symbols of a word are the leaves of a segment tree over the ranks of adjacent
pairs: the root names the leftmost pair of lowest rank, a merge changes two ranks in logarithmic
time, and the word is done when no pair is left.  Words repeat, so each Python worker keeps the
encodings of the words it has seen in a memory of fixed size; that changes no result.

Defined results
---------------
* null and empty texts give an empty list; a blank text is encoded as it is;
* strings that look like special tokens are ordinary text;
* a text or word of any length is encoded whole, n log n in the length of a word;
* repeated rows give one result each; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

#: The folder with the vocabulary files.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# Fixed value: the vocabulary's pattern, which parts a text into words before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept in a worker's memory, and the longest of them in bytes.
MEMORY_WORDS, MEMORY_BYTES = 200_000, 64
NONE = 1 << 40


class SegmentTree:
    """Minimum of (rank, position) over the pairs of a word's symbols."""

    def __init__(self, ranks: list[int]) -> None:
        n = len(ranks)
        size = 1
        while size < n:
            size *= 2
        self.size = size
        tree = [NONE] * (2 * size)
        tree[size : size + n] = ranks
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
        self.tree = tree

    def lowest(self) -> tuple[int, int]:
        """(rank, position) of the leftmost lowest rank."""
        tree, i = self.tree, 1
        rank = tree[1]
        while i < self.size:
            i *= 2
            if tree[i] != rank:
                i += 1
        return rank, i - self.size

    def put(self, position: int, rank: int) -> None:
        tree, i = self.tree, position + self.size
        tree[i] = rank
        i //= 2
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a <= b else b
            if tree[i] == low:
                break
            tree[i] = low
            i //= 2


class BytePairEncoder:
    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.words = regex.compile(pattern)
        self.memory = _Memory(self.encode_word)

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Merges the leftmost pair of lowest rank until no adjacent pair is a token."""
        ranks = self.ranks
        n = len(word)
        if word in ranks and n == 1:
            return (ranks[word],)
        ends = list(range(1, n + 1))  # of the symbol that starts at each position
        before = list(range(-1, n - 1))
        get = ranks.get
        tree = SegmentTree([get(word[i : i + 2], NONE) for i in range(n - 1)] or [NONE])
        while True:
            rank, at = tree.lowest()
            if rank == NONE:
                break
            gone = ends[at]  # the right symbol is taken up by the left one
            end = ends[gone]
            ends[at] = end
            tree.put(gone, NONE) if gone < n - 1 else None
            if end < n:
                before[end] = at
                tree.put(at, get(word[at : ends[end]], NONE))
            else:
                tree.put(at, NONE)
            if (left := before[at]) >= 0:
                tree.put(left, get(word[left:end], NONE))
        out, at = [], 0
        while at < n:
            out.append(ranks[word[at : ends[at]]])
            at = ends[at]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.memory.__getitem__, self.words.findall(text))))


class _Memory(dict):
    """Encodings of words seen; emptied when full, so that its size stays fixed."""

    def __init__(self, encode_word) -> None:
        super().__init__()
        self.encode_word = encode_word

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = self.encode_word(raw)
        if len(raw) <= MEMORY_BYTES:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = ids
        return ids


def vocabulary(name: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES) -> str:
    return os.path.join(folder, name)


def encode_documents(documents: DataFrame, path: str | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row: one scan, no shuffle."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BytePairEncoder(path)
        for b in batches:
            ids = pa.array((encoder.encode(t) for t in b.column(1).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return documents.selectExpr(f"`{key}` as doc_id", f"`{text}` as text").mapInArrow(run, "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, path: str | None = None, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row."""
    path = path or vocabulary()
    fields = documents.select(*keep).schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BytePairEncoder(path)
        for b in batches:
            n = pa.array((len(encoder.encode(t)) for t in b.column(b.num_columns - 1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    return documents.select(*keep, text).mapInArrow(run, fields)
