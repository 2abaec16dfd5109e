"""Encoding of whole texts with a public byte-level BPE vocabulary by corpus-level merge replay."""

from __future__ import annotations

import heapq
import json
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Where the vocabulary files of the public tokenizers lie; a parameter of every operator here.
TOKENIZERS = os.environ.get("KINLOOM_TOKENIZERS", "/opt/tokenizers")
#: The split pattern published with the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker remembers between blocks, and the characters of text replayed as one block.
REMEMBERED, BLOCK_CHARS = 400_000, 4_000_000


@lru_cache(maxsize=1)
def _byte_names() -> list[str]:
    """The printable stand-in of each byte in the published vocabulary: printable Latin-1 stands for itself, the rest follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeReplay:
    """Ids of distinct words by replaying all merges, in rank order, over an inverted index from token pair to positions."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        self.bytes = [vocab[name] for name in _byte_names()]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of every word. All words are laid out in one array; a merge visits only the places where its pair stands."""
        tokens: list[int] = []
        starts: list[int] = []
        to_id = self.bytes
        for w in words:
            starts.append(len(tokens))
            tokens += [to_id[b] for b in w.encode("utf-8")]
            tokens.append(-1)  # a wall between words: it is in no pair that has a rank
        n = len(tokens)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        index: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, pair in enumerate(zip(tokens, tokens[1:])):
            if pair in rank:
                index[pair].append(i)
        queue = [(*rank[pair], pair) for pair in index]
        heapq.heapify(queue)
        while queue:
            _, merged, pair = heapq.heappop(queue)
            a, b = pair
            places = index.pop(pair, ())
            for i in sorted(places):
                if tokens[i] != a:
                    continue  # merged away by an earlier place, or by the place to its left
                j = following[i]
                if j >= n or tokens[j] != b:
                    continue
                tokens[i] = merged
                tokens[j] = -2
                k = following[j]
                following[i] = k
                if k < n:
                    previous[k] = i
                    right = (merged, tokens[k])
                    if right in rank:
                        if right not in index:
                            heapq.heappush(queue, (*rank[right], right))
                        index[right].append(i)
                h = previous[i]
                if h >= 0:
                    left = (tokens[h], merged)
                    if left in rank:
                        if left not in index:
                            heapq.heappush(queue, (*rank[left], left))
                        index[left].append(h)
        starts.append(n)
        return [[t for t in tokens[a : b - 1] if t >= 0] for a, b in zip(starts, starts[1:])]


class _Encoder:
    """Pre-splits texts and remembers the ids of words seen before; unknown words of a block are replayed together."""

    def __init__(self, path: str) -> None:
        import regex

        self.replay = MergeReplay(path)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def block(self, texts: list[str | None]) -> list[list[str]]:
        pieces = [self.split(t) if t else [] for t in texts]
        new = set(chain.from_iterable(pieces)).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set(chain.from_iterable(pieces))
        if new:
            fresh = list(new)
            self.known.update(zip(fresh, self.replay.encode(fresh)))
        return pieces


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about BLOCK_CHARS characters, so that a batch of very long texts stays bounded in memory."""
    start, texts, size = 0, [], 0
    for i, value in enumerate(column):
        t = value.as_py()
        texts.append(t)
        size += len(t or "")
        if size >= BLOCK_CHARS:
            yield start, texts
            start, texts, size = i + 1, [], 0
    if texts:
        yield start, texts


def _ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    for batch in batches:
        for start, texts in _blocks(batch.column(1)):
            known = encoder.known
            rows = [list(chain.from_iterable(map(encoder.known.__getitem__, words))) for words in encoder.block(texts)]
            offsets = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(offsets[-1]))
            del known
            yield pa.record_batch([batch.column(0).slice(start, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])


def _counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    sizes: dict[str, int] = {}
    for batch in batches:
        for start, texts in _blocks(batch.column(1)):
            pieces = encoder.block(texts)
            known = encoder.known
            for word in set(chain.from_iterable(pieces)).difference(sizes):
                sizes[word] = len(known[word])
            if len(sizes) > 2 * REMEMBERED:
                sizes = {w: len(ids) for w, ids in known.items()}
            counts = [sum(map(sizes.__getitem__, words)) for words in pieces]
            yield pa.record_batch([batch.column(0).slice(start, len(texts)), pa.array(counts, type=pa.int64())], names=["key", "n_tokens"])


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.json"


def encode_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every text, without special tokens.

    Empty and null texts give an empty list; every row gives one row, repeated ids included; texts of any length are
    encoded whole; strings that look like special tokens are ordinary text. An empty table gives an empty result.

    Texts are split into words and only distinct words are encoded: the words of a block that the task has not met yet
    are laid out as one small corpus over which every merge is replayed in rank order through an inverted index from
    token pair to positions, touching only the neighbours of a merge. The encoding of a word depends on nothing but the
    word, so blocks need no exchange: the plan is one scan without a shuffle.
    """
    path = path or vocabulary_path()
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(lambda batches: _ids(batches, path), f"doc_id {kind}, ids array<int>")
    return out.withColumnRenamed("doc_id", doc_id)


def count_tokens(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens) for every row, by the same replay; null and empty texts have 0 tokens."""
    path = path or vocabulary_path()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(lambda batches: _counts(batches, path), f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)
