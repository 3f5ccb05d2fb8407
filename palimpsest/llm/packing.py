"""Packing token sequences by minimum bin slack.

Documents become token ids plus an end id. Full windows are cut off long documents;
the remainders wait in a pool. For each window, the longest remainder is set and a
bitset dynamic program over the pool's lengths (with their counts) finds the
multiset whose sum comes closest to what is left; backtracking tells how many of each
length it takes. A slack that remains is filled by cutting one more remainder. At the end of
a partition less than a window is left; it is cut into sequences whose lengths are powers
of two, which need no padding. So only a partition's pool is ever in memory, and it holds
less than ``pool_tokens`` plus one document.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, read, short_batches, WORKER_CACHES

CAPACITY, END_ID = 4096, 2
HELD_IDS = 1 << 18  # ids of finished sequences that a worker holds before it gives them on
#: Texts with these are encoded directly: special tokens, a letter whose lower case depends on its place, rare spaces.
_DIRECT = ("<|startoftext|>", "<|endoftext|>", "Σ", "İ", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")
LONG_CHUNK = 1000  # characters; longer chunks without white space are not cached


class WordTokenizer(dict):
    """Ids of the word-end BPE vocabulary, with a bounded cache of the ids of chunks between white space.

    The vocabulary lower-cases, drops white space and cuts texts into runs of letters, single
    digits and runs of marks before it merges, and each such piece ends with an end-of-word id. So a text's
    ids are those of the chunks between white space one after the other, and theirs those of their pieces. Most
    chunks repeat. A new one goes through the same merges in a faster implementation: pieces hold no space, so a space stands
    for the end of a word there. That one merges any two neighbours whose joined bytes are a token, this vocabulary only listed pairs;
    as each token comes out of the merges of its own bytes, both give the same ids.
    """

    def __init__(self, path: str, keep: int = 400_000) -> None:
        super().__init__()
        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok, self.keep = Tokenizer.from_file(path), keep
        # the byte that each letter of the vocabulary's spelling stands for
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        assert set(letters) == set(ByteLevel.alphabet())
        special = set(self.tok.get_added_tokens_decoder())
        ranks = {}
        for word, i in self.tok.get_vocab().items():
            if i not in special:
                ranks[bytes(letters[c] for c in word.removesuffix("</w>")) + b" " * word.endswith("</w>")] = i
        self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.ascii_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall

    def __missing__(self, chunk: str) -> bytes:
        """Ids of a chunk that is not in the cache, as little-endian unsigned 32-bit numbers."""
        if len(chunk) > LONG_CHUNK:
            return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if not chunk.isalpha():
            chunks = " ".join(self.ascii_pieces(chunk) if chunk.isascii() else self.pieces(chunk))
        else:
            chunks = chunk
        ids = array("I", self.fast(chunks + " ")).tobytes()
        if len(self) >= self.keep:
            self.clear()
        self[chunk] = ids
        return ids

    def ids_of(self, text: str) -> np.ndarray:
        if any(x in text for x in _DIRECT):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")
        chunks = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()
        return np.frombuffer(b"".join(map(self.__getitem__, chunks)), "<u4")


_tokenizers: dict[str, WordTokenizer] = {}
WORKER_CACHES.append(_tokenizers)


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that the sum is the largest one not above ``room``.

    ``reach`` has bit s where sum s can be had; counts are split in powers of two, so
    a length with count c takes log2(c) steps. It ends as soon as ``room`` itself is reached.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left, k = min(counts[size], room // size), 1
        while left > 0 and not reach >> room & 1:
            k = min(k, left)
            steps.append((size, k, reach))
            reach |= reach << size * k & mask
            left, k = left - k, k * 2
        if reach >> room & 1:
            break
    total, take = reach.bit_length() - 1, defaultdict(int)
    for size, k, before in reversed(steps):
        if not before >> total & 1:
            take[size] += k
            total -= size * k
    return dict(take)


Piece = tuple[int, int, np.ndarray, int]  # document, start, ids, the document's tokens


class Packer:
    """Packs a stream of documents; ``add`` and ``finish`` return (pieces of a sequence) lists."""

    def __init__(self, capacity: int = CAPACITY, pool_tokens: int = 1 << 20) -> None:
        self.capacity, self.limit = capacity, max(pool_tokens, 2 * capacity)
        self.pool: dict[int, list[Piece]] = {}
        self.held = 0

    def _put(self, piece: Piece) -> None:
        if n := len(piece[2]):
            self.pool.setdefault(n, []).append(piece)
            self.held += n

    def _take(self, size: int) -> Piece:
        pieces = self.pool[size]
        piece = pieces.pop()
        if not pieces:
            del self.pool[size]
        self.held -= size
        return piece

    def _cut(self, piece: Piece, n: int) -> Piece:
        doc, start, ids, total = piece
        self._put((doc, start + n, ids[n:], total))
        return doc, start, ids[:n], total

    def add(self, doc: int, ids: np.ndarray) -> list[list[Piece]]:
        whole = len(ids) // self.capacity * self.capacity
        out = [[(doc, at, ids[at : at + self.capacity], len(ids))] for at in range(0, whole, self.capacity)]
        self._put((doc, whole, ids[whole:].copy() if whole else ids, len(ids)))
        return out + (self._drain(self.limit // 2) if self.held >= self.limit else [])

    def _drain(self, keep: int) -> list[list[Piece]]:
        out = []
        while self.held >= max(keep, self.capacity):
            longest = max(self.pool)
            got = [self._take(longest)]
            room = self.capacity - longest
            for size, n in best_fill({s: len(p) for s, p in self.pool.items()}, room).items():
                got += [self._take(size) for _ in range(n)]
                room -= size * n
            if room:  # every remainder left is longer than the slack
                got.append(self._cut(self._take(min(self.pool)), room))
            out.append(got)
        return out

    def finish(self) -> list[list[Piece]]:
        out = self._drain(0)
        while self.held:
            room, got = 1 << self.held.bit_length() - 1, []
            while room:
                size = max(self.pool)
                piece = self._take(size)
                got.append(piece if size <= room else self._cut(piece, room))
                room -= len(got[-1][2])
            out.append(got)
        return out


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, pool_tokens: int = 1 << 20) -> DataFrame:
    """Pieces of packed sequences: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` holds little-endian unsigned 32-bit ids. Each id of each document lies in exactly one piece; every sequence is full,
    or a power of two long. ``capacity`` must be a power of two or at least not below any power left over. Documents are packed with
    those of their own partition, so nothing is shuffled; ``sequence_id`` is the partition's number times 2**32 plus a running number.

    A null or empty text is the end id alone; a null ``doc_id`` stays null; repeated rows are packed each; an empty table gives no rows.
    """

    def packed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        tok, packer = tokenizer(tokenizer_path), Packer(capacity, pool_tokens)
        number = TaskContext.get().partitionId() << 32
        end = np.array([end_id], "<u4")

        def rows(sequences: list[list[Piece]]) -> Iterator[tuple]:
            nonlocal number
            for pieces in sequences:
                at = 0
                for doc, start, ids, total in pieces:
                    yield doc, start, len(ids), total, number, at, ids.tobytes()
                    at += len(ids)
                number += 1

        def frame(got: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(got, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            return out.astype({"doc_id": "Int64"})

        for batch in batches:
            got, size = [], 0
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.concatenate([tok.ids_of(text or ""), end])
                got += rows(packer.add(None if pd.isna(doc) else int(doc), ids))
                size += len(ids)
                if size > HELD_IDS:
                    if got:
                        yield frame(got)
                    got, size = [], 0
            if got:
                yield frame(got)
        if got := list(rows(packer.finish())):
            yield frame(got)

    return short_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(packed, SCHEMA)


def packed_digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(read(spark, sf_dir, "documents"))
