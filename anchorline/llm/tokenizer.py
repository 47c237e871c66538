"""Encoding and decoding with a public byte-level BPE vocabulary.

Each piece of a text is covered by longest token matches (found by one Aho-Corasick scan); a match is kept only if it
and the token before it can stand side by side in a BPE result, else shorter matches are tried and, last, the token
before is taken back. A position from which no cover exists is never tried again, so the work is linear in the length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte_bpe_50k splits a text into pieces before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers; longer pieces than LONG are not remembered.
REMEMBER, LONG = 100_000, 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    """A vocabulary whose ids are its merge ranks."""

    def __init__(self, path: str, pattern: str = PIECES):
        with open(path, "rb") as f:
            ranked = sorted((int(b), base64.b64decode(a)) for a, b in (line.split() for line in f if line.strip()))
        if [r for r, _ in ranked] != list(range(len(ranked))):
            raise ValueError("ids must run from 0 without gaps")
        self.tokens = [t for _, t in ranked]
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.lengths = [len(t) for t in self.tokens]
        # Decoding: all tokens in one buffer, token i at offsets[i]:offsets[i + 1].
        self.buffer = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):  # reversed: the longest token ending at a place of the reversed text begins there in the text
            self.automaton.add_word(t[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        self._pairs()
        self.remembered: dict[str, tuple[int, ...]] = {}

    def _pairs(self) -> None:
        """For each token its longest proper prefix that is a token, and the two tokens that its last merge joins."""
        self.shorter: list[int] = [-1] * len(self.tokens)
        self.left = list(range(len(self.tokens)))
        self.right = list(range(len(self.tokens)))
        self.merged: dict[tuple[int, int], int] = {}
        for i, t in enumerate(self.tokens):
            for n in range(len(t) - 1, 0, -1):
                if (p := self.ids.get(t[:n])) is not None:
                    self.shorter[i] = p
                    break
        for i, t in enumerate(self.tokens):
            p = self.shorter[i]
            while p >= 0:
                rest = self.ids.get(t[self.lengths[p] :])
                if rest is not None and p < i and rest < i and self.compatible(p, rest):
                    self.left[i], self.right[i] = p, rest
                    self.merged[p, rest] = i
                    break
                p = self.shorter[p]

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE can leave `a` and `b` side by side.

        Undoing merges from the latest, the parts that touch at the border must never have been mergeable earlier than
        the merge that took one of them away.
        """
        merged, left, right = self.merged, self.left, self.right
        before = len(self.tokens)
        while True:
            joint = merged.get((a, b))
            if joint is not None and joint < before:
                return False
            undo_a = a > b
            for _ in range(2):
                if undo_a and right[a] != a:
                    before, a = a, right[a]
                    break
                if not undo_a and left[b] != b:
                    before, b = b + 1, left[b]
                    break
                before = a if undo_a else b + 1
                undo_a = not undo_a
            else:
                return True

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ids.get(piece)
        if whole is not None and self.left[whole] == whole and len(piece) == 1:
            return (whole,)
        n = len(piece)
        longest = [-1] * n
        for end, token in self.automaton.iter(piece[::-1].decode("latin-1")):
            at = n - 1 - end
            if longest[at] < 0 or self.lengths[token] > self.lengths[longest[at]]:
                longest[at] = token
        lengths, shorter, compatible = self.lengths, self.shorter, self.compatible
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                if open_[at + lengths[token]] and (last < 0 or compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += lengths[token]
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                open_[at] = 0
                token = out.pop()
                at -= lengths[token]
                # The same token again would end at a closed place, so the search goes on with shorter ones.
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; empty and null texts have none."""
        if not text:
            return []
        out: list[int] = []
        known = self.remembered
        for m in self.pattern.finditer(text):
            piece = m.group()
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= LONG:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int] | None) -> str:
        """Text of ids; the inverse of `encode`. Null and empty lists give an empty text; bytes that are no UTF-8 become U+FFFD."""
        if ids is None or len(ids) == 0:
            return ""
        ids = np.asarray(ids, dtype=np.int64)
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.buffer[where].tobytes().decode("utf-8", errors="replace")


@cache
def _bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


@lru_cache(maxsize=1)
def default_path() -> str:
    return vocabulary_path()


def encode(df: DataFrame, text: str, keep: list[str], path: str | None = None, pattern: str = PIECES, count_only: bool = False) -> DataFrame:
    """`keep` columns and `ids` (array<int>) of each row's `text`, or with `count_only` their number `tokens` (bigint).

    Every row is encoded whole; an empty or null text has an empty list. `path` names the vocabulary file, which all workers must see.
    """
    path = path or default_path()
    slim = df.select(*keep, F.col(text).cast("string").alias("_text"))
    kind = "bigint" if count_only else "array<int>"
    schema = slim.drop("_text").withColumn("tokens" if count_only else "ids", F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in batches:
            at = batch.num_columns - 1
            lists = [bpe.encode(t) for t in batch.column(at).to_pylist()]
            sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            if count_only:
                new, name = pa.array(sizes), "tokens"
            else:
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(sizes.sum()))
                new, name = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat)), "ids"
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], new], names=[*batch.schema.names[:at], name])

    return slim.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, keep: list[str], path: str | None = None, pattern: str = PIECES) -> DataFrame:
    """`keep` columns and `text` of each row's `ids`; a null or empty list gives an empty text."""
    path = path or default_path()
    slim = df.select(*keep, F.col(ids).alias("_ids"))
    schema = slim.drop("_ids").withColumn("text", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in batches:
            at = batch.num_columns - 1
            texts = pa.array([bpe.decode(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts], names=[*batch.schema.names[:at], "text"])

    return slim.mapInArrow(run, schema)
