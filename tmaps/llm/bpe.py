"""Byte-level BPE: a backtracking encoder and an offset-table decoder.

Encoder. An Aho-Corasick automaton over the vocabulary gives the longest token that
starts at each place of a word. The encoder takes it, checks it against its left
neighbour in the pair-compatibility table, and falls back to the next shorter prefix
token, or to the place before, where the two could not stand side by side in a merged
word. Places found to be dead ends are never tried again, so the work is linear and
the result is the one that applying the merges in order gives.

Two tokens are compatible when no merge across their border comes before the merges
inside them: the table is filled on demand by undoing the later merge of the two.

Decoder. All token bytes lie in one buffer with an offset table; ids gather their byte
ranges, without a lookup per token.

Words. A text splits before each space that stands before a non-white character: no
token of the pre-tokenizer's pattern reaches over such a place, so a piece encodes the
same wherever it stands. Pieces are kept in a bounded memo (the results do not depend
on what it holds). The strings of special tokens are cut out first.

Defined cases: null and empty texts give no ids and decode to the empty text; repeated
rows give repeated results; null doc_ids stay null; empty tables give no rows; further
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmaps.llm.common import pieces

#: The pre-tokenizer's pattern (a fixed value of the vocabulary file's "ByteLevel" kind).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 250_000
LONG_WORD = 256  # bytes
_OPEN_SPACE = re.compile(r" (?=\s|\Z)")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Tokens and special tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        self.id_of = {bytes(letter[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.read(spec["model"]["merges"], letter)

    def read(self, merges: list, letter: dict[str, int]) -> None:
        """Tokens alone need no merges."""


class Vocabulary(Tokens):
    """Tokens with their merges and the decoder's offset table."""

    def read(self, merges: list, letter: dict[str, int]) -> None:
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        # merges by rank; the token that a merge makes, and the two that it is made of
        self.rank, self.halves, self.made = {}, {}, {}
        for k, m in enumerate(merges):
            left, right = (bytes(letter[c] for c in s) for s in (m.split(" ") if isinstance(m, str) else m))
            pair, token = (self.id_of[left], self.id_of[right]), self.id_of[left + right]
            self.made[pair] = token
            if token not in self.halves:
                self.halves[token], self.rank[token] = pair, k
        ends = np.cumsum([0, *map(len, self.bytes_of)])
        self.offsets = ends.astype(np.int64)
        self.buffer = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``, gathered through the offset table."""
        start = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - start
        to = np.cumsum(size)
        if not len(to):
            return b""
        return self.buffer[np.repeat(start - (to - size), size) + np.arange(to[-1])].tobytes()


class Encoder:
    """Backtracking encoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO) -> None:
        self.v = v = vocabulary
        trie = ahocorasick.Automaton()
        for b, i in v.id_of.items():
            trie.add_word(b.decode("latin-1"), i)
        trie.make_automaton()
        self.match = trie.iter_long  # every byte is a token: the first match starts at the place asked for
        self.size = [len(b) for b in v.bytes_of]
        self.longest = max(self.size, default=1)
        # the next shorter token that starts a token
        self.shorter = [-1] * len(v.bytes_of)
        for b, i in v.id_of.items():
            for n in range(len(b) - 1, 0, -1):
                j = v.id_of.get(b[:n])
                if j is not None:
                    self.shorter[i] = j
                    break
        self.pair_fits: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")").split if v.special else None
        self.words, self.memo = {}, memo
        self.first, self.after = _Memo(self, "", memo), _Memo(self, " ", memo)

    def fits(self, left: int, right: int) -> bool:
        """Can these two stand side by side? Undo the later of their last merges until
        the border is bare; a merge across it that comes before what was undone says no."""
        a, b, undone = left, right, len(self.v.rank) + 1
        rank, halves, made = self.v.rank, self.v.halves, self.v.made
        while True:
            across = made.get((a, b))
            if across is not None and rank[across] < undone:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # a merge on the left of the border wins a tie of ranks (the same pair, met first)
            if ra > rb:
                undone, a = ra, halves[a][1]
            else:
                undone, b = rb + 1, halves[b][0]

    def word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        known = self.v.id_of.get(raw)
        if known is not None:
            return [known]
        text, size, match = raw.decode("latin-1"), self.size, self.match
        out, at, total, shorter, table = [], 0, len(raw), self.shorter, self.pair_fits
        dead = bytearray(total + 1)
        # a long word is matched in slices: a call costs what the text given to it is long
        longest, sliced = self.longest, total > LONG_WORD
        token = next(match(text[:longest] if sliced else text))[1]
        while at < total:
            last = out[-1] if out else -1
            while token >= 0:
                if not dead[at + size[token]]:
                    if last < 0:
                        break
                    fit = table.get((last, token))
                    if fit is None:
                        fit = table[last, token] = self.fits(last, token)
                    if fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                if at >= total:
                    token = -1
                elif sliced:
                    token = next(match(text[at:at + longest]))[1]
                else:
                    token = next(match(text, at))[1]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        if len(table) > 4_000_000:
            table.clear()
        return out

    def piece(self, text: str) -> bytes:
        """Ids of a piece as little-endian 32-bit integers."""
        words, out = self.words, []
        for w in self.split(text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= self.memo:
                    forget_older(words)
                ids = pack(f"<{len(found := self.word(w.encode()))}I", *found)
                if len(w) < 64:
                    words[w] = ids
            out.append(ids)
        return b"".join(out)

    def ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if _OPEN_SPACE.search(text) is None and text[0] != " ":
            head, *rest = text.split(" ")
            return self.first[head] + b"".join(map(self.after.__getitem__, rest))
        # spaces before white space stay with the piece before them
        out, at, n = [], 0, len(text)
        for m in _BEFORE_WORD.finditer(text):
            if m.start():
                out.append(self.piece(text[at:m.start()]))
                at = m.start()
        out.append(self.piece(text[at:n]))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if self.cut is None:
            return self.ordinary(text)
        parts = self.cut(text)
        if len(parts) == 1:
            return self.ordinary(text)
        return b"".join(np.array([self.v.special[p]], dtype="<u4").tobytes() if k % 2 else self.ordinary(p)
                        for k, p in enumerate(parts))


_BEFORE_WORD = re.compile(r" (?=\S)")


def forget_older(memo: dict) -> None:
    """Drops the older half of a table in the order of its entries."""
    kept = list(memo.items())[len(memo) // 2:]
    memo.clear()
    memo.update(kept)


class _Memo(dict):
    """Ids of the pieces that follow ``lead``; forgets the older half when full."""

    def __init__(self, encoder: Encoder, lead: str, limit: int) -> None:
        super().__init__()
        self.encoder, self.lead, self.limit = encoder, lead, limit

    def __missing__(self, part: str) -> bytes:
        ids = self.encoder.piece(self.lead + part)
        if len(self) >= self.limit:
            forget_older(self)
        if len(part) < 64:
            self[part] = ids
        return ids


_READY: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _READY:
        _READY[path] = Encoder(Vocabulary(path))
    return _READY[path]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in pieces(batches, "text"):
            out = ([], [], [])
            for text in b.column("text").to_pylist():
                ids = e.encode(text or "")
                out[0].append(len(ids) // 4)
                out[1].append(hashlib.sha256(ids).hexdigest())
                out[2].append(hashlib.sha256(e.v.decode(np.frombuffer(ids, dtype="<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of every text, and the text that they decode to."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in pieces(batches, "text"):
            ids = [np.frombuffer(e.encode(t or ""), dtype="<u4") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                 pa.array([e.v.decode(x).decode("utf-8", "replace") for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        kernel, "doc_id long, ids array<int>, decoded string")
