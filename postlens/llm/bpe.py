"""Byte-level BPE encoding and decoding by backtracking over longest matches."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import slices

KNOWN_PIECES = 400_000
KNOWN_PAIRS = 1_000_000
#: Pieces longer than this are not remembered.
LONGEST_KNOWN = 64
#: Characters of a decoded stretch; bounds the memory of its index arrays.
DECODED_AT_ONCE = 1 << 20

# Fixed value: the Unicode property White_Space. Python's own class holds four more characters.
WHITE_SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Bpe:
    """Encodes and decodes with the ranks of a vocabulary, given as token bytes by id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.split = regex.compile(
            pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE_SPACE}\p{{L}}\p{{N}}]")
            .replace(r"\S", f"[^{WHITE_SPACE}]")
            .replace(r"\s", f"[{WHITE_SPACE}]")
        ).findall
        self.blank_begins = pattern == PATTERN
        blank = f"[{WHITE_SPACE}]"
        self.edge_blank = regex.compile(f" {blank}|{blank} |{blank}$|^{blank}").search
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        # the two tokens that a token is merged from, itself twice if it is never merged
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self._learn(token, rank)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self._reached(rank):
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.size_of = {rank: len(token) for rank, token in self.bytes_of.items()}
        # the longest token that a token begins with, besides itself
        self.shorter = {rank: self._prefix(token) for rank, token in self.bytes_of.items()}
        self.sizes = np.zeros(max(self.bytes_of, default=0) + 1, np.int64)
        for rank, token in self.bytes_of.items():
            self.sizes[rank] = len(token)
        self.starts = np.cumsum(self.sizes) - self.sizes
        flat = b"".join(self.bytes_of.get(r, b"") for r in range(len(self.sizes)))
        self.flat = np.frombuffer(flat, np.uint8)

    def _learn(self, token: bytes, rank: int) -> None:
        """How the merges of lower rank leave a token: in two, if it can be reached."""
        self.halves[rank] = (rank, rank)
        if len(token) == 1:
            return
        for at in range(1, len(token)):
            left, right = self.ranks.get(token[:at]), self.ranks.get(token[at:])
            if left is None or right is None or left >= rank or right >= rank:
                continue
            if self._reached(left) and self._reached(right) and self.fits(left, right):
                self.halves[rank] = (left, right)
                self.merged[left, right] = rank
                self.compatible.clear()
                return

    def _prefix(self, token: bytes) -> int:
        found = (self.ranks.get(token[:at]) for at in range(len(token) - 1, 0, -1))
        return next((r for r in found if r is not None and self._reached(r)), -1)

    def _reached(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves[token][0] != token

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side.

        Undo the later merge of the two at their border, step by step: no pair met there may be
        one that would have been merged before the step that is undone.
        """
        known = self.compatible.get((left, right))
        if known is not None:
            return known
        if len(self.compatible) >= KNOWN_PAIRS:
            self.compatible.clear()
        pair, answer, limit = (left, right), True, None
        while True:
            rank = self.merged.get((left, right))
            if rank is not None and (limit is None or rank < limit):
                answer = False
                break
            a = left if self.halves[left][0] != left else -1
            b = right if self.halves[right][0] != right else -1
            if a < 0 and b < 0:
                break
            # of two equal merges the left one is done first, so the right one is undone first
            if a > b:
                limit, left = a, self.halves[left][1]
            else:
                limit, right = b + 1, self.halves[right][0]
        self.compatible[pair] = answer
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of a piece that is no token itself.

        Only one sequence of tokens has none but fitting neighbours, so the greedy one is it if all
        its neighbours fit. Else from each place the longest token that fits the one before
        is taken; where none does, the last step is taken back and the place never tried again.
        """
        known, letters = self.compatible, piece.decode("latin-1")
        greedy = [rank for _, (_, rank) in self.automaton.iter_long(letters)]
        for pair in zip(greedy, greedy[1:], strict=False):
            fits = known.get(pair)
            if not (self.fits(*pair) if fits is None else fits):
                break
        else:
            return greedy
        n = len(piece)
        longest = [0] * n
        for end, (size, rank) in self.automaton.iter(letters):
            longest[end + 1 - size] = rank
        dead, shorter, sizes = bytearray(n + 1), self.shorter, self.size_of
        tokens, places = [], []
        at, last, rank = 0, -1, longest[0]
        while at < n:
            while rank >= 0:
                if not dead[at + sizes[rank]]:
                    if last < 0:
                        break
                    fits = known.get((last, rank))
                    if self.fits(last, rank) if fits is None else fits:
                        break
                rank = shorter[rank]
            if rank >= 0:
                tokens.append(rank)
                places.append(at)
                at, last = at + sizes[rank], rank
                rank = longest[at] if at < n else -1
            else:
                dead[at] = 1
                at, rank = places.pop(), shorter[tokens.pop()]
                last = tokens[-1] if tokens else -1
        return tokens

    def encoded(self, piece: str) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers."""
        raw = piece.encode()
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else self.encode_piece(raw)
        return array("I", ids).tobytes()

    def _pieces(self, text: str) -> bytes:
        known, out = self.pieces, []
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encoded(piece)
                if len(piece) <= LONGEST_KNOWN:
                    if len(known) >= KNOWN_PIECES:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text.

        No piece reaches over a blank that stands alone: it begins the piece of what follows. So
        stretches between such blanks are looked up whole, and pieces are only found
        in new ones. A text with a blank beside other white space is taken whole, and so is
        every text if the pattern is not the one that this holds for.
        """
        words = text.split(" ")
        if not self.blank_begins or not all(words) or self.edge_blank(text):
            return self._pieces(text)
        known, new = self.words.get, self._word
        out = [self._pieces(words[0])]
        out += [known(word) or new(word) for word in words[1:]]
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """Ids of a stretch that follows a blank. Letters alone are one piece."""
        ids = self.words.get(word)
        if ids is None:
            if word.isalpha():
                ids = self.encoded(" " + word)
            elif word[-1] in ".,;:!?" and word[:-1].isalpha():
                ids = self._word(word[:-1]) + self._pieces(word[-1])
            else:
                ids = self._pieces(" " + word)
            if len(word) <= LONGEST_KNOWN:
                if len(self.words) >= KNOWN_PIECES:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids, gathered a stretch at a time from one array of all token bytes."""
        ids, out = np.frombuffer(ids, np.uint32), []
        for at in range(0, len(ids), DECODED_AT_ONCE):
            own = ids[at : at + DECODED_AT_ONCE]
            sizes = self.sizes[own]
            shift = self.starts[own] - (np.cumsum(sizes) - sizes)
            places = np.arange(sizes.sum()) + np.repeat(shift, sizes)
            out.append(self.flat[places].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    """The tokenizer of a rank file, built once in a worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Bpe(ranks, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded``: token ids as little-endian unsigned 32-bit integers, and the
    bytes that they decode to.

    Takes ``doc_id`` and ``text``; a null text is empty and has no ids. Each row stands alone: there
    is no shuffle, and a lost task is one partition. ``path`` names a rank file that
    every executor has; ``pattern`` splits the text before the merges.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for rows in slices(batches):
            ids = [bpe.encode(t or "") for t in rows.column(1).to_pylist()]
            columns = [rows.column(0), pa.array(ids, pa.binary())]
            columns.append(pa.array([bpe.decode(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def with_digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, ids, n_tokens, ids_sha256, decoded_sha256`` of ``encode_documents``."""
    return encoded.select(
        "doc_id",
        "ids",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
