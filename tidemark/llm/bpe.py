"""Byte-level BPE by backtracking over longest matches, and its inverse.

The text is split by the pattern; in each piece the bytes, as Latin-1 characters, run through an
Aho-Corasick automaton of the vocabulary, which gives the longest token at each place. The encoder
takes it if it may follow the token before, else the next shorter one, and steps back where none
may. Two tokens may be neighbours if merging their joined bytes by rank would give just these two; each
pair of tokens is decided once. Each place is reached at most once per start, so the work is linear
and the result equal to merging by rank.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pieces and pairs of tokens that a worker remembers; beyond that it starts anew.
PIECES_KEPT = 500_000
PAIRS_KEPT = 1_000_000

# The pattern of the rank files, and code points that newer versions of Unicode than
# the tokenizer's count as letters or numbers.
STANDARD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEWER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC),
    (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
NEWER_NUMBERS = (
    (0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16FF4, 0x16FF6),
)


def _ranges(pairs: tuple[tuple[int, int], ...]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in pairs)


class Splitter:
    """Finds the pieces of a text.

    Texts of Latin letters only take the standard pattern with its classes written out, which
    the plain ``re`` module matches faster; the pieces are the same.
    """

    def __init__(self, pattern: str):
        letters, numbers = (_ranges(x) for x in (NEWER_LETTERS, NEWER_NUMBERS))
        exact = pattern.replace(
            r"[^\s\p{L}\p{N}]", rf"[^\s[\p{{L}}--[{letters}]][\p{{N}}--[{numbers}]]]"
        )
        exact = exact.replace(r" ?\p{L}+", rf" ?[\p{{L}}--[{letters}]]+")
        exact = exact.replace(r" ?\p{N}+", rf" ?[\p{{N}}--[{numbers}]]+")
        self.any = regex.compile(exact, regex.V1)
        letter, number, space = r"A-Za-zªµºÀ-ÖØ-öø-ɏ", r"0-9²³¹¼-¾", r" \t-\r\x85\xa0"
        self.latin = re.compile(
            rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+"
            rf"|[{space}]+(?![^{space}])|[{space}]+"
        )
        self.beyond = re.compile("[^\x00-ɏ]") if pattern == STANDARD else re.compile("")

    def __call__(self, text: str) -> list[str]:
        return (self.any if self.beyond.search(text) else self.latin).findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


class Encoder:
    """Encodes and decodes texts by the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = Splitter(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.parents, self.merges = self._merges()
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            # A token that merging never makes can only be a whole piece, which is looked up first.
            if len(token) == 1 or rank in self.parents:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    def _merges(self) -> tuple[dict[int, tuple[int, int]], dict[tuple[int, int], int]]:
        """For each token the two it is merged from, and the token that each such pair makes."""
        parents, merges = {}, {}
        for token, rank in self.ranks.items():
            if len(token) < 2:
                continue
            parts = self._merged(token, rank)
            if len(parts) == 2:
                pair = self.ranks[parts[0]], self.ranks[parts[1]]
                parents[rank] = pair
                merges[pair] = rank
        return parents, merges

    def _merged(self, token: bytes, below: int) -> list[bytes]:
        """What merging by rank leaves of ``token`` with only the ranks under ``below``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranked = [(self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens would give these two."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            known = self.fits[left, right] = self._decide(left, right)
        return known

    def _decide(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' last merges, step by step. A merge across the border that
        # ranks below the merge just undone would have come first.
        limit = len(self.tokens) + 1
        while True:
            crossing = self.merges.get((left, right))
            if crossing is not None and crossing < limit:
                return False
            of_left, of_right = self.parents.get(left), self.parents.get(right)
            # Of equal ranks the left one merges first.
            if of_left is not None and (of_right is None or left > right):
                limit, left = left, of_left[1]
            elif of_right is not None:
                limit, right = right + 1, of_right[0]
            else:
                return True

    def _next_shorter(self, rank: int) -> int | None:
        """The longest token that this token starts with."""
        if rank not in self.shorter:
            token = self.tokens[rank]
            found = None
            for size in range(len(token) - 1, 0, -1):
                other = self.ranks.get(token[:size])
                if other is not None and (size == 1 or other in self.parents):
                    found = other
                    break
            self.shorter[rank] = found
        return self.shorter[rank]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        # Matches come by their ends, so the last one noted for a place is the longest.
        longest: list[int | None] = [None] * len(piece)
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = rank
        tokens, fits = self.tokens, self.fits
        out: list[int] = []
        dead = bytearray(len(piece) + 1)  # places from which no valid sequence reaches the end
        at, rank = 0, longest[0]
        while rank is not None:
            end = at + len(tokens[rank])
            if not dead[end]:
                fit = not out or fits.get((out[-1], rank))
                if fit is None:
                    fit = self.may_follow(out[-1], rank)
                if fit:
                    out.append(rank)
                    if end == len(piece):
                        return tuple(out)
                    at, rank = end, longest[end]
                    continue
            rank = self._next_shorter(rank)
            if rank is None:
                dead[at] = 1
                if not out:
                    break
                rank = out.pop()
                at -= len(tokens[rank])
        raise ValueError("the vocabulary lacks a byte of the text")

    def encode(self, text: str) -> list[int]:
        known = self.known
        pieces = self.split(text)
        new = {p for p in pieces if p not in known}
        if len(known) + len(new) > PIECES_KEPT:
            known = self.known = {}
            new = set(pieces)
        for piece in new:
            known[piece] = self.encode_piece(piece.encode())
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(read_ranks(path), pattern)


def encoded(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the ids themselves.

    ``path`` is the vocabulary file, which each executor reads. ids_sha256 is over the decimal ids
    joined by commas, decoded_sha256 over the bytes that the ids decode to. One row for each row; a
    null text counts as empty and has no ids; extra columns are ignored; an empty table gives an empty
    result.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        shown = {rank: str(rank) for rank in own.tokens}
        for batch in source:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                counts, hashes, decoded, kept = [], [], [], []
                for text in piece.column(1).to_pylist():
                    ids = own.encode(text or "")
                    counts.append(len(ids))
                    joined = ",".join(map(shown.__getitem__, ids))
                    hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                columns = [
                    piece.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(hashes, pa.string()),
                    pa.array(decoded, pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        batches, schema
    )


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of each row of (doc_id, ids); ids that are no UTF-8 give replacement signs."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, STANDARD)
        for batch in source:
            texts = [own.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(
        batches, "doc_id bigint, text string"
    )
