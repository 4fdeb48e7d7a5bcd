"""The word-level BPE vocabulary: cutting texts into pieces, and exact merging in ragged arrays."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import regex

#: Fixed values of the vocabulary file: its pre-token pattern, and white space of str.split() that the pattern takes as text.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CONTROL_SPACE = "\x1c\x1d\x1e\x1f"
MARKS = ".,;:!?)|\""

NO_RANK = np.int32(2**31 - 1)


def _byte_alphabet() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes, as byte-level vocabularies write them."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + len(names) - len(kept))
    return names


class Vocabulary:
    """Vocabulary, merge ranks and special strings of a word-level BPE file."""

    def __init__(self, raw: bytes):
        data = json.loads(raw)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.ids, **self.special}.items()}
        self._special = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        end = model["end_of_word_suffix"]
        names = _byte_alphabet()
        self.inner = np.array([self.ids[names[b]] for b in range(256)], np.int32)
        self.final = np.array([self.ids[names[b] + end] for b in range(256)], np.int32)
        self.width = np.int64(max(self.tokens) + 1)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        keys = np.array([self.ids[a] * int(self.width) + self.ids[b] for a, b in pairs], np.int64)
        self.merged = np.array([self.ids[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def parts(self, text: str) -> list[str]:
        """``text`` cut at special strings, which stay as parts of their own (odd positions)."""
        if self._special is None or "<|" not in text:
            return [text]
        return self._special.split(text)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; NO_RANK if the pair is not merged."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all pieces, and how many each has.

        All pieces lie behind each other in one array. In each round every piece
        merges all occurrences of its own lowest-ranked pair at once; pieces
        without a pair left are done. This equals merging one pair at a time,
        because a symbol takes part in merges only after the one that makes it.
        """
        sizes = np.array([len(p) for p in pieces], np.int64)
        counts = np.zeros(len(pieces), np.int64)
        if not sizes.sum():
            return np.zeros(0, np.int32), counts
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[raw]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        last = np.cumsum(sizes)[sizes > 0] - 1
        symbols[last] = self.final[raw[last]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = np.full(len(symbols), NO_RANK, np.int32)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
            lowest = np.minimum.reduceat(rank, start)
            length = np.diff(np.r_[start, len(symbols)])
            low = np.repeat(lowest, length)
            open_ = low != NO_RANK
            if not open_.all():
                done.append((owner[~open_], symbols[~open_]))
                owner, symbols, rank, low = owner[open_], symbols[open_], rank[open_], low[open_]
                if not len(symbols):
                    break
            hit = rank == low
            if (hit[1:] & hit[:-1]).any():  # aaa: of overlapping pairs every second one counts
                place = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
                hit &= (place - begin) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            owner, symbols = owner[keep], symbols[keep]
        owners = np.concatenate([o for o, _ in done])
        order = np.argsort(owners, kind="stable")
        counts += np.bincount(owners, minlength=len(pieces))
        return np.concatenate([s for _, s in done])[order], counts


def chunks(text: str) -> list[str]:
    """White-space separated chunks; no piece of the pattern reaches across white space."""
    if any(c in text for c in CONTROL_SPACE):
        return regex.findall(r"\S+", text)
    return text.split()


def pieces(chunk: str) -> list[bytes]:
    """Pre-tokens of a chunk: composed form, lower case character by character, cut by the pattern."""
    chunk = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")).lower()
    if chunk.isalpha():  # most chunks: letters only, or letters and one mark
        return [chunk.encode()]
    if chunk[-1] in MARKS and chunk[:-1].isalpha():
        return [chunk[:-1].encode(), chunk[-1:].encode()]
    return [p.encode() for p in PIECE.findall(chunk)]


def encode_chunks(vocabulary: Vocabulary, new: Iterable[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Chunks in groups of a bounded size: (chunks, their ids behind each other, where each one's ids begin and end)."""
    batch: list[str] = []
    size = 0
    for chunk in new:
        batch.append(chunk)
        size += len(chunk)
        if size > 1 << 18:
            yield batch, *_encode(vocabulary, batch)
            batch, size = [], 0
    if batch:
        yield batch, *_encode(vocabulary, batch)


def _encode(vocabulary: Vocabulary, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    cut = [pieces(c) for c in batch]
    symbols, counts = vocabulary.merge([p for ps in cut for p in ps])
    total = np.r_[0, np.cumsum(counts)]
    return symbols, total[np.r_[0, np.cumsum([len(ps) for ps in cut])]]
