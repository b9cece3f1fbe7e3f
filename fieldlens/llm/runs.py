"""Runs of bytes in many texts at once: where words begin and end, and which are equal.

A word is a longest run of bytes of a class within one text; classes hold or leave out all bytes beyond ASCII together, so that words are whole in
UTF-8.  Null is an empty text, and texts without words have none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: What stands between words by ``[^\x20\x09-\x0D]+``.
SPACES = bytes([32, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def all_but(chars: bytes) -> np.ndarray:
    """The class of all bytes but these."""
    out = np.ones(256, bool)
    out[list(chars)] = False
    return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, joined, and where each begins and the last ends."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None and data.size else np.zeros(0, np.uint8)), cuts - cuts[0]


def code_points(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (data & 0xC0) != 0x80


@dataclass
class Words:
    """Words of texts: ``data`` has all bytes, text ``i`` those from ``cuts[i]``, its words have the numbers from ``bounds[i]``."""

    data: np.ndarray
    cuts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    inside: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @cached_property
    def coded(self) -> pa.DictionaryArray:
        offsets = np.append(0, np.cumsum(self.ends - self.starts)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[self.inside])]).dictionary_encode()

    @property
    def codes(self) -> np.ndarray:
        """A number for each word; equal words have equal ones."""
        return self.coded.indices.to_numpy().astype(np.int64)

    @property
    def different(self) -> list[bytes]:
        """The word that each number stands for."""
        return self.coded.dictionary.to_pylist()

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    @cached_property
    def hashes(self) -> np.ndarray:
        """64 bits for each different word."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.different), np.uint64, len(self.coded.dictionary))


def words(texts: pa.Array, kind: np.ndarray, lower: bool = True) -> Words:
    """The longest runs of bytes of a class, A to Z in lower case if asked for."""
    data, cuts = bytes_of(texts)
    if lower:
        data = LOWER[data]
    inside = kind[data]
    begins = cuts[:-1][cuts[:-1] < len(data)]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[begins] = False
    after[begins[begins > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return Words(data, cuts, starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, cuts), inside)
