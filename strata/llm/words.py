"""Words of Arrow text columns as numpy positions, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and the ASCII controls from tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Words:
    """The words of several texts, in order.

    ``data`` are the UTF-8 bytes of all texts, ``starts`` and ``ends`` the byte range of each word
    and ``bounds[i]:bounds[i + 1]`` the words of text ``i``.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def texts(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def numbered(self) -> tuple[np.ndarray, pa.Array]:
        """A number per word, equal for equal words, and the distinct words by number."""
        coded = _cut(self.data, self.starts, self.ends).dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def joined(self, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The words, or those numbered in ``order``, each with a space after it.

        Returns the bytes and where each word begins, with the end of all as the last entry.
        """
        starts = self.starts if order is None else self.starts[order]
        ends = self.ends if order is None else self.ends[order]
        at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts + 1, out=at[1:])
        out = np.full(at[-1], 0x20, np.uint8)
        # Every byte of a word moves by the same distance.
        move = np.repeat(starts - at[:-1], ends - starts)
        to = np.arange(len(move)) + np.repeat(np.arange(len(starts)), ends - starts)
        out[to] = self.data[to + move]
        return out, at


def words_of(
    texts: pa.Array, separates: np.ndarray = SPACES, fold: np.ndarray | None = None
) -> Words:
    """The maximal stretches of bytes that do not separate words; a null text has none.

    ``fold`` maps each byte to the one that counts instead.
    """
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    at = at - at[0]
    if fold is not None:
        data = fold[data]
    solid = ~separates[data]
    edge = solid.copy()
    edge[1:] &= ~solid[:-1]
    begins = at[:-1][at[:-1] < len(data)]
    edge[begins] = solid[begins]
    starts = np.flatnonzero(edge)
    edge = solid.copy()
    edge[:-1] &= ~solid[1:]
    lasts = at[1:][at[1:] > 0] - 1
    edge[lasts] = solid[lasts]
    ends = np.flatnonzero(edge) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at))


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces of the buffer as an Arrow array."""
    cuts = np.empty(2 * len(starts) + 1, np.int64)
    cuts[:-1:2], cuts[1::2], cuts[-1] = starts, ends, ends[-1] if len(ends) else 0
    both = pa.Array.from_buffers(
        pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)]
    )
    return both.take(pa.array(np.arange(0, 2 * len(starts), 2)))


def without_last(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The pieces between the cuts as texts, each without its last byte, which is a space."""
    keep = np.ones(len(data), bool)
    lasts = cuts[1:][cuts[1:] > cuts[:-1]] - 1
    keep[lasts] = False
    at = np.zeros(len(cuts), np.int64)
    np.cumsum(np.maximum(np.diff(cuts) - 1, 0), out=at[1:])
    texts = pa.Array.from_buffers(
        pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data[keep])]
    )
    return texts.cast(pa.string())
