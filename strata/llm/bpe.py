"""Operator 1: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of tokens. Every pair that can merge lies in the bucket of its merge
rank; a two-level bitmap over the ranks finds the lowest filled bucket with find-first-set, so
neither a scan of all pairs nor a heap over all positions is needed. Entries whose pair has changed
meanwhile are stale and skipped when they come up. A pre-token of n bytes costs O(n) queue steps.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField

from strata.llm.common import with_columns

CACHED_LENGTH = 48
#: Estimated bytes of one of the two generations of the cache of pre-tokens that a worker keeps.
CACHE_BYTES = 48 << 20
ENTRY_BYTES = 180
PAIR_BYTES = 168
#: From so many bytes on the linked list of a pre-token is kept in flat arrays.
LONG_PIECE = 4096
SHIFT = 8  # a node of the bitmap has 256 children
NODE, MASK = 1 << SHIFT, (1 << SHIFT) - 1


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Ranks, token bytes and the queue. ``ranks`` is the text of a rank file."""

    def __init__(self, ranks: bytes, pattern: str, cache_bytes: int = CACHE_BYTES):
        self.cache_bytes, self.known_pairs = cache_bytes, cache_bytes // PAIR_BYTES
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.token_array = pa.array(self.tokens, pa.large_binary())
        self.find = regex.compile(pattern).findall
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.merges: dict[int, int] = {}
        self.words = [0] * (size // NODE + 1)
        self.bits = [1 << i for i in range(max(NODE, size // NODE + 1))]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.spent = 0

    def merge_rank(self, pair: int) -> int:
        """Rank of the token that two tokens (ids, packed) make together, or -1."""
        rank = self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], -1)
        if len(self.merges) < self.known_pairs:
            self.merges[pair] = rank
        return rank

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        single, merges, words, bits = self.single, self.merges, self.words, self.bits
        known, slow = merges.get, self.merge_rank
        token = [single[byte] for byte in piece]
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = []  # the rank at which the pair that starts here waits
        if n >= LONG_PIECE:
            token, after, before, due = (array("q", values) for values in (token, after, before, due))
        buckets: dict[int, list[int]] = {}
        top = 0  # upper level of the bitmap: which words have a bit
        for i in range(n - 1):
            pair = token[i] << 32 | token[i + 1]
            if (rank := known(pair)) is None:
                rank = slow(pair)
            due.append(rank)
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    high = rank >> SHIFT
                    words[high] |= bits[rank & MASK]
                    top |= bits[high]
        due.append(-1)
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            rank = high << SHIFT | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[high] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if due[i] != rank:
                continue  # stale
            gone = after[i]
            token[i], due[i], due[gone] = rank, -1, -1
            right = after[i] = after[gone]
            if right < n:
                before[right] = i
            for at in (i, before[i]):  # the pairs on both sides of the new token
                if at < 0 or (right := after[at]) >= n:
                    continue
                pair = token[at] << 32 | token[right]
                if (rank := known(pair)) is None:
                    rank = slow(pair)
                due[at] = rank
                if rank >= 0:
                    if rank in buckets:
                        heappush(buckets[rank], at)
                    else:
                        buckets[rank] = [at]
                        high = rank >> SHIFT
                        words[high] |= bits[rank & MASK]
                        top |= bits[high]
        ids, i = [], 0
        while i < n:
            ids.append(token[i])
            i = after[i]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Each pre-token is merged once while it is in the cache. When its young generation is full, it
        becomes the old one; what is used again moves back, the rest is forgotten with the next turn.
        """
        young, old, out = self.young, self.old, []
        for piece in self.find(text):
            ids = young.get(piece)
            if ids is None:
                ids = old.get(piece)
                if ids is None:
                    ids = packed(self.merge(piece.encode()))
                if len(piece) <= CACHED_LENGTH:
                    young[piece] = ids
                    self.spent += ENTRY_BYTES + len(piece) + len(ids)
                    if self.spent > self.cache_bytes:
                        self.old = old = young
                        self.young = young = {}
                        self.spent = 0
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_all(self, packed_ids: pa.Array) -> pa.Array:
        """The bytes of each list of packed ids; a null list has none."""
        packed_ids = packed_ids.fill_null(b"").cast(pa.large_binary())
        _, offsets, data = packed_ids.buffers()
        cuts = np.frombuffer(offsets, np.int64, len(packed_ids) + 1, packed_ids.offset * 8)
        ids = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]].view("<u4") if cuts[-1] > cuts[0] else ()
        # The tokens, taken in the order of the ids, lie one after the other in one buffer.
        taken = self.token_array.take(pa.array(np.asarray(ids, np.int64)))
        _, ends, whole = taken.buffers()
        ends = np.frombuffer(ends, np.int64, len(taken) + 1)
        at = ends[(cuts - cuts[0]) // 4].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(packed_ids), [None, pa.py_buffer(at), whole])


_codecs: dict[str, Codec] = {}


def codec(ranks: bytes, pattern: str, cache_bytes: int = CACHE_BYTES) -> Codec:
    """One codec per Python worker and vocabulary, with a cache of bounded size across its tasks."""
    key = f"{hashlib.sha256(ranks + pattern.encode()).hexdigest()} {cache_bytes}"
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern, cache_bytes)
    return _codecs[key]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "token_ids"
) -> DataFrame:
    """Append ``out``: the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    ``ranks_path`` is a rank file on the driver (a vocabulary of fixed size, sent to the executors);
    ``pattern`` cuts a text into pre-tokens. There are no special tokens: their strings are ordinary
    text. Null and empty texts give empty binaries; rows, repeated or not, stay one to one; an empty
    table stays empty. A column named as ``out`` is replaced, all others are kept.
    """
    vocabulary = _vocabulary(df, ranks_path)

    def start():
        worker = codec(vocabulary.value, pattern)
        return lambda texts: [
            pa.array([worker.encode(t.as_py() or "") for t in texts], pa.binary())
        ]

    return with_columns(df, [text], [StructField(out, BinaryType())], start)


def encode_and_decode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    text: str = "text",
    ids: str = "token_ids",
    out: str = "decoded",
    cache_bytes: int = CACHE_BYTES,
) -> DataFrame:
    """``encode``, then ``decode`` of its result, in one Python worker instead of two.

    ``cache_bytes`` bounds each generation of a worker's cache; it changes speed and memory only.
    """
    vocabulary = _vocabulary(df, ranks_path)

    def start():
        worker = codec(vocabulary.value, pattern, cache_bytes)

        def work(texts: pa.Array) -> list[pa.Array]:
            encoded = pa.array([worker.encode(t.as_py() or "") for t in texts], pa.binary())
            return [encoded, worker.decode_all(encoded)]

        return work

    return with_columns(df, [text], [StructField(ids, BinaryType()), StructField(out, BinaryType())], start)


def decode(
    df: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded"
) -> DataFrame:
    """Append ``out``: the bytes that packed ids stand for. Null ids give empty bytes.

    An id outside the vocabulary is an error.
    """
    vocabulary = _vocabulary(df, ranks_path)

    def start():
        worker = codec(vocabulary.value, "")
        return lambda packed: [worker.decode_all(packed)]

    return with_columns(df, [ids], [StructField(out, BinaryType())], start)
