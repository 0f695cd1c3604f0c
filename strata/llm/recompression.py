"""Passages of 50 words that repeat across documents, found by recompression.

Recompression rewrites all texts round by round. A run round puts one symbol for each run of equal
symbols, a pair round one symbol for each pair whose left symbol is on the left side of the
alphabet and whose right symbol is on the right side; which side a symbol is on is decided by its
name. A name is a 64-bit hash of the round and the names of its parts, so that it is the same in
every task without a dictionary, and equal passages are rewritten equally but for a few symbols at
either end.

What such an end loses follows from the passage alone: in a run round its first and last run, in a
pair round a first symbol of the right and a last symbol of the left side. So each window of 50
words has an interior of symbols that every occurrence of the window has at the same places. The
window is followed through ROUNDS rounds, or to the last one in which that interior still has a few
symbols, and the one among these that comes first in a fixed order (long symbols first, then by
name) is its anchor. Neighbouring windows mostly share their anchor; the words they span are a
stretch.

Spark then works on anchors, some for every hundred words: an anchor in one document only settles
its windows. A stretch that a smaller document holds as well is removed whole. The first document of
a stretch keeps it if its anchor has no other stretch; only where an anchor has several are windows
compared one by one, each stretch in its first document only. Stretches and windows are compared by 128 bits of SHA-256 over their
words; the 64-bit names only bring together what may be equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from strata.llm.common import slices, with_columns
from strata.llm.words import Words, without_last, words_of
from strata.session import materialize

WINDOW = 50
#: A window is followed through so many rounds, while its interior has so many symbols.
ROUNDS = 6
LEAST_SYMBOLS = 2
#: Every so many rounds are a run round; the others are pair rounds.
RUN_EVERY = 4
#: From so many words on a symbol is a good anchor; shorter ones come after all of these.
LONG_SYMBOL = 4

ANCHORS = "doc_id bigint, row bigint, anchor bigint, d1 bigint, d2 bigint, first int, many int"
DIGESTS = "doc_id bigint, row bigint, first int, w1 bigint, w2 bigint"

_ONE = np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _named(level: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(_mix(left + np.uint64(2 * level + 1)) * np.uint64(0x9E3779B97F4A7C15) + right)


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest of ``values[low:high]`` for each range, none of them empty."""
    size = high - low
    power = np.frexp(size.astype(float))[1] - 1
    found = np.empty(len(low), values.dtype)
    table = values
    for k in range(int(power.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:]) if len(table) > half else table
        mine = np.flatnonzero(power == k)
        found[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << k)])
    return found


def anchors_of(names: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(window, name, place) of the anchor of each window of consecutive words of one text.

    ``names`` are the words of all texts, those of text i at ``bounds[i]:bounds[i + 1]``.
    """
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(names))
    windows = np.flatnonzero(at + window <= bounds[1:][owner])
    low, high = windows.copy(), windows + window
    anchor, place = np.zeros(len(windows), np.uint64), np.zeros(len(windows), np.int64)
    rest = np.arange(len(windows))
    end = bounds[1:][owner[-1]] if len(owner) else 0
    level = 0
    while len(rest):
        if level % RUN_EVERY == 0:
            group, first, changed, lo, hi = _run_round(names, owner, level, low, high)
        else:
            group, first, changed, lo, hi = _pair_round(names, owner, level, low, high)
        enough = (hi - lo >= LEAST_SYMBOLS) & (level < ROUNDS)
        done = ~enough
        if done.any():
            words = np.diff(np.append(at, end))
            order = (np.where(words >= LONG_SYMBOL, 0, _ONE << np.uint64(63))).astype(np.uint64)
            # The order of names, with the symbol's number below it: of equal names the first counts.
            bits = max(1, int(len(names) - 1).bit_length())
            order |= (_mix(names + np.uint64(level)) >> np.uint64(bits + 1)) << np.uint64(bits)
            order |= np.arange(len(names), dtype=np.uint64)
            best = _least(order, low[done], high[done]) & ((_ONE << np.uint64(bits)) - _ONE)
            best = best.astype(np.int64)
            anchor[rest[done]] = _mix(names[best] + np.uint64(level))
            place[rest[done]] = at[best]
        rest, low, high = rest[enough], lo[enough], hi[enough]
        names, owner, at = changed, owner[first], at[first]
        level += 1
    return windows, anchor, place


def _run_round(names, owner, level, low, high):
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    length = np.diff(np.append(first, len(names)))
    changed = names[first]
    runs = length > 1
    changed[runs] = _named(level, changed[runs], length[runs].astype(np.uint64))
    # The runs at both ends may go on outside of the window.
    return group, first, changed, group[low] + 1, group[high - 1]


def _pair_round(names, owner, level, low, high):
    left = (_mix(names ^ np.uint64(0x5851F42D4C957F2D + level)) & _ONE).astype(bool)
    pair = np.zeros(len(names), bool)
    pair[:-1] = left[:-1] & ~left[1:] & (owner[:-1] == owner[1:])
    new = np.ones(len(names), bool)
    new[1:] = ~pair[:-1]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    changed = names[first]
    pairs = pair[first]
    changed[pairs] = _named(level, changed[pairs], names[first[pairs] + 1])
    # A first symbol of the right side may belong to one before, a last of the left to one after.
    low = low + ~left[low]
    high = high - left[high - 1]
    some = low < high
    lo = np.where(some, group[np.minimum(low, len(names) - 1)], 0)
    return group, first, changed, lo, np.where(some, group[high - 1] + 1, 0)


def _digest(view: memoryview, start: int, end: int) -> bytes:
    return hashlib.sha256(view[start:end]).digest()[:16]


def _stretches(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, digest, first word, windows) of each stretch of windows with one anchor."""
    ids, distinct = words.numbered()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], np.uint64)
    windows, anchor, place = anchors_of(hashes[ids], words.bounds, window)
    new = np.ones(len(windows), bool)
    new[1:] = (windows[1:] != windows[:-1] + 1) | (place[1:] != place[:-1]) | (anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(new)
    many = np.diff(np.append(begin, len(windows)))
    first = windows[begin]
    data, at = words.joined()
    view = memoryview(data)
    ends = at[first + many - 1 + window] - 1
    packed = b"".join(_digest(view, a, b) for a, b in zip(at[first].tolist(), ends.tolist(), strict=True))
    digest = np.frombuffer(packed, np.int64).reshape(-1, 2)
    text = np.searchsorted(words.bounds, first, side="right") - 1
    return text, anchor[begin].view(np.int64), digest, first - words.bounds[text], many


def _anchors(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text, anchor, digest, first, many = _stretches(words_of(part.column("text")), window)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(text)),
                        part.column("row").take(pa.array(text)),
                        pa.array(anchor), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                        pa.array(first.astype(np.int32)), pa.array(many.astype(np.int32)),
                    ],
                    names=["doc_id", "row", "anchor", "d1", "d2", "first", "many"],
                )

    return rows.mapInArrow(run, ANCHORS)


def _window_digests(asked: DataFrame, window: int) -> DataFrame:
    """The digests of the windows of chosen stretches: column ``asked`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"))
                data, at = words.joined()
                view = memoryview(data)
                lists = part.column("asked")
                flat, sizes = lists.flatten(), lists.value_lengths().to_numpy()
                many = flat.field("many").to_numpy().astype(np.int64)
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                nth += np.repeat(flat.field("first").to_numpy(), many)
                text = np.repeat(np.repeat(np.arange(len(sizes)), sizes), many)
                start = words.bounds[text] + nth
                ends = at[start + window] - 1
                packed = b"".join(
                    _digest(view, a, b) for a, b in zip(at[start].tolist(), ends.tolist(), strict=True)
                )
                found = np.frombuffer(packed, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(text)),
                        part.column("row").take(pa.array(text)),
                        pa.array(nth.astype(np.int32)), pa.array(found[:, 0]), pa.array(found[:, 1]),
                    ],
                    names=["doc_id", "row", "first", "w1", "w2"],
                )

    return asked.mapInArrow(run, DIGESTS)


def _marks(rows: DataFrame, window: int) -> DataFrame:
    """``(doc_id, row, first, many)``: windows that also start in a smaller document."""
    anchors = materialize(_anchors(rows.where("doc_id IS NOT NULL"), window))
    ends = F.min("doc_id").alias("smallest"), F.max("doc_id").alias("greatest")
    shared = anchors.groupBy("anchor").agg(*ends).where("smallest < greatest").select("anchor")
    live = materialize(anchors.join(shared, "anchor"))
    # A stretch that a smaller document holds as well goes as a whole.
    first = live.groupBy("anchor", "d1", "d2").agg(F.min("doc_id").alias("smallest"))
    placed = live.join(first, ["anchor", "d1", "d2"])
    whole = placed.where("doc_id > smallest").select("doc_id", "row", "first", "many")
    # The first document of a stretch keeps it, unless its anchor has other stretches too.
    mixed = first.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    unsure = placed.where("doc_id = smallest").join(mixed, "anchor")
    asked = unsure.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "many")).alias("asked"))
    one_each = rows.select("doc_id", "row", "text").dropDuplicates(["doc_id", "row"])
    windows = materialize(_window_digests(one_each.join(asked, ["doc_id", "row"]), window))
    least = windows.groupBy("w1", "w2").agg(*ends).where("smallest < greatest").drop("greatest")
    single = windows.join(least, ["w1", "w2"]).where("doc_id > smallest")
    return whole.unionByName(single.select("doc_id", "row", "first", F.lit(1).alias("many")))


def remove_repeated_passages(
    df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW,
    n_words: str = "n_words", n_removed: str = "n_removed", kept: str = "kept",
) -> DataFrame:
    """Append the number of words, of words removed, and the other words joined by one space.

    Words are what stands between spaces and ASCII controls from tab to carriage return, unchanged.
    A word is removed if a window of ``window`` words that covers it also starts in a row with a
    smaller ``key``, an integer. Windows are taken from the input, not from what is left.

    A null or empty text has no words. A row with a null key is left whole and removes nothing; rows
    with one key remove nothing from each other, whether their texts are equal or not. Other columns
    stay; one named like a new column is replaced. An empty table stays empty.
    """
    rows = df.select(
        F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text")
    )
    marks = (
        _marks(rows, window).groupBy("doc_id", "row")
        .agg(F.collect_set(F.struct("first", "many")).alias("__marks"))
        .withColumnsRenamed({"doc_id": "__key", "row": "__row"})
    )
    same = (F.col(key).cast("bigint") == F.col("__key")) & (F.xxhash64(text) == F.col("__row"))
    marked = df.join(marks, same, "left").drop("__key", "__row")
    fields = [StructField(n_words, LongType()), StructField(n_removed, LongType()), StructField(kept, StringType())]

    def start():
        def work(texts: pa.Array, lists: pa.Array) -> list[pa.Array]:
            words = words_of(texts)
            flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
            first = words.bounds[np.repeat(np.arange(len(texts)), sizes)] + flat.field("first").to_numpy()
            deep = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(deep, first, 1)
            np.add.at(deep, first + flat.field("many").to_numpy() - 1 + window, -1)
            left = np.flatnonzero(np.cumsum(deep)[:-1] == 0)
            n = np.diff(words.bounds)
            of = np.searchsorted(left, words.bounds)
            data, at = words.joined(left)
            return [pa.array(n), pa.array(n - np.diff(of)), without_last(data, at[of])]

        return work

    return with_columns(marked, [text, "__marks"], fields, start).drop("__marks")
