"""Periodic runs: stretches of words that repeat with a short period, and texts without them.

A run is a stretch of consecutive words with smallest period q, at least ``max(6, 4 q)`` words long,
that no neighbouring word extends. Runs are found at dyadic scales. At scale B the words are cut
into blocks of B, aligned at multiples of B. A run whose period q has ``B <= q < 2 B`` holds a whole
block together with the equal block q words later, since it is at least 4 q long. So every block
is laid on the 2 B - 1 words that follow it: the sum of the squared differences of the words'
numbers at each of the B distances comes from one cyclic convolution of length 2 B, done as a
number-theoretic transform on exact integers. Primes are taken until their product exceeds every
possible sum, so that a sum is zero exactly where it is zero modulo each prime. The distances found
are the seeds: neighbouring blocks with one distance are joined and extended word by word. A seed
inside a run of a smaller scale whose period divides the distance would give that run again, since
the whole stretch then has the smaller period; it is left out, so that long runs cost no more.

All blocks of a slice of documents are transformed together, a bounded number of words at a time.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from strata.llm.common import with_columns
from strata.llm.words import without_last, words_of

SHORTEST = 6
REPEATS = 4
#: Words in one batch of transforms; three times this many 64-bit numbers stay in a core's cache.
CHUNK = 1 << 16
#: Primes below 2**31 with a large power of two in p - 1, each with a primitive root.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
STEP = 64

RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


@lru_cache(maxsize=128)
def _powers(prime: int, root: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first half of the powers of a ``length``-th root of unity and of its inverse."""
    found = []
    for base in (pow(root, (prime - 1) // length, prime), pow(root, -((prime - 1) // length), prime)):
        powers = np.ones(1, np.uint64)
        factor = base
        # Doubling: the next powers are the ones so far times base ** len(powers).
        while len(powers) < length // 2:
            powers = np.concatenate([powers, powers * np.uint64(factor) % np.uint64(prime)])
            factor = factor * factor % prime
        found.append(powers)
    return found[0], found[1]


def _mod(values: np.ndarray, prime: np.uint64) -> np.ndarray:
    """Remainders, in place; a division by a constant is faster than ``%``."""
    values -= values // prime * prime
    return values


def _forward(x: np.ndarray, prime: np.uint64, powers: np.ndarray) -> None:
    """Transforms of the columns of ``x`` in place, with results in bit-reversed order."""
    length, many = x.shape
    half, stride = length // 2, 1
    while half:
        view = x.reshape(length // (2 * half), 2, half, many)
        low, high = view[:, 0], view[:, 1]
        difference = low + (prime - high)
        low += high
        np.minimum(low, low - prime, out=low)  # wraps round where it was below the prime
        difference *= powers[::stride][:half, None]
        high[...] = _mod(difference, prime)
        half, stride = half // 2, stride * 2


def _backward(x: np.ndarray, prime: np.uint64, powers: np.ndarray) -> None:
    """The inverse of ``_forward``, without the division by the length."""
    length, many = x.shape
    half, stride = 1, length // 2
    while half < length:
        view = x.reshape(length // (2 * half), 2, half, many)
        low, high = view[:, 0], view[:, 1]
        turned = _mod(high * powers[::stride][:half, None], prime)
        np.subtract(low + prime, turned, out=high)
        np.minimum(high, high - prime, out=high)
        low += turned
        np.minimum(low, low - prime, out=low)
        half, stride = half * 2, stride // 2


def _differences(ids: np.ndarray, at: np.ndarray, size: int, prime: int, root: int) -> np.ndarray:
    """Sums of squared differences modulo the prime, by distance (row) and block (column).

    The block at ``at`` is compared with the words from ``at + size + r`` on, for r below ``size``.
    """
    length, p = 2 * size, np.uint64(prime)
    places = np.arange(length)[:, None] + (at + size)[None, :]
    after = ids[np.minimum(places, len(ids) - 1)]
    # Reversed round zero, so that the product of the transforms is a correlation.
    block = np.zeros((length, len(at)), np.uint64)
    own = ids[at[None, :] + np.arange(size)[:, None]]
    block[0] = own[0]
    block[length - size + 1 :] = own[:0:-1]
    squares = np.zeros((length + 1, len(at)), np.uint64)
    np.cumsum(_mod(after * after, p), axis=0, out=squares[1:])
    total = squares[size : 2 * size] - squares[:size] + _mod(own * own, p).sum(axis=0)
    if size == 1:
        product = own * after[:1]
    else:
        ahead, back = _powers(prime, root, length)
        _forward(block, p, ahead)
        _forward(after, p, ahead)
        product = _mod(block * after, p)
        _backward(product, p, back)
        product = _mod(product[:size] * np.uint64(pow(length, -1, prime)), p)
    return _mod(_mod(total, p) + np.uint64(2) * (p - _mod(product, p)), p)


def _seeds(
    ids: np.ndarray, at: np.ndarray, size: int, greatest: int, known: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and the distances of ``size`` to ``2 size - 1`` at which they occur again.

    ``known`` are the runs of smaller scales and ``inside`` the number of one that holds each word,
    or -1; seeds that these account for are left out.
    """
    wanted, product, primes = size * greatest**2 + 1, 1, []
    for prime, root in PRIMES:
        if product >= wanted:
            break
        primes.append((ids if greatest < prime else ids % np.uint64(prime), prime, root))
        product *= prime
    blocks, distances = [], []
    many = max(1, CHUNK // (2 * size))
    for low in range(0, len(at), many):
        part = at[low : low + many]
        equal = np.ones((size, len(part)), bool)
        for residues, prime, root in primes:
            equal &= _differences(residues, part, size, prime, root) == 0
        distance, block = np.nonzero(equal)
        block, distance = part[block], distance + size
        if len(known):
            start, length, period = known[inside[block], :3].T
            again = (inside[block] >= 0) & (block + size + distance <= start + length)
            fresh = ~again | (distance % period != 0)
            block, distance = block[fresh], distance[fresh]
        blocks.append(block)
        distances.append(distance)
    return np.concatenate(blocks), np.concatenate(distances)


def _extended(
    ids: np.ndarray, at: np.ndarray, distance: np.ndarray, stop: np.ndarray, step: int
) -> np.ndarray:
    """How many words from ``at`` on, in steps of +1 or -1 up to ``stop``, equal those at a distance."""
    found = np.zeros(len(at), np.int64)
    active = np.arange(len(at))
    ahead = np.arange(STEP)
    while len(active):
        room = (stop[active] - at[active]) * step - found[active]
        places = at[active, None] + step * (found[active, None] + np.minimum(ahead, room[:, None] - 1))
        places = np.clip(places, 0, len(ids) - 1)
        other = np.clip(places + distance[active, None], 0, len(ids) - 1)
        equal = (ids[places] == ids[other]) & (ahead < room[:, None])
        whole = equal.all(axis=1)
        found[active] += np.where(whole, STEP, equal.argmin(axis=1))
        active = active[whole]
    return found


def find_runs(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The runs of several texts, as rows (start, length, period, text) in this order of text, start.

    ``ids`` are non-negative numbers of words, those of text i at ``bounds[i]:bounds[i + 1]``.
    """
    lengths = np.diff(bounds)
    longest = int(lengths.max(initial=0))
    numbers = ids.astype(np.uint64)
    runs = np.empty((0, 4), np.int64)
    inside = np.full(len(ids), -1, np.int64)
    greatest = int(ids.max(initial=0))
    size = 1
    while REPEATS * size <= longest and SHORTEST <= longest:
        texts = np.flatnonzero(lengths >= max(SHORTEST, REPEATS * size))
        begin, end = bounds[texts], bounds[texts + 1]
        first, last = -(-begin // size), (end - 2 * size) // size
        count = last - first + 1
        text = np.repeat(texts, count)
        at = (np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)) * size
        block, distance = _seeds(numbers, at, size, greatest, runs, inside)
        owner = text[(np.searchsorted(at, block))]
        whole = block + size + distance <= bounds[owner + 1]
        found = _merged(ids, bounds, block[whole], distance[whole], owner[whole], size)
        held = np.repeat(found[:, 0] - (np.cumsum(found[:, 1]) - found[:, 1]), found[:, 1])
        held += np.arange(len(held))
        inside[held] = np.repeat(np.arange(len(found)) + len(runs), found[:, 1])
        runs = np.concatenate([runs, found])
        size *= 2
    if not len(runs):
        return runs
    # One stretch seen with several distances has the smallest as its period.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _merged(
    ids: np.ndarray,
    bounds: np.ndarray,
    block: np.ndarray,
    distance: np.ndarray,
    owner: np.ndarray,
    size: int,
) -> np.ndarray:
    """Seeds of one scale as stretches: neighbours joined, then extended; the long ones as runs."""
    order = np.lexsort((block, distance))
    block, distance, owner = block[order], distance[order], owner[order]
    new = np.ones(len(block), bool)
    new[1:] = (distance[1:] != distance[:-1]) | (block[1:] != block[:-1] + size) | (owner[1:] != owner[:-1])
    left, text, distance = block[new], owner[new], distance[new]
    right = block[np.append(new[1:], True)[: len(block)]] + size
    least = np.maximum(SHORTEST, REPEATS * distance)
    # The blocks before and after did not match, so fewer than size words can be added at each end.
    able = right - left + 2 * (size - 1) + distance >= least
    left, right, text, distance, least = (v[able] for v in (left, right, text, distance, least))
    left = left - _extended(ids, left - 1, distance, bounds[text] - 1, -1)
    right = right + _extended(ids, right, distance, bounds[text + 1] - distance, 1)
    length = right - left + distance
    long = length >= least
    return np.stack([left, length, distance, text], axis=1)[long]


def _local(ids: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Numbers that are dense within each text, so that sums of squares stay small."""
    if not len(ids):
        return ids
    width = int(ids.max()) + 1
    distinct, inverse = np.unique(texts * width + ids, return_inverse=True)
    owner = distinct // width
    first = np.searchsorted(owner, owner)
    return (np.arange(len(distinct)) - first)[inverse]


def _cycled(bounds: np.ndarray, seeds: list[int | None]) -> np.ndarray:
    """The place each word is taken from where texts are turned into cycles."""
    order = np.arange(bounds[-1])
    for i, seed in enumerate(seeds):
        n = int(bounds[i + 1] - bounds[i])
        if seed is None or not n:
            continue
        start = seed % n
        period = 1 + (n - start) // (3 + seed % 8)
        order[bounds[i] + start : bounds[i + 1]] = bounds[i] + start + np.arange(n - start) % period
    return order


def periodic_runs(
    df: DataFrame,
    text: str = "text",
    runs: str = "runs",
    collapsed: str = "collapsed",
    cycle: str | None = None,
) -> DataFrame:
    """Append the runs of every text, and its words without the repetitions.

    Words are what stands between spaces, tabs, line feeds, vertical tabs, form feeds and carriage
    returns. ``runs`` is an array of (start, length, period) in words, numbered from 0, by start, then
    period. ``collapsed`` has the words joined by one space, without those that any run contains
    after its first period. ``cycle`` may name an integer column: where it is not null, say g, the
    text's n words from word ``a = g % n`` on are first replaced by repetitions of the first
    ``1 + (n - a) // (3 + g % 8)`` of them, which plants a run.

    A null or empty text, or one without words, has no runs and an empty ``collapsed``. Each row is
    judged alone: repeated rows and ids, null ids and empty tables need no care. Other columns stay;
    one named like a new column is replaced. A text of any length is treated whole, in memory of
    about 150 bytes a word.
    """
    fields = [StructField(runs, ArrayType(RUN)), StructField(collapsed, StringType())]
    inputs = [text] + ([cycle] if cycle else [])

    def start():
        def work(texts: pa.Array, cycles: pa.Array | None = None) -> list[pa.Array]:
            words = words_of(texts)
            ids = _local(words.numbered()[0], words.texts)
            order = _cycled(words.bounds, cycles.to_pylist()) if cycles is not None else None
            if order is not None:
                ids = ids[order]
            found = find_runs(ids, words.bounds)
            found = found[np.argsort(found[:, 3], kind="stable")]
            deep = np.zeros(len(ids) + 1, np.int64)
            np.add.at(deep, found[:, 0] + found[:, 2], 1)
            np.add.at(deep, found[:, 0] + found[:, 1], -1)
            kept = np.flatnonzero(np.cumsum(deep)[:-1] == 0)
            left, at = words.joined(kept if order is None else order[kept])
            cuts = at[np.searchsorted(kept, words.bounds)]
            return [
                pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(found[:, 3], np.arange(len(texts) + 1)), pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(found[:, 0] - words.bounds[found[:, 3]]), *map(pa.array, found[:, 1:3].T)],
                        names=RUN.names,
                    ),
                ),
                without_last(left, cuts),
            ]

        return work

    return with_columns(df, inputs, fields, start)


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period, compared exactly; the first of equals, or null."""
    return F.aggregate(
        runs,
        F.lit(None).cast(RUN),
        lambda best, run: F.when(
            best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run
        ).otherwise(best),
    )
