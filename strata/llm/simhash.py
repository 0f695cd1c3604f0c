"""Operator 2: SimHash near-duplicates by the generalised pigeonhole principle.

Distinct fingerprints are the nodes. Their 64 bits are split into partitions of correlated bits,
and thresholds T (one per partition, possibly none) with sum(T + 1) = radius + 1 are allocated by
dynamic programming on estimated candidate counts: two fingerprints within the radius then differ
in at most T bits of some partition. A partition is probed with its bits, T of them left out.
All statistics come from all fingerprints; the plan decides the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from strata.llm.common import components, unused, with_columns
from strata.session import materialize

BITS = 64
#: A bucket above this size is resolved by leaving out bits instead of comparing pairs: a member
#: takes part in half as many comparisons as its bucket has members, or in about C(43, 2) keys.
PAIRED_BUCKET = 1024
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of words, joined by spaces, with A-Z lower-cased; repeats included."""
    found = text.encode().translate(LOWER).split()  # bytes split on ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        found = [b" ".join(found)]
        starts, ends = [0], [len(found[0])]
        joined = found[0]
    else:
        joined = b" ".join(found)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        begin = np.cumsum(lengths + 1) - lengths - 1
        starts = begin[: len(found) - words + 1].tolist()
        ends = (begin + lengths)[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)], np.uint64
    )


def fingerprint(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """Bit k is 1 if it is set in more than half of the hashes; zero without any."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), block):
        octets = hashes[at : at + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(octets, axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint32)
    return int(sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Append ``out``: the SimHash of each whole text as a signed 64-bit integer (null: empty)."""

    def start():
        def work(texts):
            prints = [fingerprint(shingle_hashes(t.as_py() or "")) for t in texts]
            return [pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())]

        return work

    return with_columns(df, [text], [StructField(out, LongType())], start)


@dataclass
class Partition:
    bits: tuple[int, ...]
    threshold: int

    def masks(self) -> list[int]:
        """The partition's bits with ``threshold`` of them left out, in every way."""
        whole = sum(1 << b for b in self.bits)
        return [
            whole & ~sum(1 << b for b in left) for left in combinations(self.bits, self.threshold)
        ]


def bit_moments(prints: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, how often each bit is set, how often each two are, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(values), 8192):
                octets = values[at : at + 8192].view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(octets, axis=1, bitorder="little").astype(np.float64)
                total += bits.T @ bits
                n += len(bits)
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"]
        )

    cells = np.zeros(BITS * BITS + 1)
    for row in (
        prints.select("fp").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").sum("n").collect()
    ):
        cells[row[0]] = row[1]
    both = cells[:-1].reshape(BITS, BITS)
    return int(cells[-1]), both.diagonal().copy(), both


def grouped_bits(n: int, ones: np.ndarray, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Partitions of about equal size: each takes the bits most correlated with what it has."""
    share = ones / max(1, n)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    near = np.abs((both / max(1, n) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    free = list(range(BITS))
    out = []
    for part in range(parts):
        size = len(free) // (parts - part)
        inner = near[np.ix_(free, free)]
        own = [free[int(inner.sum(1).argmax())]]
        free.remove(own[0])
        while len(own) < size:
            best = max(free, key=lambda b: near[b, own].sum())
            own.append(best)
            free.remove(best)
        out.append(tuple(sorted(own)))
    return out


def within(shares: np.ndarray, threshold: int) -> float:
    """Chance that two random fingerprints differ in at most ``threshold`` of these bits."""
    chance = np.array([1.0])
    for differ in 2 * shares * (1 - shares):
        chance = np.convolve(chance, [1 - differ, differ])
    return float(chance[: threshold + 1].sum())


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Dynamic programming: units per partition, ``units`` in all, with the least total cost.

    ``costs[i][u]`` is the cost of u units, a threshold of u - 1, in partition i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for u in range(units - used + 1):
                total = cost + own[u]
                if used + u not in after or total < after[used + u][0]:
                    after[used + u] = (total, [*chosen, u])
        best = after
    return best[units]


def plan(prints: DataFrame, radius: int, choices: tuple[int, ...] = (2, 3, 4)) -> list[Partition]:
    """The partitions and thresholds with the least estimated work, from all fingerprints.

    Candidates at threshold 0 are counted (pairs that agree on a partition); higher thresholds
    scale that count by the chances under the bits' own shares.
    """
    n, ones, both = bit_moments(prints)
    share = ones / max(1, n)
    groups = {m: grouped_bits(n, ones, both, m) for m in choices}
    every = [(m, i, bits) for m in choices for i, bits in enumerate(groups[m])]
    keys = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(bits))).alias("v"))
            for k, (_, _, bits) in enumerate(every)
        ]
    )
    counted = {
        row["k"]: float(row["pairs"])
        for row in prints.select(F.explode(keys).alias("key"))
        .groupBy("key.k", "key.v")
        .agg(F.count("*").alias("n"))
        .groupBy("k")
        .agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("double")).alias("pairs"))
        .collect()
    }
    options = []
    for m in choices:
        costs = []
        for k, (m_, _, bits) in enumerate(every):
            if m_ != m:
                continue
            own = share[list(bits)]
            costs.append([0.0])
            for threshold in range(radius + 1):
                ratio = within(own, threshold) / max(within(own, 0), 1e-300)
                floor = n * n / 2 * within(own, threshold)
                pairs = max(counted.get(k, 0.0) * ratio, floor)
                costs[-1].append(n * comb(len(bits), threshold) * 4.0 + pairs)
        total, units = allocate(costs, radius + 1)
        options.append((total, m, units))
    _, m, units = min(options)
    return [Partition(b, u - 1) for b, u in zip(groups[m], units, strict=True) if u]


def _signed(bits: tuple[int, ...]) -> int:
    return _long(sum(1 << b for b in bits))


def _long(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(prints: DataFrame, radius: int, partitions: list[Partition]) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column fp, distinct) within the radius.

    Buckets up to PAIRED_BUCKET compare their pairs and give exactly the pairs within the radius.
    Members of larger ones are keyed with ``radius`` bits left out; those that share a key, at most
    2 ** radius, are linked in a star, each to one within the radius. Both ways lose no link.
    """
    masks = [_long(m) for p in partitions for m in p.masks()]
    probes = prints.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("s", "mask"))
    probes = probes.select("fp", "s", F.col("fp").bitwiseAND(F.col("mask")).alias("v"))
    sizes = probes.groupBy("s", "v").agg(F.count("*").alias("n")).where("n > 1")
    live = materialize(probes.join(sizes, ["s", "v"]))
    cold = live.where(F.col("n") <= PAIRED_BUCKET)
    a = cold.select("s", "v", F.col("fp").alias("a"))
    b = cold.select("s", "v", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    paired = a.join(b, ["s", "v"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    hot = live.where(F.col("n") > PAIRED_BUCKET).select("fp", "s", "v")
    if hot.isEmpty():
        return paired.distinct()
    left_out = [_long(sum(1 << b for b in bits)) for bits in combinations(range(BITS), radius)]
    # Only bits outside the probed ones can differ, besides those the probe itself leaves out.
    kept = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("s") + 1)
    keyed = (
        hot.withColumn("out", F.explode(F.array(*[F.lit(m) for m in left_out])))
        .where(F.col("out").bitwiseAND(kept) == 0)
        .select("fp", "s", "out", F.col("fp").bitwiseAND(F.bitwise_not("out")).alias("key"))
    )
    stars = (
        keyed.groupBy("s", "out", "key")
        .agg(F.collect_set("fp").alias("members"))
        .where(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .where("a <> b")
    )
    return paired.union(stars).distinct()


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    radius: int = 2,
    carry: tuple[str, ...] = (),
    root: str | None = None,
) -> DataFrame:
    """(key, carried columns, fingerprint, component_id) for every row.

    The fingerprint is the SimHash, component_id the smallest key reachable over rows whose
    fingerprints differ in at most ``radius`` bits. Null and empty texts have fingerprint zero and
    link like any other. Rows with a null key come back too; they connect others but are nobody's
    component, and a component of null keys only has a null id. Repeated rows come back as often as
    they are there. A column named ``root``, if asked for, holds the component's smallest fingerprint,
    which no other component has. An empty table gives an empty result.
    """
    carried = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *carried)
    rows = materialize(with_fingerprint(source, "text", "fp").drop("text"))
    prints = materialize(rows.groupBy("fp").agg(F.min("key").alias("low")))
    if prints.isEmpty():
        joined = rows.withColumns({"component_id": F.col("key"), "root": F.col("fp")})
    else:
        edges = links(prints.select("fp"), radius, plan(prints, radius))
        roots = components(edges)
        placed = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), "low"
        )
        lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
        placed = placed.join(lows, "root").select("fp", "root", "component_id")
        joined = rows.join(placed, "fp")
    return joined.select(
        F.col("key").alias(key),
        *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)],
        F.col("fp").alias("fingerprint"),
        "component_id",
        *([F.col("root").alias(root)] if root else []),
    )


def without_near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2
) -> DataFrame:
    """One row of each component: that with the smallest key, of several the smallest text hash.

    Rows that agree in key and text are one row. A component whose keys are all null counts as one,
    and components that share a key count each.
    """
    mark, root = unused(df, "_mark"), unused(df, "_root")
    marked = df.withColumn(mark, F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("text")))
    found = near_duplicates(marked, key, text, radius, (mark,), root)
    low = F.struct(F.col(key).isNull(), mark)
    chosen = found.groupBy(root).agg(F.min(low).getField(mark).alias(mark)).select(mark).distinct()
    return marked.join(chosen, mark, "left_semi").dropDuplicates([mark]).drop(mark)


def hex_digits(fingerprint_: str = "fingerprint"):
    return F.lpad(F.lower(F.hex(F.col(fingerprint_))), 16, "0")
