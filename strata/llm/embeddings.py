"""Operator 10: embedding near-duplicates with randomised-rotation binary codes.

Distinct directions are rotated at random. The signs of the rotated components, packed into bytes,
are a vector's binary code. It is stored once with a correction factor and a coarse form of the
rotated vector in a few bit planes; code and planes of two vectors, by counts of common bits, give
an unbiased estimate of their inner product and a bound on its error. Vectors meet in buckets of
equal code bits. Only codes travel there: pairs whose upper confidence bound stays below the
threshold are passed over, and vectors are fetched only for places in buckets that have other
pairs. Those are computed again in double precision, and only that decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from strata.llm.common import components, runs, union_find
from strata.session import materialize

BLOCK = 1024
#: Bits a component of the coarse rotated vector has.
PLANES = 3
#: Sign bits that estimates use, as far as ``ROTATIONS`` rotations have them.
ESTIMATE_BITS = 192
ROTATIONS = 3


@lru_cache(maxsize=16)
def rotations(width: int, bits: int, seed: int) -> list[np.ndarray]:
    """Random orthogonal matrices that give at least ``bits`` sign bits together."""
    out = []
    for k in range(ceil(bits / width)):
        q, r = np.linalg.qr(np.random.default_rng([seed, width, k]).standard_normal((width, width)))
        out.append(q * np.sign(np.diag(r)))
    return out


def banding(n: int, threshold: float, recall: float, bucket: int) -> tuple[int, int]:
    """(bits of a band, bands): buckets of about ``bucket`` unrelated vectors among n.

    A bit of two vectors at the threshold differs with chance angle / pi; the number of bands makes
    the chance that such a pair agrees on no band at most 1 - recall.
    """
    width = max(1, min(48, ceil(log2(max(2, n / bucket)))))
    agree = (1 - acos(min(1.0, threshold)) / pi) ** width
    return width, max(1, ceil(log(1 - recall) / log(1 - agree))) if agree < 1 else 1


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by a power of two first, so that no square over- or underflows."""
    _, exponent = np.frexp(np.abs(vectors).max(1, keepdims=True))
    # In two steps: a power of two that brings the smallest doubles to 1 is none itself.
    scaled = np.ldexp(np.ldexp(vectors, -(exponent // 2)), -(exponent - exponent // 2))
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def words(packed: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words, with zeros at the end."""
    spare = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, spare)))).view(np.uint64)


class Codes:
    """Stored codes of vectors of one length: sign bits, bit planes and correction factors.

    ``signs`` are the packed sign bits of one rotation after the other, each from a byte of its own;
    there are as many as the bands need. For each of the first ``used`` rotations, ``planes`` hold
    the components in steps of ``step`` from ``low``, rounded by a random dither, so that they are
    right on average, and ``factor`` is the inner product of the vector with its code as a unit
    vector; estimates are means over these rotations.
    """

    def __init__(self, dims: int, signs: np.ndarray, planes: np.ndarray, numbers: np.ndarray):
        self.dims, self.signs, self.planes, self.numbers = dims, signs, planes, numbers
        self.used = numbers.shape[1] // 3

    @staticmethod
    def rotations_used(dims: int) -> int:
        return min(ROTATIONS, ceil(ESTIMATE_BITS / dims))

    @classmethod
    def of(cls, vectors: np.ndarray, bits: int, seed: int) -> Codes:
        """Codes of unit vectors with at least ``bits`` sign bits."""
        dims = vectors.shape[1]
        used = cls.rotations_used(dims)
        signs, planes, numbers = [], [], []
        for k, q in enumerate(rotations(dims, max(bits, used * dims), seed)):
            rotated = vectors @ q
            signs.append(np.packbits(rotated > 0, axis=1, bitorder="little"))
            if k < used:
                low = rotated.min(1, keepdims=True)
                step = np.maximum((rotated.max(1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-30)
                dither = np.random.default_rng([seed, dims, k, 1]).random(dims)
                coarse = np.clip(np.floor((rotated - low) / step + dither), 0, (1 << PLANES) - 1).astype(np.uint8)
                planes += [np.packbits(coarse >> p & 1, axis=1, bitorder="little") for p in range(PLANES)]
                numbers += [np.abs(rotated).sum(1, keepdims=True) / np.sqrt(dims), low, step]
        stored = np.concatenate(numbers, axis=1).astype(np.float32)
        return cls(dims, np.concatenate(signs, axis=1), np.concatenate(planes, axis=1), stored)

    def packed(self) -> pa.Array:
        """One binary value per vector, all of one length."""
        rows = np.concatenate([self.signs, self.planes, self.numbers.view(np.uint8)], axis=1)
        ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
        data = np.ascontiguousarray(rows)
        return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])

    @classmethod
    def unpacked(cls, column: pa.Array, dims: int) -> Codes:
        rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        used = cls.rotations_used(dims)
        numbers = rows.shape[1] - used * 12
        planes = numbers - used * PLANES * ceil(dims / 8)
        stored = np.ascontiguousarray(rows[:, numbers:]).view(np.float32)
        return cls(dims, rows[:, :planes], rows[:, planes:numbers], stored)

    def at(self, places: np.ndarray) -> Codes:
        return Codes(self.dims, self.signs[places], self.planes[places], self.numbers[places])

    def bands(self, width: int, bands: int) -> np.ndarray:
        """One integer per vector and band: its sign bits, ``width`` at a time."""
        n = len(self.signs)
        each = self.signs.reshape(n, -1, ceil(self.dims / 8))
        bits = np.unpackbits(each, axis=2, count=self.dims, bitorder="little").reshape(n, -1)
        bits = bits[:, : width * bands].reshape(n, bands, width).astype(np.int64)
        return bits @ (1 << np.arange(width, dtype=np.int64))

    def estimates(self, other: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products with the others, and their standard errors."""
        size, dims = ceil(self.dims / 8), self.dims
        estimate = np.zeros((len(self.signs), len(other.signs)))
        variance = np.zeros_like(estimate)
        for k in range(self.used):
            own = words(self.signs[:, k * size : (k + 1) * size])
            common, total = np.zeros_like(estimate), np.zeros(len(other.signs))
            for p in range(PLANES):
                at = (k * PLANES + p) * size
                plane = words(other.planes[:, at : at + size])
                for w in range(own.shape[1]):
                    common += np.bitwise_count(own[:, None, w] & plane[None, :, w]) * float(1 << p)
                total += np.bitwise_count(plane).sum(1) * float(1 << p)
            ones = np.bitwise_count(own).sum(1).astype(float)
            low, step = other.numbers[:, 3 * k + 1 : 3 * k + 3].T.astype(float)
            factor = self.numbers[:, 3 * k, None].astype(float)
            product = 2 * (ones[:, None] * low + common * step) - (low * dims + total * step)
            estimate += product / np.sqrt(dims) / factor
            spread = np.maximum(0.0, 1 - factor**2) / factor**2 / max(1, dims - 1)
            variance += spread + (step / 2 / factor) ** 2
        return estimate / self.used, np.sqrt(variance) / self.used


def candidates(
    one: Codes, other: Codes, threshold: float, sigmas: float, same: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs whose upper confidence bound reaches ``threshold``.

    With ``same`` the two sides are one block, and only i < j is looked at.
    """
    estimate, error = one.estimates(other)
    i, j = np.nonzero(estimate + sigmas * error >= threshold)
    return (i[i < j], j[i < j]) if same else (i, j)


def exactly(one: np.ndarray, other: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs in double precision, in pieces of bounded size."""
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        piece = slice(at, at + (1 << 16))
        out[piece] = np.einsum("ij,ij->i", one[i[piece]], other[j[piece]])
    return out


def usable(column: str):
    """The condition under which a vector can link: not null, not zero, all components finite."""
    value = F.col(column)
    return (
        value.isNotNull()
        & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(value, lambda x: x != 0)
    )


def matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Equally long vectors as rows of doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def near_duplicates(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.95,
    recall: float = 0.9995,
    sigmas: float = 5.0,
    bucket: int = 64,
    seed: int = 7,
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row, by cosine links of at least ``threshold``.

    ``recall`` is the chance that a pair just at the threshold shares a bucket; closer pairs have a
    better one. ``sigmas`` widens the confidence bound. Very large and very small finite components
    are as good as others: vectors are scaled first. Equal vectors are compared once and count
    as often as they are there. Vectors of different lengths do not link. Vectors that are null,
    zero, or hold null or non-finite components have no links and are their own component. Rows
    with a null key count as links and connect, but are nobody's component; they come back too, as
    do repeated rows. An empty table gives an empty result.
    """
    narrow = df.schema[vector].dataType == ArrayType(FloatType(), True)
    values = F.col(vector) if narrow else F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("key"), values.alias("v"))
    good = rows.where(usable("v"))
    nodes = materialize(
        good.groupBy("v")
        .agg(F.count("*").alias("copies"), F.min("key").alias("low"), F.count("key").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    n = nodes.count()
    width, bands = banding(n, threshold, recall, bucket)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dims))
                codes = Codes.of(unit(matrix(part.column("v"), dims)), width * bands, seed)
                places = codes.bands(width, bands)
                ends = np.arange(len(places) + 1, dtype=np.int32) * bands
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node"),
                        pa.array(np.full(len(places), dims, np.int32)),
                        codes.packed(),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(places.ravel())),
                    ],
                    names=["node", "dims", "packed", "bands"],
                )

    stored = materialize(
        nodes.select("node", "v").mapInArrow(encode, "node bigint, dims int, packed binary, bands array<bigint>")
    )
    place = ["dims", "band", "code"]
    keys = stored.select("dims", F.posexplode("bands").alias("band", "code"))
    large = materialize(
        keys.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        .select(*place, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    # A large bucket is cut into blocks by the node's hash, and each pair of blocks is a task group.
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = (
        stored.select("node", "dims", "packed", F.posexplode("bands").alias("band", "code"))
        .join(large, place, "left")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            *place, "node", "packed", "block",
            F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        )
    )
    groups = [*place, "low", "high"]

    def chosen(group: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j) in a group of the pairs that codes cannot exclude, a block at a time."""
        dims, band, low, high = (group.column(c)[0].as_py() for c in ("dims", "band", "low", "high"))
        codes = Codes.unpacked(group.column("packed"), dims)
        earlier = codes.bands(width, band) if band else None
        block = group.column("block").to_numpy(zero_copy_only=False)
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        for s in range(0, len(left), BLOCK):
            for t in range(s if low == high else 0, len(right), BLOCK):
                one, two = left[s : s + BLOCK], right[t : t + BLOCK]
                same = low == high and s == t
                i, j = candidates(codes.at(one), codes.at(two), threshold, sigmas, same)
                i, j = one[i], two[j]
                if earlier is not None:  # a pair belongs to the first band it shares
                    new = np.ones(len(i), bool)
                    for b in range(band):
                        new &= earlier[i, b] != earlier[j, b]
                    i, j = i[new], j[new]
                yield i, j

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, groups):
            if group.num_rows > 1:
                needed = np.zeros(group.num_rows, bool)
                for i, j in chosen(group):
                    needed[i] = needed[j] = True
                if needed.any():
                    yield group.filter(pa.array(needed))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, groups):
            vectors = unit(matrix(group.column("v"), group.column("dims")[0].as_py()))
            node, copies = (group.column(c).to_numpy(zero_copy_only=False) for c in ("node", "copies"))
            counts = np.zeros(len(node), np.int64)
            ends = [np.empty((2, 0), np.int64)]
            for i, j in chosen(group):
                close = exactly(vectors, vectors, i, j) >= threshold
                i, j = i[close], j[close]
                np.add.at(counts, i, copies[j])
                np.add.at(counts, j, copies[i])
                ends.append(np.stack([node[i], node[j]]))
            a, b = np.concatenate(ends, axis=1).tolist()
            roots = union_find(a, b)
            has = np.flatnonzero(counts)
            root = [roots[x] for x in node[has].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[has]), pa.array(counts[has]), pa.array(root, pa.int64())],
                names=["node", "links", "root"],
            )

    layout = "dims int, band int, code bigint, node bigint, packed binary, block int, low int, high int"
    needed = materialize(
        dealt.repartition(*groups).sortWithinPartitions(*groups, "node").mapInArrow(search, layout)
    )
    found = materialize(
        needed.join(nodes.select("node", "copies", "v"), "node")
        .repartition(*groups)
        .sortWithinPartitions(*groups, "node")
        .mapInArrow(compare, "node bigint, links bigint, root bigint")
    )
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = (
        nodes.select("node", "v", "copies", "low")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .select("node", "v", "copies", "low", "links", F.coalesce("root", "node").alias("root"))
    )
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    resolved = placed.join(lows, "root").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = rows.where(usable("v")).join(resolved, "v").select("key", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable("v"), F.lit(False))).select(
        "key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")
    )
    return linked.union(alone).select(
        F.col("key").alias(key),
        "n_links",
        "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
