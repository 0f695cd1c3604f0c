"""Operator 7: shards of bounded size by extendible hashing, in DataFrame functions.

A row's hash is a string of bits; a directory of prefixes names the shards. A bucket whose bytes
exceed the limit is split on the next bit, and only such buckets are. The depth of every bucket
follows from byte sums per prefix, which are aggregated once for many depths; only rows of buckets
that still do not fit go on to a further round of bits.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import materialize

KEY_BITS = 60
#: A second hash for rows that agree on the first: their place in the table as it was written.
PLACE_BITS = 60
LEVELS = 12  # depths that one round looks at


def key_hash(*columns: str) -> Column:
    """The first 60 bits of the MD5 of the columns' texts, joined by a separator; null is empty."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def prefix(bits: Column, depth: int, width: int = KEY_BITS) -> Column:
    """The first ``depth`` bits."""
    return F.shiftright(bits, width - depth)


def assign_shards(
    df: DataFrame,
    limit: int,
    keys: tuple[str, ...] = ("doc_id",),
    size: Column | None = None,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """(keep..., n_bytes, depth, shard, shard_bytes, oversized) for every row.

    ``size`` is a row's bytes (default: of its text; null counts as 0), ``limit`` the bytes a shard
    may hold. ``shard`` is the bucket's hash prefix as a string of bits, ``depth`` its length. A
    shard above the limit is one row that is larger by itself: it is split off from all others
    whose hash differs and marked ``oversized``. Rows of equal hash, such as repeated rows, are told
    apart by a second hash, of their place in the table, after all bits of the first; which of
    them gets which shard is arbitrary. Null keys hash as empty texts. An empty table stays empty.
    """
    width = KEY_BITS + PLACE_BITS
    bytes_ = F.coalesce(size if size is not None else F.octet_length("text"), F.lit(0)).cast("long")
    rows = materialize(
        df.select(
            *[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)],
            key_hash(*keys).alias("hash"),
            bytes_.alias("n_bytes"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    rows = rows.withColumn("place", F.shiftrightunsigned(F.xxhash64("row"), 64 - PLACE_BITS))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    first = max(1, ceil(log2(max(1, total / limit))) + 2)
    finished: list[DataFrame] = []
    open_, shallow = rows, 0

    def bits(depth: int) -> Column:
        """The first bits, up to ``depth``, as text: unique over both hashes."""
        own = min(depth, KEY_BITS)
        text = F.lpad(F.bin(prefix(F.col("hash"), own)), own, "0") if own else F.lit("")
        if depth > KEY_BITS:
            more = depth - KEY_BITS
            text = F.concat(text, F.lpad(F.bin(prefix(F.col("place"), more, PLACE_BITS)), more, "0"))
        return text

    while True:
        deep = min(width, max(first, shallow + LEVELS))
        leaves = open_.groupBy(bits(deep).alias("leaf")).agg(
            F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")
        )
        levels = F.sequence(F.lit(shallow), F.lit(deep))
        sums = materialize(
            leaves.withColumn("depth", F.explode(levels))
            .groupBy("depth", F.expr("left(leaf, depth)").alias("shard"))
            .agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("rows"))
        )
        last = deep == width
        fits = (F.col("shard_bytes") <= limit) | (F.col("rows") == 1)
        # A prefix that does not fit is split on its next bit. A bucket is a child that fits, so no
        # prefix meets more than two others here. What the round began with has no parent in it.
        split = sums.where(~fits).select("depth", "shard")
        children = split.select(
            (F.col("depth") + 1).alias("depth"), F.expr("explode(array(shard || '0', shard || '1'))").alias("shard")
        )
        begun = F.col("depth") == shallow
        ends = fits | (F.col("depth") == deep) if last else fits
        buckets = materialize(
            sums.where(begun & ends).unionByName(sums.where(~begun & ends).join(children, ["depth", "shard"], "left_semi"))
            .select("depth", "shard", "shard_bytes")
        )
        # Leaves look for their bucket at those depths only that buckets have: at most one a bit.
        depths = sorted(r.depth for r in buckets.select("depth").distinct().collect())
        directory = (
            leaves.select("leaf", F.explode(F.lit(depths).cast("array<int>")).alias("depth"))
            .withColumn("shard", F.expr("left(leaf, depth)"))
            .join(buckets, ["depth", "shard"])
            .select("leaf", "depth", "shard", "shard_bytes")
        )
        directory = materialize(directory)
        placed = open_.withColumn("leaf", bits(deep)).join(directory, "leaf", "left")
        finished.append(placed.where("shard is not null"))
        if last:
            break
        waiting = materialize(placed.where("shard is null").select(*open_.columns))
        if waiting.isEmpty():
            break
        open_, shallow = waiting, deep + 1
    out = reduce(DataFrame.unionByName, finished)
    return out.select(
        *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)],
        "n_bytes",
        F.col("depth").cast("int").alias("depth"),
        "shard",
        "shard_bytes",
        (F.col("shard_bytes") > limit).alias("oversized"),
    )


def write_shards(df: DataFrame, shards: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the rows of ``df``, whose keys are unique, as one Parquet directory per shard."""
    named = shards.select(F.col(key), F.concat(F.lit("p"), "shard").alias("shard"))
    df.drop("shard").join(named, key).repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(limit: int) -> str:
    """The same in SQL for unique document ids: sums per prefix at every depth."""
    return f"""
      WITH rows AS (
        SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents),
      spread AS (SELECT doc_id, n_bytes, hash, d::INTEGER AS depth, hash >> (60 - d) AS p
                 FROM rows, range(0, 61) AS t(d)),
      sums AS (SELECT depth, p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS n FROM spread GROUP BY ALL),
      fit AS (SELECT doc_id, n_bytes, hash, min(depth) AS depth FROM spread JOIN sums USING (depth, p)
              WHERE shard_bytes <= {limit} OR n = 1 GROUP BY ALL)
      SELECT doc_id, n_bytes::BIGINT AS n_bytes, fit.depth AS depth,
             CASE WHEN fit.depth = 0 THEN '' ELSE
               right(lpad(bin(hash >> (60 - fit.depth)), 60, '0'), fit.depth) END AS shard,
             shard_bytes, shard_bytes > {limit} AS oversized
      FROM fit JOIN sums ON fit.depth = sums.depth AND fit.hash >> (60 - fit.depth) = sums.p"""
