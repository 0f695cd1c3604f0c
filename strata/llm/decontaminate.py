"""Operator 3: benchmark decontamination by size-partitioned MinHash, in DataFrame functions.

A document contains an item if it has a share of ``threshold`` or more of the item's distinct
word shingles. Documents are much longer than items, so their resemblance is near zero and a
MinHash of the document would not find anything; the search is for containment. Items are
partitioned by size: a class holds those of 2^c up to 2^(c+1) - 1 shingles. An item with n of them
may miss m = floor((1 - threshold) n), so of the m + r smallest hashes, its bottom-k MinHash, every
containing document has r at least: candidates are complete. The class sets r, and its largest
sketch hash is its limit: a shingle of a document is looked up in the classes whose limit it does
not exceed, by (class, hash). Candidates are verified by their exact shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strata.session import materialize

#: A containing document has to hit one sketch hash, and one more for every so many shingles of the class.
HIT_EVERY = 16


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def shingled(df: DataFrame, keep: list[str], text: str, size: int) -> DataFrame:
    """A row per place with columns w1..wn: the words that start there, as a shingle.

    A text of fewer than ``size`` words gives one shingle, its words followed by nulls; a text
    without words gives none.
    """
    words = df.select(*keep, words_of(F.col(text)).alias("_words"))
    count = F.size("_words")
    starts = F.greatest(count - size + 1, F.least(count, F.lit(1)))
    columns = [F.slice("_words", k + 1, starts).alias(f"w{k + 1}") for k in range(size)]
    return words.select(*keep, F.inline(F.arrays_zip(*columns)))


def places(df: DataFrame, keep: list[str], text: str, widths: list[int], size: int) -> DataFrame:
    """Shingles of each of the given widths (``size`` at most), the narrower ones followed by nulls."""
    out = df.select(*keep, *[F.lit(None).cast("string").alias(w) for w in names(size)]).limit(0)
    for width in widths:
        found = shingled(df, keep, text, width).where(f"w{width} is not null")
        empty = [F.lit(None).cast("string").alias(w) for w in names(size)[width:]]
        out = out.unionByName(found.select("*", *empty))
    return out


def names(size: int) -> list[str]:
    return [f"w{k + 1}" for k in range(size)]


def contaminated(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """(key, item, n_shingles, n_found, containment) of every item that a document contains.

    Words are lower-cased runs of letters and digits, shingles have ``size`` words. An item of
    fewer words is one shingle of its own length, which is sought at every place of a document.
    Items and documents without words, null texts among them, contain nothing and are in nothing.
    Rows of one key are one document, rows of one item id one item, with the shingles of all of
    them; rows with a null key or id are left out. Other columns of both tables, whatever their
    names, are not looked at. Empty tables give an empty result.
    """
    w = names(size)
    source = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key is not null")
    asked = items.select(F.col(item).alias("_item"), F.col(item_text).alias("_text"))
    wanted = materialize(
        shingled(asked.where("_item is not null"), ["_item"], "_text", size)
        .distinct()
        .withColumn("h", F.xxhash64(*w))
    )
    # One number for each width that there is, 1 to ``size``.
    length = sum((F.col(c).isNotNull().cast("int") for c in w), F.lit(0))
    widths = sorted(row[0] for row in wanted.select(length.alias("n")).distinct().collect())
    by_hash = W.partitionBy("_item").orderBy("h", *w)
    ranked = wanted.select(
        "_item", "h", F.row_number().over(by_hash).alias("rank"),
        F.count("*").over(W.partitionBy("_item")).alias("n"),
    )
    least = F.ceil(F.lit(threshold) * F.col("n") - 1e-9)
    sized = ranked.withColumn("size_class", F.floor(F.log2(F.col("n").cast("double"))).cast("int"))
    sized = sized.withColumn(
        "need", F.least(F.expr(f"1 + shiftleft(1L, size_class) div {HIT_EVERY}"), least)
    )
    # Equal hashes of different shingles count as often as they are there: no candidate is lost.
    sketches = materialize(
        sized.where(F.col("rank") <= F.col("n") - least + F.col("need"))
        .groupBy("size_class", "h", "_item", "need")
        .agg(F.count("*").alias("copies"))
    )
    # A row a class, of which there are as many as an item's number of shingles has bits.
    limits = sketches.groupBy("size_class").agg(F.max("h").alias("top")).collect()
    reached = F.array(*[F.when(F.col("h") <= F.lit(r["top"]), F.lit(r["size_class"])) for r in limits])
    hashed = places(source, ["_key"], "_text", widths, size).select("_key", F.xxhash64(*w).alias("h"))
    hashed = hashed.select("_key", "h", F.explode(F.array_compact(reached.cast("array<int>"))).alias("size_class"))
    candidates = materialize(
        hashed.join(sketches, ["size_class", "h"])
        .select("_key", "_item", "h", "need", "copies")
        .distinct()
        .groupBy("_key", "_item", "need")
        .agg(F.sum("copies").alias("hits"))
        .where("hits >= need")
        .select("_key", "_item")
    )
    # Exact shingles of the documents that have a candidate, against those of its items.
    there = candidates.select("_key").distinct()
    own = places(source.join(there, "_key", "left_semi"), ["_key"], "_text", widths, size)
    same = [F.col(f"own.{c}").eqNullSafe(F.col(f"wanted.{c}")) for c in w]
    pairs = candidates.alias("pair").join(wanted.alias("wanted"), "_item")
    pairs = pairs.select("pair._key", "_item", "h", *[F.col(f"wanted.{c}") for c in w])
    hits = (
        pairs.alias("wanted")
        .join(
            own.withColumn("h", F.xxhash64(*w)).alias("own"),
            [F.col("own._key") == F.col("wanted._key"), F.col("own.h") == F.col("wanted.h"), *same],
        )
        .select("wanted._key", "wanted._item", *[F.col(f"wanted.{c}") for c in w])
        .distinct()
        .groupBy("_key", "_item")
        .agg(F.count("*").alias("n_found"))
    )
    sizes = wanted.groupBy("_item").agg(F.count("*").alias("n_shingles"))
    return (
        hits.join(sizes, "_item")
        .where(F.col("n_found") >= F.lit(threshold) * F.col("n_shingles") - 1e-9)
        .select(
            F.col("_key").alias(key),
            F.col("_item").alias(item if item != key else f"{item}_found"),
            "n_shingles",
            "n_found",
            (F.col("n_found") / F.col("n_shingles")).alias("containment"),
        )
    )


def oracle(size: int = 5, threshold: float = 0.8) -> str:
    """The same search in SQL, by comparing all shingles."""
    def words(table: str, key: str) -> str:
        return f"""
          SELECT {key}, string_split(t, ' ') AS ws
          FROM (SELECT {key}, trim(regexp_replace(lower(coalesce(text, '')),
                  '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t
                FROM {table} WHERE {key} IS NOT NULL) WHERE t <> ''"""

    return f"""
      WITH item_words AS ({words("benchmark", "item_id")}), doc_words AS ({words("documents", "doc_id")}),
      widths AS (SELECT DISTINCT least(len(ws), {size}) AS n FROM item_words),
      items AS (SELECT DISTINCT item_id, array_to_string(ws[i:i+n-1], ' ') AS shingle
        FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
              FROM (SELECT *, least(len(ws), {size}) AS n FROM item_words))),
      docs AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+n-1], ' ') AS shingle
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
              FROM doc_words JOIN widths ON len(ws) >= n)),
      sizes AS (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY item_id),
      hits AS (SELECT doc_id, item_id, count(*) AS n_found FROM docs JOIN items USING (shingle) GROUP BY ALL)
      SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
      FROM hits JOIN sizes USING (item_id) WHERE n_found >= {threshold} * n_shingles - 1e-9"""
