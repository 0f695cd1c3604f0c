"""Which sources of a language use other words than the language, and than each other.

Documents are counted per (language, source, term) within each slice before anything is shuffled.
Everything after works on counts:

- A group's terms with equal counts in the group and in the language form a cell. The divergence is
  computed once a cell, cells of equal divergence are merged, and a running sum of their sizes tells
  which of them reach the wanted ranks. Only their terms are looked up and put in UTF-8 order.
- Two sources are compared over blocks of terms: a task lays the counts of a bounded number of terms
  and sources into a matrix. Terms that neither source has add the same to a pair and are counted,
  not visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import slices
from strata.llm.words import words_of
from strata.session import materialize

LEAST_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
RANKS = 50
#: Bytes of texts that are counted together before their counts go on.
SLICE_BYTES = 8 << 20
#: Counts of one block of terms, and sources on each side of a block of pairs.
BLOCK_COUNTS = 1 << 18
BLOCK_SOURCES = 512

_BYTES = np.arange(256)
_CAPITAL = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
_SMALL = (_BYTES >= ord("a")) & (_BYTES <= ord("z"))
#: A term is made of ASCII letters and of characters beyond ASCII, whose bytes are all above 127.
_NO_TERM = ~(_CAPITAL | _SMALL | (_BYTES >= 0x80))
_LOWER = np.where(_CAPITAL, _BYTES + 32, _BYTES).astype(np.uint8)

COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term and documents that hold it.

    Every group also has one row with a null term, so that groups without terms are known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                yield _counted(*part.columns)

    texts = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in
                        ((text, "text"), (lang, "lang"), (source, "source"))])
    counted = texts.mapInArrow(run, COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counted(texts: pa.Array, lang: pa.Array, source: pa.Array) -> pa.RecordBatch:
    words = words_of(texts, _NO_TERM, _LOWER)
    ids, terms = words.numbered()
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    pair = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    pairs, group = np.unique(pair, return_inverse=True)
    width = max(1, len(terms))
    in_text, n = np.unique(words.texts * width + ids, return_counts=True)
    keys, place = np.unique(group[in_text // width] * width + in_text % width, return_inverse=True)
    owner = np.concatenate([keys // width, np.arange(len(pairs))])
    none = np.zeros(len(pairs), np.int64)
    totals = np.bincount(place, n, len(keys)).astype(np.int64)
    names = terms.take(pa.array(keys % width)).cast(pa.large_string()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [
            langs.dictionary.take(pa.array(pairs[owner] // len(sources.dictionary))),
            sources.dictionary.take(pa.array(pairs[owner] % len(sources.dictionary))),
            pa.concat_arrays([names, pa.nulls(len(pairs), pa.string())]),
            pa.array(np.concatenate([totals, none])),
            pa.array(np.concatenate([np.bincount(place, minlength=len(keys)), none])),
        ],
        names=["lang", "source", "term", "n", "docs"],
    )


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)) in whole numbers of 38 digits."""
    exact = "decimal(20,0)"
    above = F.lit(SCALE).cast("decimal(10,0)") * (count.cast(exact) + F.lit(SMOOTHING).cast("decimal(1,0)"))
    below = total.cast(exact) + F.lit(SMOOTHING).cast("decimal(1,0)") * terms.cast(exact)
    return (F.lit(1) + F.call_function("div", above, below)).cast("bigint")


def divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every group of a language and a source.

    Terms are stretches of ASCII letters and characters beyond ASCII; only A to Z are lower-cased. A
    language keeps the V terms that at least 30 of its rows hold. A group, and the language, gives
    a kept term with n occurrences there the share ``1 + floor(10**9 (n + 5) / (N + 5 V))``, N being the
    sum of n over the kept terms. Part ``pair`` has each other source of the language with the sum of
    the absolute differences of the shares over all kept terms, part ``term`` the terms of the group
    with a share above the language's, and the difference, up to rank 50. Ranks follow falling value,
    then the item's UTF-8 bytes.

    Nulls in the three columns count as empty texts. Every row counts as a document, repeated or not;
    other columns are not read, whatever their names. An empty table gives no rows; a language
    without kept terms gives pairs with value 0 and no terms. All counts cover all rows.
    """
    counts = materialize(term_counts(df, text, lang, source))
    known = counts.where("term IS NOT NULL")
    kept = (
        known.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"))
        .where(F.col("docs") >= LEAST_DOCUMENTS)
        .drop("docs")
    )
    cells = materialize(known.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"))
    groups = counts.where("term IS NULL").select("lang", "source")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total", "held"])
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("held").alias("counts"))
    by_lang = sizes.join(by_lang, "lang", "left").fillna(0, ["terms", "total_lang"])
    groups = materialize(groups.join(by_lang, "lang"))
    return _pairs(cells, groups).unionByName(_terms(cells, groups))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _terms(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """The terms of each group with the greatest excess over their language."""
    sized = cells.groupBy("lang", "source", "n", "n_lang").agg(F.count("*").alias("many"))
    value = _share(F.col("n"), F.col("total"), F.col("terms")) - _share(
        F.col("n_lang"), F.col("total_lang"), F.col("terms")
    )
    valued = (
        sized.join(groups, ["lang", "source"]).withColumn("value", value).where("value > 0")
        .select("lang", "source", "n", "n_lang", "value", "many")
    )
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("many").alias("many"))
    before = F.sum("many").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    # A value has one term at least, so the first 50 values hold the first 50 ranks.
    top = merged.withColumn("nth", F.row_number().over(falling)).where(F.col("nth") <= RANKS)
    top = top.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < RANKS)
    wanted = valued.join(top.select("lang", "source", "value"), ["lang", "source", "value"])
    wanted = wanted.select("lang", "source", "n", "n_lang", "value")
    named = cells.join(wanted, ["lang", "source", "n", "n_lang"]).withColumnRenamed("term", "item")
    return (
        _ranked(named).where(F.col("rank") <= RANKS)
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    )


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """The summed differences between every two sources of a language."""
    buckets = F.ceil((F.col("counts") + 1) / BLOCK_COUNTS)
    blocks = F.ceil(F.col("sources") / BLOCK_SOURCES)
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    placed = groups.withColumns({"buckets": buckets, "blocks": blocks}).withColumn("block", block)
    placed = placed.withColumn("none", _share(F.lit(0), F.col("total"), F.col("terms")))
    placed = placed.where("terms > 0").select(
        "lang", "source", "total", "terms", "buckets", "blocks", "block", "none"
    )
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets"))
    counted = cells.join(placed, ["lang", "source"]).select(
        "lang", "source", "term", bucket.alias("bucket"), "block", "blocks", "terms", "none",
        _share(F.col("n"), F.col("total"), F.col("terms")).alias("share"),
    )
    # Each source is in every block of terms, with or without terms there.
    present = placed.select(
        "lang", "source", F.lit(None).cast("string").alias("term"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1)).alias("bucket"),
        "block", "blocks", "terms", "none", F.col("none").alias("share"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    sided = counted.unionByName(present).withColumn("other", other).withColumns(
        {"low": F.least("block", "other"), "high": F.greatest("block", "other")}
    )
    parts = (
        sided.select("lang", "bucket", "low", "high", "block", "source", "term", "terms", "none", "share")
        .groupBy("lang", "bucket", "low", "high")
        .applyInArrow(_compared, "lang string, a string, b string, value bigint")
    )
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # Languages without kept terms: all values are 0.
    bare = groups.where("terms = 0").select("lang", "source")
    bare = bare.select("lang", F.col("source").alias("a")).join(
        bare.select("lang", F.col("source").alias("b")), "lang"
    ).where("a < b").withColumn("value", F.lit(0).cast("bigint"))
    summed = materialize(summed.unionByName(bare))
    both = summed.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        summed.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    return _ranked(both).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")


def _compared(rows: pa.Table) -> pa.Table:
    """Differences of the sources of one or two blocks over the terms of one block."""
    first = rows.slice(0, 1).to_pylist()[0]
    sources, terms = (rows.column(c).combine_chunks().dictionary_encode() for c in ("source", "term"))
    sources, terms = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (sources, terms))
    names = sources.dictionary.to_pylist()
    column = sources.indices.to_numpy()
    block, none = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    block[column] = rows.column("block").to_numpy()
    none[column] = rows.column("none").to_numpy()
    line = terms.indices.fill_null(-1).to_numpy()
    shares = np.tile(none, (len(terms.dictionary), 1))
    shares[line[line >= 0], column[line >= 0]] = rows.column("share").to_numpy()[line >= 0]
    # Equal lines of the matrix are one cell with a size.
    shares, many = np.unique(shares, axis=0, return_counts=True) if len(shares) else (shares, None)
    order = sorted(range(len(names)), key=names.__getitem__)
    found: dict[str, list] = {"a": [], "b": [], "value": []}
    for nth, i in enumerate(order):
        # Two different blocks meet in one task only; one block with itself in another.
        later = [j for j in order[nth + 1 :] if first["low"] == first["high"] or block[i] != block[j]]
        if not later:
            continue
        apart = np.abs(none[i] - none[later])
        value = apart * first["terms"] if first["bucket"] == 0 else apart * 0
        if len(shares):
            value = value + ((np.abs(shares[:, [i]] - shares[:, later]) - apart) * many[:, None]).sum(axis=0)
        found["a"] += [names[i]] * len(later)
        found["b"] += [names[j] for j in later]
        found["value"] += value.tolist()
    return pa.table(
        {
            "lang": pa.array([first["lang"]] * len(found["a"]), pa.string()),
            "a": pa.array(found["a"], pa.string()),
            "b": pa.array(found["b"], pa.string()),
            "value": pa.array(found["value"], pa.int64()),
        }
    )


def oracle() -> str:
    """The same rows in DuckDB's SQL."""
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
      FROM documents
    ), t AS (
      SELECT r, lang, source,
             unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
    ), kept AS (
      SELECT lang, term, count(*) AS n_lang FROM t GROUP BY lang, term
      HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}
    ), v AS (
      SELECT lang, count(*) AS terms, sum(n_lang) AS total_lang FROM kept GROUP BY lang
    ), c AS (
      SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
    ), g AS (
      SELECT lang, source, coalesce(total, 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)
    ), p AS (
      SELECT lang, source, term, coalesce(n, 0) AS n,
             1 + ({SCALE}::HUGEINT * (coalesce(n, 0) + {SMOOTHING})) // (total + {SMOOTHING} * terms)::HUGEINT AS p,
             1 + ({SCALE}::HUGEINT * (n_lang + {SMOOTHING})) // (total_lang + {SMOOTHING} * terms)::HUGEINT AS q
      FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
    ), f AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
             (SELECT coalesce(sum(abs(x.p - y.p)), 0) FROM p AS x JOIN p AS y USING (lang, term)
              WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value
      FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
      UNION ALL
      SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
    ), ranked AS (
      SELECT lang, source, part, item, value::BIGINT AS value,
             (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
      FROM f
    )
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {RANKS}
    """
