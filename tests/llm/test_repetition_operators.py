"""Periodic runs, divergence of sources and repeated passages: against plain versions, and odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from strata.llm import divergence, periodic, queries, recompression

FOLDER = "/root/testdata/sf0.001"


def plain_runs(x):
    found = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def looping_texts(rng, many):
    for _ in range(many):
        letters = rng.choice([1, 2, 3, 30])
        text = [rng.randrange(letters) for _ in range(rng.randint(0, 100))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.randrange(letters) for _ in range(rng.randint(1, 20))]
            at, long = rng.randint(0, len(text)), rng.randint(1, 7 * len(unit))
            text[at:at] = [unit[i % len(unit)] for i in range(long)]
        yield text


def test_runs_equal_plain_search(monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 64)
    rng = random.Random(11)
    texts = list(looping_texts(rng, 300))
    bounds = np.cumsum([0, *map(len, texts)])
    found = periodic.find_runs(np.array(sum(texts, []), np.int64), bounds)
    for i, text in enumerate(texts):
        mine = [(int(s - bounds[i]), int(n), int(q)) for s, n, q, t in found if t == i]
        assert mine == plain_runs(text)


def test_sums_are_exact_with_large_numbers():
    """Numbers whose squared differences add up to multiples of the first prime, but not to zero."""
    prime = periodic.PRIMES[0][0]
    ids = np.array([0, prime] * 20 + [5] * 40, np.int64)
    assert [tuple(r) for r in periodic.find_runs(ids, np.array([0, 80]))] == [(0, 40, 2, 0), (40, 40, 1, 0)]


def test_long_runs_are_not_searched_again():
    ids = np.zeros(300_000, np.int64)
    assert periodic.find_runs(ids, np.array([0, len(ids)])).tolist() == [[0, 300_000, 1, 0]]


def test_runs_of_rows(documents, edges):
    text = "a b a b a b a b c c c c c c d"
    rows = periodic.periodic_runs(documents((1, text), (1, text), (None, text), (2, "c  c\tc\n c\x0bc c"))).collect()
    for row in rows[:3]:
        assert [tuple(r) for r in row.runs] == [(0, 8, 2), (8, 6, 1)] and row.collapsed == "a b c d"
        assert row.score == "own" and row.text == text
    assert [tuple(r) for r in rows[3].runs] == [(0, 6, 1)] and rows[3].collapsed == "c"
    odd = periodic.periodic_runs(edges).collect()
    assert len(odd) == 10 and [r.collapsed for r in odd[:4]] == ["", "", "", "one"]
    assert [r.collapsed for r in odd if r.doc_id == 7] == ["é漢字😀"]
    assert periodic.periodic_runs(edges.limit(0)).count() == 0
    named = periodic.periodic_runs(documents((1, text)).withColumnRenamed("score", "runs"))
    assert len(named.collect()[0].runs) == 2


def test_op11_equals_its_contract(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, FOLDER).collect()}
    some = sorted(docs, key=lambda d: (zlib.crc32(str(d[0]).encode()) % 10 != 0, len(d[1] or "")))[:120]
    for doc_id, text in some:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words)
        best = (None,) * 4
        if runs:
            s, length, q = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
            best = (s, length, q, 1000 * length // q)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, plain_collapsed(words, runs))]
        assert found[doc_id] == (len(runs), *best, *digests)


ODD = "text string, lang string, source string, value string, item int"


def odd_groups(spark):
    rows = [(None, None, None), ("", None, "a"), ("Ab ab É", "x", ""), ("uno", "es", "q")]
    rows += [("the Cat É" + str(i % 3) * (i % 5) + " É’s" * (i % 2), "en", f"s{i % 7}") for i in range(150)]
    rows += [("uno dos", "es", "q")] * 40 + [("zz", "fr", "k1"), (None, "fr", "k2")]
    return spark.createDataFrame([(*r, "own", 1) for r in rows], ODD)


@pytest.mark.parametrize(("sources", "counts"), [(512, 1 << 18), (2, 3), (1, 1)])
def test_divergence_of_odd_rows_equals_sql(spark, monkeypatch, sources, counts):
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", sources)
    monkeypatch.setattr(divergence, "BLOCK_COUNTS", counts)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    rows = odd_groups(spark)
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [tuple(r)[:3] for r in rows.collect()])
    result = con.sql(divergence.oracle())
    found = divergence.divergence(rows).select(result.columns).collect()
    assert sorted(map(tuple, found)) == sorted(result.fetchall())
    assert {r.part for r in found} == {"pair", "term"}


def test_divergence_of_no_rows(spark):
    assert divergence.divergence(odd_groups(spark).limit(0)).count() == 0


def plain_removed(rows, window):
    first, split = {}, [(k, (t or "").encode().split()) for k, t in rows]
    for k, words in split:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if k is not None:
                first[w] = min(k, first.get(w, k))
    for k, words in split:
        gone = set()
        for i in range(len(words) - window + 1 if k is not None else 0):
            if first[tuple(words[i : i + window])] < k:
                gone.update(range(i, i + window))
        yield k, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def repeating_texts(rng):
    words = [f"w{i}" for i in range(rng.choice([1, 2, 3, 8, 200]))]
    passages = [[rng.choice(words) for _ in range(rng.randint(30, 120))] for _ in range(6)]
    for number in range(40):
        text = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.5:
                passage = list(rng.choice(passages))
                if rng.random() < 0.3:
                    passage[rng.randrange(len(passage))] = "edit"
                text += passage[rng.randint(0, 10) : len(passage) - rng.randint(0, 10)]
            elif kind < 0.6:
                text += words[:1] * rng.randint(1, 150)
            elif kind < 0.7:
                text += (words[:3] * 60)[: rng.randint(1, 170)]
            else:
                text += [rng.choice(words) for _ in range(rng.randint(1, 60))]
        key = rng.choice([number // 2, None]) if rng.random() < 0.2 else number
        yield key, rng.choice([" ", "\n", "\t  "]).join(text)


@pytest.mark.parametrize("seed", range(4))
def test_repeated_passages_equal_plain_search(documents, seed):
    rows = list(repeating_texts(random.Random(seed)))
    out = recompression.remove_repeated_passages(documents(*rows))
    found = [tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(found, key=repr) == sorted(plain_removed(rows, 50), key=repr)


def test_repeated_passages_with_colliding_names(documents, monkeypatch):
    """Names cut to 4 bits bring everything together; the words still decide."""
    named = recompression._named
    monkeypatch.setattr(recompression, "_named", lambda *a: named(*a) & np.uint64(15))
    rows = list(repeating_texts(random.Random(9)))
    out = recompression.remove_repeated_passages(documents(*rows))
    found = [tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(found, key=repr) == sorted(plain_removed(rows, 50), key=repr)


def test_repeated_passages_of_odd_rows(documents, edges):
    out = recompression.remove_repeated_passages(edges)
    assert out.columns == [*edges.columns, "n_words", "n_removed", "kept"]
    assert out.count() == 10 and out.where("n_removed > 0").count() == 0
    assert recompression.remove_repeated_passages(edges.limit(0)).count() == 0
    long = " ".join(f"word{i}" for i in range(60))
    named = documents((2, long), (1, long), (None, long)).withColumnRenamed("score", "kept")
    rows = recompression.remove_repeated_passages(named).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.kept == long) for r in rows) == [
        ("1", 0, True), ("2", 60, False), ("None", 0, True)
    ]


def test_op13_equals_its_contract(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = sorted(map(tuple, queries.op13_substring_dedup(spark, FOLDER).collect()))
    plain = ((k, n, gone, hashlib.sha256(t.encode()).hexdigest()) for k, n, gone, t in plain_removed(docs, 50))
    assert found == sorted(plain)
