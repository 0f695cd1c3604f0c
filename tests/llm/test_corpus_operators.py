"""Near-duplicates, containment, shards, classifiers, components: against brute force."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strata.llm import decontaminate, embeddings, quality, sharding, simhash, toxicity
from strata.llm.common import components, fold, union_find


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(-90, 300), rng.randint(-90, 300)) for _ in range(250)]
    pairs += [(k, k + 1) for k in range(1000, 1060)]  # a long chain
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    expected = union_find(*zip(*pairs, strict=True))
    assert found == {n: r for n, r in expected.items() if n != r}


def plain_fingerprint(text):
    data = (text or "").encode().translate(simhash.LOWER).split()
    shingles = [b" ".join(data[i : i + 3]) for i in range(len(data) - 2)] or ([b" ".join(data)] if data else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def near_rows():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    bases = [[rng.choice(words) for _ in range(150)] for _ in range(12)]
    rows = []
    for k in range(240):
        base = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            base[rng.randrange(150)] = rng.choice(words)
        rows.append((k, " ".join(base)))
    return rows


@pytest.mark.parametrize("paired", [1024, 2])
def test_simhash_components(documents, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", paired)  # 2: buckets take the other way
    rows = [*near_rows(), (900, None), (901, ""), (902, " "), (3, near_rows()[0][1]), (None, near_rows()[1][1])]
    prints = [plain_fingerprint(t) for _, t in rows]
    i, j = np.nonzero(np.bitwise_count(np.array(prints, np.uint64)[:, None] ^ np.array(prints, np.uint64)) <= 2)
    group = union_find(i.tolist(), j.tolist())
    lows = {}
    for at, (doc, _) in enumerate(rows):
        if doc is not None:
            lows[group[at]] = min(doc, lows.get(group[at], doc))
    expected = [(d, format(p, "016x"), lows.get(group[at])) for at, ((d, _), p) in enumerate(zip(rows, prints, strict=True))]
    out = simhash.near_duplicates(documents(*rows))
    found = [tuple(r) for r in out.select("doc_id", simhash.hex_digits(), "component_id").collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    kept = simhash.without_near_duplicates(documents(*rows))
    assert kept.columns == documents((1, "x")).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(lows.values()))


def test_thresholds_fill_the_radius():
    cost, units = simhash.allocate([[0, 5, 6, 40], [0, 1, 30, 60], [0, 9, 9, 9]], 3)
    assert sum(units) == 3 and cost == 7 and units == [2, 1, 0]


def test_simhash_of_odd_tables(edges):
    assert simhash.near_duplicates(edges).count() == 10
    assert simhash.near_duplicates(edges.limit(0)).count() == 0
    assert simhash.without_near_duplicates(edges.limit(0)).count() == 0


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 32))
    vectors = np.concatenate(
        [centres[rng.integers(0, 20, 300)] + rng.standard_normal((300, 32)) * 0.15, rng.standard_normal((100, 32))]
    ).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(1000, vectors[0].tolist())]
    odd = [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [None] * 32), (2004, [])]
    df = spark.createDataFrame(rows + odd + [(2005, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    found = {r.vec_id: tuple(r)[1:] for r in embeddings.near_duplicates(df).collect()}
    wide = np.array([v for _, v in rows], float)
    wide /= np.linalg.norm(wide, axis=1)[:, None]
    close = wide @ wide.T >= 0.95
    np.fill_diagonal(close, False)
    ids = [k for k, _ in rows]
    group = union_find(*(x.tolist() for x in np.nonzero(close | np.eye(len(ids), dtype=bool))))
    for at, key in enumerate(ids):
        root = ids[group[at]]
        assert found[key] == (int(close[at].sum()), root, key == root)
    assert all(found[k] == (0, k, True) for k in range(2000, 2006))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def linked_by_brute_force(vectors):
    wide = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    close = wide @ wide.T >= 0.95
    np.fill_diagonal(close, False)
    group = union_find(*(x.tolist() for x in np.nonzero(close | np.eye(len(wide), dtype=bool))))
    return [(int(close[at].sum()), group[at], at == group[at]) for at in range(len(wide))]


def test_embedding_links_in_one_large_bucket(spark):
    """More near copies than a block holds, of a length that is no multiple of 8."""
    rng = np.random.default_rng(14)
    near = rng.standard_normal(21) + rng.standard_normal((1500, 21)) * 0.16
    vectors = np.concatenate([near, rng.standard_normal((200, 21))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    # Full recall of buckets: this tests blocks, codes and bounds. Bands are few, so that it is quick.
    found = {r.vec_id: tuple(r)[1:] for r in embeddings.near_duplicates(df, bucket=2000).collect()}
    assert [found[k] for k in range(len(vectors))] == linked_by_brute_force(vectors)


def test_embedding_extremes(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]),
            (5, [-1e308, 1e308]), (6, [-1e-308, 1e-308]), (7, [0.0, 1.7e308])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert found == {**{k: (3, 1) for k in (1, 2, 3, 4)}, 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_codes_are_kept_whole_and_unbiased():
    rng = np.random.default_rng(15)
    one = embeddings.unit(rng.standard_normal((40, 50)))
    other = embeddings.unit(one + 0.1 * rng.standard_normal((40, 50)))
    true, off, within = one @ other.T, [], []
    for seed in range(60):
        a, b = (embeddings.Codes.of(v, 130, seed) for v in (one, other))
        again = embeddings.Codes.unpacked(b.packed(), 50)
        assert (again.bands(13, 10) == b.bands(13, 10)).all()
        estimate, error = a.estimates(again)
        off.append(estimate - true)
        within.append(np.abs(estimate - true) <= 3 * error)
    assert abs(np.mean(off)) < 0.002 and np.abs(np.mean(off, axis=0)).max() < 0.08
    assert np.mean(within) > 0.99


def plain_containment(docs, items, size=5, threshold=0.8):
    def runs(text, widths):
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        lengths = widths or [min(size, len(words))]
        return {tuple(words[i : i + n]) for n in lengths for i in range(len(words) - n + 1) if n}

    by_item, by_doc = {}, {}
    for into, rows, widths in ((by_item, items, None), (by_doc, docs, range(1, size + 1))):
        for key, text in rows:
            if key is not None:
                into.setdefault(key, set()).update(runs(text, widths))
    return sorted(
        (d, i, len(own), len(own & there))
        for i, own in by_item.items() for d, there in by_doc.items()
        if own and len(own & there) >= threshold * len(own)
    )


@pytest.fixture
def broadcast_bytes(spark, request):
    """The largest side that Spark broadcasts by its own choice."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


@pytest.mark.parametrize("broadcast_bytes", ["10m", "-1"], indirect=True)
@pytest.mark.parametrize("every", [16, 4])
def test_contaminated_equals_plain_search(spark, documents, monkeypatch, broadcast_bytes, every):
    monkeypatch.setattr(decontaminate, "HIT_EVERY", every)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for k in range(30)]
    docs = []
    for k in range(120):
        body = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        part = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            part[rng.randrange(len(part))] = "Other!"
        docs.append((k, " ".join(body + part + body[:5]).upper() if k % 2 else ", ".join(part)))
    docs += [(200, None), (201, ""), (None, items[0][1]), (5, items[3][1])]
    asked = spark.createDataFrame([*items, (77, None), (78, " "), (None, "w1 w2")], "item_id bigint, text string")
    out = decontaminate.contaminated(documents(*docs), asked)
    found = sorted((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in out.collect())
    assert found == plain_containment(docs, items)
    assert any(n == 1 and len(items[i][1].split()) < 5 for _, i, n, _ in found)
    assert decontaminate.contaminated(documents(*docs), asked.limit(0)).count() == 0
    assert decontaminate.contaminated(documents(*docs).limit(0), asked).count() == 0


def test_short_items_inside_long_documents(spark, documents):
    docs = [(1, "start " * 300 + "Alpha, beta! gamma" + " end" * 300), (2, "alpha beta end"), (3, "gamma"), (4, None)]
    items = [(1, "alpha BETA gamma"), (2, "gamma"), (3, "beta gamma delta epsilon"), (4, "one two three four five six")]
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("h", F.lit(1)).withColumn("w1", F.lit(2))
    out = decontaminate.contaminated(documents(*docs).withColumn("size_class", F.lit("x")), asked)
    found = sorted((r.doc_id, r.item_id, r.containment) for r in out.collect())
    assert found == [(1, 1, 1.0), (1, 2, 1.0), (3, 2, 1.0)]


def test_shards_fit_and_are_as_shallow_as_can_be(documents):
    rng = random.Random(8)
    rows = [(k, "x" * rng.randint(0, 400)) for k in range(500)] + [(900, "y" * 5000), (901, None)]
    out = sharding.assign_shards(documents(*rows), 2000).collect()
    assert sorted(r.doc_id for r in out) == sorted(k for k, _ in rows)
    sums = Counter()
    for r in out:
        sums[r.shard] += r.n_bytes
    assert all(r.shard_bytes == sums[r.shard] and r.depth == len(r.shard) for r in out)
    assert [r.doc_id for r in out if r.oversized] == [900]
    assert all(v <= 2000 for s, v in sums.items() if v != 5000)
    shards = set(sums)
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    for shard in shards:  # the parent of a bucket would not have fitted
        if shard:
            assert sum(v for s, v in sums.items() if s.startswith(shard[:-1])) > 2000


def test_shards_split_repeated_rows(documents):
    out = sharding.assign_shards(documents(*[(1, "z" * 100)] * 60, (None, "z")), 500).collect()
    assert len(out) == 61 and not any(r.oversized for r in out)
    assert sharding.assign_shards(documents((1, "z")).limit(0), 500).count() == 0


def test_written_shards(documents, spark, tmp_path):
    docs = documents(*[(k, "x" * 50) for k in range(40)])
    sharding.write_shards(docs, sharding.assign_shards(docs, 300), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() == 40


def classified(spark):
    rng = random.Random(9)
    words = ["the", "river", "house", "green", "table", "window", "walks", "slowly", "under"]
    rows, labels = [], []
    for k in range(360):
        bad = k % 4 == 0
        body = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        toxic = k % 3 == 0
        if toxic:
            for _ in range(4):
                body.insert(rng.randrange(len(body)), rng.choice(["you idiot", "zorgy", "zorgla", "moron!"]))
        text = " ".join(w.upper() + "!!" if bad else w for w in body)
        rows.append((k, text))
        labels.append((k, int(not bad), int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def accuracy(df, labels, label, threshold, held_out):
    rows = df.where(held_out).join(labels, "doc_id").select("score", label).collect()
    return np.mean([(r[0] >= threshold) == bool(r[1]) for r in rows])


def test_quality_on_held_out_rows(spark, documents, edges):
    rows, labels = classified(spark)
    held_out = fold("doc_id", 3) == 1
    scored = quality.score_quality(documents(*rows), labels, ~held_out)
    assert accuracy(scored, labels, "quality", 0.5, held_out) > 0.95
    odd = quality.score_quality(documents(*rows).union(edges), labels, ~held_out)
    assert odd.where(F.col("score").between(0, 1)).count() == len(rows) + 10
    unlabelled = quality.score_quality(edges, labels.limit(0), ~held_out)
    assert {r.score for r in unlabelled.collect()} == {0.5}


def test_toxicity_on_held_out_rows(spark, documents, edges):
    rows, labels = classified(spark)
    held_out = fold("doc_id", 4) == 2
    model = toxicity.train_toxicity(documents(*rows), labels, ~held_out)
    assert any(s.startswith("zorg") for s in model.stems)
    scored = toxicity.score_toxicity(documents(*rows), model)
    assert accuracy(scored, labels, "toxic", 0.3, held_out) > 0.95
    odd = toxicity.score_toxicity(edges, model)
    assert odd.where(F.col("score").between(0, 1)).count() == 10
    assert toxicity.train_toxicity(documents(*rows), labels.limit(0), ~held_out) is None
    assert {r.score for r in toxicity.score_toxicity(edges, None).collect()} == {0.0}


def test_isotonic_is_monotone():
    rng = np.random.default_rng(2)
    raw = rng.standard_normal(300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    at, value = toxicity.isotonic(raw, y, np.ones(300))
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all()


def test_quality_equals_a_plain_vote(spark, documents):
    rows, labels = classified(spark)
    train = fold("doc_id", 3) != 1
    asked = documents(*rows, (None, "the river"), (9000, None), (9001, ""))
    out = quality.score_quality(asked, labels, train, width=20, neighbours=7)
    learned = labels.where(train & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q"))
    votes = {r.doc_id: int(r.q) for r in learned.collect() if r.q is not None}
    texts = dict(rows)
    known = sorted(k for k in votes if k in texts)
    terms = np.stack([quality.terms_of(texts[k] or "") for k in known]).astype(float)
    weights = np.log((1 + len(terms)) / (1 + (terms > 0).sum(0))) + 0.3
    _, vectors = np.linalg.eigh((terms * weights).T @ (terms * weights))
    axes = vectors[:, ::-1][:, :20]

    def latent(text):
        at = (quality.terms_of(text or "") * weights) @ axes
        return at / np.linalg.norm(at)

    places = [latent(texts[k]) for k in known]
    for row in out.collect():
        own = latent(row.text)
        near = sorted(((float(own @ p), votes[k]) for p, k in zip(places, known, strict=True)), reverse=True)
        near = [(c, v) for c, v in near if c >= near[6][0] - 1e-6]
        pull = [np.exp(12.0 * (c - 1)) for c, _ in near]
        plain = sum(w * v for w, (_, v) in zip(pull, near, strict=True)) / sum(pull)
        assert abs(row.score - plain) < 2e-3, row.doc_id


def test_votes_of_ties_do_not_depend_on_their_order():
    vectors = np.repeat(np.eye(3, dtype=np.float32), [6, 2, 1], axis=0)
    votes = np.array([1, 0, 0, 0, 0, 1, 1, 1, 0])
    for order in (np.arange(9), np.arange(9)[::-1]):
        space = quality.Space(
            np.ones(3, np.float32), np.eye(3, dtype=np.float32), vectors[order], votes[order], np.ones(9), 2, 12.0
        )
        assert space.score(np.eye(3, dtype=np.float32)[:1]) == pytest.approx([2 / 6])


def test_toxicity_equals_a_plain_walk(spark, documents, edges):
    rows, labels = classified(spark)
    model = toxicity.train_toxicity(documents(*rows), labels, fold("doc_id", 4) != 2, trees=12)
    words = toxicity.automaton(model.stems)

    def walk(tree, x, node=0):
        f = tree.feature[node]
        return tree.value[node] if f < 0 else walk(tree, x, 2 * node + (2 if x[f] > tree.threshold[node] else 1))

    def calibrated(raw):
        ends = list(zip(*model.boosted.steps, strict=True))
        if raw <= ends[0][0]:
            return ends[0][1]
        for (a, u), (b, v) in zip(ends, ends[1:], strict=False):
            if raw <= b:
                return u + (v - u) * (raw - a) / (b - a)
        return ends[-1][1]

    for row in toxicity.score_toxicity(edges.unionByName(documents(*rows), True), model).collect():
        x = toxicity.features_of(row.text or "", words)
        raw = model.boosted.base + sum(model.boosted.rate * walk(t, x) for t in model.boosted.trees)
        assert row.score == pytest.approx(calibrated(raw), abs=1e-9)


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    x, weight = rng.integers(0, 9, (200, 4)).astype(float), rng.integers(1, 4, 200).astype(float)
    y = ((x[:, 2] > 4) ^ (rng.random(200) < 0.1)).astype(float)
    tree = toxicity.boost(x, y, weight, 1, depth=1).trees[0]
    p = np.average(y, weights=weight)
    g, h = weight * (p - y), weight * p * (1 - p)
    gains = {}
    for f in range(4):
        for cut in sorted(set(x[:, f]))[:-1]:
            right = x[:, f] > cut
            if min(h[right].sum(), h[~right].sum()) >= 0.5:
                gains[f, cut] = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (right, ~right))
    assert (tree.feature[0], tree.threshold[0]) == max(gains, key=gains.get)


def test_isotonic_equals_the_minimax_formula():
    rng = random.Random(5)
    for _ in range(20):
        n = rng.randint(1, 25)
        raw = [rng.randint(0, 12) for _ in range(n)]
        y, weight = [rng.randint(0, 1) for _ in range(n)], [rng.randint(1, 3) for _ in range(n)]
        order = sorted(range(n), key=lambda i: raw[i])

        def mean(a, b, order=order, y=y, weight=weight):
            some = order[a : b + 1]
            return Fraction(sum(y[i] * weight[i] for i in some), sum(weight[i] for i in some))

        level = [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
        share, steps = mean(0, n - 1), {}
        for value in sorted(set(level)):
            some = [order[k] for k in range(n) if level[k] == value]
            total = sum(weight[i] for i in some)
            at = Fraction(sum(raw[i] * weight[i] for i in some), total)
            steps.setdefault(at, (value * total + share) / (total + 1))
        at, values = toxicity.isotonic(np.array(raw, float), np.array(y, float), np.array(weight, float))
        assert at == pytest.approx([float(a) for a in sorted(steps)])
        plain = np.maximum.accumulate([float(steps[a]) for a in sorted(steps)])
        assert values == pytest.approx(plain)
