"""Operator 9: toxicity by gradient-boosted trees over dense features, calibrated isotonically.

Features: densities of a fixed lexicon and of word beginnings learned from the training rows, how
near their hits are to a second-person word, capitals, punctuation, and rates of obfuscation. The
trees are grown in numpy on the driver from a bounded labelled sample; scoring runs in Arrow
batches on the executors.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField

from strata.llm.common import fold, labelled_sample, slices, texts_of, with_columns

# Insults, and second-person words of four languages.
INSULTS = (
    "idiot moron stupid scum trash pathetic loser worthless disgusting clown dumb ugly filth "
    "vermin imbecile fool garbage disgrace hate coward bastard bitch asshole fuck shit crap "
    "idiota estúpido estúpida imbécil basura asqueroso inútil payaso dummkopf abschaum dreck "
    "widerlich versager trottel arschloch connard imbécile ordure crétin débile minable salaud"
).split()
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous "
    "votre vos tú ti tus usted ustedes vosotros"
).split()
LEET = str.maketrans("0134578@$!|", "oieastbasil")
STEMS = (4, 5, 6, 8)  # lengths of word beginnings that are tried as learned lexicon
WORD = re.compile(r"[^\W\d_]{3,}")
INNER = re.compile(r"[^\W\d_][0-9@$!*#.\-_|][^\W\d_]")
NEAR = 40


def automaton(stems: dict[str, float]) -> ahocorasick.Automaton:
    """Insults as whole words, learned stems as word beginnings, second-person words."""
    words = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for word in INSULTS:
        entries.setdefault(word, [len(word), False, False, 0.0])[1] = True
    for word in SECOND_PERSON:
        entries.setdefault(word, [len(word), False, False, 0.0])[2] = True
    for stem, worth in stems.items():
        entries.setdefault(stem, [len(stem), False, False, 0.0])[3] = worth
    for word, entry in entries.items():
        words.add_word(word, tuple(entry))
    words.make_automaton()
    return words


def _hits(lowered: str, words: ahocorasick.Automaton) -> tuple[list[int], dict[int, float], list[int]]:
    """Places of insults, of learned stems with their worth, and of second-person words."""
    insults, stems, persons = [], {}, []
    n = len(lowered)
    for end, (length, insult, person, worth) in words.iter(lowered):
        start = end - length + 1
        if start and lowered[start - 1].isalnum():
            continue
        if worth > stems.get(start, 0.0):
            stems[start] = worth
        if (insult or person) and (end + 1 == n or not lowered[end + 1].isalnum()):
            (insults if insult else persons).append(start)
    return insults, stems, persons


def _near(places: list[int], persons: list[int]) -> int:
    """How many places have a second-person word within NEAR characters."""
    count = 0
    for place in places:
        at = bisect_left(persons, place - NEAR)
        count += at < len(persons) and persons[at] <= place + NEAR
    return count


def features_of(text: str, words: ahocorasick.Automaton) -> list[float]:
    """The dense features of one whole text; an empty text has only zeros."""
    lowered = text.lower()
    n, per = max(1, len(text)), 1000 / max(50, len(text))
    insults, stems, persons = _hits(lowered, words)
    plain = set(insults)
    clear = lowered.translate(LEET)
    hidden = [p for p in _hits(clear, words)[0] if p not in plain] if clear != lowered else []
    spread = [p for p in _hits(re.sub(r"(?<=\w)[.\-_*](?=\w)", "", lowered), words)[0]] if (
        "." in text or "-" in text or "*" in text or "_" in text
    ) else []
    places = sorted(plain | set(stems))
    kinds = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    capitals, small = int(kinds[65:91].sum()), int(kinds[97:123].sum())
    marks = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    loud = int(kinds[33])
    odd = int(kinds[[35, 36, 37, 38, 42, 64]].sum())
    return [
        len(insults) * per,
        float(len(insults)),
        len(stems) * per,
        float(len(stems)),
        sum(stems.values()) * per,
        max(stems.values(), default=0.0),
        _near(places, persons) * per,
        len(persons) * per,
        capitals / max(1, capitals + small),
        marks / n,
        loud / n,
        int(kinds[63]) / n,
        odd / n,
        int(kinds[48:58].sum()) / n,
        len(INNER.findall(text)) * per,
        len(hidden) * per,
        max(0, len(spread) - len(insults)) * per,
        float(np.log1p(len(text))),
        len({lowered[p : p + 6] for p in places}),
    ]


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Nodes lie as in a heap: the children of node i are 2i+1 and 2i+2."""
        at = np.zeros(len(x), int)
        rows = np.arange(len(x))
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.value[at]
            right = x[rows, np.maximum(self.feature[at], 0)] > self.threshold[at]
            at = np.where(inner, 2 * at + 1 + right, at)


def _tree(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], slope, curve, depth: int) -> Tree:
    size = 2 ** (depth + 1) - 1
    tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
    members = {0: np.arange(len(x))}
    for node in range(size):
        own = members.pop(node, None)
        if own is None:
            continue
        g, h = slope[own].sum(), curve[own].sum()
        tree.value[node] = -g / (h + 1.0)
        if node >= 2**depth - 1 or len(own) < 20:
            continue
        best = (1e-3, -1, 0)
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            gs = np.bincount(bins[own, f], slope[own], len(cuts) + 1).cumsum()[:-1]
            hs = np.bincount(bins[own, f], curve[own], len(cuts) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(hs < 0.5) | (h - hs < 0.5)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], f, at)
        if best[1] >= 0:
            _, f, at = best
            tree.feature[node], tree.threshold[node] = f, edges[f][at]
            right = bins[own, f] > at
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return tree


@dataclass
class Boosted:
    """Trees on the log-odds scale, and the steps of the isotonic calibration."""

    base: float
    trees: list[Tree]
    rate: float
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += self.rate * tree.predict(x)
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0.0, 1.0)


def boost(x, y, weight, trees: int, depth: int = 3, rate: float = 0.15, bins: int = 64) -> Boosted:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
    share = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    model = Boosted(float(np.log(share / (1 - share))), [], rate)
    total = np.full(len(x), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        tree = _tree(x, binned, edges, weight * (p - y), weight * p * (1 - p), depth)
        model.trees.append(tree)
        total += rate * tree.predict(x)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: raw values and the non-decreasing shares they stand for."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # weighted sum, weight, sum of raw, rows
    for i in order:
        blocks.append([y[i] * weight[i], weight[i], raw[i] * weight[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.array([b[2] / b[1] for b in blocks])
    # One pseudo-row of the overall share keeps the ends off 0 and 1 and the order strict.
    share = np.average(y, weights=weight)
    value = np.array([(b[0] + share) / (b[1] + 1) for b in blocks])
    value = np.maximum.accumulate(value)
    at, first = np.unique(at, return_index=True)
    return at, value[first]


def learn_stems(
    sample: DataFrame, text: str, least_share: float, purity: float, most: int
) -> dict[str, float]:
    """Word beginnings that a share of ``least_share`` of the toxic documents has, clean ones hardly ever.

    The model keeps the ``most`` that are in the most toxic documents of the bounded sample.

    ``sample`` has columns ``label`` and ``text``. Document counts come from the whole sample; the
    worth of a stem is its logarithmic odds. Of nested stems with the same counts the shortest stays.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for part in slices(batch):
                for value, t in zip(
                    part.column("label").to_pylist(), texts_of(part.column(text)), strict=True
                ):
                    words = set(WORD.findall(t.lower()))
                    stems = {w[:k] for w in words for k in STEMS if len(w) >= k}
                    seen[value].update(stems | {w for w in words if len(w) <= STEMS[-1]})
        toxic = {s: n for s, n in seen[1].items()}
        names = list(toxic.keys() | seen[0].keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([toxic.get(s, 0) for s in names], pa.int64()),
                pa.array([seen[0].get(s, 0) for s in names], pa.int64()),
            ],
            names=["stem", "toxic", "clean"],
        )

    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return {}
    least = max(3.0, least_share * sizes[1])
    odds = (F.col("toxic") / sizes[1]) / ((F.col("clean") + 0.5) / sizes[0])
    rows = (
        sample.mapInArrow(count, "stem string, toxic bigint, clean bigint")
        .groupBy("stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= least) & (odds >= purity))
        .select("stem", "toxic", "clean", F.log(odds).alias("worth"))
        .orderBy(F.desc("toxic"), F.length("stem"), "stem")
        .limit(most)
        .collect()
    )
    stems: dict[str, float] = {}
    for r in rows:
        if not any(r["stem"].startswith(s) for s in stems):
            stems[r["stem"]] = float(r["worth"])
    return stems


@dataclass
class Model:
    stems: dict[str, float]
    boosted: Boosted


def train_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    train: Column,
    label: str = "toxic",
    text: str = "text",
    per_class: tuple[int, int] = (5000, 3000),
    trees: int = 60,
    least_share: float = 0.01,
    purity: float = 20.0,
    most_stems: int = 2000,
) -> Model | None:
    """Model from at most ``per_class`` clean and toxic labelled rows for which ``train`` holds.

    One half of the sample (by a hash of the id) yields the learned stems, the other half the
    trees, so that a stem's count never includes the row it is used on; then the halves swap for
    the calibration, and the final stems come from the whole sample, ``most_stems`` at most. None
    without both classes. An id with several texts is learned from with the least of them, an id
    labelled twice counts as toxic if any label says so.
    """
    chosen, sizes = labelled_sample(labels, label, train, {0: per_class[0], 1: per_class[1]})
    sample = (
        documents.select("doc_id", text)
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(F.min(text).alias(text), F.max("label").alias("label"))
        .withColumn("half", fold("doc_id", 2).cast("int"))
        .persist()
    )
    try:
        halves = [learn_stems(sample.where(F.col("half") == k), text, least_share, purity, most_stems) for k in (0, 1)]
        stems = learn_stems(sample, text, least_share, purity, most_stems)

        def start():
            sides = [automaton(halves[1]), automaton(halves[0])]

            def work(texts, half):
                return [
                    pa.array(
                        [
                            np.array(features_of(t, sides[h]), np.float64).tobytes()
                            for t, h in zip(texts_of(texts), half.to_pylist(), strict=True)
                        ],
                        pa.binary(),
                    )
                ]

            return work

        rows = (
            with_columns(sample, [text, "half"], [StructField("features", BinaryType())], start)
            .select("doc_id", "label", "half", "features")
            .collect()
        )
    finally:
        sample.unpersist()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], float)
    if len(set(y)) < 2:
        return None
    x = np.stack([np.frombuffer(r["features"], np.float64) for r in rows])
    half = np.array([r["half"] for r in rows])
    weight = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    weight /= weight.mean()
    boosted = boost(x, y, weight, trees)
    raw = np.zeros(len(y))
    for k in (0, 1):
        if len(set(y[half != k])) == 2:
            raw[half == k] = boost(x[half != k], y[half != k], weight[half != k], trees).raw(x[half == k])
        else:
            raw[half == k] = boosted.raw(x[half == k])
    boosted.steps = isotonic(raw, y, weight)
    return Model(stems, boosted)


def score_toxicity(
    documents: DataFrame, model: Model | None, text: str = "text", out: str = "score"
) -> DataFrame:
    """Append ``out``, the calibrated probability of toxicity, to every row.

    Null and empty texts have features of zero and get the score of such a text; rows stay one to
    one, repeated or not. Without a model every score is 0. A column named as ``out`` is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def start():
        known = shared.value
        words = automaton(known.stems) if known else None

        def work(texts):
            whole = texts_of(texts)
            if known is None or not whole:
                return [pa.array([0.0] * len(whole), pa.float64())]
            x = np.array([features_of(t, words) for t in whole])
            return [pa.array(known.boosted.score(x), pa.float64())]

        return work

    return with_columns(documents, [text], [StructField(out, DoubleType())], start)
