"""Toxicity: a logistic model of words and word beginnings, regularised by counterfactuals.

Labelled sentences that mention an identity term are repeated with each other term of its group, and the model is
fitted to change its score as little as possible between the two, so that a neutral mention of a group says nothing.

Labels are learned only from rows whose crc32 of the id as text isn't divisible by 5, through a sample of
about `sample` (20,000) labelled ids, chosen by a hash of the id, one row of each. Of the features that tell the labels apart
beyond chance, the `features` (4,096) best are used. The sample's rows, as lists of these, and the weights are all that
passes through the driver. Every text is scored whole.

A row with several labels counts as toxic if one says so; null labels don't count. Without usable labels every score
is 0. Null texts are empty texts, and get the score of a text without features. Null ids are never held out nor learned from.
Repeated rows are scored alike. Label, lang, source and id are never inputs of a score.
"""

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import batch_of, begin, stored

SAMPLE = 20_000
FEATURES = 4096
#: Log likelihood that a feature must explain, about 3.5 standard errors; less is likely chance.
LEAST_GAIN = 6.0
FOLDS = 5
KEPT_WORDS = 100_000
BEGINNINGS = (3, 4, 5, 6)
#: Terms that name a group of people; a term may be swapped for any other of its line.
IDENTITY = (
    "women men girls boys people persons",
    "woman man girl boy person",
    "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists catholic catholics atheist atheists",
    "black white asian latino hispanic african arab european indian native",
    "gay lesbian straight bisexual transgender queer heterosexual homosexual",
    "immigrant immigrants refugee refugees foreigner foreigners citizen citizens migrant migrants",
    "mexican chinese french german spanish russian american turkish polish",
    "disabled deaf blind elderly old young",
    "frauen männer mädchen jungen menschen",
    "muslime christen juden hindus buddhisten",
    "femmes hommes filles garçons gens",
    "musulmans chrétiens juifs hindous bouddhistes",
    "mujeres hombres niñas niños personas",
    "musulmanes cristianos judíos hindúes budistas",
)
GROUP = {w: line.split() for line in IDENTITY for w in line.split()}
_SWAP = pa.struct([("gone", pa.list_(pa.string())), ("come", pa.list_(pa.string()))])
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) >= k)]


@dataclass
class Model:
    """Weights by feature, and the score of a text without any."""

    bias: float
    weights: dict[str, float]
    base: float | None = None
    kept: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False, compare=False)

    def logit(self, text: str) -> float:
        kept, weights, found = self.kept, self.weights, set()
        for word in words_of(text):
            own = kept.get(word)
            if own is None:
                own = tuple(f for f in features_of(word) if f in weights)
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                kept[word] = own
            if own:
                found.update(own)
        return self.bias + sum(weights[f] for f in sorted(found))

    def score(self, text: str) -> float:
        if self.base is not None:
            return self.base
        z = self.logit(text)
        return float(1 / (1 + np.exp(-z))) if z >= 0 else float(np.exp(z) / (1 + np.exp(z)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(toxic, features, swaps) of the rows that may be learned from, about `sample`; the id isn't kept.

    swaps has, for each identity term of a text and each other term of its group, the features that go and those that come.
    """
    one = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    one = one.agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out(F.col("label_id")))
    n = one.count()
    if n > sample:
        share = int(2**31 * sample / n)
        one = one.where(F.pmod(F.xxhash64("label_id"), F.lit(2**31)) < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(stored(one), "label_id").dropDuplicates(["label_id"]).select("toxic", "text")
    schema = pa.schema([("toxic", pa.int32()), ("features", pa.list_(pa.string())), ("swaps", pa.list_(_SWAP))])

    def run(batches):
        begin("toxicity sample")
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [words_of(t) for t in part["text"].to_pylist()]
                own, swaps = zip(*map(with_swaps, found))
                yield batch_of(schema, {"toxic": part["toxic"], "features": own, "swaps": swaps})

    return rows.mapInArrow(run, "toxic int, features array<string>, swaps array<struct<gone:array<string>,come:array<string>>>")


def with_swaps(words: set[str]) -> tuple[list[str], list[dict[str, list[str]]]]:
    """The features of a text's words, and what each swap of an identity term takes from them and adds."""
    count = Counter(f for w in words for f in features_of(w))
    swaps = []
    for w in sorted(words & GROUP.keys()):
        for other in GROUP[w]:
            if other != w:
                new = features_of(other)
                gone = [f for f in features_of(w) if count[f] == 1 and f not in new]
                swaps.append({"gone": sorted(gone), "come": sorted(f for f in new if f not in count)})
    return sorted(count), swaps


def choose(rows: DataFrame, features: int) -> list[str]:
    """The features whose presence explains the labels best, by log likelihood; identity terms too."""
    n = rows.groupBy("toxic").count()
    totals = {r["toxic"]: r["count"] for r in n.collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    counts = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    total = max(1, pos + neg)
    a, here = F.col("a").cast("double"), F.col("n").cast("double")

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    gain = sum(
        term(seen, with_it * (of / total))
        for seen, with_it, of in ((a, here, pos), (here - a, here, neg), (pos - a, total - here, pos), (neg - here + a, total - here, neg))
    )
    best = counts.select("f", gain.alias("gain")).where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "f").limit(features)
    return sorted({r["f"] for r in best.collect()} | {f for w in GROUP for f in features_of(w)})


def _sparse(rows: list) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate([np.empty(0, np.int32), *(np.asarray(r, dtype=np.int32) for r in rows)])
    return np.repeat(np.arange(len(rows), dtype=np.int32), lengths), flat


Swap = tuple[int, list[int], list[int]]


def descend(y: np.ndarray, rows: list[np.ndarray], swapped: list[Swap], n_features: int, fair: float, ridge: float, steps: int = 150, rate: float = 0.2) -> tuple[float, np.ndarray]:
    """Bias and weights: log loss, toxic rows counting by the root of the labels' ratio, plus `fair` times the mean squared change of the score
    between a row and its swapped versions, plus `ridge` times the squared weights. A swap is (row, features that go, those that come)."""
    r, c = _sparse(rows)
    sr, sc = _sparse([gone + come for _, gone, come in swapped])
    sign = np.array([s for _, gone, come in swapped for s in [-1.0] * len(gone) + [1.0] * len(come)])
    of = np.array([i for i, _, _ in swapped], dtype=np.int64)
    weight = np.where(y == 1, np.sqrt(max(1, (y == 0).sum()) / max(1, (y == 1).sum())), 1.0)
    weight /= max(1, weight.sum())
    w, bias = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        z = np.bincount(r, w[c], len(rows)) + bias
        p = sigma(z)
        g = weight * (p - y)
        if len(of):
            q = sigma(z[of] + np.bincount(sr, sign * w[sc], len(of)))
            change = 2 * fair / len(of) * (p[of] - q)
            gs = -change * q * (1 - q)
            g += np.bincount(of, change * p[of] * (1 - p[of]) + gs, len(rows))
        grad = np.append(np.bincount(c, g[r], n_features) + 2 * ridge * w, g.sum())
        if len(of):
            grad[:-1] += np.bincount(sc, sign * gs[sr], n_features)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return float(bias), w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, fair: float = 1.0, ridge: float = 1e-4) -> Model:
    """A model from the labelled rows that aren't held out."""
    rows = stored(labelled(docs, labels, sample))
    chosen = choose(rows, features)
    place = {f: k for k, f in enumerate(chosen)}
    schema = pa.schema([("toxic", pa.int32()), ("own", pa.binary()), ("swapped", pa.list_(pa.list_(pa.int32())))])

    def run(batches):
        numbers = lambda fs: [place[f] for f in fs if f in place]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                own = [np.array(numbers(fs), "<i4").tobytes() for fs in part["features"].to_pylist()]
                swapped = [[numbers(s[side]) for s in swaps for side in ("gone", "come")] for swaps in part["swaps"].to_pylist()]
                yield batch_of(schema, {"toxic": part["toxic"], "own": own, "swapped": swapped})

    got = rows.mapInArrow(run, "toxic int, own binary, swapped array<array<int>>").collect()
    got.sort(key=lambda r: (r["toxic"], r["own"]))  # so that the sums don't depend on how rows are dealt
    y = np.array([r["toxic"] for r in got], dtype=np.float64)
    if not len(y):
        return Model(0.0, {}, 0.0)
    if y.min() == y.max():
        return Model(0.0, {}, float((y.sum() + 0.5) / (len(y) + 1)))
    swapped = [(k, gone, come) for k, r in enumerate(got) for gone, come in zip(r["swapped"][::2], r["swapped"][1::2])]
    bias, w = descend(y, [np.frombuffer(r["own"], "<i4") for r in got], swapped, len(chosen), fair, ridge)
    return Model(bias, {f: float(x) for f, x in zip(chosen, w) if abs(x) > 1e-6})


def _scores(model: Model, texts: pa.Array) -> list[float]:
    """The scores of a batch; its texts become Python strings a few at a time."""
    return [model.score(t or "") for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs."""
    model = model or fit(docs, labels)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        begin("toxicity")
        for batch in batches:
            yield batch_of(schema, {"doc_id": batch["doc_id"], "score": _scores(model, batch["text"])})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """docs without the rows whose score is 0.5 or more."""
    model = model or fit(docs, labels)

    def run(batches):
        begin("toxicity")
        for batch in batches:
            yield batch.filter(pa.array([s < 0.5 for s in _scores(model, batch["text"])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
