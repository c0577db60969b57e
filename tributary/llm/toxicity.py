"""Toxicity by a classifier chain: linear models for one category after the other.

The features of a text are its words (ASCII letters lower-cased) and their heads and tails of EDGES bytes, so that
derived forms of a word count; presence only, so that the length of a text does not dilute them. Each category's
model is a logistic regression over the MAX_FEATURES features whose presence differs most between the classes
(counted by Spark over all taught documents; a fold that is left out has no say in its choice), and over the log-odds of the
categories before it. For training
these probabilities are out-of-fold: each fold's come from models that haven't seen it, so that a later model
learns how far to trust an earlier one. The decision bounds are those of the best F1 out of fold.

Bound: at most MAX_TRAINING labelled documents are taught, those with the least hash of their id. Scoring covers
all rows and whole texts.

Edge cases: a null or empty text has no word: it gets the models' base rates and is never called toxic. A very long
text is one chunk of a worker's memory. Repeated labels of a document count as one, with any category that one of them
has; of rows that repeat a doc_id, the least text is taught, and all are answered, those without a doc_id too. Null
labels aren't learned from. Of equally telling features the least hash is taken; a score at the bound is called. With
no labels, or one class only, a category's probability is its rate and nothing is called. An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .storage import Workspace, ship

MAX_TRAINING, MAX_FEATURES, FOLDS, RIDGE, LEAST_Z = 20_000, 192, 5, 1.0, 4.0
EDGES = (5, 6, 7)
#: Taught documents that a feature must be in: fewer have too little to say.
LEAST = 5
#: The chain, in order, as conditions on a labels row.
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


def _distinct(words: tc.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of a chunk's documents, and the document of each."""
    h, doc = [words.hashes(9)], [words.doc_of()]
    starts, ends = words.starts, words.ends
    for mark, k in ((m, k) for k in EDGES for m in (0, 1)):
        long = np.flatnonzero(ends - starts > k)
        words.starts, words.ends = (starts[long], starts[long] + k) if mark == 0 else (ends[long] - k, ends[long])
        h.append(tc.mix(words.hashes(9) + np.uint64(k * 2 + mark + 1)))
        doc.append(doc[0][long])
    words.starts, words.ends = starts, ends
    flat, own = np.concatenate(h), np.concatenate(doc)
    order = np.lexsort((flat, own))
    flat, own = flat[order], own[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (own[1:] != own[:-1])
    return flat[new], own[new]


@dataclass(frozen=True)
class Linear:
    """A logistic regression: features (sorted word hashes), their weights, those of earlier log-odds, bias."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logit(self, present: np.ndarray, before: np.ndarray) -> np.ndarray:
        return present @ self.weights + before @ self.earlier + self.bias


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Bags:
    """The training documents: fold and labels of each, and which of the candidate features it has.

    counts: for each candidate, the documents that have it by fold and label bits; totals: all documents so.
    """

    vocabulary: np.ndarray
    counts: np.ndarray
    totals: np.ndarray
    doc: np.ndarray
    col: np.ndarray
    n: int

    def choose(self, category: int, without: int | None, most: int = MAX_FEATURES) -> np.ndarray:
        """The features whose presence differs most between the classes outside a fold, by a two-sample z."""
        bits = np.arange(self.totals.shape[1]) >> category & 1 == 1
        use = [k for k in range(FOLDS) if k != without]
        a, b = (self.counts[:, use][:, :, m].sum((1, 2)) for m in (bits, ~bits))
        n1, n0 = (max(1, int(self.totals[use][:, m].sum())) for m in (bits, ~bits))
        p = (a + b + 1) / (n1 + n0 + 2)
        z = np.where(a + b >= LEAST, np.abs((a + 0.5) / (n1 + 1) - (b + 0.5) / (n0 + 1)) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)), 0.0)
        best = np.argsort(-z, kind="stable")[:most]
        return np.sort(best[z[best] >= LEAST_Z])

    def matrix(self, chosen: np.ndarray) -> np.ndarray:
        place = np.full(len(self.vocabulary), -1)
        place[chosen] = np.arange(len(chosen))
        col = place[self.col]
        x = np.zeros((self.n, len(chosen)), np.float64)
        x[self.doc[col >= 0], col[col >= 0]] = 1
        return x


def fit_linear(bags: Bags, category: int, y: np.ndarray, before: np.ndarray, fold: np.ndarray, without: int | None) -> tuple[Linear, np.ndarray]:
    """A ridge logistic regression by Newton steps on all folds but one, and its log-odds for all documents."""
    chosen, rows = bags.choose(category, without), fold != (-1 if without is None else without)
    x = np.hstack([bags.matrix(chosen), before, np.ones((bags.n, 1))])
    xs, ys = x[rows], y[rows].astype(float)
    w = np.zeros(x.shape[1])
    w[-1] = _logit(np.array([(ys.sum() + 0.5) / (len(ys) + 1)]))[0]
    if 0 < ys.sum() < len(ys):
        penalty = np.full(x.shape[1], RIDGE)
        penalty[-1] = 1e-6
        for _ in range(12):
            p = _sigmoid(xs @ w)
            step = np.linalg.solve((xs * (p * (1 - p) + 1e-9)[:, None]).T @ xs + np.diag(penalty), xs.T @ (ys - p) - penalty * w)
            w += step * min(1.0, 8 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-4:
                break
    k = len(chosen)
    return Linear(bags.vocabulary[chosen], w[:k], w[k:-1], float(w[-1])), x @ w


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    models: tuple[Linear, ...]
    bounds: tuple[float, ...]

    def score(self, text: pa.Array) -> np.ndarray:
        """(texts, categories) probabilities."""
        every = np.unique(np.concatenate([m.features for m in self.models])) if self.models else np.zeros(0, np.uint64)
        places = [np.searchsorted(every, m.features) for m in self.models]
        out = np.zeros((len(text), len(self.models)))
        for words in tc.chunks(text, tc.WORD, tc.LOWER):
            h, doc = _distinct(words)
            k = np.minimum(np.searchsorted(every, h), max(0, len(every) - 1))
            good = every[k] == h if len(every) else np.zeros(len(h), bool)
            present = np.zeros((words.docs, len(every)))
            present[doc[good], k[good]] = 1
            before = np.zeros((words.docs, 0))
            for i, m in enumerate(self.models):
                z = m.logit(present[:, places[i]], before)
                out[words.row : words.row + words.docs, i] = _sigmoid(z)
                before = np.hstack([before, z[:, None]])
        return out


def _best_bound(p: np.ndarray, y: np.ndarray) -> float:
    """The bound of the best F1, midway between two scores; above 1 if nothing can be told."""
    if not y.any() or y.all():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    last = np.r_[p[order][1:] != p[order][:-1], True]
    k = int(np.argmax(np.where(last, f1, -1)))
    after = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float((p[order][k] + after) / 2)


def fit(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, str], ...] = CHAIN, most: int = MAX_TRAINING) -> Chain:
    with Workspace(docs.sparkSession, "toxicity") as work:
        found = _fit(work, docs, labels, chain, most)
    work.close()
    return found


def _fit(work: Workspace, docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, str], ...], most: int) -> Chain:
    marks = [F.max(F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in chain]
    known = labels.where("doc_id IS NOT NULL").where(" AND ".join(f"({rule}) IS NOT NULL" for _, rule in chain)).groupBy("doc_id").agg(*marks)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most MAX_TRAINING rows: bounded, so sent to all
    names = [name for name, _ in chain]
    combos = 1 << len(names)
    bits = sum((F.col(n).cast("int") * (1 << i) for i, n in enumerate(names)), F.lit(0))
    taught = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", bits.alias("bits")).agg(F.min("text").alias("text"))
    # At most MAX_TRAINING texts, whatever the number of rows: read three times below, so written once.
    taught = work.save(taught.select("doc_id", "text", "bits", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")), "taught")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(3).to_numpy() * combos + batch.column(2).to_numpy()
            for words in tc.chunks(batch.column(1), tc.WORD, tc.LOWER):
                h, doc = _distinct(words)
                own = kind[words.row + doc]
                order = np.lexsort((h, own))
                h, own = h[order], own[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]) if len(h) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tc.signed(h[first])), pa.array(own[first].astype(np.int32)), pa.array(np.diff(np.append(first, len(h))).astype(np.int64))], ["h", "kind", "n"])

    kinds = range(FOLDS * combos)
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in kinds]
    totals = np.zeros((FOLDS, combos), np.int64)
    for r in taught.groupBy("fold", "bits").count().collect():
        totals[r["fold"], r["bits"]] = r["count"]

    def z(category: int, without: int | None) -> Column:
        """As Bags.choose has it: a fold left out has no say in what is chosen for it."""
        use = [k for k in kinds if k // combos != without]
        on, off = [k for k in use if k >> category & 1], [k for k in use if not k >> category & 1]
        n1, n0 = (max(1, int(totals.ravel()[x].sum())) for x in (on, off))
        a, b = (sum((F.col(f"k{k}") for k in x), F.lit(0)) for x in (on, off))
        p = (a + b + 1) / (n1 + n0 + 2)
        return F.when(a + b >= LEAST, F.abs((a + 0.5) / (n1 + 1) - (b + 0.5) / (n0 + 1)) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)))

    counted = work.save(taught.mapInArrow(count, "h long, kind int, n long").groupBy("h").agg(*sums).where(sum((F.col(f"k{k}") for k in kinds), F.lit(0)) >= LEAST), "counted")
    best = None
    for i in range(len(names)):
        for without in (*range(FOLDS), None):  # at most MAX_FEATURES rows each
            top = counted.withColumn("z", z(i, without)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), F.col("h").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))).limit(MAX_FEATURES).drop("z")
            best = top if best is None else best.unionByName(top)
    best = best.distinct().collect()
    best.sort(key=lambda r: r["h"] % (1 << 64))
    vocabulary = np.array([r["h"] for r in best], np.int64).view(np.uint64)
    counts = np.array([list(r)[1:] for r in best], np.int64).reshape(len(best), FOLDS, combos)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in tc.chunks(batch.column(1), tc.WORD, tc.LOWER):
                h, doc = _distinct(words)
                k = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
                good = vocabulary[k] == h if len(vocabulary) else np.zeros(len(h), bool)
                part = [batch.column(i)[words.row : words.row + words.docs] for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*part, tc.list_array(k[good].astype(np.int32), np.bincount(doc[good], minlength=words.docs))], ["doc_id", "bits", "fold", "found"])

    table = taught.mapInArrow(find, "doc_id long, bits int, fold int, found array<int>").toArrow().sort_by("doc_id").combine_chunks()
    sets = [x.values.to_numpy() for x in table["found"]]
    n = len(sets)
    fold, code = (table[c].to_numpy() for c in ("fold", "bits"))
    bags = Bags(vocabulary, counts, totals, np.repeat(np.arange(n), [len(x) for x in sets]), np.concatenate(sets) if n else np.zeros(0, np.int32), n)
    models, bounds, before = [], [], np.zeros((n, 0))
    for i in range(len(names)):
        y = code >> i & 1 == 1
        fair = np.zeros(n)
        for k in range(FOLDS):
            if (fold == k).any():
                fair[fold == k] = fit_linear(bags, i, y, before, fold, k)[1][fold == k]
        models.append(fit_linear(bags, i, y, before, fold, None)[0])
        bounds.append(_best_bound(_sigmoid(fair), y))
        before = np.hstack([before, fair[:, None]])
    return Chain(tuple(names), tuple(models), tuple(bounds))


def scorer(chain: Chain):
    """A column function text -> struct of probabilities p_<category> and decisions <category>."""
    result = T.StructType([T.StructField(f"p_{n}", T.DoubleType()) for n in chain.names] + [T.StructField(n, T.BooleanType()) for n in chain.names])

    def score(text: pa.Array) -> pa.Array:
        p = chain.score(text)
        some = np.array([bool(t) for t in pa.compute.fill_null(pa.compute.greater(pa.compute.binary_length(text), 0), False).to_pylist()], bool)
        cols = [pa.array(p[:, i]) for i in range(len(chain.names))] + [pa.array((p[:, i] >= chain.bounds[i]) & some) for i in range(len(chain.names))]
        return pa.StructArray.from_arrays(cols, result.fieldNames())

    return F.arrow_udf(score, result).asNondeterministic()


def with_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, name: str = "toxicity") -> DataFrame:
    """docs with a struct column of probabilities and decisions for each category of the chain."""
    ship(spark)
    return docs.withColumn(name, scorer(fit(docs, labels))(F.col("text")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_toxicity(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    x: Column = F.col("toxicity")
    return out.select("doc_id", x["p_low_quality"].alias("p_low_quality"), x["p_toxic"].alias("score"), x["toxic"].alias("toxic"))
