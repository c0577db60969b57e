"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is lower-cased; its features are the byte 1- to 4-grams of its letters' words, with the word bounds,
hashed into BUCKETS rows of an embedding. The mean of their embeddings goes through a linear softmax. Both
layers are trained together by minibatch stochastic gradient descent.

Calibration. A part of the training rows (by hash) is kept from the fit. On it, and on its first 1, 3 and 10
words as texts of their own, a temperature is found for the softmax by number of features (LENGTHS), with
smoothed targets, so that a score tells how often such a text is right. The rejection bound is the least
score at which what is accepted is right in at least PRECISION of the cases, whatever this rejects, and at least
the least score of a right text among the whole texts kept from the fit: a text less sure than any of these
(key mash, random letters) is rejected. With no such score all texts are. A language never taught that shares its
letters with a taught one can score higher. A text without letters is always rejected (`und`, score 0).

Bound: at most PER_LANG labelled documents of each language are taught, and of all languages together at most
MAX_TRAINING (equal parts; one of each where there are more languages), those with the least hash of their id.
Everything else covers all rows and whole texts.

Edge cases: a null text, one that is empty and one without a letter get `und`. A very long text is worked on whole, and
is one row of at most BUCKETS numbers where it is taught. Rows without a language aren't learned from, nor are those
without a doc_id, which are not held out; of rows that repeat a doc_id and language, the least text is. Of equally
likely languages the first in alphabetical order is told. An empty table gives no rows. With no labelled row all texts
are rejected; with one language all others get it. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .storage import ship

BUCKETS, DIM, GRAMS = 1 << 14, 16, (1, 2, 3, 4)
PER_LANG, MAX_TRAINING, SALTS = 1280, 12_800, 64
PRECISION = 0.98
#: Bounds between the numbers of features that have a temperature of their own.
LENGTHS = (24, 96, 384)
#: Words of the texts' heads that are calibrated on besides the whole texts.
HEADS = (1, 3, 10)
UNKNOWN = "und"
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

#: ASCII letters (lower case) and the bytes of non-ASCII characters.
_LETTERS = tc.byte_class([(0x61, 0x7A), (0x80, 0xFF)])


def _features(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, document of each feature, bucket) for some documents at a time; features in any order."""
    data, offsets = tc.utf8(pa.compute.utf8_lower(text) if not pa.types.is_binary(text.type) else text)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + tc.CHUNK_BYTES // 2, "right")) - 1)
        part, own = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        letter = _LETTERS[part]
        # One space for each run of other bytes: words with their bounds.
        value = np.where(letter, part, 0x20).astype(np.uint64)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        doc = np.repeat(np.arange(end - row), np.diff(own))
        value, doc = value[keep], doc[keep]
        docs, buckets = [], []
        acc = np.zeros(len(value), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            m = len(value) - n + 1
            if m <= 0:
                break
            acc = acc[:m] * np.uint64(257) + value[n - 1 : n - 1 + m] + np.uint64(1)
            if n in GRAMS:
                same = doc[:m] == doc[n - 1 : n - 1 + m]
                h = (acc + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKETS.bit_length() + 1)
                docs.append(doc[:m][same])
                buckets.append(h[same].astype(np.int32))
        yield row, np.concatenate(docs) if docs else np.zeros(0, np.int64), np.concatenate(buckets) if buckets else np.zeros(0, np.int32)
        row = end


@dataclass(frozen=True)
class LanguageModel:
    """Log-odds of each bucket (the two layers multiplied out), biases, and the calibration."""

    langs: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: np.ndarray = field(default_factory=lambda: np.ones(len(LENGTHS) + 1))
    bound: float = 0.0

    def logits(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the number of features they rest on."""
        out, features = np.zeros((len(text), len(self.langs))), np.zeros(len(text), np.int64)
        for row, doc, bucket in _features(text):
            n = int(doc.max()) + 1 if len(doc) else 0
            features[row : row + n] = np.bincount(doc, minlength=n)
            count = np.maximum(features[row : row + n], 1)
            for k in range(len(self.langs)):
                out[row : row + n, k] = np.bincount(doc, self.weights[bucket, k], n) / count
        return out + self.bias, features

    def probabilities(self, logits: np.ndarray, features: np.ndarray) -> np.ndarray:
        z = logits / self.temperature[np.searchsorted(LENGTHS, features, "right")][:, None]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, per_lang: int = PER_LANG, most: int = MAX_TRAINING) -> DataFrame:
    """(lang, text, part): at most per_lang rows of each language; part 0 of 5 calibrates, and -1 are its heads.

    The bound is split over SALTS classes of the hash, so that a frequent language is not ranked in one task.
    """
    some = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = some.select("lang").distinct().count()
    per_lang = max(1, min(per_lang, most // max(1, langs)))
    salts = min(SALTS, per_lang)
    # Rows that repeat a doc_id count once.
    ranked = some.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct().withColumn("salt", F.pmod("h", F.lit(salts)))
    ranked = ranked.withColumn("i", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "doc_id"))).where(F.col("i") <= per_lang // salts)
    chosen = ranked.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)).cast("int").alias("part"))
    # At most MAX_TRAINING short rows, or one of each language: bounded. One text for each, so that a doc_id with many rows stays within the bound.
    rows = some.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang", "part").agg(F.min("text").alias("text"))
    heads = F.array(*(F.array_join(F.slice(F.split("text", r"\s+"), 1, k), " ") for k in HEADS))
    whole = F.struct("text", "part")
    return rows.select("lang", F.explode(F.when(F.col("part") == 0, F.concat(F.array(whole), F.transform(heads, lambda t: F.struct(t.alias("text"), F.lit(-1).alias("part"))))).otherwise(F.array(whole))).alias("x")).select("lang", "x.text", "x.part")


def _sparse(rows: DataFrame) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(lang, part, buckets, counts) of each row, made on the executors: at most BUCKETS numbers for a text of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, bucket in _features(batch.column(1)):
                n = int(doc.max()) + 1 if len(doc) else 0
                keys, counts = np.unique(doc * BUCKETS + bucket, return_counts=True)
                per = np.bincount(keys // BUCKETS, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row : row + n], batch.column(2)[row : row + n], tc.list_array((keys % BUCKETS).astype(np.int32), per), tc.list_array(counts.astype(np.int32), per)], ["lang", "part", "buckets", "counts"]
                )

    table = rows.mapInArrow(run, "lang string, part int, buckets array<int>, counts array<int>").toArrow()
    order = sorted(range(table.num_rows), key=lambda i: (table["lang"][i].as_py(), len(table["buckets"][i].values or []), (table["buckets"][i].values.to_numpy().tobytes() if len(table["buckets"][i]) else b"")))
    return [(table["lang"][i].as_py(), table["part"][i].as_py(), table["buckets"][i].values.to_numpy(), table["counts"][i].values.to_numpy().astype(np.float32)) for i in order if len(table["buckets"][i])]


def fit(docs: DataFrame, per_lang: int = PER_LANG, epochs: int = 12, least_steps: int = 1000, rate: float = 2.0, batch: int = 32, seed: int = 7) -> LanguageModel | None:
    """Train and calibrate on the documents that may be learned from."""
    ship(docs.sparkSession)
    rows = _sparse(training_rows(docs, per_lang))
    langs = tuple(sorted({r[0] for r in rows}))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    code = {x: i for i, x in enumerate(langs)}
    teach = [r for r in rows if r[1] > 0] or rows
    check = [r for r in rows if r[1] <= 0] or rows
    size = np.bincount([code[r[0]] for r in teach], minlength=len(langs))
    weight = len(teach) / np.maximum(size, 1) / len(langs)  # each language counts alike
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    epochs = max(epochs, -(-least_steps * batch // len(teach)))
    steps, done = epochs * len(teach), 0
    for _ in range(epochs):
        order = rng.permutation(len(teach))
        for i in range(0, len(order), batch):
            part = [teach[j] for j in order[i : i + batch]]
            step = rate * (1 - done / steps)
            done += len(part)
            flat = np.concatenate([r[2] for r in part])
            share = np.concatenate([r[3] / r[3].sum() for r in part])
            doc = np.repeat(np.arange(len(part)), [len(r[2]) for r in part])
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            mean = np.add.reduceat(emb[flat] * share[:, None], first)
            z = mean @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            y = np.array([code[r[0]] for r in part])
            p[np.arange(len(part)), y] -= 1
            p *= (weight[y] / len(part))[:, None].astype(np.float32)
            back = p @ out.T
            out -= step * (mean.T @ p)
            bias -= step * p.sum(0)
            np.subtract.at(emb, flat, (step * 8) * back[doc] * share[:, None])
    weights = emb @ out
    z = np.stack([(weights[r[2]] * (r[3] / r[3].sum())[:, None]).sum(0) + bias for r in check])
    y = np.array([code[r[0]] for r in check])

    features = np.array([int(r[3].sum()) for r in check])
    whole = np.array([r[1] != -1 for r in check])
    kind = np.searchsorted(LENGTHS, features, "right")
    temperature = np.ones(len(LENGTHS) + 1)
    for k in range(len(temperature)):
        zs, ys = z[kind == k], y[kind == k]
        if not len(ys):
            continue
        target = np.full(zs.shape, 1 / (len(ys) + 2) / max(1, len(langs) - 1))
        target[np.arange(len(ys)), ys] = 1 - 1 / (len(ys) + 2)

        def loss(t: float, zs: np.ndarray = zs, target: np.ndarray = target) -> float:
            s = zs / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - (s * target).sum(1)).mean())

        temperature[k] = min(np.geomspace(0.02, 50, 121), key=loss)
    model = LanguageModel(langs, weights, bias, temperature)
    p = model.probabilities(z[whole], features[whole])
    top, good = p.max(1), p.argmax(1) == y[whole]
    order = np.argsort(-top, kind="stable")
    precise = np.flatnonzero(np.cumsum(good[order]) / np.arange(1, len(top) + 1) >= PRECISION)
    bound = max(float(top[order][precise[-1]]), float(top[good].min())) if len(precise) else np.inf
    # A hair lower: the same text's score is summed in another order later.
    return LanguageModel(langs, weights, bias, temperature, bound - 1e-6)


def detector(model: LanguageModel | None):
    """A column function text -> (lang, score, rejected): the likeliest language even if it is rejected."""

    def detect(text: pa.Array) -> pa.Array:
        # has_letter: any character that Unicode calls a letter
        letter = np.array([any(map(str.isalpha, t)) if t else False for t in text.to_pylist()])
        if model is None:
            lang, score, rejected = np.full(len(text), UNKNOWN, object), np.zeros(len(text)), np.ones(len(text), bool)
        else:
            p = model.probabilities(*model.logits(text))
            score, lang = p.max(1), np.array(model.langs, object)[p.argmax(1)]
            lang[~letter], score[~letter] = UNKNOWN, 0.0
            rejected = ~letter | (score < model.bound)
            tc.relax()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], ["lang", "score", "rejected"])

    return F.arrow_udf(detect, RESULT).asNondeterministic()


def with_language(spark: SparkSession, docs: DataFrame, train: DataFrame, name: str = "language") -> DataFrame:
    """docs with a struct column `name`: lang, score, rejected; learned from the part of train that may be."""
    ship(spark)
    return docs.withColumn(name, detector(fit(train))(F.col("text")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = with_language(spark, docs.select("doc_id", "text"), docs)
    x = F.col("language")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), x["lang"].alias("lang_pred"), x["score"].alias("score"), x["rejected"].alias("rejected"))
