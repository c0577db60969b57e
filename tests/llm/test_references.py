"""Operators that SQL does not express, against slow plain versions of them."""

import collections
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import LONG, SPACE, brute_spans, texts_of
from tributary.llm import decontamination, language, near_duplicates, personal, pieces, sharding, toxicity
from tributary.llm import textcore as tc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


# Merge-dropout: every candidate is put to its own draw once; the best that was not skipped is taken, the leftmost of equals.


def plain_merge(sp, unit, key, limit):
    scores = {sp.id_to_piece(i): (-sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    symbols = [(i, i + 1) for i in range(len(unit))]
    name = lambda a, b: unit[a:b].replace(" ", "▁")
    while True:
        best = None
        for (a, m), (_, b) in zip(symbols, symbols[1:]):
            if name(a, b) not in scores or (unit[a:b] != " " and "▁" in unit[a:b]):
                continue
            place = tc.mix(np.array([a], np.uint64) * pieces._A ^ np.array([m], np.uint64) * pieces._B ^ np.array([b], np.uint64) * pieces._C)
            if tc.mix(np.array([key], np.uint64) ^ place)[0] < limit:
                continue
            if best is None or scores[name(a, b)] < best[0]:
                best = (scores[name(a, b)], a, m, b)
        if best is None:
            return [unit[a:b] for a, b in symbols]
        _, a, m, b = best
        symbols = [(x, y) for x, y in symbols if (x, y) not in ((a, m), (m, b))] + [(a, b)]
        symbols.sort()


def test_merge_dropout_against_a_plain_loop():
    if not os.path.exists(pieces.MODEL):
        pytest.skip("no vocabulary here")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    vocabulary = pieces.Vocabulary.load()
    draw = random.Random(11)
    words = [" " + "".join(draw.choice("aeiourstnlcd") for _ in range(draw.randint(1, 14))) for _ in range(60)] + [" the", " internationalization", "thethethe", " café", "\n", "   x"]
    for dropout in (0.1, 0.5):
        e = pieces.Encoder(vocabulary, dropout)
        for k, w in enumerate(words):
            key = int(e.keys_of(k, 1)[0])
            got = [vocabulary.pieces[i].decode() for i in np.frombuffer(e.encode_many([w], np.array([key], np.uint64))[0], np.int32)] if "é" not in w else None
            if got is not None and all(c in vocabulary.chars for c in w):
                assert got == plain_merge(sp, w, key, e.limit), (w, dropout)


def test_dropout_skips_its_share():
    """Words of two characters that are one piece have one candidate: a tenth of their occurrences keeps them apart."""
    if not os.path.exists(pieces.MODEL):
        pytest.skip("no vocabulary here")
    e = pieces.Encoder(pieces.Vocabulary.load(), 0.1)
    n = sum(len(x) > 1 for x in e.encode(["a"] * 20_000, list(range(20_000))))
    assert 0.09 < n / 20_000 < 0.11


# Disclosure.


def plain_disclosure(texts):
    """(text, start, end) -> kind of the disclosing terms, from sums over different texts."""
    texts = sorted({t for t in texts if t is not None})
    entities, terms = {}, {}
    for t in texts:
        spans = brute_spans(t)
        entities[t] = {personal._entity(k, t[a:b]) for a, k, b in spans}
        terms[t] = {}
        for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", t):
            if not any(a < m.end() and m.start() < b for a, _, b in spans):
                terms[t].setdefault(lower(m.group()), []).append(m.span())
    n_e, n_t, n_te = collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        words = set(map(lower, re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t)))
        n_t.update(words)
        n_e.update(entities[t])
        n_te.update((e, w) for e in entities[t] for w in terms[t])
    kinds = {}
    for (e, w), n in n_te.items():
        if n >= personal.MIN_CONTEXTS and n_e[e] >= personal.MIN_CONTEXTS and n_e[e] < len(texts):
            p = n_e[e] / len(texts)
            disclosure = math.log(n / n_t[w] / p) / -math.log(p)
            if disclosure >= personal.GENERALISE:
                kinds[e, w] = 5 if disclosure >= personal.REMOVE else 4
    out = {}
    for t in texts:
        for w, places in terms[t].items():
            found = [kinds[e, w] for e in entities[t] if (e, w) in kinds]
            for a, b in places if found else ():
                out[t, a, b] = max(found)
    return out


def test_disclosure_against_plain_sums(spark, data):
    draw = random.Random(3)
    people = [(f"p{i}@mail{i}.example.org", f"Name{chr(97 + i)}son") for i in range(12)]
    made = []
    for i in range(400):
        words = [f"word{draw.randint(0, 60)}" for _ in range(draw.randint(3, 25))]
        if i % 3 == 0:
            mail, name = draw.choice(people)
            words.insert(draw.randint(0, len(words)), mail)
            if draw.random() < 0.8:
                words.insert(draw.randint(0, len(words)), name)
        elif i % 10 == 1:
            words.append(draw.choice(people)[1])
        made.append(" ".join(words))
    made += made[:40]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()] + [(10_000 + i, t) for i, t in enumerate(made)]
    want = plain_disclosure([t for _, t in rows])
    assert len({k for k in want.values()}) == 2
    got, texts = {}, dict(rows)
    for r in personal.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.update({(texts[r.doc_id], s.a, s.b): s.kind for s in r.spans if s.kind >= 4})
    assert got == want


# Sharding: the splitters by sorting all keys on the driver.


def test_splitters_against_sorted_keys(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    hot = docs.unionByName(spark.range(300).select((F.col("id") + 5000).alias("doc_id"), F.lit("the same text " * 40).alias("text"))).unionByName(spark.createDataFrame([(9000, None), (9001, ""), (None, "x")], "doc_id long, text string"))
    keyed = hot.withColumns({"key": F.xxhash64(F.coalesce("text", F.lit(""))), "tie": F.xxhash64(F.lit("tie"), F.col("doc_id").cast("string"))})
    rows = sharding.shard(keyed).collect()
    unsigned = lambda x: x % (1 << 64)
    rows.sort(key=lambda r: (unsigned(r.key), unsigned(r.tie)))
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)  # the order of keys is that of shards
    total, below = sum(r.size for r in rows), 0
    slack = int(sharding.TOLERANCE * total / 8)
    at = {}
    for r in rows:
        at.setdefault(r.shard, below)
        below += r.size
    for i in range(1, 8):
        target, edge = total * i // 8, at.get(i, below)
        # No other place of the order is nearer by more than the tolerance or the row that lies across.
        assert abs(edge - target) <= slack + max(r.size for r in rows if r.shard in (i - 1, i))
    spread = collections.defaultdict(set)
    for r in rows:
        spread[r.text or ""].add(r.shard)
    split = [t for t, s in spread.items() if len(s) > 1]
    assert all(sum(r.size for r in rows if (r.text or "") == t) > slack for t in split) and len(spread[""]) == 1


def test_operators_at_one_third_of_one_text(spark):
    """A text with a third of all rows, and a doc_id with half of them: every row is answered once, whatever the operator."""
    from tributary.llm import fingerprints

    rows = [(i if i % 2 else 7, "the same words stand here again and again" if i % 3 == 0 else f"text {i} of its own with number {i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.fingerprint(df).select("doc_id", "text", "edited_text").collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    # Of the rows in the order of the search each takes the start of the next one's text.
    order = sorted(((i is not None, i), h, t) for i, h, t in ((r.doc_id, r.h, r.text) for r in df.withColumn("h", F.xxhash64("text")).collect()))[::-1]
    want = collections.Counter()
    for (key, _, t), (_, _, following) in zip(order, [*order[1:], order[0]]):
        want[key[1], t, t[: len(t) - len(t) // 2] + following[: len(t) // 2]] += 1
    assert collections.Counter((r.doc_id, r.text, r.edited_text) for r in got) == want


# Trained models: held-out accuracy.


def test_toxicity_held_out(spark, data):
    folder = data.replace("sf0.001", "sf0.1")
    if not os.path.isdir(folder):
        pytest.skip("no larger tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL AND quality IS NOT NULL")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    scored = toxicity.with_toxicity(spark, docs.join(labels.where(~half).select("doc_id"), "doc_id", "left_semi"), labels.where("false"))
    assert scored.where("toxicity.toxic").count() == 0
    chain = toxicity.fit(docs, labels.where(half))
    rows = docs.join(labels.where(~half), "doc_id").select("toxic", toxicity.scorer(chain)(F.col("text")).alias("x")).select("toxic", F.col("x.toxic").alias("called")).collect()
    right = sum(r.toxic == 1 and r.called for r in rows)
    assert right / sum(r.called for r in rows) > 0.85 and right / sum(r.toxic == 1 for r in rows) > 0.85


def test_folds_have_no_say_in_their_own_features(spark):
    """Words that are only in one fold's bad documents are never chosen for it."""
    bags = toxicity.Bags(np.arange(3, dtype=np.uint64), np.zeros((3, toxicity.FOLDS, 2), np.int64), np.full((toxicity.FOLDS, 2), 50), np.zeros(0, int), np.zeros(0, int), 0)
    bags.counts[0, 2, 1] = 40
    bags.counts[1, :, 1] = 40
    assert bags.choose(0, 2).tolist() == [1] and bags.choose(0, None).tolist() == [0, 1]


def test_a_hundred_languages(spark):
    """No bound on languages: a small part of each is taught, all can be told."""
    draw = random.Random(2)
    alphabet = [chr(0x4E00 + i) for i in range(400)]
    rows = [(i, " ".join("".join(draw.choices(alphabet[4 * (i % 100) : 4 * (i % 100) + 4], k=6)) for _ in range(12)), f"l{i % 100:03}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = language.training_rows(docs, most=1200).where("part >= 0")
    assert taught.count() <= 1200 and taught.select("lang").distinct().count() == 100
    out = docs.select("lang", language.detector(language.fit(docs))(F.col("text")).alias("x")).select("lang", "x.lang").toDF("truth", "lang").collect()
    assert sum(r.truth == r.lang for r in out) > 0.95 * len(out)


# The pipeline's stages from the texts alone.


def plain_contaminated(texts, items):
    windows = {}
    for item in items:
        w = WORD.findall(lower(item))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(min(13, len(w)), set()).add(tuple(w[i : i + 13]))
    out = {}
    for key, t in texts.items():
        w, hit = WORD.findall(lower(t)), set()
        for n, known in windows.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
        out[key] = bool(hit) and 20 * len(hit) >= len(w)
    return out


def test_pipeline_stages_against_texts(spark, data):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = texts_of(docs)
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    left = {r.doc_id for r in stages["decontamination"](spark, docs, data).collect()}
    bad = plain_contaminated(texts, items)
    assert left == {i for i, b in bad.items() if not b} and any(bad.values())
    disclosed = plain_disclosure(texts.values())
    for r in stages["personal"](spark, docs, data).select("doc_id", "text", "n_chars").collect():
        t = texts[r.doc_id]
        spans = sorted(brute_spans(t) + [(a, k, b) for (x, a, b), k in disclosed.items() if x == t])
        out, done = [], 0
        for a, k, b in spans:
            if a >= done:
                out += [t[done:a], ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<NUMBER>" if re.search(r"\d", t[a:b]) else "<WORD>", "")[k]]
            done = max(done, b)
        assert r.text == "".join(out) + t[done:] and r.n_chars == len(r.text)


def test_recall_of_near_copies(spark, data):
    """Copies with some words changed: every link of the similarity or more is found; what the tests of others plant may be below it."""
    draw = random.Random(9)
    base = [" ".join(draw.choice(LONG.split()) + str(i) for _ in range(draw.randint(40, 300))) for i in range(60)]
    rows, want = [], {}
    for i, t in enumerate(base):
        w = t.split()
        for share in (0.0, 0.005, 0.01, 0.02, 0.03):
            v = list(w)
            for k in range(len(v)):
                if draw.random() < share:
                    v[k] = f"changed{draw.randint(0, 9**6)}"
            rows.append((len(rows), " ".join(v)))
            a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (w, SPACE.findall(rows[-1][1])))
            want[rows[-1][0]] = len(a & b) / len(a | b) >= 0.8
    classes = {r.doc_id: r.class_id for r in near_duplicates.link(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for i in want if want[i]]
    found = sum(classes[i] == i // 5 * 5 for i in linked)
    assert found >= 0.999 * len(linked) and len(linked) < len(rows)


def test_decontamination_odd_items(spark):
    """Items without an id hit words and are in no list; ids of any type; several blocks are counted in one pass."""
    docs = spark.createDataFrame([(1, "x y z a b c d"), (2, None), (None, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([("q-1", "x y"), (None, "a b c"), ("q-1", "d"), (None, None)], "item_id string, text string")
    for block in (1, 50_000):
        got = {r.doc_id: r.contamination for r in decontamination.with_contamination(spark, docs, items, block=block).collect()}
        assert (got[1].n_hit, list(got[1]["items"]), got[1].hits) == (6, ["q-1"], [[0, 2], [3, 7]]) and got[None].n_hit == 3 and list(got[None]["items"]) == [] and got[2].n_words == 0
