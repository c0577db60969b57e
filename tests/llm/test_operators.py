"""The ten operators against brute force on small tables, and their defined results for odd rows."""

import collections
import hashlib
import itertools
import os
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same
from tributary.llm import decontamination, fingerprints, language, near_duplicates, personal, pieces, queries, sharding, substring, toxicity, url_rules

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * i % 977}" for i in range(6000))
BASE = " ".join(f"b{i}" for i in range(120))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, nulls, empty, blank and long texts, a repeated row; columns that clash with internal names."""
    near = BASE.split()
    near[60] = "changed"
    texts = [BASE, BASE, " ".join(near), None, "", " \n\t", "one", "one", LONG, "pre " + " ".join(BASE.split()[10:75]) + " post", "a b c d e f", LONG + " end", "é漢字 😀 ▁x  y\n\nz", "mail a.b@c.example.org or +1 (988) 555-2485 from 10.0.0.1 card 4111 1111 1111 1111"]
    rows = [(i, t, "en" if t else None, "s", 1, "clash") for i, t in enumerate(texts)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, `__key` string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, data, name):
    assert_same(queries.QUERIES[name](spark, data), queries.ORACLES[name], data)


def test_fingerprints(spark, docs, empty):
    rows = fingerprints.fingerprint(docs).orderBy("doc_id").collect()
    assert len(rows) == docs.count() and fingerprints.fingerprint(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[0].sketch == by[1].sketch and by[3].sketch == by[4].sketch == by[5].sketch == [] and len(by[6].sketch) == 1
    for r in rows:
        if r.doc_id not in (0, 1):  # the repeated row comes between
            n, following = len(r.text), by[(r.doc_id - 1) % 14].text
            assert r.edited_text == r.text[: n - n // 2] + following[: n // 2]
    both = spark.createDataFrame([(by[0].sketch, by[10].sketch)], "a array<string>, b array<string>").select(fingerprints.merge(F.col("a"), F.col("b")).alias("m")).first().m
    one = fingerprints.with_sketch(docs.where("doc_id = 10"), "text", "k").first().k
    assert set(both) <= set(by[0].sketch) | set(one)
    assert fingerprints.fingerprint(docs.where("doc_id = 8")).first().edited_text == LONG[: len(LONG) - len(LONG) // 2] + LONG[: len(LONG) // 2]


def brute_substring(texts, window=50):
    first, words, out = {}, {}, {}
    for i in sorted(texts):
        words[i] = SPACE.findall(texts[i] or "")
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substring(spark, docs, empty, data):
    want = brute_substring(texts_of(docs))
    got = substring.deduplicate(spark, docs).collect()
    assert len(got) == docs.count()
    assert all((r.n_words, r.n_removed, r.kept_text) == want[r.doc_id] for r in got)
    assert substring.deduplicate(spark, empty).count() == 0
    real = spark.read.parquet(f"{data}/documents.parquet")
    want = brute_substring(texts_of(real))
    for batches in (1, 4):
        assert all((r.n_words, r.n_removed, r.kept_text) == want[r.doc_id] for r in substring.deduplicate(spark, real, batches).collect())


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(BASE.split()[20:60])), (2, "A b-C"), (3, None), (4, "--"), (5, "never seen words at all"), (1, "one")], "item_id long, text string")
    for block in (1000, 7):
        rows = {r.doc_id: r.contamination for r in decontamination.with_contamination(spark, docs, items, block=block).collect()}
        assert (rows[0].n_words, rows[0].n_hit, list(rows[0]["items"])) == (120, 40, ["1"])
        assert rows[10].hits == [[0, 3]] and list(rows[10]["items"]) == ["2"] and list(rows[6]["items"]) == ["1"]
        assert rows[3].n_words == rows[4].n_words == 0 and rows[8].n_hit == 0
    assert decontamination.with_contamination(spark, docs, items.where("false")).where("contamination.n_hit > 0").count() == 0
    assert decontamination.with_contamination(spark, empty, items).count() == 0


def test_language(spark, docs, empty, data):
    real = spark.read.parquet(f"{data}/documents.parquet")
    rows = language.with_language(spark, real, real).where(language.held_out(F.col("doc_id"))).select("lang", "language.*").toDF("truth", "lang", "score", "rejected").collect()
    assert sum(r.truth == r.lang for r in rows) >= 0.95 * len(rows) and sum(r.rejected for r in rows) <= 0.02 * len(rows)
    odd = {r.doc_id: r.language for r in language.with_language(spark, docs, real).collect()}
    assert all(odd[i].lang == "und" and odd[i].rejected and odd[i].score == 0 for i in (3, 4, 5)) and odd[8].lang != "und"
    assert language.fit(empty) is None and language.with_language(spark, empty, real).count() == 0
    assert language.with_language(spark, docs, empty).where("NOT language.rejected").count() == 0


def test_language_rejects_random_letters(spark, data):
    """Where the calibration texts are all told rightly there still is a bound, and random letters fall below it."""
    real = spark.read.parquet(f"{data}/documents.parquet")
    draw = random.Random(5)
    noise = spark.createDataFrame([(i, "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400))) for i in range(50)], "doc_id long, text string")
    model = language.fit(real)
    assert model.bound > 0.25
    assert noise.select(language.detector(model)(F.col("text")).alias("x")).where("x.rejected").count() >= 45


def test_hot_doc_id_is_taught_once(spark):
    """One doc_id with most of the rows stays within the training bounds of both classifiers."""
    rows = [(1 if i % 2 else i, f"text number {i} of the hot one", "en") for i in range(2000)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = train.where(~language.held_out(F.col("doc_id"))).select("doc_id").distinct().count()
    assert language.training_rows(train, 10**6).where("part >= 0").count() == known
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 2000, 2)] + [(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in toxicity.with_toxicity(spark, train, labels).collect()} == {r[0] for r in rows}


def brute_links(texts):
    sets, links, parent = {}, collections.Counter(), {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in texts.items():
        w = SPACE.findall(t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    at = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    for a, b in {(a, b) for v in at.values() for a in v for b in v if a < b}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links.update((a, b))
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i in texts}


def test_near_duplicates(spark, docs, empty, data, monkeypatch):
    for df in (docs.dropDuplicates(["doc_id"]), spark.read.parquet(f"{data}/documents.parquet")):
        want = brute_links(texts_of(df))
        assert {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.link(spark, df).collect()} == want
    assert near_duplicates.link(spark, empty).count() == 0
    # One group over many blocks: every pair of distinct near copies counts once.
    monkeypatch.setattr(near_duplicates, "BLOCK_DOCS", 7)
    words = BASE.split()
    group = spark.createDataFrame([(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(0, 60)], "doc_id long, text string")
    assert {(r.class_id, r.n_links) for r in near_duplicates.link(spark, group).collect()} == {(0, 59)}


def test_bands():
    b, r = near_duplicates.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and 1 - (1 - 0.4**r) ** b <= 0.2


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == 2 and not (14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("text", ["a@b@c.de x@y.z@q.rr", "@a.b a@.b a@b. a@b.c-", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4", "4111-1111-1111-1111 4111 1111 1111 1112", "+1 (988) 555-2485+44 20 7946 0958 ++1234567890", "x" * 5000 + "@" + "a." * 3000, "9" * 6000, "ü@b.c ä.a@b.cé"])
def test_base_spans(text):
    assert personal.base_spans(text) == brute_spans(text)


@pytest.mark.parametrize("text", ["no spans", "", "one two a@b.c three 1.2.3.4 four, five six seven eight nine", "+1 (988) 555-2485 x", "t\u00e9 a@b.c\u00e9 z", "a@b.c 10.0.0.1@d.e f", " ".join(f"u{i}@h.example.org w{i}" for i in range(30))])
def test_free_terms(text):
    spans = personal.base_spans(text)
    want = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text) if not any(a < m.end() and m.start() < b for a, _, b in spans)]
    start, end = personal._free_terms(text, spans)
    assert list(zip(start.tolist(), end.tolist())) == want


def test_dense_personal():
    """A text of addresses only takes time in proportion to its length."""
    text = " ".join(f"u{i}@h{i}.example.org" for i in range(50_000))
    spans = personal.base_spans(text)
    began = time.monotonic()
    assert len(personal._free_terms(text, spans)[0]) == 0 and len(spans) == 50_000
    assert time.monotonic() - began < 20


def test_personal(spark, docs, empty, data):
    real = spark.read.parquet(f"{data}/documents.parquet")
    for df in (docs, real):
        texts = texts_of(df)
        rows = personal.find(spark, df).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert [(s.a, s.kind, s.b) for s in r.spans if s.kind < 4] == brute_spans(texts[r.doc_id] or "")
    masked = texts_of(personal.sanitise(spark, docs))
    assert masked[13] == "mail <EMAIL> or <PHONE> from <IP> card <CARD>" and masked[3] is None and masked[8] == LONG
    assert personal.sanitise(spark, empty).columns == empty.columns and personal.find(spark, empty).count() == 0


def test_disclosing_terms(spark):
    """A name that goes with one address in four different contexts gives it away; common words do not."""
    rows = [(i, f"filler{i} words zorbleton k{i}a writes from q@x.example.org about m{i} n{i}") for i in range(4)] + [(100 + i, f"words writes from about plain{i}") for i in range(300)]
    spans = {r.doc_id: r.spans for r in personal.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kinds = {rows[i][1][s.a : s.b]: personal.KINDS[s.kind] for i in range(4) for s in spans[i]}
    assert kinds["zorbleton"] in ("link", "quasi") and not {"words", "writes", "from", "about"} & set(kinds)
    assert all(not spans[100 + i] for i in range(300))


def disclosed(spark, rows):
    """The disclosing terms of each text."""
    texts = dict(rows)
    return {r.doc_id: sorted(texts[r.doc_id][s.a : s.b].lower() for s in r.spans if s.kind >= 4) for r in personal.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_disclosing_counts_documents(spark):
    """A fixed signature in different documents is evidence; copies of one document are none, and don't weaken any."""
    sign = "yours truly zorbleton from q@x.example.org in haste and with regards"
    plain = [(1000 + i, f"yours truly from in haste and with regards plain{i}") for i in range(300)]
    signed = [(i, f"letter{i} matter{i} {sign}") for i in range(4)]
    once = disclosed(spark, signed + plain)
    assert all(once[i] == ["zorbleton"] for i in range(4)) and not any(once[i] for i, _ in plain)
    copied = disclosed(spark, [(i + 10_000 * k, t) for i, t in signed + plain for k in range(10)])
    assert all(copied[i + 10_000 * k] == x for i, x in once.items() for k in range(10))
    assert not any(disclosed(spark, [(i, signed[0][1]) for i in range(9)] + plain).values())


def test_disclosing_terms_of_whole_documents(spark):
    """A name far from the address is found, and masked wherever it stands in documents with that address, and only there."""
    far = " ".join(f"common{j}" for j in range(40))
    rows = [(i, f"Zorbleton letter{i} {far} q@x.example.org {far} says zorbleton") for i in range(4)] + [(1000 + i, f"letter {far} says plain{i}") for i in range(300)] + [(5000, f"zorbleton {far}")]
    found = disclosed(spark, rows)
    assert all(found[i] == ["zorbleton", "zorbleton"] for i in range(4)) and not any(x for i, x in found.items() if i >= 4)


def test_pieces(spark, docs, empty):
    import os

    if not os.path.exists(pieces.MODEL):
        pytest.skip("no vocabulary here")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain = pieces.with_text(spark, pieces.with_pieces(spark, docs, dropout=0.0)).collect()
    for r in plain:
        assert r.decoded == r.text
        if r.text and "▁" not in r.text:
            assert r.ids == sp.encode(r.text)
    varied = pieces.with_round_trip(spark, docs).collect()
    assert all(r.decoded == r.text for r in varied) and next(r.ids for r in varied if r.doc_id == 8) != sp.encode(LONG)
    assert [r.ids for r in varied] == [r.ids for r in pieces.with_pieces(spark, docs).collect()]
    assert pieces.with_round_trip(spark, empty).count() == 0
    e = pieces.Encoder(pieces.Vocabulary.load())
    for unit in ("the", " thering", "anerthionst" * 3, "ç▁x"):
        assert e.encode_long(unit, 1) == e.encode_many([unit], 1)[0]


def test_pieces_each_occurrence_draws():
    """A word has more than four segmentations; every occurrence is as merged alone."""
    if not os.path.exists(pieces.MODEL):
        pytest.skip("no vocabulary here")
    e = pieces.Encoder(pieces.Vocabulary.load())
    word = " the thering anerthionst " + "anerthionst" * 6
    texts, keys = [word] * 1500, list(range(1500))
    units = pieces._UNIT.findall(" " + word)
    found = [x.tobytes() for x in e.encode(texts, keys)]
    for k in range(0, 1500, 50):
        assert found[k] == b"".join(e.encode_long(u, int(x)) for u, x in zip(units, e.keys_of(k, len(units))))
    assert len(set(found)) > 1000
    assert len({x.tobytes() for x in e.encode(["thering"] * 1500, keys)}) > 4


def test_url_rules(spark):
    urls = ["http://A.Org/x", "https://www.example.org/es/1", "http://example.org/en/12?q", "http://x.com/fr/", "x.com/de/", None, "ftp://evilexample.org/es/", "http://com/de/#a", "http://a.net", "http://a.org?x/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, []).collect()}
    assert rows[0] == ("a.org", "/x", "org/", "allow") and rows[1] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert rows[2] == ("example.org", "/en/12", "example.org/en/1", "block") and rows[3][2:] == ("com/fr/", "allow")
    assert rows[4] == rows[5] == ("", "", None, "allow") and rows[6][2:] == ("org/", "allow") and rows[7] == ("com", "/de/", "com/de/", "block")
    assert rows[8] == ("a.net", "", None, "allow") and rows[9] == ("a.org", "", None, "allow")
    many = spark.createDataFrame([(i, f"http://{'bad-pills' if i % 3 == 0 else 'good'}{'' if i % 2 else '.shop'}.net/p/{i}") for i in range(300)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(300)], "doc_id long, quality int")
    mined = url_rules.mine(many, labels)
    assert mined and all(r.confidence >= url_rules.MIN_LIFT / 3 for r in mined)
    verdicts = {r.page_id: r.verdict for r in url_rules.judge(many, mined).collect()}
    assert all(v == ("block" if i % 3 == 0 else "allow") for i, v in verdicts.items())
    assert url_rules.mine(many, labels.where("false")) == [] and url_rules.judge(pages.where("false"), mined).count() == 0


def brute_rules(rows, least, lift=url_rules.MIN_LIFT):
    """The pruned token combinations of up to three of rows with quality and tokens t."""
    seen = {}
    for r in rows:
        for size in (1, 2, 3):
            for part in itertools.combinations(sorted(r.t), size):
                x = seen.setdefault(part, [0, 0])
                x[0] += 1
                x[1] += r.quality == 0
    base = sum(r.quality == 0 for r in rows) / len(rows)
    sure = {p: b / n for p, (n, b) in seen.items() if b >= least}
    inside = lambda p: [q for k in range(1, len(p)) for q in itertools.combinations(p, k)]
    return {p for p, c in sure.items() if c >= lift * base and all(sure[q] < c for q in inside(p))}


def test_url_rules_against_brute_force(spark, data):
    """Rules and verdicts on all pages of a larger folder."""
    folder = data.replace("sf0.001", "sf0.1")
    if not os.path.isdir(folder):
        pytest.skip("no larger tables here")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = pages.select("page_id", url_rules.tokens(F.col("url")).alias("t")).join(labels.select(F.col("doc_id").alias("page_id"), "quality"), "page_id", "left").collect()
    known = [r for r in rows if r.quality is not None]
    want = brute_rules(known, max(url_rules.MIN_COUNT, -(-len(known) * 2 // 1000)))
    assert want
    mined = url_rules.mine(pages, labels)
    assert {tuple(sorted(c)) for r in mined for c in itertools.product(*r.items)} == want
    judged = {r.page_id: (r.n_mined, r.rule, r.verdict) for r in url_rules.judge(pages, mined).collect()}
    for r in rows:
        n, rule, verdict = judged[r.page_id]
        assert n == sum(set(p) <= set(r.t) for p in want) and (rule or verdict == ("block" if n else "allow"))


def test_url_rules_many(spark):
    """2,112 rules that share tokens, on 20,000 URLs: the index reads each URL's own rules only."""
    rules = [url_rules.MinedRule((("w:shared",), (f"p:{a}{b}",)), 0.9, 0.01) for a in "abcdefghijklmnop" for b in [f"{c}{d}" for c in "abcdefghijkl" for d in "abcdefghijk"]]
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://shared.net/"), F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 3), "0123456789", "ghijklmnop")).alias("url"))
    began = time.monotonic()
    names = {r.items[1][0][2:] for r in rules}
    got = url_rules.judge(pages, rules).select("path", "n_mined").collect()
    assert len(got) == 20_000 and all((r.n_mined > 0) == (r.path[1:] in names) for r in got)
    assert time.monotonic() - began < 60


def test_url_rules_are_not_cut(spark):
    """A URL template of 15 tokens that always go together does not crowd out the rules of a less sure one; rules of several tokens fit by the joined index."""
    kinds = [("http://www.pills.shop.net/buy/cheap/now.html?ref=x&id={}", 100, 1.0), ("http://casino.net/bonus/{}", 80, 0.75), ("http://mix.net/alpha/beta/{}", 50, 1.0), ("http://mix.net/alpha/{}", 50, 0.0), ("http://mix.net/beta/{}", 50, 0.0), ("http://good.net/page/{}", 300, 0.0)]
    rows, of = [], []
    for k, (url, n, bad) in enumerate(kinds):
        for i in range(n):
            rows.append((len(rows), url.format(len(rows)), int(i >= bad * n)))
            of.append(k)
    pages = spark.createDataFrame(rows, "page_id long, url string, quality int")
    mined = url_rules.mine(pages.select("page_id", "url"), pages.select(F.col("page_id").alias("doc_id"), "quality"), min_lift=1.8)
    want = brute_rules(pages.select("quality", url_rules.tokens(F.col("url")).alias("t")).collect(), 5, 1.8)
    assert {tuple(sorted(c)) for r in mined for c in itertools.product(*r.items)} == want
    judged = url_rules.judge(pages, mined).select("page_id", "verdict", "n_mined").collect()
    assert len(judged) == len(rows) and all(r.verdict == ("block" if of[r.page_id] in (0, 1, 2) else "allow") for r in judged)
    tokens = {r.page_id: set(r.t) for r in pages.select("page_id", url_rules.tokens(F.col("url")).alias("t")).collect()}
    assert all(r.n_mined == sum(set(p) <= tokens[r.page_id] for p in want) for r in judged)


def check_shards(rows, shards):
    for s in range(shards):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_sharding(spark, docs, empty, data, monkeypatch):
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count() and "__key" in rows[0] and all(r.size == len((r.text or "").encode()) + 1 for r in rows)
    check_shards(rows, 8)
    assert sharding.shard(empty).count() == 0
    real = spark.read.parquet(f"{data}/documents.parquet")
    rows = sharding.shard(real).collect()
    check_shards(rows, 8)
    bytes_ = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(bytes_) - min(bytes_) <= 2 * max(r.size for r in rows)
    # One text with half of all bytes is split; the shards stay near equal.
    hot = spark.createDataFrame([(i, "same text " * 20 if i % 2 else f"text number {i} " * 14) for i in range(4000)], "doc_id long, text string")
    rows = sharding.shard(hot).collect()
    check_shards(rows, 8)
    bytes_ = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(bytes_) < 1.02 * min(bytes_)
    monkeypatch.setattr(sharding, "LANE_BYTES", 64)  # many more lanes than rows of a shard
    check_shards(sharding.shard(real).collect(), 8)
    crc = queries.QUERIES["op9_sharding"](spark, data).where("doc_id = 0").first().text_crc32
    assert crc == zlib.crc32(real.where("doc_id = 0").first().text.encode())


def test_toxicity(spark, docs, empty):
    rows = [(i, f"plain words number{i} here " + ("vile " if i % 4 == 0 else "nice ") + ("junk" if i % 5 == 0 else "")) for i in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.toxicity for r in toxicity.with_toxicity(spark, train, labels).collect()}
    assert all(found[i].toxic == (i % 4 == 0) and found[i].low_quality == (i % 5 == 0) for i in range(400))
    odd = {r.doc_id: r.toxicity for r in toxicity.with_toxicity(spark, docs, labels.withColumn("doc_id", F.col("doc_id") % 3)).collect()}
    assert not odd[3].toxic and not odd[4].toxic
    assert toxicity.with_toxicity(spark, train, labels.where("false")).where("toxicity.toxic").count() == 0
    assert toxicity.with_toxicity(spark, empty, labels).count() == 0


def test_digest_columns(spark, data):
    r = queries.QUERIES["op2_substring_dedup"](spark, data).where("n_removed = 0").first()
    text = spark.read.parquet(f"{data}/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text
    assert r.kept_sha256 == hashlib.sha256(" ".join(SPACE.findall(text)).encode()).hexdigest()
