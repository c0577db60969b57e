"""Personal data: fixed patterns, and terms that the corpus shows to reveal a protected entity.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found by linear scans. Every distinct
value of a base span is a protected entity. Terms (runs of letters and digits, lower case, outside base spans)
anywhere in a document that mentions it may disclose it. How strongly is estimated from the corpus:

    information of the entity   IC(e) = -ln P(e),            P(e) = documents with e / documents
    point-wise information      PMI(t, e) = ln(P(e|t) / P(e)), P(e|t) = documents with t and e / documents with t
    disclosure                  PMI(t, e) / IC(e)             1: the term gives the entity away

Documents are counted by different texts, everywhere in these sums: copies weigh nothing, equal surroundings in
different documents count. With MIN_CONTEXTS documents or more, a disclosure of GENERALISE makes all mentions of the
term in documents with that entity `quasi` spans (replaced by their class, a number or a word), one of REMOVE makes
them `link` spans (removed). Near copies are different texts: what only they share with an entity discloses it.

All counts cover all documents. A term in more than n_e * P(e) ** (GENERALISE - 1) documents can't disclose e whatever
it goes with: such pairs are left out before anything is summed, which changes no result. Documents whose entities
are in fewer than MIN_CONTEXTS others are not read again.

Edge cases: null and empty texts have no spans; null texts stay null when masked. Rows with a null doc_id, and rows
that repeat a doc_id, are each answered (rows are told apart by a hash of their text). A very long text costs time and
memory in proportion to it. A term of several entities gets the stronger kind; of spans with one start, base ones come
first. An empty table gives no rows. Other columns are ignored, whatever their names, and sanitise keeps them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .storage import BROADCAST_BYTES, Workspace, measured, packed

KINDS = ("email", "ip", "card", "phone", "quasi", "link")
MIN_CONTEXTS, GENERALISE, REMOVE = 3, 0.8, 0.95

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Runs of digits are taken whole; a start inside a run can't match where its first digit doesn't.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_DOUBLE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _luhn(digits: str) -> bool:
    total = sum(_DOUBLE[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans in code points, by start and then kind."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            done = m.end()
        else:
            done = at + 1  # no match can hold this sign
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _hash(values: list[str]) -> np.ndarray:
    """64-bit hashes of strings, as a whole."""
    data, off = tc.utf8(pa.array(values, pa.string()))
    words = tc.Words(data, off, np.ones(256, bool), 0)
    out = np.zeros(len(values), np.uint64)
    out[words.counts() > 0] = words.hashes(3)
    return out


def _free_terms(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms that touch no base span.

    One pass over the text, then binary searches: time and memory grow with the text and its spans, however dense they are.
    """
    flat = array("q")
    for m in _TERM.finditer(text):
        flat.extend(m.span())
    start, end = np.array(flat, np.int64).reshape(-1, 2).T
    if not spans:
        return start, end
    low, high = np.array([a for a, _, _ in spans]), np.maximum.accumulate([b for _, _, b in spans])
    # Spans are in order of their starts: of those that start before a term's end, one at least must end after its start.
    at = np.searchsorted(low, end)
    free = (at == 0) | (high[at - 1] <= start)
    return start[free], end[free]


def _entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else ''.join(c for c in value if c.isdigit() or c == '.')}"


def _scan(docs: DataFrame) -> DataFrame:
    """Base spans of every document, and its entities, each once."""
    span = pa.struct([("a", pa.int32()), ("kind", pa.int32()), ("b", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_out, values, per = [], [], []
            for text in batch.column(2).to_pylist():
                spans = base_spans(text) if text else []
                spans_out.append([{"a": a, "kind": k, "b": b} for a, k, b in spans])
                own = {_entity(k, text[a:b]) for a, k, b in spans}
                values.extend(sorted(own))
                per.append(len(own))
            entities = tc.list_array(tc.signed(_hash(values)) if values else np.zeros(0, np.int64), np.array(per, np.int64))
            tc.relax()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans_out, pa.list_(span)), entities], ["doc_id", "tag", "spans", "entities"])

    schema = "doc_id long, tag long, spans array<struct<a: int, kind: int, b: int>>, entities array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text").mapInArrow(run, schema)


def term_hashes(terms: list[str]) -> np.ndarray:
    """Hashes of single terms, as documents' words are hashed."""
    return np.concatenate([tc.signed(w.hashes(5)) for w in tc.chunks(pa.array(terms, pa.string()), tc.WORD, tc.LOWER)])


def document_frequencies(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(term, n): in how many different texts each term of the corpus is. Summed in each task first.

    copies: (tag, m) of the texts that m > 1 rows have. Each of them counts 1 / m; rounding the sum gives the whole number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        shares: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, at = np.unique(np.concatenate(held), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(tc.signed(keys)), pa.array(np.bincount(at, np.concatenate(shares), len(keys)))], ["term", "n"])

        for batch in batches:
            share = 1 / batch.column(1).to_numpy(zero_copy_only=False)
            for words in tc.chunks(batch.column(0), tc.WORD, tc.LOWER):
                h, doc = words.hashes(5), words.doc_of()
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                held.append(h[new])
                shares.append(share[words.row + doc[new]])
                size += int(new.sum())
                if size > 4_000_000:
                    yield flush()
                    held, shares, size = [], [], 0
        if held:
            yield flush()

    some = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("tag")).join(measured(copies, 32), "tag", "left")
    some = some.select("text", F.coalesce("m", F.lit(1)).cast("double").alias("m"))
    return some.mapInArrow(run, "term long, n double").groupBy("term").agg(F.round(F.sum("n")).cast("long").alias("n"))


def _text_terms(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, term): the different free terms of the texts named by tags, once for each row that has the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start, end = _free_terms(text, base_spans(text))
                terms = list({text[a:b] for a, b in zip(start.tolist(), end.tolist())})
                if terms:
                    found = np.unique(term_hashes(terms))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), tag, np.int64)), pa.array(found)], ["tag", "term"])
            tc.relax()

    return docs.select(F.xxhash64("text").alias("tag"), "text").join(measured(tags, 16), "tag", "left_semi").mapInArrow(run, "tag long, term long")


def _text_spans(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tag, more): the spans of all mentions of the wanted terms (tag, terms: array of term, kind) in each text."""
    span = pa.struct([("a", pa.int32()), ("kind", pa.int32()), ("b", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = []
            for text, terms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kinds = {t["term"]: t["kind"] for t in terms}
                start, end = (x.tolist() for x in _free_terms(text, base_spans(text)))
                hashes = term_hashes([text[a:b] for a, b in zip(start, end)]).tolist() if start else []
                more.append([{"a": a, "kind": kinds[h], "b": b} for a, b, h in zip(start, end, hashes) if h in kinds])
            tc.relax()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(more, pa.list_(span))], ["tag", "more"])

    found = docs.select(F.xxhash64("text").alias("tag"), "text").join(wanted, "tag").select("tag", "text", "terms")
    return found.mapInArrow(run, "tag long, more array<struct<a: int, kind: int, b: int>>").dropDuplicates(["tag"])


def disclosing(work: Workspace, docs: DataFrame, scanned: DataFrame, mentions: DataFrame) -> DataFrame | None:
    """(entity, term, kind): the terms that disclose an entity; kind is the span kind they get. mentions: (tag, entity), each once. None: there are none."""
    entities = mentions.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= MIN_CONTEXTS)
    entities = work.save(entities, "entities")
    most = entities.agg(F.max("n_e")).first()[0]
    if not most:
        return None
    sizes = work.save(scanned.groupBy("tag").agg(F.count("*").alias("m")), "sizes")
    copies = work.save(sizes.where("m > 1"), "copies")
    total = sizes.count()
    bound = lambda n_e: n_e * F.pow(n_e / F.lit(float(total)), F.lit(GENERALISE - 1)) * (1 + 1e-9)
    every = document_frequencies(docs, copies).where(F.col("n") >= MIN_CONTEXTS)
    # Frequent terms are few (at most 100 times those of a text): they go before rows are dealt by term.
    rare = F.col("n") <= bound(F.lit(float(most)))
    counts = work.save(every.where(rare | (F.col("n") * 100 >= total)).select("term", "n", rare.alias("rare")), "counts")
    named = work.save(mentions.join(entities, "entity"), "named")
    terms = _text_terms(docs, work.save(named.select("tag").distinct(), "tags")).join(F.broadcast(counts.where("NOT rare").select("term")), "term", "left_anti")
    terms = work.save(terms.join(counts.where("rare").select("term", "n"), "term").distinct(), "terms")
    pairs = named.join(terms, "tag").where(F.col("n") <= bound(F.col("n_e"))).groupBy("entity", "term", "n_e", "n").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= MIN_CONTEXTS)
    p_e = F.col("n_e") / F.lit(float(total))
    share = F.least(F.col("n_te") / F.col("n"), F.lit(1.0))
    judged = pairs.withColumn("disclosure", F.when(p_e < 1, F.log(share / p_e) / -F.log(p_e)))
    kind = F.when(F.col("disclosure") >= REMOVE, KINDS.index("link")).when(F.col("disclosure") >= GENERALISE, KINDS.index("quasi"))
    return work.save(judged.select("entity", "term", kind.alias("kind")).where("kind IS NOT NULL"), "disclosing")


def _found(work: Workspace, docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """What _scan finds, and (tag, more): the further spans of texts that have some. None: no term discloses anything."""
    scanned = work.save(_scan(docs), "scanned")
    mentions = work.save(scanned.where(F.size("entities") > 0).select("tag", F.explode("entities").alias("entity")).distinct(), "mentions")
    found = disclosing(work, docs, scanned, mentions)
    if found is None or found.isEmpty():
        return scanned, None
    # A term of several entities of a document: the stronger kind.
    wanted = mentions.join(found, "entity").groupBy("tag", "term").agg(F.max("kind").alias("kind"))
    wanted = work.save(wanted.groupBy("tag").agg(F.collect_list(F.struct("term", "kind")).alias("terms")), "wanted")
    extra = work.save(_text_spans(docs, wanted), "extra")
    spans = extra.agg(F.coalesce(F.sum(F.size("more")), F.lit(0))).first()[0]
    work.release()
    return scanned, F.broadcast(extra) if 24 * spans <= BROADCAST_BYTES else extra


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, tag (hash of its text), spans (a, kind, b) by a and kind; base spans first of equals."""
    with Workspace(spark, "personal") as work:
        scanned, extra = _found(work, docs)
    if extra is None:
        return scanned.select("doc_id", "tag", F.array_sort("spans").alias("spans"))
    none = F.array().cast("array<struct<a: int, kind: int, b: int>>")
    joined = scanned.join(extra, "tag", "left")
    return joined.select("doc_id", "tag", F.array_sort(F.concat("spans", F.coalesce("more", none))).alias("spans"))


def _mask(text: pa.Array, more: pa.Array) -> pa.Array:
    """Texts without their base spans and the further ones given."""
    out = []
    for t, extra in zip(text.to_pylist(), more.to_pylist()):
        own = [{"a": a, "kind": k, "b": b} for a, k, b in base_spans(t)] + (extra or []) if t else []
        if not own:
            out.append(t)
            continue
        parts, done = [], 0
        for s in sorted(own, key=lambda s: (s["a"], s["kind"])):
            if s["a"] < done:  # overlaps what is masked already: only the rest of it goes
                done = max(done, s["b"])
                continue
            parts.append(t[done : s["a"]])
            kind = KINDS[s["kind"]]
            if kind == "quasi":
                parts.append("<NUMBER>" if any(c.isdigit() for c in t[s["a"] : s["b"]]) else "<WORD>")
            elif kind != "link":
                parts.append(f"<{kind.upper()}>")
            done = s["b"]
        parts.append(t[done:])
        out.append("".join(parts))
    return pa.array(out, pa.string())


def sanitise(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs, all columns, with base spans replaced by their kind, generalised terms by their class, and removed terms gone.

    Texts are masked where they are read: only texts with disclosing terms are joined with those.
    """
    with Workspace(spark, "personal") as work:
        extra = _found(work, docs)[1]
    own = docs.select(packed(docs), "text", F.xxhash64("text").alias("tag"))
    more = F.col("more")
    if extra is None:
        more = F.lit(None).cast("array<struct<a: int, kind: int, b: int>>")
    else:
        own = own.join(extra, "tag", "left")
    masked = own.withColumn("masked", F.arrow_udf(_mask, "string")(F.col("text"), more))
    return masked.select(*(F.col("masked").alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["a"], s["b"])), ",")


def op6_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return out.select("doc_id", *(count(k) for k in range(4)), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
