"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

A document is the set of its five-word shingles (words split at ASCII white space; a shorter text is one
shingle of all its words). Two documents are linked if their sets' Jaccard similarity is THRESHOLD or more.

1. Equal sets are one class, represented by its row of the least doc_id. All that follows works on classes.
2. Band and row counts are chosen for the target recall at the threshold. Classes are exchanged on band
   hashes; those that share a band are candidates. Candidate components put classes that can be linked together.
3. Components are dealt into blocks of bounded size, large ones over several. The pairs of blocks that share
   a band are the units of verification: a unit has the full sets of at most two blocks, finds the pairs that
   share a band, counts their common shingles exactly, and returns sums for each class and local components,
   not pairs. A class lies in one block, so every candidate pair is looked at in exactly one unit.
4. Local components are joined into the final ones.

Nothing is capped: a group of any size is many blocks. The only links that can be missed are those that share
no band, as the recall says.

Edge cases: every row is answered. Null and empty texts have no shingles, no links and are a class each. Rows that
repeat a doc_id are documents of their own: with one text they are copies of each other. Rows with a null doc_id
take part; a class has the least doc_id of its rows, null if none has one. Of equal doc_ids the least hash of the
text comes first. A very long text is one chunk of a worker's memory and one set of a unit. An empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .components import components
from .storage import Workspace, measured, packed

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Bounds of a block.
BLOCK_SHINGLES, BLOCK_DOCS = 1 << 17, 256


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, low: float = 0.4, waste: float = 0.2) -> tuple[int, int]:
    """(bands, rows): the fewest hashes that reach the recall at the threshold and propose at most `waste` of pairs of similarity `low`."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if 1 - (1 - low**rows) ** bands <= waste and (best is None or bands * rows < best[0] * best[1]):
            best = (bands, rows)
    return best or (math.ceil(math.log(1 - recall) / math.log(1 - threshold**32)), 32)


def _sets(words: tc.Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's documents, sorted within each, and how many each has."""
    h = words.hashes()
    g = tc.grams(h, shingle)
    ok = np.flatnonzero(tc.inside_doc(words.first, shingle, len(g)))
    doc, value = words.doc_of()[: len(g)][ok], g[ok]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        whole = [tc.mix(np.add.reduce(h[words.first[d] : words.first[d + 1]] * (np.arange(counts[d], dtype=np.uint64) * np.uint64(2) + np.uint64(3)), keepdims=True))[0] for d in short]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, np.array(whole, np.uint64)])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(doc[new], minlength=words.docs)


def _digests(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each document's set (0 for none)."""
    first = (np.cumsum(counts) - counts)[counts > 0]
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        d = np.zeros(len(counts), np.uint64)
        if len(values):
            d[counts > 0] = np.add.reduceat(tc.mix(values ^ np.uint64(salt)), first)
        out.append(tc.mix(d + counts.astype(np.uint64)))
    return out[0], out[1]


def _band_hashes(values: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents with shingles, bands) MinHash band hashes; a band's number is part of its hash."""
    first = (np.cumsum(counts) - counts)[counts > 0]
    rng = np.random.default_rng(20240301)
    out = np.zeros((len(first), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(first), b + 1, np.uint64)
        for _ in range(rows):
            a, c = (rng.integers(1, 1 << 63, dtype=np.uint64) for _ in range(2))
            low = np.minimum.reduceat((values ^ c) * (a * np.uint64(2) + np.uint64(1)), first)
            acc = tc.mix(acc * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, b] = acc
    return out


def _signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in tc.chunks(batch.column(2)):
                values, counts = _sets(words, shingle)
                one, two = _digests(values, counts)
                per = np.where(counts > 0, bands, 0)
                hashes = _band_hashes(values, counts, bands, rows).ravel() if len(values) else np.zeros(0, np.uint64)
                ids, tags = (batch.column(i)[words.row : words.row + words.docs] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, tags, pa.array(tc.signed(one)), pa.array(tc.signed(two)), pa.array(counts.astype(np.int64)), tc.list_array(tc.signed(hashes), per)], ["doc_id", "tag", "one", "two", "n", "bands"])

    return docs.mapInArrow(run, "doc_id long, tag long, one long, two long, n long, bands array<long>")


def _with_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """rows: node, one, block, copies, bands, text. The same with the set of the text; rows whose text has another set go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(1).to_numpy(zero_copy_only=False)
            for words in tc.chunks(batch.column(5)):
                values, counts = _sets(words, shingle)
                good = pa.array(tc.signed(_digests(values, counts)[0]) == known[words.row : words.row + words.docs])
                part = [batch.column(i)[words.row : words.row + words.docs] for i in (0, 2, 3, 4)]
                out = pa.RecordBatch.from_arrays([*part, tc.list_array(tc.signed(values), counts)], ["node", "block", "copies", "bands", "shingles"])
                yield out.filter(good)

    return rows.mapInArrow(run, "node long, block long, copies long, bands array<long>, shingles array<long>")


def _common(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Numbers of common shingles of the pairs (a[i], b[j])."""
    if len(i) <= 4 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    left, right = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(left, right)
    total = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(both), 4096):
        cols = both[at : at + 4096]
        sides = []
        for sets in (a, b):
            m = np.zeros((len(sets), len(cols)), np.float32)
            for r, s in enumerate(sets):
                k = np.searchsorted(cols, s[np.searchsorted(s, cols[0]) : np.searchsorted(s, cols[-1], "right")])
                own = s[np.searchsorted(s, cols[0]) : np.searchsorted(s, cols[-1], "right")]
                m[r, k[cols[k] == own]] = 1
            sides.append(m)
        total += sides[0] @ sides[1].T
    return total[i, j].astype(np.int64)


def _verify(threshold: float):
    """Links among the classes of one unit: (node, links, root)."""

    def run(unit: pa.Table) -> pa.Table:
        unit = unit.combine_chunks().sort_by([("block", "ascending"), ("node", "ascending")])
        rep, block, copies = (unit[c].to_numpy() for c in ("node", "block", "copies"))
        sizes = unit["bands"].combine_chunks()
        bands = sizes.flatten().to_numpy().reshape(len(rep), -1)
        col = unit["shingles"].combine_chunks()
        flat, off = col.values.to_numpy(), col.offsets.to_numpy()
        sets = [flat[off[k] : off[k + 1]] for k in range(len(rep))]  # sorted as unsigned
        sets = [np.sort(s) for s in sets]
        n = np.array([len(s) for s in sets])
        split = int(np.searchsorted(block, block[-1]))  # the first row of the second block
        alone = split == 0
        a = np.arange(len(rep)) if alone else np.arange(split)
        b = np.arange(len(rep)) if alone else np.arange(split, len(rep))
        meet = np.zeros((len(a), len(b)), bool)
        for k in range(bands.shape[1]):
            meet |= bands[a, k][:, None] == bands[b, k][None, :]
        small, large = np.minimum(n[a][:, None], n[b][None, :]), np.maximum(n[a][:, None], n[b][None, :])
        meet &= small >= threshold * large - 1e-9
        if alone:
            meet = np.triu(meet, 1)
        i, j = np.nonzero(meet)
        if len(i):
            common = _common([sets[x] for x in a], [sets[x] for x in b], i, j)
            good = common >= threshold * (n[a[i]] + n[b[j]] - common) - 1e-9
            i, j = a[i[good]], b[j[good]]
        links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep)) if len(i) else np.zeros(len(rep))
        root = np.arange(len(rep))
        while len(i):
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
            if (before == root).all():
                break
        some = np.flatnonzero(links > 0)
        tc.relax()
        return pa.table({"node": pa.array(rep[some]), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(rep[root[some]])})

    return run


def link(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """One row for each row of docs: doc_id, tag (hash of the text), copy_of (least doc_id with the same shingle set),
    class_id (least doc_id that links lead to), n_links (other rows of at least the threshold's similarity) and class_key
    (tells classes apart also where they have no doc_id or share one; null without shingles)."""
    with Workspace(spark, "near") as work:
        return _link(work, docs, threshold, shingle, recall)


def _link(work: Workspace, docs: DataFrame, threshold: float, shingle: int, recall: float) -> DataFrame:
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    every = work.save(_signatures(docs, shingle, bands, rows), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "n", "bands")).alias("s")
    reps = every.where("n > 0").groupBy("one", "two").agg(least, F.count("*").alias("copies"))
    # A class is known by a number that is given once, in a written table.
    reps = work.save(reps.select(F.monotonically_increasing_id().alias("node"), F.col("s.doc_id").alias("rep"), F.col("s.tag").alias("tag"), "one", "two", "s.n", "s.bands", "copies"), "reps")
    work.release()

    entries = reps.select("node", F.explode("bands").alias("key"))
    keys = work.save(entries.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("m")).where("m > 1").select("key", "low"), "keys")
    members = work.save(entries.join(keys, "key"), "members")
    work.release()
    comp = components(work, members.select(F.col("node").alias("u"), F.col("low").alias("v")).distinct(), "candidate")
    sized = work.save(comp.select("node", "label").join(reps.select("node", "n"), "node"), "sized")
    # A large component has blocks of its own; small ones share blocks.
    parts = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS))
    totals = work.save(sized.groupBy("label").agg(parts.alias("parts"), F.sum("n").alias("sum_n"), F.count("*").alias("m")), "totals")
    whole = totals.agg(F.coalesce(F.greatest(F.ceil(F.sum("sum_n") / BLOCK_SHINGLES), F.ceil(F.sum("m") / BLOCK_DOCS)), F.lit(1))).first()[0]
    own = F.xxhash64(F.lit("large"), "label", F.pmod(F.xxhash64("node"), F.col("parts")))
    shared = F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("label"), F.lit(max(1, 2 * whole))))
    assigned = work.save(sized.join(totals.select("label", "parts"), "label").select("node", F.when(F.col("parts") > 1, own).otherwise(shared).alias("block")), "assigned")

    met = work.save(members.select("key", "node").join(assigned, "node").select("key", "block").distinct(), "met")
    pairs = met.alias("x").join(met.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block"))).select(F.col("x.block").alias("a"), F.col("y.block").alias("b")).distinct()
    pairs = work.save(pairs.withColumn("unit", F.xxhash64("a", "b")), "pairs")
    wanted = assigned.join(reps.select("node", "rep", F.col("tag").alias("rep_tag"), "one", "copies", "bands"), "node")
    found = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("tag") == F.col("rep_tag"))).select("node", "one", "block", "copies", "bands", "text")
    sets = work.save(_with_sets(found, shingle).dropDuplicates(["node"]), "sets")
    work.drop("keys", "members", "met", "sized", "totals")
    work.release()
    sides = pairs.select(F.col("a").alias("block"), "unit").unionByName(pairs.where("a <> b").select(F.col("b").alias("block"), "unit"))
    units = sets.join(sides, "block").select("unit", "block", "node", "copies", "bands", "shingles")
    found = work.save(units.groupBy("unit").applyInArrow(_verify(threshold), "node long, links long, root long"), "found")
    work.drop("sets", "pairs", "assigned")
    work.release()
    final = components(work, found.select(F.col("node").alias("u"), F.col("root").alias("v")), "final").select("node", "label")
    first = final.join(reps.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("low"))
    final = work.save(final.join(first, "label"), "labels")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = reps.select("node", "rep", "one", "two", "copies").join(counts, "node", "left").join(final, "node", "left")
    low = F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("low"))
    classes = work.save(classes.select("one", "two", "rep", low.alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "node").alias("class_key")), "classes")
    linked = every.where("n > 0").select("doc_id", "tag", "one", "two").join(classes, ["one", "two"]).select("doc_id", "tag", F.col("rep").alias("copy_of"), "class_id", "n_links", "class_key")
    alone = every.where("n = 0").select("doc_id", "tag", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("class_key"))
    return linked.unionByName(alone)


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that of the least doc_id, then of the least hash of the text, then of the least
    row as JSON. Rows without a word are a class each and stay. The result is the same in every run."""
    with Workspace(spark, "keep_one") as work:
        found = link(spark, docs).where("class_key IS NOT NULL").groupBy("class_key", "doc_id", "tag").agg(F.count("*").alias("n"))
        first = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "n")).alias("s"))
        first = work.save(first.select(F.col("s.doc_id").alias("first_id"), F.col("s.tag").alias("first_tag"), "s.n"), "first")
    rows = docs.select(packed(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tag"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("has_words"))
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tag") == F.col("first_tag"))
    single = rows.where("has_words").join(first.where("n = 1"), is_first, "left_semi").select("row")
    repeated = rows.where("has_words").join(measured(first.where("n > 1"), 32), is_first, "left_semi")
    repeated = repeated.groupBy("id", "tag").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(repeated).unionByName(rows.where("NOT has_words").select("row")).select("row.*")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "copy_of", "class_id", "n_links")


#: The same in DuckDB: all pairs that share a shingle, and what is reached over links.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(h, '' ORDER BY h)) AS s FROM sh GROUP BY 1),
copies AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY s) AS copy_of FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN copies a ON a.doc_id = x JOIN copies b ON b.doc_id = y WHERE c >= 0.8::DOUBLE * (a.n + b.n - c) - 1e-9::DOUBLE),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
class AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY 1),
links AS (SELECT x AS doc_id, count(*) AS n_links FROM link GROUP BY 1)
SELECT doc_id, coalesce(copy_of, doc_id) AS copy_of, class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM d JOIN class USING (doc_id) LEFT JOIN copies USING (doc_id) LEFT JOIN links USING (doc_id)
"""
