"""Substring deduplication with a log-structured fingerprint index.

A window is `window` consecutive words of one document; a word goes if a window that covers it has the
same word sequence as a window that starts in a document with a smaller doc_id.

Index. The fingerprint of a window is the least hash among its `gram`-word sequences. It depends on the
window's words alone, so equal windows have equal fingerprints, and neighbouring windows mostly share
one (a "stretch"), which leaves about one fingerprint for 20 words. Each batch of documents becomes a
sorted immutable run (fingerprint, first document, whether further documents have it), bucketed by
fingerprint. On arrival a run is merge-joined with the historical ones; the hits are verified against the
batch and the documents before it; then, when there are more than `fanout` runs, they are compacted by full
outer merge joins into one. No row is dropped: a run holds every fingerprint.

Verification. Only stretches whose fingerprint lies in two documents or more are looked at again. Two
64-bit digests of their whole word sequence tell which are equal as a whole; where a fingerprint has
stretches that differ, the windows in one of each are compared singly, by fingerprint and an independent
64-bit hash of all their words.

Skew: nothing is grouped by document pair, and a text's fingerprints and spans are gathered by doc_id and a hash of
the text, so that rows that share a doc_id don't meet. Minima are combined before each exchange, and both sides of
the joins that meet a fingerprint with all its rows are exchanged, so that Spark splits a hot one at run time.

Edge cases: null and empty texts have no words; an empty table gives no rows. A null doc_id has no place in the
order: such rows neither remove nor lose anything. Rows that repeat a doc_id are one document to each other (they
don't remove each other's words) and each is answered. Equal windows at several places of one document, or in
several documents, are one kind: the least doc_id keeps it (all its places). A very long text is one chunk of a
worker's memory. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .storage import Workspace


def _stretches(words: tc.Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint of each window, the windows that exist, their document, and the words' hashes."""
    h = words.hashes()
    low = tc.sliding_min(tc.grams(h, gram), window - gram + 1)
    exists = tc.inside_doc(words.first, window, len(low))
    return low, exists, words.doc_of()[: len(low)], h


def fingerprints(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """(fp, doc_id, tag): the distinct fingerprints of each row. tag: hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for words in tc.chunks(batch.column(2)):
                low, exists, doc, _ = _stretches(words, gram, window)
                at = np.flatnonzero(exists)
                fp, doc = low[at], doc[at]
                new = np.ones(len(at), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
                fp, doc = fp[new], doc[new]
                order = np.lexsort((fp, doc))
                fp, doc = fp[order], doc[order]
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
                row = words.row + doc[new]
                yield pa.RecordBatch.from_arrays([pa.array(tc.signed(fp[new])), pa.array(ids[row]), pa.array(tags[row])], ["fp", "doc_id", "tag"])

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "tag", "text").mapInArrow(run, "fp long, doc_id long, tag long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tag, text: rows are told apart by doc_id and a hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")


class FingerprintIndex:
    """Sorted runs of fingerprints, grown batch by batch."""

    def __init__(self, work: Workspace, buckets: int, fanout: int = 2, gram: int = 10, window: int = 50):
        self.work, self.buckets, self.fanout, self.gram, self.window = work, buckets, fanout, gram, window
        self.runs: list[tuple[str, DataFrame]] = []
        self.postings: list[DataFrame] = []
        self.made = 0

    def _name(self) -> str:
        self.made += 1
        return f"run{self.made}"

    def add(self, batch: DataFrame, documents: DataFrame) -> DataFrame:
        """Add a batch of rows (doc_id, tag, text) and tell what to remove from it: repeated_spans of its rows.

        documents: the batch and all rows added before. Every doc_id of the batch is above those added before.
        """
        k = len(self.postings)
        posting = self.work.save(fingerprints(batch, self.gram, self.window), f"posting{k}")
        run = posting.groupBy("fp").agg(F.min("doc_id").alias("first"), (F.min("doc_id") < F.max("doc_id")).alias("many"))
        run = self.work.save_run(run, name := self._name(), "fp", self.buckets)
        met = run.select("fp", "many", F.lit(False).alias("old"))
        for _, older in self.runs:  # merge joins of bucketed, sorted tables: no exchange
            met = met.join(older.select("fp", F.lit(True).alias("has")), "fp", "left").select("fp", "many", (F.col("old") | F.coalesce("has", F.lit(False))).alias("old"))
        hot = self.work.save(met.where("many OR old").select("fp", "old"), f"hot{k}")
        rows = posting.join(hot, "fp").select("doc_id", "tag", "fp")
        for older in self.postings:
            rows = rows.unionByName(older.join(hot.where("old"), "fp").select("doc_id", "tag", "fp"))
        found = rows.groupBy("doc_id", "tag").agg(F.collect_set("fp").alias("fps"))  # at most the fingerprints of one text
        texts = documents.where("text IS NOT NULL").join(found, ["doc_id", "tag"]).select("doc_id", "tag", "text", "fps")
        stretches = self.work.save(_shared_stretches(texts, self.gram, self.window), f"stretches{k}")
        self.work.drop(f"hot{k}")
        self.postings.append(posting)
        self.runs.append((name, run))
        if len(self.runs) > self.fanout:
            self.compact()
        self.work.release()
        first = batch.agg(F.min("doc_id")).first()[0]
        return _verified(self.work, stretches, F.col("doc_id") >= F.lit(first), str(k))

    def compact(self) -> None:
        """Merge all runs into one. A fingerprint of two runs has several documents, unless it is the same one."""
        if len(self.runs) < 2:
            return
        whole = self.runs[0][1]
        for _, run in self.runs[1:]:
            old, new = whole.alias("o"), run.alias("n")
            whole = old.join(new, F.col("o.fp") == F.col("n.fp"), "full_outer").select(
                F.coalesce("o.fp", "n.fp").alias("fp"),
                F.least("o.first", "n.first").alias("first"),
                (F.coalesce("o.many", F.lit(False)) | F.coalesce("n.many", F.lit(False)) | F.coalesce(F.col("o.first") != F.col("n.first"), F.lit(False))).alias("many"),
            )
        name = self._name()
        merged = self.work.save_run(whole, name, "fp", self.buckets)
        self.work.drop_runs(*(x for x, _ in self.runs))
        self.runs = [(name, merged)]

    def drop(self) -> None:
        """Delete the index."""
        self.work.drop_runs(*(x for x, _ in self.runs))
        self.work.drop(*(f"posting{i}" for i in range(len(self.postings))))
        self.runs, self.postings = [], []


def _shared_stretches(rows: DataFrame, gram: int, window: int) -> DataFrame:
    """rows: doc_id, tag, text, fps (the shared fingerprints). A row for each stretch: its digests and window hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fps = batch.column(3)
            flat, counts = fps.flatten().to_numpy(zero_copy_only=False), np.diff(fps.offsets.to_numpy())
            owner = np.repeat(np.arange(len(ids)), counts)
            salt = lambda fp, doc: tc.mix(fp.view(np.uint64) + (doc + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            known = salt(flat, owner)
            for words in tc.chunks(batch.column(2)):
                low, exists, doc, h = _stretches(words, gram, window)
                part = known[(owner >= words.row) & (owner < words.row + words.docs)]
                at = np.flatnonzero(exists)
                at = at[np.isin(salt(low[at], doc[at] + words.row), part)]
                if not len(at):
                    continue
                fp, doc = low[at], doc[at]
                new = np.ones(len(at), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
                start = np.flatnonzero(new)
                length = np.diff(np.append(start, len(at)))
                windows = tc.grams(h, window, 1)[at]
                other = tc.grams(words.hashes(7), window, 2)[at]
                # equal sequences have equal windows in equal order: weigh each by its place
                place = (np.arange(len(at)) - np.repeat(start, length)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
                one, two = np.add.reduceat(tc.mix(windows * place), start), np.add.reduceat(tc.mix(other * place), start)
                d = doc[start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (tc.signed(fp[start]), tc.signed(one), tc.signed(two), ids[words.row + d], tags[words.row + d], at[start] - words.first[d], length)] + [tc.list_array(tc.signed(windows), length)],
                    ["fp", "one", "two", "doc_id", "tag", "pos", "len", "windows"],
                )

    return rows.mapInArrow(run, "fp long, one long, two long, doc_id long, tag long, pos long, len long, windows array<long>")


def _verified(work: Workspace, stretches: DataFrame, wanted: Column, k: str) -> DataFrame:
    """(doc_id, tag, pos, len): places of windows, by stretches, of the wanted rows that an earlier document has too."""
    same = work.save(stretches.groupBy("fp", "one", "two").agg(F.min("doc_id").alias("first")), f"same{k}")
    kinds = work.save(same.groupBy("fp").agg((F.count("*") > 1).alias("differ")), f"kinds{k}")
    same = work.save(same.join(kinds, "fp"), f"same_kinds{k}")
    judged = work.save(
        stretches.join(same, ["fp", "one", "two"]).select("fp", "doc_id", "tag", "pos", "len", (F.col("first") < F.col("doc_id")).alias("copy"), F.when((F.col("first") == F.col("doc_id")) & F.col("differ"), F.col("windows")).alias("windows")), f"judged{k}"
    )
    work.drop(f"stretches{k}", f"same{k}", f"kinds{k}", f"same_kinds{k}")
    work.release()
    copies = judged.where(F.col("copy") & wanted).select("doc_id", "tag", "pos", "len")
    single = judged.where("windows IS NOT NULL").select("fp", "doc_id", "tag", F.col("pos").alias("at"), F.posexplode("windows").alias("i", "window"))
    firsts = work.save(single.groupBy("fp", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("fp", "window", "first"), f"firsts{k}")
    hits = single.where(wanted).join(firsts, ["fp", "window"]).where("first < doc_id").select("doc_id", "tag", (F.col("at") + F.col("i")).alias("pos"), F.lit(1).cast("long").alias("len"))
    spans = work.save(copies.unionByName(hits), f"spans{k}")
    work.drop(f"judged{k}", f"firsts{k}")
    work.release()
    return spans


def repeated_spans(spark: SparkSession, rows: DataFrame, work: Workspace, batches: int = 3, gram: int = 10, window: int = 50) -> DataFrame:
    """(doc_id, tag, pos, len): places of windows, by stretches, that an earlier document has too. rows: as of keyed."""
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = FingerprintIndex(work, buckets, gram=gram, window=window)
    cuts = sorted(set(rows.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    bounds = [None, *cuts, None]
    found = None
    for low, high in zip(bounds, bounds[1:]):
        known = rows if high is None else rows.where(F.col("doc_id") < int(high))
        spans = index.add(known if low is None else known.where(F.col("doc_id") >= int(low)), known)
        found = spans if found is None else found.unionByName(spans)
    index.drop()
    return found


def deduplicate(spark: SparkSession, docs: DataFrame, batches: int = 3, gram: int = 10, window: int = 50) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, removed (word spans, end exclusive), kept_text.

    kept_text has the kept words, joined by one space. batches: how many parts of the doc_id range are
    fed to the index, one after the other; the result doesn't depend on it.
    """
    own = keyed(docs)
    with Workspace(spark, "substring") as work:
        spans = repeated_spans(spark, own, work, batches, gram, window)
    per_text = spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("pos", "len")).alias("spans"))  # at most the windows of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            for words in tc.chunks(batch.column(1)):
                counts = words.counts()
                removed, kept, gone = [], [], np.zeros(words.docs, np.int64)
                for d in range(words.docs):
                    first, n = int(words.first[d]), int(counts[d])
                    cover = np.zeros(n + 1, np.int64)
                    if spans[words.row + d].is_valid:
                        mine = spans[words.row + d].values
                        pos, length = mine.field("pos").to_numpy(), mine.field("len").to_numpy()
                        np.add.at(cover, pos, 1)
                        np.add.at(cover, pos + length + window - 1, -1)
                    out = np.cumsum(cover[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                    cuts = edge.reshape(-1, 2).tolist()
                    gone[d] = out.sum()
                    keep, last = [], 0
                    for a, b in [*cuts, (n, n)]:
                        if a > last:
                            keep.append(words.text(first + last, first + a))
                        last = b
                    removed.append(cuts)
                    kept.append(b" ".join(keep).decode())
                rows = slice(words.row, words.row + words.docs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows.start : rows.stop], pa.array(counts.astype(np.int64)), pa.array(gone), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "removed", "kept_text"]
                )

    rows = own.join(per_text, ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, removed array<array<long>>, kept_text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The same in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS first FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (h) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE g.p IS NOT NULL) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY words.p) FILTER (WHERE g.p IS NULL), '') AS t
  FROM words LEFT JOIN gone g USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
