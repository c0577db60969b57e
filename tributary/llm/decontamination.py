"""Benchmark decontamination by a prefix-filtered set join of item windows with documents.

Words are runs of ASCII letters and digits and of all non-ASCII characters, with A-Z lower-cased. A window
is `size` consecutive words of an item, or all words of a shorter item that has any. A document word inside
any occurrence of a window is hit.

Join. A window is the set of its `shingle`-word shingles (fewer words: one shingle). Shingles are ordered by
rarity: their exact number of occurrences in all documents. Containment of a whole window needs overlap with
all of its shingles, so the necessary prefix is one shingle, the rarest; only prefixes are joined. A document
place that has a prefix shingle gives a candidate; the length bound drops documents with fewer words than the
window, the positional bound those where the window, laid so that the shingle meets its place, would leave
the document. What is left is verified word by word.

The benchmark side is cut into blocks of at most BLOCK windows, so that what a task holds of it is bounded and any
benchmark is matched in whole; shingles of WAVE blocks are counted in one pass. Documents are never shuffled.

Edge cases: null and empty texts have no words; items without words have no window; an empty benchmark hits
nothing, an empty document table gives no rows. Items that repeat an id count once, and their windows together. Items
without an id are matched like others; they are in no list or number of items. Ids are of any type that casts to a
string. Of equally rare shingles the least hash is the prefix. A very long text is one chunk of a worker's memory. Rows
that repeat a doc_id are all answered. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .storage import ship

WINDOW, SHINGLE, BLOCK = 13, 5, 50_000
#: Blocks whose shingles are counted in one pass over the documents.
WAVE = 8
RESULT = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType())))]
)
ARROW_RESULT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hits", pa.list_(pa.list_(pa.int64())))])


@dataclass
class Block:
    """Distinct windows of some items and their shingles. prefix: sorted rarest shingles; rows[i]: the (window, offset) pairs of prefix[i]."""

    words: list[tuple[bytes, ...]]
    owners: list[list[str]]
    shingles: list[np.ndarray] = field(default_factory=list)
    prefix: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    rows: list[list[tuple[int, int]]] = field(default_factory=list)

    def order(self, counts: dict[int, int]) -> None:
        """Choose every window's rarest shingle as its prefix."""
        at: dict[int, list[tuple[int, int]]] = {}
        for w, s in enumerate(self.shingles):
            rare = min(range(len(s)), key=lambda i: (counts.get(int(s[i]), 0), int(s[i])))
            at.setdefault(int(s[rare]), []).append((w, rare))
        self.prefix = np.array(sorted(at), np.uint64)
        self.rows = [at[int(x)] for x in self.prefix]


def _words_of(texts: list[str]) -> Iterator[tuple[int, tc.Words]]:
    for words in tc.chunks(pa.array(texts, pa.string()), tc.WORD, tc.LOWER):
        for d in range(words.docs):
            yield d, words


def blocks(items: Iterator[tuple[str | None, str | None]], size: int = WINDOW, shingle: int = SHINGLE, most: int = BLOCK) -> Iterator[Block]:
    """Blocks of at most `most` windows from (item_id, text) pairs."""
    known: dict[tuple[bytes, ...], int] = {}
    block = Block([], [])

    def full() -> Block:
        for w in block.words:
            text = pa.array([b" ".join(w).decode()])
            words = next(tc.chunks(text, tc.WORD))
            block.shingles.append(tc.grams(words.hashes(), min(shingle, len(w))))
        return block

    for item, text in items:
        if text is None:
            continue
        for d, words in _words_of([text]):
            have = [words.text(i, i + 1) for i in range(int(words.first[d]), int(words.first[d + 1]))]
            for i in range(max(1, len(have) - size + 1) if have else 0):
                w = tuple(have[i : i + size])
                at = known.get(w)
                if at is None:
                    if len(block.words) >= most:
                        yield full()
                        block, known = Block([], []), {}
                    at = known[w] = len(block.words)
                    block.words.append(w)
                    block.owners.append([])
                if item is not None and (not block.owners[at] or block.owners[at][-1] != item):
                    block.owners[at].append(item)
    if block.words:
        yield full()


def _widths(block: Block, shingle: int) -> list[int]:
    return sorted({min(shingle, len(w)) for w in block.words})


class _Filter:
    """Which of many hashes are in a small sorted set: a bit table first, a binary search for what passes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        width = min(26, max(20, len(keys).bit_length() + 3))
        self.shift = np.uint64(64 - width)
        self.bits = np.zeros(1 << width, bool)
        self.bits[(keys >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h, and the number of the key there."""
        at = np.flatnonzero(self.bits[(h >> self.shift).astype(np.int64)])
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        good = self.keys[k] == h[at]
        return at[good], k[good]


def count_shingles(docs: DataFrame, some: list[Block], shingle: int, text_col: str = "text") -> dict[int, int]:
    """Exact number of occurrences in all documents of each shingle of some blocks. One sum for each task and shingle is exchanged."""
    every = _Filter(np.unique(np.concatenate([s for b in some for s in b.shingles])))
    widths = sorted({k for b in some for k in _widths(b, shingle)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(every.keys), np.int64)
        for batch in batches:
            for words in tc.chunks(batch.column(0), tc.WORD, tc.LOWER):
                h = words.hashes()
                for k in widths:
                    g = tc.grams(h, k)
                    at, key = every.find(g)
                    at_ok = tc.inside_doc(words.first, k, len(g))[at]
                    total += np.bincount(key[at_ok], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    found = docs.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {int(every.keys[r["k"]]): r["n"] for r in found}


def _occurrences(words: tc.Words, block: Block, prefix: _Filter, widths: list[int], shingle: int) -> Iterator[tuple[int, int, int]]:
    """(window, first word, end) of every occurrence in the chunk."""
    h = words.hashes()
    doc_of = words.doc_of()
    raw = words.data.tobytes()
    for k in widths:
        at, key = prefix.find(tc.grams(h, k))
        for place, i in zip(at.tolist(), key.tolist()):
            low, high = int(words.first[doc_of[place]]), int(words.first[doc_of[place] + 1])
            for w, offset in block.rows[i]:
                expect = block.words[w]
                n, start = len(expect), place - offset
                if min(n, shingle) != k or high - low < n or start < low or start + n > high:  # length and positional bounds
                    continue
                if all(raw[words.starts[start + j] : words.ends[start + j]] == expect[j] for j in range(n)):
                    yield w, start, start + n


def matcher(block: Block, shingle: int = SHINGLE):
    """A column function (text, earlier result) -> result, with this block's matches added."""
    prefix, widths = _Filter(block.prefix), _widths(block, shingle)

    def match(text: pa.Array, before: pa.Array) -> pa.Array:
        out = []
        for words in tc.chunks(text, tc.WORD, tc.LOWER):
            found: dict[int, tuple[set[int], list[tuple[int, int]]]] = {}
            doc_of = words.doc_of()
            for w, start, end in _occurrences(words, block, prefix, widths, shingle):
                d = int(doc_of[start])
                items, spans = found.setdefault(d, (set(), []))
                items.update(block.owners[w])
                spans.append((start - int(words.first[d]), end - int(words.first[d])))
            counts = words.counts()
            for d in range(words.docs):
                items, spans = found.get(d, (set(), []))
                old = before[words.row + d].as_py()
                if old:
                    items, spans = items | set(old["items"]), spans + [tuple(x) for x in old["hits"]]
                merged: list[list[int]] = []
                for a, b in sorted(spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                out.append({"n_words": int(counts[d]), "n_hit": sum(b - a for a, b in merged), "items": sorted(items), "hits": merged})
        return pa.array(out, ARROW_RESULT)

    return F.arrow_udf(match, RESULT).asNondeterministic()  # keeps the optimizer from running it twice


def with_contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, name: str = "contamination", size: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK, text_col: str = "text") -> DataFrame:
    """docs with a struct column `name`: n_words, n_hit, items (ids with occurring windows, sorted as strings), hits (word spans, end exclusive)."""
    ship(spark)
    empty = F.lit(None).cast(RESULT)
    docs = docs.withColumn(name, empty)
    pairs = ((r["item_id"], r["text"]) for r in items.select(F.col("item_id").cast("string").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator())
    none = True
    for some in itertools.batched(blocks(pairs, size, shingle, block), WAVE):
        counts = count_shingles(docs, list(some), shingle, text_col)
        for b in some:
            b.order(counts)
            docs = docs.withColumn(name, matcher(b, shingle)(F.col(text_col), F.col(name)))
        none = False
    if none:
        docs = docs.withColumn(name, matcher(Block([], []), shingle)(F.col(text_col), F.col(name)))
    return docs


def is_contaminated(found: Column) -> Column:
    """At least one word in twenty, and one at all, is hit."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_contamination(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    c = F.col("contamination")
    return out.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(c).alias("contaminated"),
    )


#: The same in DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)
"""
