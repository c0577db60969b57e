"""Document fingerprints: a threshold-scaled sketch of word shingles, in DataFrame functions only.

A shingle is five consecutive words (split at ASCII white space, unchanged), or all words of a shorter
text that has any. Its hash is the MD5 of the words joined by one space, as hexadecimal. The sketch of a
text keeps every distinct hash below a fixed fraction of the hash space (FRACTION), whatever the length of
the text, so sketches of a short and of a huge document can be compared: the share of one's hashes that
the other has estimates containment, and the share of the union estimates the Jaccard likeness.

A text whose hashes are all above the threshold keeps its least one. Sketches stay mergeable: the sketch
of two texts' union is the union's hashes below the threshold or, if there are none, the lesser of the two.

Edge cases: a null text counts as empty. A text without words has an empty sketch; two empty sketches are
alike (1.0), an empty and another are not (0.0). Rows that repeat a doc_id are ordered by a hash of their text;
null doc_ids come last in descending order. One document is its own next. A very long text is one row of a task.
An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Workspace, measured

SHINGLE = 5
#: The first hexadecimal digit of a kept hash is below this: two of sixteen, an eighth of all hashes.
KEPT_DIGITS = 2
FRACTION = KEPT_DIGITS / 16
#: Hexadecimal digits of a hash that the fingerprint shows (64 bits).
DIGITS = 16
#: The ordered neighbour search deals the rows into cells of about ROWS rows; keys of more than HOT_ROWS are split.
ROWS, HOT_ROWS = 128, 1024
#: Neighbouring cells are found among so many cells at a time.
SPAN = 4096


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the sketch of a text column. Each step is a column of its own, so nothing is computed twice."""
    words, hashes, kept = f"__{name}_words", f"__{name}_hashes", f"__{name}_kept"
    df = df.withColumn(words, F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")), " "))
    w = F.col(words)
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
    whole = F.when(F.element_at(w, 1) == "", F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.md5(F.array_join(F.slice(w, i, SHINGLE), " ").cast("binary"))))
    df = df.withColumn(hashes, whole).withColumn(kept, F.filter(hashes, lambda h: h < format(KEPT_DIGITS, "x")))
    least = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<string>"))
    some = F.when(F.size(kept) > 0, F.array_sort(F.array_distinct(kept))).otherwise(least)
    return df.withColumn(name, F.transform(some, lambda h: F.substring(h, 1, DIGITS))).drop(words, hashes, kept)


def pack(kept: Column) -> Column:
    """A sketch as bytes, eight for each hash."""
    return F.unhex(F.array_join(kept, ""))


def unpack(packed: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.hex(packed)), F.lit(f".{{{DIGITS}}}"), 0)


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two texts' shingle sets, from their sketches."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h < format(KEPT_DIGITS, "x"))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of a that b has too; 1 if a has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def _cell(key: Column, cuts: list[int], parts: int) -> Column:
    """A cell number that rises with the key: a binary search over the cuts, then equal parts between two cuts."""

    def search(low: int, high: int) -> Column:
        if high - low == 1:
            a, b = cuts[low], cuts[high]
            place = ((key - F.lit(a)).cast("double") * F.lit(float(parts)) / F.lit(float(max(1, b - a)))).cast("long")
            return F.lit(low * parts).cast("long") + F.least(F.greatest(place, F.lit(0).cast("long")), F.lit(parts - 1).cast("long"))
        mid = (low + high) // 2
        return F.when(key < F.lit(cuts[mid]), search(low, mid)).otherwise(search(mid, high))

    return search(0, len(cuts) - 1)


PLACE = ["cell", "segment", "piece"]


def _placed(work: Workspace, df: DataFrame, key: str) -> DataFrame:
    """df with its place (cell, segment, piece), which rises with (key, h).

    Equal-frequency cuts of the key make the cells. A key with more than HOT_ROWS rows is a segment of its own in its
    cell, and the range of h is cut into pieces there.
    """
    n = df.count()
    cuts = sorted({int(x) for x in df.approxQuantile(key, [i / 64 for i in range(65)], 0.002)})
    if len(cuts) < 2:
        cuts = [*(cuts or [0]), (cuts or [0])[0] + 1]
    parts = max(1, n // ROWS // (len(cuts) - 1))
    df = df.withColumn("cell", F.coalesce(_cell(F.col(key), cuts, parts), F.lit(-1).cast("long")))
    hot = df.groupBy("cell", key).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS)
    hot = work.save(hot.groupBy("cell").agg(F.collect_list(F.struct(F.col(key).alias("key"), "n")).alias("hot")), "hot")
    if hot.isEmpty():
        return df.withColumns({"segment": F.lit(0), "piece": F.lit(0).cast("long")})
    df = df.join(measured(hot, 1024), "cell", "left")
    own = F.filter("hot", lambda x: x["key"].eqNullSafe(F.col(key)))
    is_hot = F.coalesce(F.size(own) > 0, F.lit(False))
    below = F.coalesce(F.size(F.filter("hot", lambda x: x["key"] < F.col(key))), F.lit(0))
    pieces = F.ceil(F.try_element_at(own, F.lit(1))["n"] / HOT_ROWS)
    high = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63)).cast("long")), 32)  # h in order, from 0 to 2 ** 32
    piece = F.when(is_hot, F.shiftrightunsigned(high * pieces, 32)).otherwise(F.lit(0).cast("long"))
    return df.withColumns({"segment": F.when(F.size("hot") > 0, 2 * below + is_hot.cast("int")).otherwise(F.lit(0)), "piece": piece}).drop("hot")


def _following(places: DataFrame) -> DataFrame:
    """Each place of a table of places with the next lower one (cell, segment, piece as to_*); the last with the first.

    Places are ordered within SPAN cells at a time; only the heads of such spans are ordered together.
    """
    places = places.withColumn("span", F.floor(F.col("cell") / SPAN))
    place = F.struct(*PLACE)
    heads = places.groupBy("span").agg(F.max(place).alias("head"))
    heads = heads.select("span", F.coalesce(F.lead("head").over(Window.orderBy(F.desc("span"))), F.max("head").over(Window.partitionBy())).alias("head"))
    inside = Window.partitionBy("span").orderBy(*(F.desc(c) for c in PLACE))
    out = places.withColumn("to", F.lead(place).over(inside)).join(heads, "span").withColumn("to", F.coalesce("to", "head"))
    return out.select(*PLACE, *(F.col(f"to.{c}").alias(f"to_{c}") for c in PLACE))


def with_next(work: Workspace, df: DataFrame, key: str, columns: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """derive(df) with next_<column> for each column: its value in the row that follows in descending order of (key, h).

    df has a column h, a hash that tells rows with one key apart. derive adds columns row by row; it is applied to each
    row once, and to the first row of each place again. Each place of about ROWS rows is ordered in one task; the last
    row of a place takes its next from the first row of the following place, and the very last from the very first.
    """
    placed = _placed(work, df, key)
    top = F.struct(F.col(key).isNotNull().alias("some"), key, "h")
    tops = work.save(placed.groupBy(*PLACE).agg(F.max(top).alias("top")), "tops")
    wanted = tops.select(*PLACE, F.col(f"top.{key}").alias("top_key"), F.col("top.h").alias("top_h"))
    same = F.col(key).eqNullSafe(F.col("top_key")) & (F.col("h") == F.col("top_h"))
    first = placed.join(measured(wanted, 40), PLACE).where(same).groupBy(*PLACE).agg(F.max(F.struct(*df.columns)).alias("r"))
    first = derive(first.select(*PLACE, "r.*")).select(*(F.col(c).alias(f"to_{c}") for c in PLACE), F.struct(*columns).alias("after"))
    after = work.save(_following(tops.select(*PLACE)).join(first, [f"to_{c}" for c in PLACE]).select(*PLACE, "after"), "after")
    order = [F.col(key).desc_nulls_last(), F.desc("h")]
    led = derive(placed).withColumn("next", F.lead(F.struct(*columns)).over(Window.partitionBy(*PLACE).orderBy(*order)))
    out = led.join(after, PLACE).withColumn("next", F.coalesce("next", "after"))
    return out.select(*(c for c in led.columns if c not in (*PLACE, "next", "h")), *(F.col(f"next.{c}").alias(f"next_{c}") for c in columns))


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, text (null: empty), sketch, and those of the next and of the edited text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("h", F.xxhash64("text"))
    packed = lambda df: with_sketch(df, "text", "sketch").withColumn("sketch", pack(F.col("sketch")))  # noqa: E731  half of what is shuffled otherwise
    with Workspace(docs.sparkSession, "fingerprints") as work:
        both = with_next(work, own, "doc_id", ["text", "sketch"], packed)
    both = both.withColumns({c: unpack(F.col(c)) for c in ("sketch", "next_sketch")}).withColumn("edited_text", edited(F.col("text"), F.col("next_text"))).drop("next_text")
    return with_sketch(both, "edited_text", "edited_sketch")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return f.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"),
        F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("contained_next"),
    )


#: The same in DuckDB.
ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS nt,
         first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS ft
  FROM documents),
edit AS (
  SELECT doc_id, text, coalesce(nt, ft) AS next_text,
         substr(text, 1, length(text) - length(text) // 2) || substr(coalesce(nt, ft), 1, length(text) // 2) AS edited_text
  FROM base),
texts AS (
  SELECT doc_id, 1 AS kind, text AS t FROM edit UNION ALL SELECT doc_id, 2, edited_text FROM edit UNION ALL SELECT doc_id, 3, next_text FROM edit),
words AS (
  SELECT doc_id, kind, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
hashes AS (
  SELECT doc_id, kind, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE
    [md5(array_to_string(w[i : i + 4], ' ')) FOR i IN range(1, greatest(len(w) - 4, 1) + 1)] END AS h
  FROM words),
sketches AS (
  SELECT doc_id, kind, [x[1:16] FOR x IN CASE WHEN len([y FOR y IN h IF y < '2']) > 0 THEN list_sort(list_distinct([y FOR y IN h IF y < '2']))
    WHEN len(h) > 0 THEN [list_min(h)] ELSE []::VARCHAR[] END] AS s
  FROM hashes)
SELECT e.doc_id, length(e.text)::BIGINT AS n_chars, sha256(e.edited_text) AS edited_sha256,
  array_to_string(a.s, '') AS fingerprint, array_to_string(b.s, '') AS edited_fingerprint,
  CASE WHEN len(a.s) + len(b.s) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END AS near_edited,
  CASE WHEN len(a.s) + len(c.s) = 0 THEN 1.0 ELSE len(list_intersect(a.s, c.s))::DOUBLE / (len(a.s) + len(c.s) - len(list_intersect(a.s, c.s))) END AS near_next,
  CASE WHEN len(a.s) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s))::DOUBLE / len(a.s) END AS contained_edited,
  CASE WHEN len(a.s) = 0 THEN 1.0 ELSE len(list_intersect(a.s, c.s))::DOUBLE / len(a.s) END AS contained_next
FROM edit e JOIN sketches a ON a.doc_id = e.doc_id AND a.kind = 1 JOIN sketches b ON b.doc_id = e.doc_id AND b.kind = 2 JOIN sketches c ON c.doc_id = e.doc_id AND c.kind = 3
"""
