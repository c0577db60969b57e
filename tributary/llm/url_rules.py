"""URL filters: explicit host and path rules, and association rules mined by Spark's FP-growth.

Explicit rules come first: the longest that fits decides. For every other URL the mined rules do.

Mining. A URL is the set of its tokens: host labels, registered-like host suffixes, path words without
digits, file extension, query keys and a fragment mark. Labelled pages (labels.doc_id = page_id; quality 0
is bad) give one basket each, with the item `=bad` for bad ones. Tokens that are in the same baskets throughout
are one item (a class): of such tokens a rule never needs two, and any of them serves. FP-growth finds itemsets
over all labelled pages (of more than MAX_TRAINING, those with a hash of their id below the share); a rule
`classes => =bad` of at most MAX_ITEMS classes stays if its support reaches the bound, its confidence is MIN_LIFT times
the share of bad pages or more, and no shorter rule within it is as confident. This pruning is done in Spark, size
by size, and no number of rules is set.

Matching. Rules are an inverted index, a table: token -> class, and class -> the rules whose rarest class it is.
The tokens of each different URL are looked up, a rule found is verified, and it fits if the URL has a token of
each of its classes; it counts once for each choice of such tokens. Where there are no rules nothing is joined.

Edge cases: a null URL or one without `://` has an empty host and path, no tokens, and is allowed. A very long URL
is one set of tokens. Of rules that fit as long as each other there is one only, as a URL has one prefix of a length.
Equally confident rules of which one holds the other: the shorter stays. An empty label table mines no rule, an
empty page table gives no rows. Rows that repeat a page_id are all answered, and each is a basket; labels that repeat
an id count once, bad if one of them is. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace, measured

#: (verdict, host, path): fixed values of the contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Labelled pages that are mined, about, where there are more.
MAX_TRAINING = 200_000
#: Bounds of a rule: its share of the baskets, its bad baskets, its confidence over the share of bad ones, its classes.
MIN_SUPPORT, MIN_COUNT, MIN_LIFT, MAX_ITEMS = 0.002, 5, 1.5, 3
BAD = "=bad"


def _upper(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(_upper(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL. Numbers are left out: they name a page, not a kind of page."""
    host, path = host_path(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    words = lambda text, mark: F.transform(F.filter(F.split(text, r"[^\p{L}]+"), lambda w: w != ""), lambda w: F.concat(F.lit(mark), F.lower(w)))
    query = F.regexp_extract_all(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    found = F.concat(
        F.transform(F.filter(labels, lambda w: w != ""), lambda w: F.concat(F.lit("h:"), w)),
        F.flatten(F.transform(labels, lambda w: words(w, "w:"))),
        F.when(n >= 3, F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, n - 2, 3), ".")))).otherwise(F.array().cast("array<string>")),
        words(path, "p:"),
        F.transform(query, lambda k: F.concat(F.lit("q:"), k)),
        F.when(F.instr(url, "#") > 0, F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
    )
    return F.coalesce(F.array_distinct(F.filter(found, lambda t: t.isNotNull())), F.array().cast("array<string>"))


@dataclass(frozen=True)
class MinedRule:
    """items: for each class of tokens the tokens, any of which serves."""

    items: tuple[tuple[str, ...], ...]
    confidence: float
    support: float


RULE_SCHEMA = "items array<array<string>>, confidence double, support double"


def mine_table(work: Workspace, pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT, max_items: int = MAX_ITEMS) -> DataFrame | None:
    """The pruned rules from the labelled pages, all of them: items, confidence, support. None: there are none."""
    bad = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("bad"))
    labelled = work.save(pages.select("page_id", "url").where("url IS NOT NULL").join(bad, "page_id"), "labelled")
    n = labelled.count()
    if n > MAX_TRAINING:
        labelled = labelled.where(F.xxhash64("page_id", F.lit("mined")).bitwiseAND(F.lit((1 << 52) - 1)) < int(MAX_TRAINING / n * (1 << 52)))
    baskets = work.save(labelled.select(F.monotonically_increasing_id().alias("b"), tokens(F.col("url")).alias("tokens"), "bad"), "baskets")
    n, n_all_bad = baskets.agg(F.count("*"), F.count_if("bad")).first()
    if not n_all_bad:
        return None
    least = max(MIN_COUNT, math.ceil(min_support * n))
    min_confidence = min(1.0, min_lift * (n_all_bad / n))
    # A rule's tokens are in as many bad baskets as the rule at least: others can be in none.
    each = baskets.select("b", "bad", F.explode("tokens").alias("token"))
    same = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.bit_xor(F.xxhash64("b")).alias("x"), F.bit_xor(F.xxhash64("b", F.lit(1))).alias("y"))
    same = same.where(F.col("n_bad") >= least)
    classes = work.save(same.groupBy("n", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.col("members")[0].alias("class"), "members"), "classes")
    # At most the tokens of least bad baskets each: 1 / MIN_SUPPORT times those of a URL, sent to all if measured small.
    held = each.join(measured(classes.select("class"), 256), each["token"] == F.col("class")).groupBy("b").agg(F.collect_list("token").alias("classes"), F.max("bad").alias("bad"))
    items = F.concat("classes", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>")))
    items = work.save(held.select(items.alias("items")), "items")
    # FPGrowth takes a share of its own rows; half a row less makes its rounding safe.
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, items.count())), minConfidence=min_confidence, numPartitions=int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(items).freqItemsets
    sets = work.save(sets.where(F.size("items") <= max_items + 1).select(F.array_sort("items").alias("items"), F.array_contains("items", BAD).alias("bad"), "freq"), "sets")
    with_bad = sets.where(F.col("bad") & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("n_bad"))
    rules = with_bad.join(sets.where("NOT bad"), "items").select("items", F.size("items").alias("k"), (F.col("n_bad") / F.col("freq")).alias("confidence"), (F.col("n_bad") / F.lit(n)).alias("support"))
    rules = work.save(rules, "rules")
    sure = F.col("confidence") >= min_confidence
    longest = rules.where(sure).agg(F.max("k")).first()[0]
    if not longest:
        return None
    # best: the confidence of the surest rule within. Every part of a frequent set is frequent: the sets with one item less are all there.
    level = rules.where("k = 1").select("items", "confidence", "support", F.lit(0.0).alias("best"))
    kept = [level.where(sure)]
    for k in range(2, longest + 1):
        parts = rules.where(F.col("k") == k).select(F.col("items").alias("whole"), F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("items"))
        best = parts.join(level.select("items", F.greatest("confidence", "best").alias("best")), "items").groupBy(F.col("whole").alias("items")).agg(F.max("best").alias("best"))
        level = work.save(rules.where(F.col("k") == k).join(best, "items").select("items", "confidence", "support", "best"), f"level{k}")
        kept.append(level.where(sure & (F.col("confidence") > F.col("best"))))
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    found = found.select(F.xxhash64("items").alias("id"), F.posexplode("items").alias("i", "class"), "confidence", "support").join(classes, "class")
    found = found.groupBy("id", "confidence", "support").agg(F.array_sort(F.collect_list(F.struct("i", "members"))).alias("x"))
    found = work.save(found.select(F.col("x.members").alias("items"), "confidence", "support"), "found")
    work.drop("labelled", "baskets", "classes", "items", "sets", "rules", *(f"level{k}" for k in range(2, longest + 1)))
    return None if found.isEmpty() else found


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT, max_items: int = MAX_ITEMS) -> list[MinedRule]:
    """The rules of mine_table, strongest first."""
    with Workspace(pages.sparkSession, "url_rules") as work:
        found = mine_table(work, pages, labels, min_support, min_lift, max_items)
        rules = [] if found is None else [MinedRule(tuple(map(tuple, r["items"])), r.confidence, r.support) for r in found.collect()]
    work.close()
    return sorted(rules, key=lambda r: (-r.confidence, -r.support, r.items))


def mined_hits(work: Workspace, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, n_mined): for each different URL that some rule fits, by how many choices of its tokens."""
    urls = pages.select("url").where("url IS NOT NULL").distinct()
    # A class is named by its first token; the rules of one call have classes without common tokens.
    index = rules.select(F.explode("items").alias("members")).distinct().select(F.col("members")[0].alias("class"), F.explode("members").alias("token"))
    has = urls.select("url", F.explode(tokens(F.col("url"))).alias("token")).join(index, "token")
    has = work.save(has.groupBy("url", "class").agg(F.count("*").alias("n")).groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("has")), "has")
    common = has.select(F.explode(F.map_keys("has")).alias("class")).groupBy("class").agg(F.count("*").alias("df"))
    named = rules.select(F.transform("items", lambda m: m[0]).alias("rule")).withColumn("id", F.monotonically_increasing_id())
    named = work.save(named, "named")
    rarest = named.select("id", F.explode("rule").alias("class")).join(common, "class", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "class")).alias("x"))
    anchors = named.join(rarest, "id").select(F.col("x.class").alias("class"), "rule")
    choices = F.aggregate("rule", F.lit(1).cast("long"), lambda acc, c: acc * F.coalesce(F.try_element_at("has", c), F.lit(0)))
    fits = has.select("url", "has", F.explode(F.map_keys("has")).alias("class")).join(anchors, "class").select("url", choices.alias("n"))
    return fits.where("n > 0").groupBy("url").agg(F.sum("n").alias("n_mined"))


def judge(pages: DataFrame, mined: DataFrame | list[MinedRule] | None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, n_mined (how many mined rules fit)."""
    host, path = host_path(F.col("url"))
    df = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    df = df.withColumns({"rule": rule, "fixed": verdict})
    if isinstance(mined, list):
        mined = pages.sparkSession.createDataFrame([([list(m) for m in r.items], r.confidence, r.support) for r in mined], RULE_SCHEMA) if mined else None
    hits = F.lit(0).cast("long")
    if mined is not None:
        with Workspace(pages.sparkSession, "url_hits") as work:
            hit = mined_hits(work, pages, mined)
        df, hits = df.join(hit, "url", "left"), F.coalesce("n_mined", F.lit(0).cast("long"))
    df = df.withColumn("n_mined", hits)
    method = F.when(F.col("n_mined") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return df.withColumn("verdict", F.coalesce("fixed", method)).select("page_id", "url", "host", "path", "rule", "verdict", "n_mined")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    with Workspace(spark, "url_rules") as work:
        mined = mine_table(work, pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        out = judge(pages, mined)
    return out.select("page_id", "host", "path", "rule", "verdict", F.col("n_mined").alias("n_mined_rules"))


_TOKENS = r"""
  list_distinct(
    [concat('h:', x) FOR x IN labels IF x <> ''] ||
    [concat('w:', lower(x)) FOR x IN flatten([regexp_split_to_array(y, '[^\p{L}]+') FOR y IN labels]) IF x <> ''] ||
    CASE WHEN len(labels) >= 3 THEN ['d:' || array_to_string(labels[len(labels) - 2 :], '.')] ELSE [] END ||
    [concat('p:', lower(x)) FOR x IN regexp_split_to_array(path, '[^\p{L}]+') IF x <> ''] ||
    [concat('q:', x) FOR x IN regexp_extract_all(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '(?:^|&)([^=&]+)', 1)] ||
    CASE WHEN contains(url, '#') THEN ['f:'] ELSE [] END)"""
_RULE = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{}}" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
#: The same in DuckDB, mining included: tokens, their combinations up to MAX_ITEMS, and the rules among them.
ORACLE = f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
ruled AS (
  SELECT *, {_RULE.format(*("'" + h + p + "'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))))} AS rule,
    {_RULE.format(*("'" + v + "'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))))} AS fixed,
    row_number() OVER (ORDER BY page_id, url) AS r, string_split(host, '.') AS labels FROM split),
tok AS (SELECT r, unnest({_TOKENS}) AS t FROM ruled WHERE url IS NOT NULL),
bad AS (SELECT doc_id AS page_id, min(quality) = 0 AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
base AS (SELECT r, bad FROM ruled JOIN bad USING (page_id) WHERE url IS NOT NULL),
total AS (SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad, greatest({MIN_COUNT}, ceil({MIN_SUPPORT}::DOUBLE * count(*))) AS least FROM base),
ones AS (SELECT [t] AS s, r FROM tok WHERE t IN (SELECT t FROM tok JOIN base USING (r) WHERE bad GROUP BY 1 HAVING count(*) >= (SELECT least FROM total))),
combos AS (
  SELECT s, r FROM ones
  UNION ALL SELECT a.s || b.s, a.r FROM ones a JOIN ones b ON a.r = b.r AND a.s < b.s
  UNION ALL SELECT a.s || b.s || c.s, a.r FROM ones a JOIN ones b ON a.r = b.r AND a.s < b.s JOIN ones c ON a.r = c.r AND b.s < c.s),
conf AS (
  SELECT s, count(*) FILTER (WHERE bad) / count(*)::DOUBLE AS c FROM combos JOIN base USING (r) GROUP BY 1 HAVING count(*) FILTER (WHERE bad) >= (SELECT least FROM total)),
within AS (
  SELECT s, max(c) AS best FROM (
    SELECT a.s, b.c FROM (SELECT s, unnest([[s[1]], [s[2]], [s[3]], [s[1], s[2]], [s[1], s[3]], [s[2], s[3]]]) AS part FROM conf WHERE len(s) > 1) a JOIN conf b ON a.part = b.s AND len(b.s) < len(a.s)) GROUP BY 1),
rules AS (
  SELECT conf.s FROM conf LEFT JOIN within USING (s), total WHERE c >= least(1.0::DOUBLE, {MIN_LIFT}::DOUBLE * (n_bad / n::DOUBLE)) AND (best IS NULL OR c > best)),
hits AS (SELECT r, count(*) AS n_mined FROM combos JOIN rules USING (s) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN coalesce(n_mined, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict, coalesce(n_mined, 0)::BIGINT AS n_mined_rules
FROM ruled LEFT JOIN hits USING (r)
"""
