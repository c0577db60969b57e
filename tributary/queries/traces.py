"""Trace analytics over the events table, and training-table checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, trace
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
POOLS = [16, 64, 128]
_T = "t AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS t, user_id AS page_id FROM events), n AS (SELECT t, page_id, lead(t) OVER (PARTITION BY page_id ORDER BY t) AS nxt, coalesce(lag(t) OVER (PARTITION BY page_id ORDER BY t), -1) AS prv FROM t)"
_REUSE = f"WITH {_T}, r AS (SELECT a.t, a.page_id, CASE WHEN a.nxt IS NULL THEN 1000000 ELSE (SELECT count(*) FROM n u WHERE u.t > a.t AND u.t < a.nxt AND u.prv <= a.t) END AS reuse FROM n a)"


def query(name: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], None]:
    """Register f(trace of events), or f(that trace, its accesses)."""

    def add(f: Callable[..., DataFrame]) -> None:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            events = table(spark, folder, "events")
            # The number of events is in the file's footer: no trace is made for it.
            return f(trace.from_events(events), *([events.count()] if f.__code__.co_argcount == 2 else []))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql

    return add


query("trace_next_occurrence", f"WITH {_T} SELECT t, page_id, coalesce(nxt, -1) AS next_t FROM n")(lambda d: trace.next_occurrence(d).select("t", "page_id", "next_t"))
query("trace_reuse_distance", f"{_REUSE} SELECT t, page_id, reuse FROM r")(lambda d, n: trace.reuse_distance(d, accesses=n).select("t", "page_id", "reuse"))
query("trace_window_features", f"{_REUSE} SELECT t, page_id, array_to_string(w, ',') AS window_pages, round(ln(reuse + 1), 6) AS label FROM (SELECT t, page_id, reuse, list(page_id) OVER (ORDER BY t ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS w FROM r) WHERE t >= 63")(
    lambda d, n: trace.window_features(d, accesses=n).select("t", "page_id", F.array_join("window", ",").alias("window_pages"), F.round("label", 6).alias("label"))
)
query("trace_window_frequency", f"WITH {_T} SELECT t, page_id, len(list_filter(w, lambda x: x = page_id)) / 64.0::DOUBLE AS frequency FROM (SELECT t, page_id, list(page_id) OVER (ORDER BY t ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS w FROM t) WHERE t >= 63")(
    lambda d: trace.window_frequency(trace.windows(d)).select("t", "page_id", "frequency")
)
query("trace_recency_features", f"WITH {_T} SELECT t, page_id, round(coalesce(ln(1 + t - lag(t, 1) OVER w), 0.0), 6) AS recency, round(ln(1 + row_number() OVER w), 6) AS frequency, round(coalesce(ln(1 + t - lag(t, 2) OVER w), 0.0), 6) AS recency_2 FROM t WINDOW w AS (PARTITION BY page_id ORDER BY t)")(
    lambda d: trace.recency_features(d).select("t", "page_id", *(F.round(x, 6).alias(x) for x in ("recency", "frequency", "recency_2")))
)
query(
    "trace_label_smoothing",
    f"{_REUSE}, l AS (SELECT t, page_id, ln(reuse + 1) AS label FROM r), m AS (SELECT page_id, avg(label) AS m FROM l WHERE t % 5 <> 0 GROUP BY 1), g AS (SELECT avg(label) AS g FROM l WHERE t % 5 <> 0) SELECT t, l.page_id, round(0.7::DOUBLE * coalesce(m, g) + 0.3::DOUBLE * label, 6) AS smoothed FROM l LEFT JOIN m USING (page_id) CROSS JOIN g",
)(lambda d, n: trace.label_smoothing(trace.reuse_distance(d, accesses=n).withColumn("label", F.log1p("reuse")), "label", F.col("t") % 5 != 0).select("t", "page_id", F.round("smoothed", 6).alias("smoothed")))
query("trace_lru_hits", f"{_REUSE} " + " UNION ALL ".join(f"SELECT {k} AS pool, count(*) FILTER (WHERE reuse < {k}) AS hits, round(count(*) FILTER (WHERE reuse < {k}) / count(*)::DOUBLE, 9) AS hit_rate FROM r" for k in POOLS))(
    lambda d, n: trace.lru_hits(d, POOLS, n).select("pool", "hits", F.round("hit_rate", 9).alias("hit_rate"))
)
query("trace_top_pages", "SELECT user_id AS page_id, count(*) AS accesses FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(lambda d: trace.top_pages(d))
query("trace_page_positions", f"WITH {_T} SELECT page_id, string_agg(t::VARCHAR, ',' ORDER BY t) AS positions FROM t GROUP BY 1")(lambda d: trace.page_positions(d).select("page_id", F.array_join("positions", ",").alias("positions")))
query("trace_summary", "SELECT count(*) AS accesses, count(DISTINCT user_id) AS unique_pages, round(100.0::DOUBLE * count(DISTINCT user_id) / (max(user_id) + 1), 6) AS coverage_percent, max(user_id) AS max_page, round((SELECT sum(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10))::DOUBLE / count(*), 9) AS top_share FROM events")(
    lambda d: trace.summary(d).select("accesses", "unique_pages", F.round("coverage_percent", 6).alias("coverage_percent"), "max_page", F.round("top_share", 9).alias("top_share"))
)
query("trace_concat", f"WITH {_T} SELECT t, page_id FROM t UNION ALL SELECT t + (SELECT count(*) FROM t), page_id FROM t")(lambda d: trace.concat(d, d).select("t", "page_id"))
query(
    "trace_page_mse",
    f"{_REUSE}, f AS (SELECT page_id, ln(reuse + 1) AS y, coalesce(ln(1 + t - lag(t) OVER (PARTITION BY page_id ORDER BY t)), 0.0) AS p FROM r), g AS (SELECT page_id, avg(p) AS p, avg(y) AS y FROM f GROUP BY 1) SELECT round(avg(pow(p - y, 2)), 6) AS page_mse, count(*) AS pages FROM g",
)(lambda d, n: trace.page_mse(trace.reuse_distance(d, accesses=n).select("trace_id", "t", F.log1p("reuse").alias("label")).join(trace.recency_features(d), ["trace_id", "t"]), "recency", "label").select(F.round("page_mse", 6).alias("page_mse"), "pages"))
query("trace_policy_simulation")(lambda d: trace.simulate(d, [16, 64]))


def _models(d: DataFrame) -> dict[str, trace.EvictionModel]:
    samples = trace.eviction_samples(d, 16)
    return {f"learned_{kind}": trace.train_eviction_model(samples, kind) for kind in trace.FEATURES}


query("trace_learned_policies")(lambda d: trace.simulate(d, [16], ("lru", "belady"), _models(d)))
query("trace_ranking_accuracy")(lambda d: trace.simulate(d, [8], ("lru", "score"), _models(d)).select("policy", "pool", "ranking_accuracy"))
query(
    "label_cap",
    f"{_REUSE} SELECT t, page_id, round(least(ln(reuse + 1), {quality.LABEL_CAP}::DOUBLE), 6) AS label FROM r",
)(lambda d, n: quality.cap_labels(trace.reuse_distance(d, accesses=n).withColumn("label", F.log1p("reuse")), "label").select("t", "page_id", F.round("label", 6).alias("label")))
query("trace_eviction_samples")(lambda d: trace.eviction_samples(d, 8))
QUERIES["trace_zipf_source"] = lambda spark, folder: trace.zipf_trace(spark, 20_000, 512)
QUERIES["trace_multiscale_source"] = lambda spark, folder: trace.multiscale_traces(spark, {1: (5_000, 128), 10: (20_000, 1280)})


@query("standardize_features", f"WITH {_T}, f AS (SELECT t, page_id, coalesce(ln(1 + t - lag(t) OVER (PARTITION BY page_id ORDER BY t)), 0.0) AS recency FROM t), s AS (SELECT avg(recency) AS m, stddev_samp(recency) AS d FROM f WHERE t % 5 <> 0) SELECT t, page_id, round((recency - m) / CASE WHEN coalesce(d, 0) = 0 THEN 1 ELSE d END, 6) AS z_recency FROM f CROSS JOIN s")
def _(d: DataFrame) -> DataFrame:
    return quality.standardise(trace.recency_features(d), ["recency"], F.col("t") % 5 != 0).select("t", "page_id", F.round("z_recency", 6).alias("z_recency"))


def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.split_80_20(table(spark, folder, "customer"), "c_mktsegment", F.col("c_custkey"))
    return out.select("c_mktsegment", "c_custkey", "is_train")


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def quality_constant_cols(spark: SparkSession, folder: str) -> DataFrame:
    return quality.constant_columns(table(spark, folder, "lineitem"), _COLUMNS)


def quality_corr_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return quality.correlated_pairs(table(spark, folder, "lineitem"), _COLUMNS).withColumn("correlation", F.round("correlation", 6))


def _latencies(spark: SparkSession, folder: str) -> DataFrame:
    """Event values stand in for latencies: types for queries, users for configurations and scale factors."""
    return table(spark, folder, "events").select((F.col("user_id") % 3).alias("sf"), F.col("event_type").alias("query"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("config"), F.col("value").alias("latency_ms"))


def latency_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return quality.latency_pivot(_latencies(spark, folder), "sf").select("sf", "query", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def result_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Orders against a copy whose prices are off by up to 0.02."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    moved = o.withColumn("o_totalprice", F.col("o_totalprice") + (F.col("o_orderkey").cast("long") % 3) * 0.0099)
    return quality.mismatches(o, moved, 0.01).groupBy("column_name").agg(F.count("*").alias("n"))


_CHECKED = ["l_quantity", "l_discount", "l_tax"]


def quality_training_report(spark: SparkSession, folder: str) -> DataFrame:
    """Lines stand in for samples: line numbers for strata, two key digits for an order."""
    rows = table(spark, folder, "lineitem").select(*_CHECKED, "l_linenumber", (F.col("l_orderkey") % 3).alias("p0"), (F.col("l_partkey") % 3).alias("p1"))
    return quality.training_report(rows, _CHECKED, "l_linenumber", ["p0", "p1"], (1, 5)).withColumn("value", F.round("value", 6))


QUERIES |= {f.__name__: f for f in (stratified_split, quality_constant_cols, quality_corr_pairs, quality_training_report, result_mismatches, latency_pivot)}
ORACLES |= {
    "quality_constant_cols": " UNION ALL ".join(f"SELECT '{x}' AS column_name, min({x}) AS minimum, max({x}) AS maximum, count(*) FILTER (WHERE {x} IS NULL OR isnan({x}) OR isinf({x})) AS non_finite, min({x}) = max({x}) AS is_constant FROM lineitem" for x in _COLUMNS),
    "quality_corr_pairs": " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation, abs(corr({a}, {b})) > 0.99 AS too_close FROM lineitem" for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]),
    "latency_pivot": "SELECT user_id % 3 AS sf, event_type AS query, round(median(value) FILTER (WHERE user_id % 2 = 0), 6) AS a, round(median(value) FILTER (WHERE user_id % 2 <> 0), 6) AS b FROM events GROUP BY 1, 2",
    "stratified_split": "SELECT c_mktsegment, c_custkey, percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR), c_custkey) < 0.8 AS is_train FROM customer",
    "result_mismatches": "SELECT 'o_totalprice' AS column_name, count(*) AS n FROM orders WHERE o_orderkey % 3 = 2 HAVING count(*) > 0",
    "quality_training_report": "WITH s AS (SELECT *, l_orderkey % 3 AS p0, l_partkey % 3 AS p1 FROM lineitem) "
    "SELECT 'stratum_outside' AS check, '' AS detail, count(*) FILTER (WHERE l_linenumber NOT BETWEEN 1 AND 5)::DOUBLE AS value, count(*) FILTER (WHERE l_linenumber NOT BETWEEN 1 AND 5) > 0 AS warning FROM s "
    "UNION ALL SELECT 'order_invalid', '', count(*) FILTER (WHERE p0 > 1 OR p1 > 1 OR (l_linenumber > 1 AND p0 = p1))::DOUBLE, count(*) FILTER (WHERE p0 > 1 OR p1 > 1 OR (l_linenumber > 1 AND p0 = p1)) > 0 FROM s "
    "UNION ALL SELECT 'orders_distinct', '', count(DISTINCT (p0, p1))::DOUBLE, count(DISTINCT (p0, p1)) <= 10 FROM s "
    "UNION ALL SELECT 'stratum_rows', l_linenumber::VARCHAR, count(*)::DOUBLE, count(*) < 100 FROM s GROUP BY l_linenumber "
    + "".join(f"UNION ALL SELECT 'feature_not_finite', '{x}', count(*) FILTER (WHERE {x} IS NULL OR isnan({x}) OR isinf({x}))::DOUBLE, count(*) FILTER (WHERE {x} IS NULL OR isnan({x}) OR isinf({x})) > 0 FROM s UNION ALL SELECT 'feature_constant', '{x}', (min({x}) = max({x}))::INT::DOUBLE, min({x}) = max({x}) FROM s " for x in _CHECKED)
    + "".join(f"UNION ALL SELECT 'features_correlate', '{a}~{b}', round(corr({a}, {b}), 6), true FROM s HAVING abs(corr({a}, {b})) > 0.99 " for i, a in enumerate(_CHECKED) for b in _CHECKED[i + 1 :]),
}
