"""Trace analytics against plain simulations."""

import numpy as np
from pyspark.sql import functions as F

from tributary.operators import trace


def _frame(spark, pages):
    return spark.createDataFrame([(0, i, p) for i, p in enumerate(pages)], "trace_id int, t long, page_id long")


def test_reuse_distance_and_lru(spark):
    pages = np.random.default_rng(3).integers(0, 12, 300).tolist()
    got = {r.t: r.reuse for r in trace.reuse_distance(_frame(spark, pages)).collect()}
    for t, p in enumerate(pages):
        later = [i for i in range(t + 1, len(pages)) if pages[i] == p]
        assert got[t] == (len(set(pages[t + 1 : later[0]])) if later else trace.NEVER)
    pools = [1, 3, 8, 20]
    hits = {r.pool: r.hits for r in trace.lru_hits(_frame(spark, pages), pools).collect()}
    for k in pools:
        held, n = [], 0
        for p in pages:
            if p in held:
                n += 1
                held.remove(p)
            elif len(held) == k:
                held.pop(0)
            held.append(p)
        assert hits[k] == n
    sim = {(r.policy, r.pool): r.hits for r in trace.simulate(_frame(spark, pages), pools).collect()}
    assert all(sim["lru", k] == hits[k] <= sim["belady", k] for k in pools)


def test_positions_are_gapless(spark):
    df = spark.createDataFrame([(i * 7919 % 101,) for i in range(101)] + [(5,), (5,)], "v long").withColumn("u", F.monotonically_increasing_id())
    rows = trace.positions(df, F.floor(F.col("v") / 10), [F.col("v"), F.col("u")]).orderBy("t").collect()
    assert [r.t for r in rows] == list(range(103)) and [r.v for r in rows] == sorted(r.v for r in rows)


def test_concat_and_summary(spark):
    a = trace.concat(_frame(spark, [1, 2]), _frame(spark, [2, 2, 9]))
    assert [(r.t, r.page_id) for r in a.orderBy("t").collect()] == [(0, 1), (1, 2), (2, 2), (3, 2), (4, 9)]
    s = trace.summary(a, pages=10, top=1).first()
    assert (s.accesses, s.unique_pages, s.coverage_percent, s.max_page, s.top_share) == (5, 3, 30.0, 9, 0.6)


def test_zipf(spark):
    t = trace.zipf_trace(spark, 5000, 64)
    assert t.count() == 5000 and t.select("t").distinct().count() == 5000
    assert trace.top_pages(t, 1).first().page_id == 0


def _reuse_brute(pages):
    out = []
    for t, p in enumerate(pages):
        later = [i for i in range(t + 1, len(pages)) if pages[i] == p]
        out.append(len(set(pages[t + 1 : later[0]])) if later else trace.NEVER)
    return out


def test_reuse_distance_in_small_blocks(spark):
    """Many blocks, several traces of different length, one page with a third of all accesses."""
    rng = np.random.default_rng(5)
    traces = [[int(x) if x % 3 else 0 for x in rng.integers(0, 40, n)] for n in (700, 1, 64, 301)]
    rows = [(k, i, p) for k, pages in enumerate(traces) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "trace_id int, t long, page_id long")
    for block in (7, 64, 1000):
        got = {(r.trace_id, r.t): r.reuse for r in trace.reuse_distance(df, block=block).collect()}
        assert got == {(k, i): d for k, pages in enumerate(traces) for i, d in enumerate(_reuse_brute(pages))}
    got = {(r.trace_id, r.t): r.window for r in trace.windows(df, 5, 6).collect()}
    assert got == {(k, i): pages[i - 4 : i + 1] for k, pages in enumerate(traces) for i in range(4, len(pages))}
    assert trace.reuse_distance(df.where("false")).count() == 0


def test_no_trace_meets_in_one_task(spark):
    plan = trace.window_frequency(trace.windows(_frame(spark, [1, 2, 3])))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(trace_id" in plan and "block" in plan.split("hashpartitioning(trace_id")[1][:40]


def test_policies_against_plain_simulation(spark):
    pages = np.random.default_rng(8).zipf(1.3, 400) % 30
    for size in (2, 5, 11):
        held, n = set(), 0
        for t, p in enumerate(pages.tolist()):
            if p in held:
                n += 1
                continue
            if len(held) == size:
                later = lambda q: next((i for i in range(t + 1, len(pages)) if pages[i] == q), len(pages))  # noqa: E731, B023
                held.remove(max(held, key=lambda q: (later(q), -q)))
            held.add(p)
        assert trace.Pool(pages, size).run(trace._belady)[0] == n


def test_learned_policies(spark):
    """Trained models come between chance and Belady; the models' labels are capped."""
    t = trace.zipf_trace(spark, 3000, 60, 1.1).cache()
    samples = trace.eviction_samples(t, 8, 800).cache()
    assert samples.groupBy("event").count().where("count <> 8").count() == 0 and samples.where("is_victim").count() == samples.select("event").distinct().count() == 100
    models = {k: trace.train_eviction_model(samples, k) for k in trace.FEATURES}
    got = {r.policy: r for r in trace.simulate(t, [8], ("lru", "belady"), models).collect()}
    assert got["belady"].ranking_accuracy == 1.0 and all(got[k].hits <= got["belady"].hits for k in got)
    assert all(got[k].hits >= 0.9 * got["lru"].hits for k in models)
    features = np.array(samples.select(*trace.FEATURES["counts"]).collect(), float)
    assert np.corrcoef(models["counts"].predict(features), [r[0] for r in samples.select("label").collect()])[0, 1] > 0.2


def test_traces_at_several_scales(spark):
    rows = trace.multiscale_traces(spark, {1: (500, 16), 4: (2000, 64)}).groupBy("trace_id").agg(F.count("*").alias("n"), F.countDistinct("t").alias("d"), F.max("page_id").alias("m")).collect()
    assert {r.trace_id: (r.n, r.d) for r in rows} == {1: (500, 500), 4: (2000, 2000)} and max(r.m for r in rows) > 15
    pages = [r.page_id for r in trace.zipf_trace(spark, 4000, 512, burst_share=0.05, burst=(7, 9)).orderBy("t").collect()]
    runs = np.diff(np.flatnonzero(np.r_[True, np.diff(pages) != 0, True]))
    assert {7, 8, 9} <= set(runs.tolist())
