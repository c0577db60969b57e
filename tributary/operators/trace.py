"""Page-access trace analytics. A trace has columns trace_id, t (0, 1, ... in each trace) and page_id."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import LABEL_CAP, cap_labels

#: The distance of a page that is not used again, the window of recent accesses, and the smoothing shares.
NEVER, WINDOW, PAGE_SHARE = 1_000_000, 64, 0.7


def positions(df: DataFrame, bucket: Column, order: list[Column], name: str = "t") -> DataFrame:
    """df with gapless positions from 0 in the order of (bucket, order).

    Rows are numbered within their bucket and shifted by the rows of the buckets before it, so a task has one
    bucket's rows and only the bucket counts meet in one task.
    """
    df = df.withColumn("__b", bucket)
    sums = df.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sums.select(F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    out = df.withColumn("__i", F.row_number().over(Window.partitionBy("__b").orderBy(*order))).join(before, F.col("__b").eqNullSafe(F.col("__c")))
    return out.withColumn(name, F.col("__i") + F.col("__s") - 1).drop("__b", "__c", "__s", "__i")


def from_events(events: DataFrame) -> DataFrame:
    """The events by (ts, event_id) as one trace of user ids."""
    numbered = positions(events.select("ts", "event_id", "user_id"), F.date_trunc("hour", "ts"), [F.col("ts"), F.col("event_id")])
    return numbered.select(F.lit(0).alias("trace_id"), F.col("t").cast("long").alias("t"), F.col("user_id").alias("page_id"))


def _page() -> Window:
    return Window.partitionBy("trace_id", "page_id").orderBy("t")


def next_occurrence(trace: DataFrame) -> DataFrame:
    """next_t: the next access to the same page, -1 if there is none."""
    return trace.withColumn("next_t", F.coalesce(F.lead("t").over(_page()), F.lit(-1)))


def page_positions(trace: DataFrame) -> DataFrame:
    return trace.groupBy("trace_id", "page_id").agg(F.sort_array(F.collect_list("t")).alias("positions"))


#: Accesses of a block at least, and blocks of a trace at most (the counts between blocks are BLOCKS ** 2 / 2 numbers).
BLOCK, BLOCKS = 1 << 17, 2048


def _greater_before(x: np.ndarray) -> np.ndarray:
    """For each entry, how many of the entries before it are greater: sorted blocks of doubling length, all at once."""
    n, size, out = len(x), 1, np.zeros(len(x), np.int64)
    rank = np.empty(n, np.int64)
    rank[np.argsort(x, kind="stable")] = np.arange(n)
    _, first = np.unique(x, return_index=True)
    if len(first) < n:  # equal values get the rank of the last of them, so that none counts as greater
        order = np.argsort(x, kind="stable")
        last = np.r_[np.flatnonzero(x[order][1:] != x[order][:-1]), n - 1]
        rank[order] = np.repeat(last, np.diff(np.r_[-1, last]))
    while size < n:
        padded = np.full(-(-n // (2 * size)) * 2 * size, -1, np.int64)
        padded[:n] = rank
        left = np.sort(padded.reshape(-1, 2, size)[:, 0], 1)
        keys = (left + np.arange(len(left))[:, None] * (n + 1)).ravel()
        i = np.flatnonzero(np.arange(n) // size % 2 == 1)
        pair = i // (2 * size)
        out[i] += (pair + 1) * size - np.searchsorted(keys, rank[i] + pair * (n + 1), "right")
        size *= 2
    return out


def reuse_distance(trace: DataFrame, never: int = NEVER, block: int = BLOCK, accesses: int | None = None) -> DataFrame:
    """reuse: distinct other pages between an access and the next to its page; `never` if there is none.

    Of the accesses between t and its next, next(t), those whose page comes again before next(t) are not the last of
    their page there: the distance is next(t) - t - 1 less the v > t with next(v) < next(t). These are counted by
    blocks of t: v in the block of t in the task of that block; next(v) in the block of next(t) in the task of that
    one; all others from the numbers of accesses for each pair of blocks. Time and memory of a task grow with a block.
    accesses: of the longest trace; counted if not given.
    """
    keys = ["trace_id", "t", "page_id"]
    if accesses is None:
        accesses = (trace.agg(F.max("t")).first()[0] or 0) + 1
    block = max(block, -(-accesses // BLOCKS))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        nxt, at = next_uses(pdf["page_id"].to_numpy()), np.arange(len(pdf))
        known, reuse = nxt < len(pdf), np.full(len(pdf), never)
        reuse[known] = (nxt - at - 1)[known] - _greater_before(-nxt[known][::-1])[::-1]
        return pdf.assign(reuse=reuse)

    if accesses <= block:  # a trace is one block
        return trace.select(*keys).groupBy("trace_id").applyInPandas(whole, "trace_id int, t long, page_id long, reuse long")
    linked = trace.select(*keys, F.lead("t").over(_page()).alias("next_t"))
    placed = linked.select(*keys, "next_t", F.floor(F.col("t") / block).cast("int").alias("i"), F.floor(F.col("next_t") / block).cast("int").alias("j"))

    def own_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ascending=False)
        return pdf.assign(n=_greater_before(-pdf["next_t"].to_numpy()))

    def next_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("next_t")
        return pdf.assign(n=pdf["n"] + _greater_before(pdf["i"].to_numpy()))

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["j"].max()) + 2
        count = np.zeros((k, k), np.int64)
        count[pdf["i"], pdf["j"]] = pdf["m"]
        below = np.cumsum(count, 1)  # by i: with j up to ...
        above = np.cumsum(below[::-1], 0)[::-1]  # with i from ... and j up to ...
        return pdf.assign(m=above[pdf["i"] + 1, pdf["j"] - 1] * (pdf["j"] > 0))

    schema = "trace_id int, t long, page_id long, next_t long, i int, j int, n long"
    some = placed.where("next_t IS NOT NULL")
    inside = some.groupBy("trace_id", "i").applyInPandas(own_block, schema).groupBy("trace_id", "j").applyInPandas(next_block, schema)
    # At most BLOCKS ** 2 / 2 rows of four numbers for a trace.
    pairs = some.groupBy("trace_id", "i", "j").agg(F.count("*").alias("m")).groupBy("trace_id").applyInPandas(between, "trace_id int, i int, j int, m long")
    known = inside.join(pairs, ["trace_id", "i", "j"]).select(*keys, (F.col("next_t") - F.col("t") - 1 - F.col("n") - F.col("m")).alias("reuse"))
    return known.unionByName(placed.where("next_t IS NULL").select(*keys, F.lit(never).cast("long").alias("reuse")))


def windows(trace: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """window: the last `size` pages up to each access (from the first full one). Each block of t reads the end of the one before."""
    block = max(block, size)
    own = F.floor(F.col("t") / block)
    also = F.when(F.col("t") % block > block - size, F.array(own, own + 1)).otherwise(F.array(own))
    by_t = Window.partitionBy("trace_id", "block").orderBy("t").rowsBetween(-(size - 1), 0)
    rows = trace.select("trace_id", "t", "page_id", F.explode(also).alias("block")).withColumn("window", F.collect_list("page_id").over(by_t))
    return rows.where((F.col("block") == own) & (F.col("t") >= size - 1)).select("trace_id", "t", "page_id", "window")


def window_features(trace: DataFrame, size: int = WINDOW, accesses: int | None = None) -> DataFrame:
    """windows with label: log(1 + reuse)."""
    return windows(trace, size).join(reuse_distance(trace, accesses=accesses).select("trace_id", "t", F.log1p("reuse").alias("label")), ["trace_id", "t"])


def window_frequency(windows: DataFrame) -> DataFrame:
    """frequency: the share of the window that is the last page."""
    return windows.withColumn("frequency", F.size(F.filter("window", lambda x: x == F.col("page_id"))) / F.size("window"))


def recency_features(trace: DataFrame) -> DataFrame:
    """log(1 + age), log(1 + accesses so far), log(1 + age of the second last); 0 where there is none."""
    age = lambda k: F.coalesce(F.log1p(F.col("t") - F.lag("t", k).over(_page())), F.lit(0.0))
    return trace.select("trace_id", "t", "page_id", age(1).alias("recency"), F.log1p(F.row_number().over(_page())).alias("frequency"), age(2).alias("recency_2"))


def label_smoothing(rows: DataFrame, label: str, train: Column) -> DataFrame:
    """smoothed: a page's mean label over the training rows (over all pages if it has none), mixed with the row's own."""
    means = rows.where(train).groupBy("page_id").agg(F.avg(label).alias("__m"))
    overall = rows.where(train).agg(F.avg(label).alias("__all"))  # one row
    out = rows.join(means, "page_id", "left").crossJoin(F.broadcast(overall))
    return out.withColumn("smoothed", PAGE_SHARE * F.coalesce("__m", "__all") + (1 - PAGE_SHARE) * F.col(label)).drop("__m", "__all")


def lru_hits(trace: DataFrame, pools: list[int], accesses: int | None = None) -> DataFrame:
    """(trace_id, pool, hits, hit_rate) for each pool size at once: an access hits if fewer than `pool` others lie between."""
    hits = [F.sum((F.col("reuse") < k).cast("long")).alias(f"k{k}") for k in pools]
    wide = reuse_distance(trace, 1 << 60, accesses=accesses).groupBy("trace_id").agg(F.count("*").alias("n"), *hits)
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("pool"), F.col(f"k{k}").alias("hits")) for k in pools))).alias("x")
    return wide.select("trace_id", "n", rows).select("trace_id", "x.pool", "x.hits", (F.col("x.hits") / F.col("n")).alias("hit_rate"))


def top_pages(trace: DataFrame, n: int = 10) -> DataFrame:
    counts = trace.groupBy("page_id").agg(F.count("*").alias("accesses"))
    return counts.orderBy(F.desc("accesses"), "page_id").limit(n)


def summary(trace: DataFrame, pages: int | None = None, top: int = 10) -> DataFrame:
    """Accesses, unique pages, coverage of `pages` (of the highest id and below if not given), highest id, share of the top pages."""
    one = trace.agg(F.count("*").alias("accesses"), F.countDistinct("page_id").alias("unique_pages"), F.max("page_id").alias("max_page"))
    head = top_pages(trace, top).agg(F.sum("accesses").alias("__top"))
    total = F.lit(pages) if pages else F.col("max_page") + 1
    return one.crossJoin(head).select("accesses", "unique_pages", (100.0 * F.col("unique_pages") / total).alias("coverage_percent"), "max_page", (F.col("__top") / F.col("accesses")).alias("top_share"))


def concat(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Traces one after the other, renumbered without gaps: each is shifted by the accesses before it."""
    out, shift = None, 0
    parts = [first, *rest]
    sizes = [p.count() for p in parts[:-1]]
    for p, n in zip(parts, [0, *sizes]):
        shift += n
        low = p.agg(F.min("t").alias("__low"))
        part = p.crossJoin(F.broadcast(low)).select(F.lit(0).alias("trace_id"), (F.col("t") - F.col("__low") + shift).alias("t"), "page_id")
        out = part if out is None else out.unionByName(part)
    return out


def page_mse(rows: DataFrame, predicted: str, label: str) -> DataFrame:
    """Mean squared error of the pages' mean predictions."""
    per = rows.groupBy("page_id").agg(F.avg(predicted).alias("p"), F.avg(label).alias("y"))
    return per.agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("page_mse"), F.count("*").alias("pages"))


def next_uses(page: np.ndarray) -> np.ndarray:
    """For each access the next one to its page; the length of the trace if there is none."""
    n = len(page)
    order = np.lexsort((np.arange(n), page))
    out = np.full(n, n)
    same = page[order][1:] == page[order][:-1]
    out[order[:-1][same]] = order[1:][same]
    return out


@dataclass(frozen=True)
class EvictionModel:
    """A small network (standardised features, one tanh layer, a linear one) that foretells log(1 + time to the next use).

    kind `counts`: log(1 + age), log(1 + accesses since it came in), log(1 + age of the second last access), and a mark of
    changed pages, which a read-only trace has none of. kind `window`: share of the last WINDOW accesses, log(1 + age).
    """

    kind: str
    mean: np.ndarray
    deviation: np.ndarray
    layers: tuple[tuple[np.ndarray, np.ndarray], ...]

    def predict(self, features: np.ndarray) -> np.ndarray:
        (w1, b1), (w2, b2) = self.layers
        return (np.tanh((features - self.mean) / self.deviation @ w1 + b1) @ w2 + b2)[:, 0]


FEATURES = {"counts": ["recency", "frequency", "recency_2", "changed"], "window": ["share", "recency"]}


class Pool:
    """A buffer pool over one trace: which pages are held, and what the policies know of them."""

    def __init__(self, page: np.ndarray, size: int):
        self.page, self.size, self.next = page, size, next_uses(page)
        self.held: OrderedDict[int, list[int]] = OrderedDict()  # page -> last, second last, count since it came in; least recent first
        self.recent: OrderedDict[int, int] = OrderedDict()  # page -> accesses among the last WINDOW

    def features(self, kind: str, t: int) -> np.ndarray:
        """A row for each held page."""
        x = np.array(list(self.held.values()), float)
        age = np.log1p(t - x[:, 0])
        if kind == "window":
            return np.stack([np.array([self.recent.get(p, 0) for p in self.held]) / WINDOW, age], 1)
        return np.stack([age, np.log1p(x[:, 2]), np.where(x[:, 1] >= 0, np.log1p(t - x[:, 1]), 0.0), np.zeros(len(x))], 1)

    def farthest(self) -> tuple[list[int], np.ndarray]:
        """The held pages and the next use of each."""
        return list(self.held), self.next[[x[0] for x in self.held.values()]]

    def run(self, choose: Callable[[Pool, int], int], watch: Callable[[Pool, int, int], None] | None = None) -> tuple[int, int, int]:
        """(hits, evictions, evictions of a page of the farthest next use). choose(pool, t) names the page that goes; watch sees it first."""
        hits = evictions = same = 0
        for t, p in enumerate(self.page.tolist()):
            if p in self.held:
                hits += 1
                last, _, count = self.held.pop(p)
                self.held[p] = [t, last, count + 1]
            else:
                if len(self.held) >= self.size:
                    victim = choose(self, t)
                    evictions += 1
                    same += self.next[self.held[victim][0]] == self.farthest()[1].max()
                    if watch:
                        watch(self, t, victim)
                    del self.held[victim]
                self.held[p] = [t, -1, 1]
            self.recent[p] = self.recent.get(p, 0) + 1
            if t >= WINDOW:
                old = int(self.page[t - WINDOW])
                self.recent[old] -= 1
                if not self.recent[old]:
                    del self.recent[old]
        return hits, evictions, int(same)


def _lru(pool: Pool, t: int) -> int:
    return next(iter(pool.held))


def _belady(pool: Pool, t: int) -> int:
    pages, use = pool.farthest()
    return min(pages[i] for i in np.flatnonzero(use == use.max()))


def _score(pool: Pool, t: int) -> int:
    """The largest of log recency less log frequency."""
    x = pool.features("counts", t)
    return list(pool.held)[int(np.argmax(x[:, 0] - x[:, 1]))]


def _learned(model: EvictionModel) -> Callable[[Pool, int], int]:
    return lambda pool, t: list(pool.held)[int(np.argmax(model.predict(pool.features(model.kind, t))))]


POLICIES = {"lru": _lru, "belady": _belady, "score": _score}


def simulate(trace: DataFrame, pools: list[int], policies: tuple[str, ...] = ("lru", "belady", "score"), models: dict[str, EvictionModel] | None = None) -> DataFrame:
    """(trace_id, policy, pool, hits, evictions, hit_rate, ranking_accuracy): one task for each trace, policy and pool.

    models: learned policies by name. ranking_accuracy: the share of evictions that take a page of the farthest next use.
    A policy's state follows every access: a trace is simulated in one task; lru_hits counts LRU for all pools without one.
    """
    choose = POLICIES | {name: _learned(m) for name, m in (models or {}).items()}
    runs = F.explode(F.array(*(F.struct(F.lit(q).alias("policy"), F.lit(k).alias("pool")) for q in (*policies, *(models or {})) for k in pools))).alias("x")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        page = pdf.sort_values("t")["page_id"].to_numpy()
        hits, evictions, same = Pool(page, int(key[2])).run(choose[key[1]])
        return pd.DataFrame([(*key, hits, evictions, hits / len(page), same / evictions if evictions else 1.0)])

    schema = "trace_id int, policy string, pool int, hits long, evictions long, hit_rate double, ranking_accuracy double"
    return trace.select("trace_id", "t", "page_id", runs).select("trace_id", "t", "page_id", "x.*").groupBy("trace_id", "policy", "pool").applyInPandas(run, schema)


def eviction_samples(trace: DataFrame, pool: int, sample: int = 2000, seed: int = 42) -> DataFrame:
    """Features of all held pages at a reservoir sample of Belady evictions, about `sample` rows for each trace.

    event: number of the eviction among those sampled; label: log(1 + time to the next use); is_victim: Belady's choice.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng, kept, seen = np.random.default_rng(seed), [], [0]

        def watch(state: Pool, t: int, victim: int) -> None:
            seen[0] += 1
            at = len(kept) if len(kept) < max(1, sample // pool) else int(rng.integers(seen[0]))
            if at < max(1, sample // pool):
                pages, use = state.farthest()
                kept[at : at + 1] = [(t, victim, pages, state.features("counts", t), state.features("window", t), np.log1p(use - t))]

        Pool(pdf.sort_values("t")["page_id"].to_numpy(), pool).run(_belady, watch)
        rows = [(key[0], e, t, p, *c, w[0], float(y), p == v) for e, (t, v, pages, counts, window, label) in enumerate(kept) for p, c, w, y in zip(pages, counts.tolist(), window.tolist(), label)]
        return pd.DataFrame(rows, columns=["trace_id", "event", "t", "page_id", *FEATURES["counts"], "share", "label", "is_victim"])

    return trace.groupBy("trace_id").applyInPandas(run, "trace_id int, event int, t long, page_id long, recency double, frequency double, recency_2 double, changed double, share double, label double, is_victim boolean")


def train_eviction_model(samples: DataFrame, kind: str = "counts", cap: float | None = LABEL_CAP, hidden: int = 16, epochs: int = 60, rate: float = 0.01, seed: int = 7) -> EvictionModel:
    """Fit by Adam on the capped labels of eviction samples: a reservoir of bounded size, so read to the driver."""
    columns = FEATURES[kind]
    rows = cap_labels(samples, "label", cap).orderBy("trace_id", "event", "page_id").select(*columns, "label").toPandas()
    x, y = rows[columns].to_numpy(float), rows["label"].to_numpy(float)
    mean, deviation = (x.mean(0), x.std(0, ddof=1)) if len(x) > 1 else (np.zeros(len(columns)), np.ones(len(columns)))
    deviation = np.where(deviation > 0, deviation, 1.0)
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / math.sqrt(len(columns)), (len(columns), hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), (hidden, 1)), np.full(1, y.mean() if len(y) else 0.0)]
    first, second, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    z = (x - mean) / deviation
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for i in range(0, len(order), 128):
            own = order[i : i + 128]
            h = np.tanh(z[own] @ w[0] + w[1])
            error = (h @ w[2] + w[3])[:, 0] - y[own]
            back = 2 * error[:, None] / len(own)
            inner = back @ w[2].T * (1 - h * h)
            step += 1
            for k, g in enumerate((z[own].T @ inner, inner.sum(0), h.T @ back, back.sum(0))):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return EvictionModel(kind, mean, deviation, ((w[0], w[1]), (w[2], w[3])))


def _unit(*key: Column) -> Column:
    """A number from 0 to 1 that the key decides."""
    return F.xxhash64(*key).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)


def zipf_trace(spark, n: int, pages: int, skew: float = 1.0, burst_share: float = 0.02, burst: tuple[int, int] = (5, 50), seed: int = 42, trace_id: int = 0) -> DataFrame:
    """A synthetic trace: Zipf-distributed pages by inverse distribution. A share of the accesses, drawn, start bursts of a
    drawn length, in which the page is that of the start; where bursts meet the earlier goes on."""
    weights = 1 / np.arange(1, pages + 1) ** skew
    edges = np.concatenate([[0.0], np.cumsum(weights) / weights.sum()])
    edges[-1] = 1.0
    cdf = spark.createDataFrame(pd.DataFrame({"page_id": np.arange(pages), "low": edges[:-1], "high": edges[1:]}))
    steps = 1024
    cdf = cdf.select("page_id", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * steps), F.floor(F.col("high") * steps))).alias("cell"))
    ids = spark.range(n).select(F.col("id").alias("t"))
    length = burst[0] + F.floor(_unit(F.col("t"), F.lit(seed), F.lit("length")) * (burst[1] - burst[0] + 1))
    starts = ids.where(_unit(F.col("t"), F.lit(seed), F.lit("burst")) < burst_share)
    covered = starts.select(F.col("t").alias("start"), F.explode(F.sequence(F.col("t"), F.col("t") + length - 1)).alias("t")).groupBy("t").agg(F.min("start").alias("start"))
    draw = ids.join(covered, "t", "left").withColumn("u", _unit(F.coalesce("start", "t"), F.lit(seed)))
    drawn = draw.withColumn("cell", F.floor(F.col("u") * steps)).join(F.broadcast(cdf), "cell").where("u >= low AND u < high")
    return drawn.select(F.lit(trace_id).alias("trace_id"), "t", "page_id")


def multiscale_traces(spark, scales: dict[int, tuple[int, int]], skew: float = 1.0, seed: int = 42) -> DataFrame:
    """A Zipf trace for each scale: trace_id -> (accesses, pages)."""
    out = None
    for i, (n, pages) in scales.items():
        one = zipf_trace(spark, n, pages, skew, seed=seed + i, trace_id=i)
        out = one if out is None else out.unionByName(one)
    return out
