"""Odd rows: clashing columns, null and repeated doc_ids, hot doc_ids, empty tables, and what a failure leaves behind."""

import glob
import os
from types import SimpleNamespace

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import BASE, LONG, brute_substring
from tributary.llm import near_duplicates, personal, storage, substring

CLASH = ["__language", "language", "__found", "contamination", "__spans", "spans", "__d", "__t", "tag", "row", "masked", "more", "id", "text_", "class_key", "first_id"]


@pytest.fixture(scope="module")
def odd(spark, data):
    """Real documents with clashing columns, null ids, ids repeated with the same and with other texts."""
    real = spark.read.parquet(f"{data}/documents.parquet").limit(120)
    rows = real.unionByName(real.where("doc_id < 10")).unionByName(real.where("doc_id < 8").withColumn("doc_id", F.lit(3).cast("long"))).unionByName(real.where("doc_id < 6").withColumn("doc_id", F.lit(None).cast("long")))
    rows = rows.unionByName(real.where("doc_id < 4").withColumn("text", F.lit(None).cast("string"))).unionByName(real.where("doc_id < 2").withColumn("text", F.lit("")))
    return rows.select("*", *(F.lit(f"kept {c}").alias(c) for c in CLASH))


def test_stages_keep_clashing_columns(spark, odd, data):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, data)
        assert out.columns == odd.columns
        for c in CLASH:
            assert [r[0] for r in out.select(c).distinct().collect()] == [f"kept {c}"], (name, c)
        assert stage(spark, odd.where("false"), data).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, data).count() == odd.count()


def test_two_runs_keep_the_same_rows(spark, odd):
    key = F.sort_array(F.collect_list(F.to_json(F.struct(*odd.columns))))
    runs = [near_duplicates.keep_one(spark, odd.repartition(n)).agg(key.alias("k")).first().k for n in (3, 7)]
    assert runs[0] == runs[1]
    words = lambda df: {tuple((t or "").split()) for (t,) in df.select("text").collect()}
    kept = near_duplicates.keep_one(spark, odd)
    assert kept.where("text IS NULL OR text = ''").count() == odd.where("text IS NULL OR text = ''").count()
    # No class is lost: every text is linked with one that stays.
    links = near_duplicates.link(spark, odd)
    assert kept.where("text <> ''").count() == links.where("class_key IS NOT NULL").select("class_key").distinct().count()
    assert words(kept) <= words(odd)


def test_links_answer_every_row(spark, odd):
    got = near_duplicates.link(spark, odd)
    assert got.count() == odd.count()
    near = BASE.split()
    near[60] = "changed"
    rows = [(1, BASE), (1, LONG), (1, BASE), (None, " ".join(near)), (None, "alone here"), (7, LONG + " x"), (None, None), (9, "")]
    out = near_duplicates.link(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in out) == sorted([(1, 1, 2), (1, 1, 1), (1, 1, 2), (-1, 1, 2), (-1, -1, 0), (7, 1, 1), (-1, -1, 0), (9, 9, 0)])
    assert len({r.class_key for r in out if r.class_key is not None}) == 3


def test_masking_repeated_rows(spark):
    rows = [(1, "a@b.de x"), (1, "y 10.0.0.1"), (None, "a@b.de x"), (None, None), (2, ""), (1, "a@b.de x")]
    out = personal.sanitise(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(7)))
    assert sorted(map(repr, ((r.doc_id, r.text, r.spans) for r in out.collect()))) == sorted(map(repr, [(1, "<EMAIL> x", 7), (1, "y <IP>", 7), (None, "<EMAIL> x", 7), (None, None, 7), (2, "", 7), (1, "<EMAIL> x", 7)]))


def test_substring_hot_doc_ids(spark):
    """Rows of two doc_ids don't meet: the exchange carries as many rows as for distinct ids, and the results are right."""
    words = [f"v{i}" for i in range(70)]
    texts = [" ".join([f"r{i}x{j}" for j in range(30)] + words + [f"s{i}"]) for i in range(200)]
    hot = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = substring.deduplicate(spark, hot).collect()
    assert len(out) == 200 and sorted((r.doc_id, r.n_words, r.n_removed) for r in out) == [(0, 101, 0)] * 100 + [(1, 101, 70)] * 100


def test_substring_batches_meet_history(spark, data):
    """A kept index is fed batch by batch; each batch is answered on arrival."""
    docs = substring.keyed(spark.read.parquet(f"{data}/documents.parquet"))
    want = brute_substring({r.doc_id: r.text for r in docs.collect()})
    with storage.Workspace(spark, "test_index") as work:
        index = substring.FingerprintIndex(work, 8, fanout=2)
        for low, high in ((0, 50), (50, 60), (60, 140), (140, 1000)):
            known = docs.where(F.col("doc_id") < high)
            spans = index.add(known.where(F.col("doc_id") >= low), known).collect()
            gone = {}
            for r in spans:
                gone.setdefault(r.doc_id, set()).update(range(r.pos, r.pos + r.len + 49))
            assert {i: len(gone.get(i, ())) for i in want if low <= i < high} == {i: w[1] for i, w in want.items() if low <= i < high}
            assert len(index.runs) <= 2
        work.close()
        assert not glob.glob(work.root.removeprefix("file://") + "*")


def test_hot_fingerprints_are_exchanged_on_both_sides(spark, data):
    with storage.Workspace(spark, "test_plan") as work:
        docs = substring.keyed(spark.read.parquet(f"{data}/documents.parquet"))
        posting = work.save(substring.fingerprints(docs, 10, 50), "posting")
        hot = work.save(posting.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "hot")
        plan = posting.join(hot.hint("merge"), "fp")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
        work.close()


def test_a_failed_step_leaves_nothing(spark):
    root = storage.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    bad = spark.createDataFrame([(i, "w " * 60) for i in range(5)], "doc_id long, text string").withColumn("text", F.when(F.col("doc_id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    for operator in (substring.deduplicate, near_duplicates.link, personal.find):
        with pytest.raises(Exception, match="lost"):
            operator(spark, bad).count()
    assert set(os.listdir(root)) == before
    warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    assert not os.path.isdir(warehouse) or not os.listdir(warehouse)
    substring.deduplicate(spark, bad.where("doc_id <> 3")).count()
    assert set(os.listdir(root)) > before
    storage.clean(spark)
    assert not [x for x in os.listdir(root) if x not in before]


def test_no_local_folder_on_a_cluster():
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context))
