import re

import corpus_pipeline
from sparkqueue.llm import common
from tests.llm.test_decontamination import words
from tests.llm.test_near_duplicates import brute_force

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = common.written(stage(spark, docs, SF), name)
        seen[name] = (docs, after)
        if name != "sharding":
            assert after.columns == columns
        docs = after
    labels = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    before, after = ([r.doc_id for r in x.collect()] for x in seen["quality"])
    kept = set(after)
    judged = [i for i in before if i in labels]
    assert sum((labels[i] == 1) == (i in kept) for i in judged) >= 0.8 * len(judged)  # 70 rows to learn from

    before, after = seen["near_duplicates"]
    expected = [i for i, _, _, stays in brute_force([(r.doc_id, r.text) for r in before.collect()], 5) if stays]
    assert sorted(r.doc_id for r in after.collect()) == expected

    before, after = seen["decontamination"]
    items = [f" {' '.join(words(r.text))} " for r in common.table(spark, SF, "benchmark").collect()]
    holding = {r.doc_id for r in before.collect() if any(i in f" {' '.join(words(r.text))} " for i in items)}
    left = {r.doc_id for r in after.collect()}
    assert holding and not holding & left and len(left) == before.count() - len(holding)

    before, after = seen["mixing"]
    n = lambda x: sum(len(re.findall(r"\S+", r.text)) for r in x.collect())
    assert 0.75 < n(after) / n(before) < 1.0

    before, after = seen["sharding"]
    assert after.count() == before.count() and after.select("shard").distinct().count() == 24


def test_run_on_awkward_rows(spark, awkward, no_rows, tmp_path):
    for name, docs in (("awkward", awkward), ("empty", no_rows)):
        docs.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 0), (2, 1), (None, None)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, "same text twice of more"), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        assert (len(got) > 0) == (name == "awkward")
        assert not {r.doc_id for r in got} & {4, 5}
