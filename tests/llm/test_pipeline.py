"""The pipeline's stages on planted cases, each judged on its own input."""

import os
import random

import corpus_pipeline
from skyloom.llm import common
from tests.llm.test_operators import ODD, invented, make, plain_dedup


def write(spark, tmp_path, texts, labels, bench):
    make(spark, texts).select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")


def test_stages(spark, tmp_path):
    r = random.Random(8)
    texts = [t + f" own{i} tail{i} end{i}" for i, t in enumerate(invented(300, 11))]
    labels = []
    for i in range(0, 300, 5):
        texts[i] += " zomglu you vrexnik"
        labels.append((i, 1, 1))
    labels += [(i, 1, 0) for i in range(300) if i % 5]
    item = " ".join(f"bench{j}" for j in range(30))
    long = [" ".join(f"{c}{r.randrange(5000)}" for _ in range(200)) for c in "pqrs"]
    passage = "a passage that several of the documents share"
    texts += [long[0], long[0], long[1], long[1].replace(long[1].split()[100], "changed"), long[2] + "\n" + passage, long[3] + "\n" + passage, "other " * 60 + "\n" + passage, "Some words then " + item.title(), *ODD]
    write(spark, tmp_path, texts, labels, [(1, item), (2, None)])
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == before.columns
        kept[name] = {x.doc_id: x.text for x in docs.collect()}
    assert len(set(range(0, 300, 5)) & set(kept["toxicity"])) <= 3 and set(range(300, 308)) <= set(kept["toxicity"])
    want = plain_dedup(list(kept["toxicity"].items()))
    assert kept["line_dedup"] == {i: None if kept["toxicity"][i] is None else "\n".join(b) for i, (_, b) in want.items()}
    gone = set(kept["line_dedup"]) - set(kept["near_dedup"])
    assert {301, 303} <= gone and not gone & {300, 302, 304, 305, 306, 307}
    assert set(kept["near_dedup"]) - set(kept["decontaminate"]) == {307}
    other = common.materialise(spark.range(3))
    before = set(os.listdir(common.shared_dir(spark)))
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept["decontaminate"])
    assert len(set(os.listdir(common.shared_dir(spark))) - before) == 1 and other.count() == 3


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_are_carried(spark, tmp_path):
    texts = [t + f" own{i} tail{i}" for i, t in enumerate(invented(60, 3))]
    for i in range(0, 60, 4):
        texts[i] += " zomglu you vrexnik"
    write(spark, tmp_path, texts, [(i, 1, int(i % 4 == 0)) for i in range(60)], [(1, None)])
    names = ["score", "_score", "n hit", "fp", "grp", "nid", "key", "n_tokens", "kept", "line"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id", "text", *[f"doc_id * {k} as `{c}`" for k, c in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs
        docs = common.materialise(stage(spark, docs, str(tmp_path)))
        assert docs.columns == before.columns
        assert all(x[c] == x.doc_id * k for x in docs.collect() for k, c in enumerate(names)), name
    assert 40 <= docs.count() < 50
