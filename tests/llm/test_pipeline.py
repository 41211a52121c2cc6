import os
import shutil
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from hopframe.llm import common
from hopframe.llm.common import table

from tests.llm import test_decontam, test_ngram_join

D = "/root/testdata/sf0.001"


def test_each_stage_does_its_work(spark):
    docs = table(spark, D, "documents")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, D, "labels").collect()}
    good = stages["quality classifier"](spark, docs, D).cache()
    assert good.columns == names
    kept = {r.doc_id for r in good.collect()}
    assert sum((i in kept) == bool(q) for i, q in labels.items() if i in before) / len(labels) > 0.95
    one = stages["n-gram Jaccard join"](spark, good, D).cache()
    want = test_ngram_join.brute([(i, before[i].text) for i in kept])
    assert one.columns == names and sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    clean = stages["benchmark decontamination"](spark, one, D).cache()
    items = [(r.item_id, r.text) for r in table(spark, D, "benchmark").collect()]
    rows = clean.collect()
    assert clean.columns == names and all(r.n_chars == len(r.text) for r in rows)
    hits = test_decontam.brute([(r.doc_id, r.text) for r in one.collect()], items)
    left = {r.doc_id: r.text for r in rows}
    for i, (n, hit, *_) in hits.items():
        assert (i in left) == (hit <= 0.5 * n or hit == 0)
        assert not hit or i not in left or left[i] != before[i].text
        assert hit or left[i] == before[i].text
    private = stages["PII"](spark, clean, D).cache()
    assert private.columns == names and private.count() == len(rows)
    pieces = stages["packing"](spark, private, D)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(left)


def test_run_is_the_stages(spark, tmp_path, monkeypatch):
    names = iter(range(1000))
    monkeypatch.setattr(common, "shared_dir", lambda _: f"{tmp_path}/shared/{next(names)}")
    docs = table(spark, D, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, D)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    total = lambda df: sorted(map(str, df.select("doc_id", "start", "length", "ids_crc32").collect()))
    shutil.rmtree(f"{tmp_path}/shared")
    got = corpus_pipeline.run(spark, D)
    assert len(os.listdir(f"{tmp_path}/shared")) == 1  # the result
    assert total(docs) == total(got)
    assert pq.ParquetDataset(f"{tmp_path}/4").read().num_rows > 0


def test_the_result_has_the_token_ids(spark):
    from tokenizers import Tokenizer

    from hopframe.llm.tokens import vocabulary

    docs = spark.createDataFrame([(1, "hello there, " * 700), (2, None)], "doc_id long, text string")
    rows = sorted(dict(corpus_pipeline.STAGES)["packing"](spark, docs, D).collect(), key=lambda r: (r.doc_id, r.start))
    ids = {i: np.frombuffer(b"".join(r.ids for r in rows if r.doc_id == i), "<u4").tolist() for i in (1, 2)}
    assert ids == {1: [*Tokenizer.from_file(vocabulary()).encode("hello there, " * 700, add_special_tokens=False).ids, 0], 2: [0]}
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in rows)


def tables(spark, path, docs, labels, benchmark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _key int, score string, `a``b` int"
    spark.createDataFrame(docs, kinds).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows_go_through_all_stages(spark, tmp_path, monkeypatch):
    names = iter(range(1000))
    monkeypatch.setattr(common, "shared_dir", lambda _: f"{tmp_path}/shared/{next(names)}")
    text = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    item = text("b", 12)
    rows = [
        (None, None), (None, text("n", 9)), (1, None), (2, ""), (3, " \t"), (4, text("w", 40)), (4, text("w", 40)), (5, text("w", 40) + " end"),
        (6, text("w", 40).upper()), (7, text("l", 60_000)), (8, f"{text('p', 20)} {item} tail a@b.cd"), (9, item), (10, "mail x@y.zz"),
    ]
    docs = [(i, t, None if i == 7 else "en", None, None if t is None else len(t), 1, "x", 2) for i, t in rows]
    d = tables(spark, tmp_path / "odd", docs, [], [(5, item), (None, "c d"), (6, None), (5, item)])
    left = spark.read.parquet(f"{d}/documents.parquet")
    columns = left.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = common.written(stage(spark, left, d))
        assert left.columns == columns, name
    got = sorted(((r.doc_id or 0), r.text or "") for r in left.collect())
    want = [(0, ""), (0, text("n", 9)), (1, ""), (2, ""), (3, " \t"), (4, text("w", 40)), (7, text("l", 60_000)), (8, f"{text('p', 20)}  tail [EMAIL]"), (10, "mail [EMAIL]")]
    assert got == want
    shutil.rmtree(f"{tmp_path}/shared")
    pieces = corpus_pipeline.run(spark, d).collect()
    total = {}
    for p in pieces:
        total[p.doc_id or 0] = total.get(p.doc_id or 0, 0) + p.length
    assert set(total) == {i for i, _ in want} and total[1] == total[2] == 1 and len(os.listdir(f"{tmp_path}/shared")) == 1
    empty = tables(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_a_stage_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    names = iter(range(1000))
    monkeypatch.setattr(common, "shared_dir", lambda _: f"{tmp_path}/{next(names)}")

    def fails(spark, docs, sf_dir):
        common.written(docs)
        return docs.selectExpr("raise_error('no') as x")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda s, d, _: d.limit(5)), ("two", fails)])
    with pytest.raises(Exception, match="no"):
        corpus_pipeline.run(spark, D)
    assert os.listdir(tmp_path) == []
