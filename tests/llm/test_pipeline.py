import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, as_sf, docs, odd_rows, prose
from tests.llm.test_toxicity import labelled
from textloom.llm import pii, toxicity


@pytest.fixture
def sf(spark, tmp_path):
    texts, marks = labelled(800)
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    rows += [(1000 + (r[0] or 0), *r[1:]) for r in odd_rows()] + [(2000, prose(90, 1) + " mail a@b.example", "en", "s1", 1), (2001, prose(90, 1) + " mail a@b.example", "en", "s1", 1)]
    as_sf(docs(spark, rows), tmp_path)
    return as_sf(spark.createDataFrame([(k, 1, int(m)) for k, m in enumerate(marks)], "doc_id long, quality int, toxic int"), tmp_path, "labels")


def test_stages_keep_the_columns_and_take_effect(spark, sf, tmp_path):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    now, made = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, now, sf)
        assert k == len(cp.STAGES) - 1 or out.columns == names
        out.write.parquet(f"{tmp_path}/out{k}")
        made[name], now = now, spark.read.parquet(f"{tmp_path}/out{k}")
    before = {r.doc_id for r in made["toxicity"].collect()}
    clean = made["near_duplicates"].collect()
    gone = before - {r.doc_id for r in clean}
    marks = dict(enumerate(labelled(800)[1]))
    assert sum(marks.get(i, 0) == 1 for i in gone) > 0.8 * sum(marks.values()) and sum(marks.get(i, 0) == 0 for i in gone) < 0.1 * len(before)
    apart = [r.doc_id for r in made["personal_data"].collect()]
    assert len(apart) == len(set(apart)) and not {2001, 1002} & set(apart) and (2000 in apart or 2000 in gone)
    hidden = made["mixing"].collect()
    assert all(not [s for s in pii.spans(r.text)] for r in hidden) and all(r.text is None or r.n_chars == len(r.text) for r in hidden)
    taken = made["bpe"].collect()
    t = Tokenizer.from_file(cp.public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids) for r in taken)
    assert sorted((r.doc_id, r.ids) for r in now.collect()) == want


def test_run_on_empty_tables(spark, tmp_path, monkeypatch):
    as_sf(docs(spark, []), tmp_path)
    sf = as_sf(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert cp.run(spark, sf).count() == 0
    assert toxicity.fitted(docs(spark, []), spark.read.parquet(f"{sf}/labels.parquet")) is None


def test_all_stages_with_columns_of_any_name(spark, tmp_path):
    more = {"a.b": F.lit(1), "TL_score": F.lit("x"), "c0": F.lit(2.0), "score": F.lit(None).cast("long"), "ref": F.lit("r")}
    as_sf(docs(spark).withColumns({k.replace(".", "_dot_"): v for k, v in more.items()}).withColumnRenamed("a_dot_b", "a.b"), tmp_path)
    sf = as_sf(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    names = now.columns
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, now, sf)
        assert out.columns == names
        out.write.parquet(f"{tmp_path}/any{k}")
        now = spark.read.parquet(f"{tmp_path}/any{k}")
        assert now.select(F.col("`a.b`")).distinct().count() == 1
    assert cp.STAGES[-1][1](spark, now, sf).count() == now.count() > 5
