"""Nested documents with defined errors; a stream whose runs are killed between write and commit."""

import json

import pytest

from textloom.sources import tables
from textloom.streaming import ingest


def test_documents_with_errors(spark, tmp_path):
    good = {"status": "frozen", "categories": {"Wood": {"short_name": "wood", "terms": ["oak", "pine", None, "a \"b\""]}, "Bare": {"terms": ["x"]}, "None": {"short_name": "none", "terms": []}}}
    texts = {"a": json.dumps(good, indent=1), "b": json.dumps(good)[:70], "c": '{"status": "draft", "categories": {}}', "d": "[1, 2]", "e": "", "f": '{"status": "frozen", "categories": {}}', "g": "7"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = sorted((r.category or "", r.short_name or "", r.term or "", r.error or "") for r in tables.dictionaries(spark, str(tmp_path)).collect())
    assert got == [("", "", "", "no dictionary")] * 3 + [("", "", "", "not frozen"), ("Bare", "", "", "no short name")] + [("Wood", "wood", t, "") for t in ('a "b"', "oak", "pine")]
    with pytest.raises(ValueError, match="not usable"):
        tables.dictionary(spark, str(tmp_path / "b.json"))


@pytest.mark.parametrize("killed", [0, 1, 2])
def test_each_record_once_though_a_run_is_killed(spark, tmp_path, killed):
    for k, texts in enumerate((["a", "b", "b", None], ["b", "c", "a  "], ["d", "c", "e", ""])):
        spark.createDataFrame([(k, t) for t in texts], "at int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema, out, state = spark.read.parquet(str(tmp_path / "in")).schema, str(tmp_path / "out"), str(tmp_path / "state")
    add, fell = ingest.ledger(out, schema, "text"), []

    def falls(batch, number):
        add(batch, number)
        if number == killed and not fell:
            fell.append(number)
            raise RuntimeError("killed between write and commit")

    stream = lambda: ingest.files(spark, str(tmp_path / "in"), schema, most=1)
    with pytest.raises(Exception, match="killed"):
        ingest.add_once(stream(), "text", out, state, handler=falls).awaitTermination()
    ingest.add_once(stream(), "text", out, state).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.text or "").strip() for r in rows) == ["", "a", "b", "c", "d", "e"] and len({r.record for r in rows}) == 6
    ingest.add_once(stream(), "text", out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 6
