import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, as_sf, docs, odd_rows, prose
from textloom.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    capped = set()
    while True:
        rest = [s for s in names if s not in capped]
        if not rest:
            break
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(w[s] for s in rest)
        over = {s for s in rest if level * w[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: 2.0 * sizes[s] if s in capped else level * w[s] for s in names}


def check(rows, got, near):
    size = lambda t: len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    want = brute_targets(sizes)
    by_size = {}
    for s in sizes:
        by_size.setdefault((sizes[s], round(want[s], 6)), []).append(s)
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert (r.source_size, round(r.target, 6)) in by_size
    for s in sizes:
        ids = {r[0] for r in rows if r[3] == s}
        taken[s] = sum(r.taken for r in got if r.doc_id in ids)
        biggest = max(size(r[1]) for r in rows if r[3] == s)
        assert abs(taken[s] - want[s]) <= max(biggest / 2 + 1e-6, near * want[s]), s


def test_against_brute_force(spark, tmp_path):
    rows = [(k, prose(1 + (k * 7919) % 300, k), "en", ["a", "b", "c", "d", None, "é"][min(5, k % 11)], 0) for k in range(900)]
    sf = as_sf(docs(spark, rows), tmp_path)
    got = mixing.op8_pareto_mix(spark, sf).collect()
    check(rows, got, 0.01)
    again = mixing.op8_pareto_mix(spark, sf).repartition(7).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_odd_rows_and_columns_of_the_mix(spark):
    rows = [r for r in odd_rows()]
    frame = docs(spark, rows).withColumns({"size": F.lit("x"), "target": F.lit("y"), "taken": F.lit("z"), "source_size": F.lit(1)})
    out = mixing.mixed(frame)
    assert out.columns == frame.columns
    copies = mixing.with_copies(frame, mixing.word_count(F.col("text")), F.col("source"), [F.col("doc_id"), F.col("text")])
    assert copies.count() == len(rows)
    clash = frame.withColumns({c: F.lit("mine") for c in ("tl_size", "tl_source", "tl_u", "TL_Row", "tl_rank", "tl_p", "tl_class", "c0", "a.b")})
    mixed = mixing.mixed(clash)
    assert mixed.columns == clash.columns and mixed.count() == out.count()
    assert all(r["tl_size"] == r["TL_Row"] == r["tl_p"] == r["c0"] == r["a.b"] == "mine" for r in mixed.collect())
    assert mixing.with_copies(clash, F.lit(1).cast("long"), F.col("source"), [F.col("doc_id")]).columns[-4:] == ["tl_size_", "tl_source_size", "tl_target", "tl_copies"]
    assert out.count() == copies.agg(F.sum("tl_copies")).first()[0]


def test_many_repeated_rows_of_one_source_still_meet_the_target(spark):
    rows = [(1, "same words here", "en", "hot", 1)] * 500 + [(k, prose(50, k), "en", f"s{k % 5}", 1) for k in range(200)]
    taken = mixing.with_copies(docs(spark, rows), mixing.word_count(F.col("text")), F.col("source"), [F.col("doc_id"), F.col("text")])
    for r in taken.groupBy("source").agg(F.sum(F.col("tl_size") * F.col("tl_copies")).alias("got"), F.first("tl_target").alias("want"), F.max("tl_size").alias("most")).collect():
        assert abs(r.got - r.want) <= r.most / 2 + 1e-6


def test_unequal_odds_prefer_short_documents(spark):
    rows = [(k, prose(10 if k % 2 else 640, k), "en", "a" if k < 2000 else "b", 1) for k in range(2400)]
    taken = mixing.with_copies(docs(spark, rows), F.when(F.col("doc_id") % 2 == 1, 10).otherwise(640).cast("long"), F.col("source"), [F.col("doc_id")], weights=(1, 8))
    share = {r.tl_size: r.p for r in taken.filter("source = 'a'").groupBy("tl_size").agg(F.avg("tl_copies").alias("p")).collect()}
    assert share[10] > share[640]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_empty(spark, rows):
    taken = mixing.with_copies(spark.createDataFrame(rows, SCHEMA), mixing.word_count(F.col("text")), F.col("source"), [F.col("doc_id")])
    assert [r.tl_copies for r in taken.collect()] == [0] * len(rows)


def test_selection_is_the_pareto_order(spark):
    """Within the rows left to the lottery, those that are taken rank before those that are not."""
    rows = [(k, prose(1 + (k * 31) % 90, k), "en", "a" if k % 3 else "b", 1) for k in range(700)]
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("pareto"), "doc_id", "text"), 11).cast("double") + 0.5) / float(1 << 53)
    taken = mixing.with_copies(docs(spark, rows), mixing.word_count(F.col("text")), F.col("source"), [F.col("doc_id"), F.col("text")]).withColumn("u", u).collect()
    for source in "ab":
        own = [r for r in taken if r.source == source and r.tl_size]
        total, target = own[0].tl_source_size, own[0].tl_target
        whole = int(target / total + 1e-12)
        rest, lean = target - whole * total, lambda n: 2.0 ** (-((n + 1).bit_length() - 1) / 2)
        low, high = 0.0, 1e6
        for _ in range(200):  # the level at which the expected words are the rest
            c = (low + high) / 2
            low, high = (c, high) if sum(r.tl_size * min(1, c * lean(r.tl_size)) for r in own) < rest else (low, c)
        rank = lambda r, p: -1.0 if p >= 1 - 1e-9 else r.u / (1 - r.u) * (1 - p) / p
        order = sorted(own, key=lambda r: rank(r, min(1, low * lean(r.tl_size))))
        flags = [r.tl_copies - whole for r in order]
        assert flags == sorted(flags, reverse=True) and set(flags) <= {0, 1}
