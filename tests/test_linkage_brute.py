"""The linkage cascade and what follows it, against plain loops over all entries and records."""

import difflib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from textloom.operators import linkage, similarity
from textloom.plans import linking


QUOTES = str.maketrans("‘’‚‛“”„–—", "''''\"\"\"--")


def norm(name):
    """Folded, lower case, no score tails, punctuation as spaces."""
    key = unicodedata.normalize("NFKC", name or "").translate(QUOTES).lower()
    key = re.sub(r"\babv\b", "%", re.sub(r"(\d)\s+%", r"\1%", key))
    key = re.sub(r"\s*sgp\s*:?\s*\d+\s*-\s*\d+", " ", key)
    key = re.sub(r"\s*-\s*\d{1,3}\s*points\s*\.?\s*$", "", key)
    key = re.sub(r"\(\s*\d{1,3}\s*points\s*\)", "", key)
    return " ".join(re.sub(r"[^\w%\-+#]", " ", key).split())


def host_and_path(link):
    link = (link or "").strip().lower()
    return link if link.split("://")[-1] else None


def brute(index, corpus, pool):
    """entry to (record, method, confidence), one entry at a time; ``pool`` None: no bound."""
    out, order = {}, sorted(corpus, key=lambda c: c["record"])
    links, names = {}, {}
    for c in order:
        links.setdefault((host_and_path(c["link"]), c["day"]), []).append(c)
        names.setdefault((norm(c["name"]), c["score"]), []).append(c)
    for e in index:
        name, found, link = norm(e["name"]), None, host_and_path(e["link"])
        same_link = links.get((link, e["day"]), []) if link and e["day"] is not None else []
        same_name = [c for c in same_link if norm(c["name"]) == name]
        pool2 = names.get((name, e["score"]), [])
        lead = norm(e["snippet"])[:200][:80]
        told = [c for c in pool2 if lead and lead in norm(c["text"])[:200]]
        if len(same_link) == 1 or len(same_name) == 1:
            found = ((same_link if len(same_link) == 1 else same_name)[0]["record"], "exact_link", 1.0)
        elif len(pool2) == 1:
            found = (pool2[0]["record"], "exact_name_score", 1.0)
        elif len(told) == 1:
            found = (told[0]["record"], "exact_name_score_snippet", 1.0)
        else:
            near = pool2 or (order if pool is None or len(order) <= pool else [])
            near = [c for c in near if e["score"] is None or c["score"] == e["score"]]
            ratios = [(difflib.SequenceMatcher(None, name, norm(c["name"])).ratio() if name else 0.0, c) for c in near]
            best = max((x for x, _ in ratios), default=0.0)
            if best >= 0.78:
                top = next(c for x, c in ratios if x == best)
                sure = best >= 0.88 and sum(x >= 0.88 for x, _ in ratios) == 1 and e["day"] is not None and e["day"] == top["day"]
                found = (top["record"], "fuzzy_high" if sure else "fuzzy_low", round(best, 4))
        out[e["entry"]] = found or (None, "unmatched", 0.0)
    return out


def test_whole_cascade_of_the_smallest_tables(spark):
    index, corpus = linking.index(spark, SF).collect(), linking.corpus(spark, SF).collect()
    assert len(corpus) <= linkage.POOL
    sample = [e for e in index if int(e["entry"][1:]) % 27 == 0] + index[:300]
    want = brute([dict(x.asDict(), link=x["link"]) for x in sample], [x.asDict() for x in corpus], linkage.POOL)
    frame = spark.createDataFrame(sample, linking.index(spark, SF).schema).dropDuplicates(["entry"])
    got = {r.entry: (r.record, r.method, r.confidence) for r in linkage.linked(frame, linking.corpus(spark, SF)).collect()}
    assert got == want and {m for _, m, _ in want.values()} >= {"exact_link", "fuzzy_high"}


@pytest.mark.parametrize("pool", [0, 100])
def test_scores_names_and_days_that_are_missing(spark, pool):
    corpus = [
        ("r1", "u1", "Acorn ten old", 90, "2020-01-01", "t one"), ("r2", "u2", "Acorn ten olde", None, "2020-01-02", "t two"), ("r3", "u3", "", None, "2020-01-03", "x"),
        ("r4", "u4", "Birch", 80, "2020-01-04", "same start a"), ("r5", "u4", "Birch", 80, "2020-01-04", "other start b"), ("r6", "u6", "Cedar wood", 70, None, "z"),
    ]
    index = [
        ("e1", "v", "Acorn ten oldy", 90, "2020-01-01", "", "named"), ("e2", "v", "Acorn ten oldest", None, "2020-01-09", "", "named"), ("e3", "v", "", 50, "2020-01-03", "", "named"),
        ("e4", "u4", "Birch", 80, "2020-01-04", "Same  start", "named"), ("e5", "v", "Birch", 80, None, "", "named"), ("e6", "v", "Cedar woods", 70, None, "", "named"), ("e7", "v", None, None, None, None, "named"),
    ]
    c = spark.createDataFrame(corpus, "record string, link string, name string, score int, day string, text string")
    i = spark.createDataFrame(index, "entry string, link string, name string, score int, day string, snippet string, page_kind string")
    got = {r.entry: (r.record, r.method, r.confidence) for r in linkage.linked(i, c, pool).collect()}
    assert got == brute([r.asDict() for r in i.collect()], [r.asDict() for r in c.collect()], pool)
    if pool:
        assert got["e1"][:2] == ("r1", "fuzzy_high") and got["e2"][0] in ("r1", "r2") and got["e3"][1] == "unmatched" and got["e7"][:2] == ("r3", "exact_name_score")


def test_similarity_of_empty_names_is_none(spark):
    rows = spark.createDataFrame([("", ""), ("", "a"), ("a", ""), ("ab", "ab")], "a string, b string")
    assert [r.x for r in rows.select(linkage.similarity(F.col("a"), F.col("b")).alias("x")).collect()] == [0.0, 0.0, 0.0, 1.0]


def names(r, n):
    """Names of a few words, some with changed, lost, doubled or swapped characters, some very short or empty."""
    words = ["acorn", "birch", "cedar", "old", "reserve", "12", "cask", "aa", "aaaa", "é", "north", "x"]
    out = []
    for _ in range(n):
        name = list(" ".join(r.choice(words) for _ in range(r.randint(0, 5))))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            k = r.randrange(len(name) + 1)
            name[k:k + r.randint(0, 2)] = r.choice(["", "z", "ab", name[:1][0] if name else "q"])
        out.append("".join(name).strip())
    return out + ["", "a", "b", "ab", "ba", "abc", "abcd", "abce", "ab" * 130, "ab" * 128 + "c"]


@pytest.mark.parametrize("least", [0.78, 0.9, 0.7])
def test_similar_names_against_all_pairs(spark, least):
    r = random.Random(int(least * 100))
    left, right = sorted(set(names(r, 250))), sorted(set(names(r, 250)))
    frame = lambda some: spark.createDataFrame([(b, x) for x in some for b in ("1", "2")] + [(None, "acorn"), ("1", None)], "block string, name string")
    got = similarity.similar_names(frame(left).repartition(3), frame(right).filter("block = '1' OR name < 'b'"), least)
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {(b, x, y): ratio(x, y) for x in left for y in right if x and y and ratio(x, y) >= least for b in ("1", "2") if b == "1" or y < "b"}
    found = [((g.block, g.name, g.other), g.ratio) for g in got.collect()]
    assert dict(found) == want and len(found) == len(want) > 10


def test_ratios_that_the_bounds_say_nothing_about(spark):
    with pytest.raises(ValueError):
        similarity.similar_names(spark.createDataFrame([], "block string, name string"), spark.createDataFrame([], "block string, name string"), 0.6)


def test_unlike_names_beyond_the_pool(spark):
    r = random.Random(4)
    score = lambda: r.choice([None, 80, 81])
    day = lambda: r.choice([None, "2020-01-01", "2020-01-02"])
    corpus = [(f"r{k:04}", f"https://a.org/{k}", n, score(), day(), f"Text {k % 7} on “{n}”") for k, n in enumerate(names(r, 150))]
    index = [(f"e{k}", "", n, score(), day(), f'text {k % 7} on "{n}"' if k % 2 else None, "named") for k, n in enumerate(names(r, 150))]
    c = spark.createDataFrame(corpus, "record string, link string, name string, score int, day string, text string")
    i = spark.createDataFrame(index, "entry string, link string, name string, score int, day string, snippet string, page_kind string")
    for pool in (None, 20):
        got = {x.entry: (x.record, x.method, x.confidence) for x in linkage.linked(i, c, pool).collect()}
        assert got == brute([x.asDict() for x in i.collect()], [x.asDict() for x in c.collect()], pool)
        methods = {m for _, m, _ in got.values()}
        assert "unmatched" in methods and ("fuzzy_low" in methods or pool)


def test_blank_links_folded_snippets_and_score_tails(spark):
    long = "word " * 60
    corpus = [
        ("r1", "", "Acorn", 90, "2020-01-01", "t"), ("r2", "https://", "Birch", 80, "2020-01-02", "t"), ("r3", "u", "Beta", 88, None, "t"), ("r4", "u", "Gamma", 70, None, "He said “good”, truly."), ("r5", "u", "Gamma", 70, None, "Other"),
        ("r6", "u", "Delta", 71, None, long + "late words"), ("r7", "u", "Delta", 71, None, "x"), ("r8", "u", "Eta (90 points)", 90, None, "t"), ("r9", "u", "Theta SGP:466 - 92", 92, None, "t"),
    ]
    index = [
        ("e1", "", "Zebra", 50, "2020-01-01", None, "named"), ("e2", " ", "Yak", 50, "2020-01-02", None, "named"), ("e3", None, "Beta - 88 points.", 88, None, None, "named"), ("e4", None, "Gamma", 70, None, 'He said "good" truly', "named"),
        ("e5", None, "Delta", 71, None, "late words", "named"), ("e6", None, "Eta", 90, None, None, "named"), ("e7", None, "Theta", 92, None, None, "named"),
    ]
    c = spark.createDataFrame(corpus, "record string, link string, name string, score int, day string, text string")
    i = spark.createDataFrame(index, "entry string, link string, name string, score int, day string, snippet string, page_kind string")
    got = {x.entry: (x.record, x.method) for x in linkage.linked(i, c, 0).collect()}
    assert got == {"e1": (None, "unmatched"), "e2": (None, "unmatched"), "e3": ("r3", "exact_name_score"), "e4": ("r4", "exact_name_score_snippet"), "e5": ("r6", "fuzzy_low"), "e6": ("r8", "exact_name_score"), "e7": ("r9", "exact_name_score")}
    assert {k: v[:2] for k, v in brute([x.asDict() for x in i.collect()], [x.asDict() for x in c.collect()], 0).items()} == got
