import itertools
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import values as V

DROPS = (r"SIZE:?\s*\d+\s*[-–]\s*\d{1,3}\s*points?\.?",)
VALUE = r"\b(?:100|[1-9]?\d)\b(?!\s*(?:%|years?\b))"
CONTEXTS = (rf"\b(?:scores?|rated?)\b[^.!?\n]{{0,45}}?{VALUE}", rf"{VALUE}[^.!?\n]{{0,30}}?\bpoints?\b")


def one(spark, make, *values):
    frame = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return frame.select(make(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first()["x"]


def nested(r, depth):
    inner = r.choice(["tin", "lot 4", "blue, late"])
    return f"({inner} {nested(r, depth - 1)} {inner})" if depth else f"({inner})"


def test_titles_of_generated_heads(spark):
    """A name and its bracket are found whatever is nested in the bracket and whatever prose stands around them."""
    r, rows = random.Random(31), []
    for k in range(300):
        name = " ".join(r.choice(["Lamp", "Kettle", "No7", "Ö-Rail"]) for _ in range(r.randint(1, 3)))
        bracket = f"({r.choice([' ', ''])}{r.randint(1, 99)}{r.choice(['', '.5', ',25'])}{r.choice(['', ' '])}%, {nested(r, r.randint(0, 4))} end)"
        want = " ".join(f"{name} {bracket}".split())
        essay = r.choice(["", "", "One thought. ", "Is it? It is! ", "So… "])
        after = r.choice(["", " and on (it goes", " (9%) twice", " then)"])
        rows.append((r.choice(["", "Preview ", "PREVIEW  "]) + essay + f"{name}  {bracket}{after}", want))
    frame = spark.createDataFrame(rows, "head string, want string")
    found = frame.select("head", "want", T.title_of(F.col("head")).alias("t")).collect()
    assert not [(x.head, x.want, x.t) for x in found if x.t.doubtful or x.t.title != x.want]


def test_titles_without_a_strength(spark):
    long = "z" * 230
    heads = {
        None: ("", True), "   ": ("", True), "preview": ("preview", True), "plain words": ("plain words", True),
        "Kettle (red) 'twas late": ("Kettle (red)", False), "Kettle (red)": ("Kettle (red)", True), "Kettle (red) 1999": ("Kettle (red)", True),
        f"{long} (red) 1": (f"{long} (red) 1", True), f"{long} (red) so": (f"{long} (red)", False),
        "Kettle (12%, (red)": ("Kettle (12%, (red)", True), "Kettle (12 (red)% x)": ("Kettle (12 (red)", True),
    }
    frame = spark.createDataFrame([(h,) for h in heads], "head string")
    for x in frame.select("head", T.title_of(F.col("head")).alias("t")).collect():
        assert (x.t.title, x.t.doubtful) == heads[x.head], x.head


def test_rebuilt_text(spark):
    """All mixes of an early mark, a title, prose after it (or ahead of it) and a body, with odd blanks between."""
    r, rows = random.Random(12), []
    for early, title, ahead, prose, marker, gap in itertools.product(["", "Preview", "PREVIEW"], ["Birch 7", "Elm (61 %, Yard)"], ["", "Once more "], ["", "made late", "seen: twice"], ["Tone:", "Hue:", ""], [" ", " \n  "]):
        body = f"{marker} pale and {r.randrange(100)}. End: long." if marker else ""
        text = gap.join(x for x in (early, ahead.strip(), title, prose, body) if x)
        whole = " ".join(text.split())
        kept = " ".join(x for x in (title, "" if ahead else prose, body) if x)
        rows.append((text, title, kept if marker else whole))
    found = spark.createDataFrame(rows, "t string, n string, want string").withColumn("got", T.rebuilt(F.col("t"), F.col("n"), ("Tone:", "Hue:"))).collect()
    assert len(found) == 216 and all(x.got == x.want for x in found)


def test_markers_prefer_the_first_spelling(spark):
    assert one(spark, lambda t: T.marker_position(t, ("Colour:", "Color:")), "Color: x Colour: y") == 10
    assert one(spark, lambda t: T.marker_position(t, ("Colour:", "Color:")), "a Color: x") == 3
    assert one(spark, lambda t: T.marker_position(t, ("Colour:", "Color:")), "nothing") is None


@pytest.mark.parametrize(
    ("note", "want"),
    [
        ("Lead. nose: a b MOUTH (neat): c Finish: d Comments: e", ["a b", "c", "d", "e"]),
        ("Nose: a Palate: c Finish: d", ["a", "c", "d", ""]),
        ("Nose: a Mouth: c finish: d", ["", "", "", ""]),
        ("Nose: a Mouth: Finish: d", ["", "", "", ""]),
        (None, ["", "", "", ""]),
    ],
)
def test_sections(spark, note, want):
    heads = (("nose", r"\b(?i:Nose)\s*:"), ("mouth", r"\b(?i:Mouth\s*(?:\([^)]*\))?\s*:|Palate\s*:)"), ("finish", r"\bFinish\s*:"))
    frame = spark.createDataFrame([(note,)], "note string")
    found = T.sections(F.col("note"), heads, ("comments", r"\bComments\s*:"))
    assert list(frame.select(*[c.alias(n) for n, c in found.items()]).first()) == want


def test_redaction_reaches_a_fixpoint_and_keeps_strengths(spark):
    redact = T.fixpoint_redactor(DROPS, CONTEXTS, VALUE)
    r = random.Random(3)
    marked = f"SIZE:{r.randint(100, 999)} - {r.randint(60, 99)} points."
    parts = ["rated 88", "score 90 or 91", "46 %", "12 years", marked, "fine", "92 points", "7"]
    rows = [(k, " ".join(r.choice(parts) for _ in range(r.randint(0, 8)))) for k in range(60)] + [(99, None)]
    once = spark.createDataFrame(rows, "k int, t string").withColumn("t", redact("t"))
    twice = once.withColumn("u", redact("t")).collect()
    assert all(x.t == x.u for x in twice)
    assert one(spark, redact, f"Rated 88 or 89 now at 46 % after 12 years. {marked}") == "Rated or now at 46 % after 12 years."


def test_small_text_functions(spark):
    assert one(spark, T.squeezed, " a  b\n") == "a b"
    assert one(spark, T.word_count, None) == 0 and one(spark, T.word_count, " a  b ") == 2
    assert one(spark, T.without_prefix, "same", "same") == "same" and one(spark, T.without_prefix, "Name  and more", "Name") == "and more"
    assert one(spark, lambda t: T.after_letter_suffix(t, "Valley"), "Acorn-valley and - Valley") == "Acorn and - Valley"
    assert one(spark, lambda t: T.url_key(t), "Example.org/A/b/?q=1#f") == "https://example.org/A/b"
    assert one(spark, lambda t: T.url_key(t, True), "http://Example.org/A/") == "http://example.org/a"
    assert one(spark, lambda t: T.match_key(t), "“Ａcorn”  10 ％ ABV—x") == "acorn 10% %-x"
    assert one(spark, lambda t: T.joined_phrases(t, ["sea_salt", "salt"]), "Sea-salts and sea salt, well-made") == "sea_salt and sea_salt, well_made"
    assert one(spark, lambda t: F.regexp_count(t, F.lit(T.category_pattern(["fruit", "dry_fruit"]))), "fruit dry fruit, tropical_fruit dry-fruit") == 3
    assert one(spark, lambda t: T.excerpt(t, ["smoke"]), "a b c d e f (Smoke) g h i") == "b c d e f (Smoke) g"
    assert one(spark, lambda t: T.excerpt(t, ["none"], size=2), "a b c") == "a b"
    assert one(spark, lambda t: T.snippet(t, "needle", 3), "hay hay needle hay") == "ay needle ha"
    assert [one(spark, T.lemma, w) for w in ("berries", "boxes", "glasses", "grass", "men", "sea_salts", "As", "notes")] == ["berry", "box", "glass", "grass", "man", "sea_salts", "as", "note"]
    assert one(spark, T.unescaped, "a &amp; b") == "a & b"


def test_dates_and_values(spark):
    assert str(one(spark, V.short_date, "090112")) == "2012-01-09" and str(one(spark, V.short_date, "010170")) == "1970-01-01"
    assert one(spark, V.short_date, "310212") is None and one(spark, V.short_date, "x") is None
    assert str(one(spark, V.long_date, "january  9, 2012")) == "2012-01-09" and one(spark, V.long_date, "February 31, 2012") is None
    assert one(spark, lambda t: V.year_within(t, 2012, 2025), "2012-01-01") and not one(spark, lambda t: V.year_within(t, 2012, 2025), "x")
    row = spark.createDataFrame([(0, 0, [3.0, 4.0])], "c int, n int, v array<double>").select(V.rate(F.col("c"), F.col("n")).alias("r"), V.unit(F.col("v")).alias("u"), V.right_closed(F.lit(74), [0, 74, 79], ["low", "mid"]).alias("b")).first()
    assert row.r is None and row.u == [0.6, 0.8] and row.b == "low"
    with pytest.raises(Exception, match="zero vector"):
        spark.createDataFrame([([0.0],)], "v array<double>").select(V.unit(F.col("v"))).collect()
