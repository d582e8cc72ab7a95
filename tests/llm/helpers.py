"""Small tables with nulls, ties, repeats, empty and long texts and clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = [f"w{k}" for k in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd_rows():
    long = prose(30_000, 1)
    base = prose(120, 2)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, "", "en", None), (5, None, None, "b"),
        (6, long, "en", "a"), (7, "  \n\t ", "fr", ""), (8, "one two", "de", "é"), (8, "one two", "de", "é"), (None, "no id here", "en", "a"),
        (10, "Mail bob@example.org or +49 (30) 1234-567", "en", "b"), (11, long[:4000] + "\n" + base, "en", "a"), (12, "\U0001F600 a" * 50, "es", "a"), (13, "x" * 5000, "es", "z"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def docs(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def as_sf(df, tmp_path, name="documents"):
    """The frame as the table ``name`` of a folder of tables."""
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
