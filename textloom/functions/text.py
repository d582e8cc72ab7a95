"""Column functions over text: cleaning, redaction, sectioning, tokens, dictionary patterns."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def marker_position(text: Column, markers: Iterable[str]) -> Column:
    """The place (from 1) of the first marker of the list that occurs; null if none does."""
    return F.coalesce(*[F.when(F.instr(text, m) > 0, F.instr(text, m)) for m in markers])


def before_marker(text: Column, markers: Iterable[str]) -> Column:
    at = marker_position(text, list(markers))
    return squeezed(F.when(at.isNotNull(), F.substring(text, F.lit(1), at - 1)).otherwise(text))


def without_prefix(text: Column, prefix: Column) -> Column:
    """``text`` without ``prefix``, unless that leaves nothing."""
    t, p = squeezed(text), squeezed(prefix)
    rest = F.trim(F.substring(t, F.length(p) + 1, F.length(t)))
    return F.when((p != "") & F.startswith(t, p) & (rest != ""), rest).otherwise(t)


def content_key(text: Column) -> Column:
    """SHA-256 of the squeezed text, as a record's key."""
    return F.sha2(squeezed(blank(text)), 256)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(blank(text), r"(?U)\s+"), lambda w: w != ""))


def tokens(text: Column, pattern: str = "[a-z_]+") -> Column:
    return F.regexp_extract_all(F.lower(blank(text)), F.lit(pattern), F.lit(0))


def rewritten(text: Column, rules: Iterable[tuple[str, str, bool]]) -> Column:
    """Rules (from, to, is_pattern) applied in order."""
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]) if rule[2] else F.replace(t, F.lit(rule[0]), F.lit(rule[1])), rules, text)


def after_letter_suffix(text: Column, suffix: str) -> Column:
    """Drops a hyphenated suffix that follows a letter, in any case."""
    return F.regexp_replace(text, rf"(?i)(?<=[A-Za-z])[-–]\s*{re.escape(suffix)}\b", "")


def sections(text: Column, heads: tuple[tuple[str, str], ...], last: tuple[str, str] | None = None) -> dict[str, Column]:
    """Named sections between ordered head patterns; all are blank if a head or a section is missing. ``last`` is an
    optional closing section."""
    body = "".join(rf"{pattern}(?<{name}>.*?)" for name, pattern in heads[:-1])
    name, pattern = heads[-1]
    close = rf"(?:{last[1]}(.*))?" if last else ""
    whole = re.sub(r"\(\?<\w+>", "(", rf"(?s)^.*?{body}{pattern}(.*?){close}$")
    names = [n for n, _ in heads] + ([last[0]] if last else [])
    parts = {n: F.trim(F.regexp_extract(blank(text), whole, k + 1)) for k, n in enumerate(names)}
    ok = reduce(lambda a, b: a & b, [parts[n] != "" for n, _ in heads])
    return {n: F.when(ok, p).otherwise("") for n, p in parts.items()}


def fixpoint_redactor(drops: tuple[str, ...], contexts: tuple[str, ...], value: str):
    """A column function: deletes matches of ``drops``, then values inside matches of each context until none is left.

    The callback and the fixpoint have no counterpart among the built-in functions, so it is an Arrow-batched UDF.
    """
    gone = [re.compile(p, re.I) for p in drops]
    around = [re.compile(p, re.I) for p in contexts]
    inner = re.compile(value, re.I)

    def one(text: str | None) -> str:
        text = text or ""
        for p in gone:
            text = p.sub("", text)
        for p in around:
            while (after := p.sub(lambda m: inner.sub("", m[0]), text)) != text:
                text = after
        return " ".join(text.split())

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return redact


#: A bracket that opens with a strength, the word that marks an early record, where a label may end, and
#: a closing bracket before a word.
STRENGTH, EARLY, LABEL_END = r"\(\s*\d+(?:[.,]\d+)?\s*%", r"(?i)^preview\s+", 220
BEFORE_WORD = r"\)\s+['‘’]?[A-Za-z]"


def balanced(text: Column) -> Column:
    """The length of the bracketed piece that ``text`` opens with, nested brackets included; null if it never closes.

    Cut at closing brackets, the piece ends with the first cut by which as many brackets have been opened as closed."""
    cuts = F.split(text, r"\)")
    opened = lambda part: F.length(part) - F.length(F.replace(part, F.lit("("), F.lit("")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(None).cast("int").alias("end"))

    def step(state, part):
        depth, size = state["depth"] + opened(part) - 1, state["size"] + F.length(part) + 1
        return F.struct(depth.alias("depth"), size.alias("size"), F.coalesce(state["end"], F.when(depth == 0, size)).alias("end"))

    return F.aggregate(F.slice(cuts, F.lit(1), F.size(cuts) - 1), start, step, lambda state: state["end"])


def title_of(head: Column) -> Column:
    """A struct of title and doubtful, from the prose before a record's body.

    A title is a name and the bracket after it that opens with a strength; the name is the last sentence before it.
    Prose without a strength is a title up to a closing bracket before a word; failing that it is doubtful, and cut
    at its first closing bracket if that comes early."""
    text = F.regexp_replace(squeezed(blank(head)), EARLY, "")
    at = F.regexp_instr(text, F.lit(STRENGTH))
    label = F.substring(text, at, F.length(text))
    end = balanced(label)
    sentences = F.split(F.trim(F.left(text, at - 1)), r"(?<=[.!?…])\s+")
    named = F.regexp_replace(F.trim(F.concat_ws(" ", F.element_at(sentences, -1), F.left(label, end))), EARLY, "")
    before_word, close = F.regexp_instr(text, F.lit(BEFORE_WORD)), F.instr(text, ")")
    bare = F.when(before_word > 0, F.left(text, before_word)).when(close.between(1, LABEL_END), F.left(text, close)).otherwise(text)
    title = F.when(at == 0, bare).when(end.isNull(), text).otherwise(named)
    sure = F.when(at == 0, before_word > 0).otherwise(end.isNotNull())
    return F.struct(title.alias("title"), (~sure).alias("doubtful"))


def rebuilt(text: Column, title: Column, markers: tuple[str, ...]) -> Column:
    """A record's text as its title, the prose that followed it, and its body from the first marker."""
    whole = squeezed(text)
    at = marker_position(whole, markers)
    head = F.regexp_replace(F.trim(F.substring(whole, F.lit(1), at - 1)), EARLY, "")
    blurb = F.when(F.startswith(head, title), F.trim(F.substring(head, F.length(title) + 1, F.length(head)))).otherwise("")
    return F.when(at.isNull(), whole).otherwise(squeezed(F.concat_ws(" ", title, blurb, F.substring(whole, at, F.length(whole)))))


def number_after(text: Column, pattern: str) -> Column:
    """The first group of a pattern as a whole number, or null."""
    return F.regexp_extract(blank(text), pattern, 1).try_cast("int")


def mapped(text: Column, change) -> Column:
    """A text column through a Python function, in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else change(t))

    return run(text)


def unescaped(text: Column) -> Column:
    return mapped(text, html.unescape)


def folded(text: Column) -> Column:
    """NFKC, which has no built-in function."""
    return mapped(text, lambda t: unicodedata.normalize("NFKC", t))


#: Typographic quotes and dashes, and what they become.
QUOTES = ("‘’‚‛“”„–—", "''''\"\"\"--")


def match_key(name: Column, drop: tuple[str, ...] = ()) -> Column:
    """A name as a join key: folded, lower case, plain quotes, numbers apart from units, punctuation as spaces."""
    key = F.lower(F.translate(folded(blank(name)), *QUOTES))
    key = F.regexp_replace(key, r"(\d)\s+%", "$1%")
    key = F.regexp_replace(key, r"\babv\b", "%")
    for pattern in drop:
        key = F.regexp_replace(key, pattern, " ")
    return squeezed(F.regexp_replace(key, r"(?U)[^\w%\-+#]+", " "))


def url_key(url: Column, loose: bool = False) -> Column:
    """A link with https for a missing scheme, a lower-case host, and neither query, fragment nor final slash; null
    where there is no host."""
    whole = F.when(url.rlike("(?i)^[a-z][a-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), F.ltrim(url)))
    scheme = F.lower(F.regexp_extract(whole, r"^([^:]+)://", 1))
    host = F.lower(F.regexp_extract(whole, r"^[^:]+://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(whole, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(F.trim(url) != "", F.when(host != "", F.concat(scheme, F.lit("://"), host, F.lower(path) if loose else path)))


def term_pattern(term: str) -> str:
    """A term between non-letters; its underscores match spaces, hyphens and underscores."""
    return r"(?<![a-z])" + r"[\s_-]+".join(re.escape(p) for p in term.split("_")) + r"(?![a-z])"


def category_pattern(terms: Iterable[str]) -> str:
    """One pattern for a category, the longest terms first."""
    longest = sorted({*terms}, key=lambda t: (-len(t), t))
    return r"(?i)\b(?:" + "|".join(r"[\s_-]+".join(re.escape(p) for p in t.split("_")) for t in longest) + r")\b"


def joined_phrases(text: Column, phrases: Iterable[str], spellings: Iterable[tuple[str, str]] = ()) -> Column:
    """Plain quotes, spellings, hyphens between letters and listed phrases (longest first, plural or not) as words
    with underscores."""
    out = F.translate(blank(text), *QUOTES)
    for a, b in spellings:
        out = F.regexp_replace(out, a, b)
    out = F.regexp_replace(out, r"(?<=[A-Za-z])-(?=[A-Za-z])", "_")
    for phrase in sorted({*phrases}, key=lambda p: (-len(p), p)):
        out = F.regexp_replace(out, r"(?i)\b" + r"[\s_-]+".join(map(re.escape, phrase.split("_"))) + r"s?\b", phrase)
    return out


#: Nouns whose plural is no suffix.
IRREGULAR = {"men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose", "leaves": "leaf", "loaves": "loaf", "knives": "knife", "lives": "life"}


def lemma(token: Column, exceptions: dict[str, str] | None = None) -> Column:
    """A noun's singular by suffix rules and exceptions; phrases and short words are only made lower case."""
    t = F.lower(token)
    table = F.create_map(*[F.lit(x) for kv in (exceptions or IRREGULAR).items() for x in kv])
    rule = F.when(t.rlike("^[a-z]+ies$") & (F.length(t) > 4), F.regexp_replace(t, "ies$", "y"))
    rule = rule.when(t.rlike("(ss|sh|ch|x|z)es$"), F.regexp_replace(t, "es$", "")).when(t.rlike("(ss|us|is)$"), t).when(t.rlike("^[a-z]{2,}s$"), F.regexp_replace(t, "s$", ""))
    return F.when(~t.rlike("^[a-z]{3,}$"), t).otherwise(F.coalesce(table[t], rule, t))


def snippet(text: Column, pattern: str, reach: int = 85) -> Column:
    """The text around the first match of a pattern, squeezed; null without a match."""
    at = F.regexp_instr(blank(text), F.lit(pattern))
    size = F.length(F.regexp_extract(blank(text), pattern, 0))
    start = F.greatest(F.lit(1), at - reach)
    return F.when(at > 0, squeezed(F.substring(text, start, at + size + reach - start)))


def excerpt(text: Column, first_words: list[str], before: int = 5, size: int = 7) -> Column:
    """``size`` words from ``before`` words ahead of the first listed word, else from the start."""
    words = F.filter(F.split(blank(text), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^\W+|\W+$", "")))
    hits = F.transform(bare, lambda w: w.isin(first_words))
    at = F.array_position(hits, F.lit(True))
    return F.array_join(F.slice(words, F.greatest(F.lit(1), at.cast("int") - before), F.lit(size)), " ")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
