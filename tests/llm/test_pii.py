import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tests.llm.helpers import as_sf, docs, odd_rows
from textloom.llm import pii


def brute(t):
    t = t or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_against_plain_patterns():
    r = random.Random(5)
    for _ in range(4000):
        letters = r.choice(["a.@-+ 1", "0123456789.+ -()", "ab@.%_é\U0001F600 ", "12. ", "0 -4"])
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        assert [s for s in pii.spans(t) if s[0] in pii.BASE] == brute(t), t


def test_query_against_brute_force(spark, tmp_path):
    rows = [*odd_rows(), (20, "4111 1111 1111 1111 at 10.0.0.1, 1.2.3.4.5.6.7.8 x@y.z@q.r", "en", "a", 1)]
    got = pii.op5_pii(spark, as_sf(docs(spark, rows), tmp_path)).collect()
    want = []
    for ident, text, *_ in rows:
        base = brute(text)
        n = [sum(s[0] == k for s in base) for k in pii.BASE]
        want.append((ident, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:6]) for r in got)


def test_added_kinds_and_redaction():
    t = "Kontonummer: 12345678, IBAN DE89 3704 0044 0532 0130 00 at 12 Baker Street or Hauptstraße 5; ftp://bob:pw@host.org/x"
    assert [t[a:b] for k, a, b in pii.spans(t) if k == "account"] == ["12345678", "DE89 3704 0044 0532 0130 00"]
    assert [t[a:b] for k, a, b in pii.spans(t) if k == "address"] == ["12 Baker Street", "Hauptstraße 5"]
    assert pii.redacted("mail a@b.co or ftp://bob:pw@host.org/x!") == "mail <EMAIL> or <URL>"
    assert pii.redacted(None) is None and pii.redacted("nothing here") == "nothing here"
    assert pii.spans("the account of 12 people; see https://example.org/a") == []


def test_long_digit_and_at_runs_are_linear():
    for t in ("1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000):
        pii.spans(t)


def test_long_runs_after_cues_are_linear():
    for cue in pii.ACCOUNT_CUES:
        for run in (" ", "\t", " \t", ".", ":", "# ", " no", "1 ", "a", "DE89", "DE89 37"):
            start = time.perf_counter()
            found = pii.spans(cue + run * (200_000 // len(run)) + "x")
            assert time.perf_counter() - start < 1, (cue, run)
            assert not [s for s in found if s[0] == "account"] or run in ("1 ", "DE89 37")


def test_identifiers_after_any_gap(monkeypatch):
    """The same spans as by a pattern that may put blanks in any of its places."""
    loose = re.compile(r"[ \t]*(?:number|num|no|nr|nummer|numéro|número|is|ist)?[ \t]*[.:#=]{0,2}[ \t]*([A-Za-z]{2}[0-9]{2}(?:[ ]?[A-Za-z0-9]{2,4}){3,8}|[0-9](?:[ -]?[0-9]){5,17})(?![A-Za-z0-9])", re.ASCII)
    r = random.Random(8)
    texts = [cue + "".join(r.choice([" ", "  ", "\t", ":", ".", "#", "no", "NO93", "number", "is", "ist"]) for _ in range(r.randint(0, 5))) + r.choice(["1234567", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "no93 8601 1117 947"]) for cue in pii.ACCOUNT_CUES for _ in range(200)]
    got = [pii.spans(t) for t in texts]
    monkeypatch.setattr(pii, "IDENTIFIER", loose)
    assert got == [pii.spans(t) for t in texts]
    assert sum(any(s[0] == "account" for s in g) for g in got) > 200


def test_empty_table_and_other_columns(spark, tmp_path):
    assert pii.op5_pii(spark, as_sf(docs(spark, []), tmp_path / "none")).collect() == []
    more = docs(spark).withColumns({"spans": F.lit(1), "a.b": F.lit(2), "n_email": F.lit("x")})
    assert pii.op5_pii(spark, as_sf(more, tmp_path / "more")).orderBy("doc_id").collect() == pii.op5_pii(spark, as_sf(docs(spark), tmp_path / "plain")).orderBy("doc_id").collect()


def test_house_numbers_at_any_distance_and_digits_by_brute_force():
    far = "Mr " + "Long" * 60
    assert ("address", 0, len(f"12 {far} Street")) in pii.spans(f"12 {far} Street")
    assert [s for s in pii.spans("Calle " + "x" * 200 + " 12") if s[0] == "address"] == [("address", 0, 209)]
    assert [s for s in pii.spans("12 " + " " * 300 + "Road") if s[0] == "address"]
    r = __import__("random").Random(5)
    chain, card = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3,}"), re.compile(r"[0-9]([\x20-]?[0-9])+")
    for _ in range(3000):
        text = "".join(r.choice("0123459.. -a") for _ in range(r.randint(0, 60)))
        got = pii.spans(text)
        want = [m.span() for m in card.finditer(text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        assert [(a, b) for k, a, b in got if k == "card"] == want
        ips = [x for m in chain.finditer(text) for x in pii.ips(m)]
        assert [(a, b) for k, a, b in got if k == "ip"] == ips
    digits = " ".join("4000 0000 0000 0002" for _ in range(1))
    assert [s for s in pii.spans("x" + digits + "y") if s[0] == "card"] == [("card", 1, 20)]
