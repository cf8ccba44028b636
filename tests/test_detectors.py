"""Values, offsets and scores of each detector, on own values."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from checks import duck as second
from veilspark.functions.detectors import DETECTORS, SAFE, analyze, choose, raw_spans, regex_detector
from veilspark.functions.texts import anonymise_text
from veilspark.operators.detect import analyze_columns, detect, entity_profile

# entity, text, expected (start, end, match)
CASES = [
    ("EMAIL_ADDRESS", "write to jo.doe@mail.example.org!", [(9, 32, "jo.doe@mail.example.org")]),
    ("EMAIL_ADDRESS", "é jo@example.org", [(3, 17, "jo@example.org")]),
    ("EMAIL_ADDRESS", "jo@example", []),
    ("EMAIL_ADDRESS", "a@b.c-_x@d.ee", [(0, 5, "a@b.c"), (5, 13, "-_x@d.ee")]),
    ("EMAIL_ADDRESS", "jo@@example.org", []),
    ("PHONE_NUMBER", "+44 7700 900123", [(0, 13, "+44 7700 9001")]),
    ("PHONE_NUMBER", "07700900123", [(0, 10, "0770090012")]),
    ("PHONE_NUMBER", "01632960123", [(0, 10, "0163296012")]),
    ("PHONE_NUMBER", "01632960x", [(0, 9, "01632960x")]),
    ("PHONE_NUMBER", "+44", [(0, 3, "+44")]),
    ("PHONE_NUMBER", "+1 212", []),
    ("PHONE_NUMBER", "call 212-555-0100", [(5, 17, "212-555-0100")]),
    ("PHONE_NUMBER", "fax +4930123456", [(4, 15, "+4930123456"), (5, 15, "4930123456")]),
    ("PHONE_NUMBER", "only 12345", []),
    ("UK_POSTCODE", "at SW1A 1AA.", [(3, 11, "SW1A 1AA")]),
    ("UK_POSTCODE", "sw1a 1aa", []),
    ("UK_POSTCODE", "éM1 1AEé", [(2, 8, "M1 1AE")]),
    ("UK_POSTCODE", "xM1 1AE", []),
    ("UK_NINO", "ab 12 34 56 d", [(0, 13, "ab 12 34 56 d")]),
    ("UK_NINO", "DA123456A", []),
    ("UK_NINO", "AB003456A", []),
    ("UK_NINO", "AB123456C", []),
    ("UK_NHS_NUMBER", "943 476 5919", [(0, 12, "943 476 5919")]),
    ("UK_NHS_NUMBER", "943-476-5918", []),
    ("UK_NHS_NUMBER", "0000000000", [(0, 10, "0000000000")]),
    ("CREDIT_CARD", "no 4111 1111 1111 1111", [(3, 22, "4111 1111 1111 1111")]),
    ("CREDIT_CARD", "4111 1111 1111 1112", []),
    ("CREDIT_CARD", "0000 0000 0000 0000", []),
    ("IBAN", "GB82WEST12345698765432", [(0, 22, "GB82WEST12345698765432")]),
    ("IBAN", "GB82WEST12345698765431", []),
    ("IBAN", "DE8937040044050513100000", [(0, 24, "DE8937040044050513100000")]),
    ("IP_ADDRESS_V4", "from 10.0.0.1.", [(5, 13, "10.0.0.1")]),
    ("IP_ADDRESS_V4", "10.0.0.1 or 10.0.0.0/8", [(12, 22, "10.0.0.0/8")]),
    ("IP_ADDRESS_V4", "256.1.1.1", []),
    ("IP_ADDRESS_V6", "é ::1", [(3, 6, "::1")]),
    ("IP_ADDRESS_V6", "x::12 ::1", [(1, 4, "::1")]),
    ("IP_ADDRESS_V6", "2001:db8:0:1:0:0:0:1", [(0, 20, "2001:db8:0:1:0:0:0:1")]),
    ("IP_ADDRESS_V6", "at 12:34", [(3, 8, "12:34")]),
    ("IP_ADDRESS_V6", "1:2", []),
    ("IP_ADDRESS_V6", "fe80::/10", [(0, 9, "fe80::/10")]),
    ("IP_ADDRESS_V6", "é ::/64", [(3, 8, "::/64")]),
    ("IP_ADDRESS_V6", "::/x", []),
    ("IP_ADDRESS_V6", "::", [(0, 2, "::")]),
    ("DATE_OF_BIRTH", "1990-02-28", [(0, 10, "1990-02-28")]),
    ("DATE_OF_BIRTH", "1990-02-29", []),
    ("DATE_OF_BIRTH", "0000-02-29", [(0, 10, "0000-02-29")]),
    ("DATE_OF_BIRTH", "31/12/1999 12/31/1999", [(0, 10, "31/12/1999"), (11, 21, "12/31/1999")]),
    ("DATE_OF_BIRTH", "1/2/1999 1-2-1999", [(0, 8, "1/2/1999")]),
    ("DATE_OF_BIRTH", "01/02/99", []),
    ("DATE_OF_BIRTH", "31-feb-2000", [(0, 11, "31-feb-2000")]),
    ("DATE_OF_BIRTH", "1-Jan-1899 1-Foo-2000", []),
    ("US_SSN", "123-45-6789 123456789", [(0, 11, "123-45-6789"), (12, 21, "123456789")]),
    ("US_SSN", "123-456789 666-12-3456 000-12-3456 123-00-4567 123-45-0000", []),
    ("US_SSN", "078-05-1120 078051120", []),
    ("US_SSN", "078.05.1120", [(0, 11, "078.05.1120")]),
    ("PASSPORT_NUMBER", "A12345678 AB1234567", [(0, 9, "A12345678"), (10, 19, "AB1234567")]),
    ("PASSPORT_NUMBER", "1234567 A1234567", []),
    ("PERSON", "Jo Doe", []),
]


def test_values(spark):
    rows = [(i, text) for i, (_, text, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", raw_spans("t").alias("s"))
    found = {r.i: r.s for r in df.collect()}
    for i, (entity, text, want) in enumerate(CASES):
        got = [(s.start, s.end, s.match) for s in found[i] if s.entity == entity]
        assert sorted(got) == sorted(want), (entity, text, got)


def test_scores_and_names(spark):
    df = spark.createDataFrame([("::/64 A12345678",)], "t string")
    spans = df.select(F.inline(raw_spans("t"))).collect()
    assert {(s.entity, s.score, s.recognizer) for s in spans} == {
        ("IP_ADDRESS_V6", 0.5, "IPv6Recognizer"),
        ("PASSPORT_NUMBER", 0.1, "PassportRecognizer"),
    }


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    assert [r.s for r in df.select(analyze("t").alias("s")).collect()] == [[], []]


def test_best_of_equal_extents(spark):
    """An equal extent keeps the better score, equal scores the first entity by name."""
    df = spark.createDataFrame([("x 123456789 y 943 476 5919",)], "t string")
    spans = df.select(F.inline(analyze("t", min_score=0.1))).collect()
    assert [(s.entity, s.start, s.end) for s in spans] == [
        ("US_SSN", 2, 11),
        ("PHONE_NUMBER", 14, 26),
    ]


def test_own_detector_and_choice(spark):
    own = regex_detector("OrderRecognizer", "ORDER", r"ORD-[0-9]{4}", 0.7, valid=lambda m: f"{m} != 'ORD-0000'")
    df = spark.createDataFrame([(1, "ORD-1234 ORD-0000 jo@example.org")], "id int, t string")
    chosen = choose(["ORDER", "EMAIL_ADDRESS"], add=[own])
    assert [d.name for d in chosen] == ["EmailRecognizer", "OrderRecognizer"]
    got = {(r.entity, r.match) for r in detect(df, ["id"], "t", detectors=chosen).collect()}
    assert got == {("ORDER", "ORD-1234"), ("EMAIL_ADDRESS", "jo@example.org")}
    assert choose(remove=["EmailRecognizer"])[0].name == "PhoneRecognizer"


def test_long_runs_take_linear_time(spark):
    """Neither a long run without an address nor thousands of labels may stall or overflow a task."""
    texts = ["a" * 200_000 + " x@y", "u@" + ".".join(["ab"] * 50_000), "1-" * 100_000, "0" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    sizes = [r.n for r in df.select(F.size(analyze("t")).alias("n")).collect()]
    assert sizes[:2] == [0, 1]


def test_many_hits_in_one_text(spark):
    df = spark.createDataFrame([(" ".join(f"u{i}@example.org" for i in range(3000)),)], "t string")
    spans = df.select(analyze("t").alias("s")).first().s
    assert len(spans) == 3000 and spans[-1].match == "u2999@example.org"
    text = df.select(anonymise_text("t")["text"].alias("t")).first().t
    assert text == " ".join(["<redacted: EMAIL_ADDRESS>"] * 3000)


def _random_texts(n=3000):
    rng = random.Random(7)
    pieces = [
        "0", "1", "2", "07", "+44", "+1", "12", "345", "6789", "123456789", "-", "-", ".", "/", " ", " ", ":",
        "::", "::1", "::/", "@", "a", "AB", "GB82", "x.y", "Jan", "FEB", "(212)", "é", "fe80", "10.0.0.1",
        "1999", "31", "SW1A", "1AA", "\n", "\t", "_", "ab12", "4111",
    ]
    texts = []
    for _ in range(n):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        # a text that opens with a phone number is cut by bytes; the second formulation cuts characters
        head, tail = text[:16].replace("é", "e"), text[16:]
        texts.append(head + tail)
    return texts


@pytest.mark.parametrize("mode", ["reference", "safe"])
def test_random_texts_against_second_formulation(spark, mode):
    texts = _random_texts()
    df = spark.createDataFrame([("t", str(i), t) for i, t in enumerate(texts)], "src string, id string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE texts (src VARCHAR, id VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO texts VALUES ('t', ?, ?)", [(str(i), t) for i, t in enumerate(texts)])
    columns = "id, entity, start, end, match, score, recognizer".split(", ")
    got = {tuple(r) for r in df.select("id", F.inline(raw_spans("text", mode=mode))).select(*columns).collect()}
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = set(con.execute(f"SELECT {quoted} FROM ({second.all_spans('texts', mode)})").fetchall())
    assert got == want
    treated = df.select("id", anonymise_text("text", mode=mode)["text"].alias("t"))
    sql = (
        f"WITH RECURSIVE raw AS MATERIALIZED ({second.all_spans('texts', mode)}),"
        f" best AS MATERIALIZED ({second.merged('raw')}),"
        + (second.joined_ctes("best", "texts") if mode == "safe" else second.kept_ctes("best"))
        + second.spliced("texts", "'<redacted: ' || en || '>'").replace("SELECT t.src, t.id", " SELECT t.id", 1)
    )
    assert dict(treated.collect()) == dict(con.execute(sql).fetchall())


def test_gates_never_hide_a_hit(spark):
    """A detector without its gate finds the same."""
    from dataclasses import replace

    open_gates = [replace(d, gate=None, digits=False) for d in DETECTORS if d.entity != "PERSON"]
    texts = _random_texts(1500) + [t for _, t, _ in CASES]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    both = df.select(
        F.array_sort(raw_spans("t", mode=SAFE)).alias("gated"),
        F.array_sort(raw_spans("t", open_gates, mode=SAFE)).alias("open"),
    )
    assert both.filter("NOT gated <=> open").count() == 0


def test_analyze_columns_boost(spark):
    rows = [(f"P{i:08d}", "x" if i else "A12345678") for i in range(10)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = {(r.column_name, r.entity): r for r in analyze_columns(df, ["a", "b"]).collect()}
    assert got["a", "PASSPORT_NUMBER"].score == 0.8 and got["a", "PASSPORT_NUMBER"].hits == 10
    assert ("b", "PASSPORT_NUMBER") not in got
    assert analyze_columns(df, ["a"], boost=False).count() == 0


def test_profile_counts_rows_once(spark):
    rows = [("s1", "a@example.org b@example.org"), ("s1", "none"), ("s2", "1.2.3.4")]
    df = spark.createDataFrame(rows, "source string, t string")
    got = {(r.source, r.entity): (r.hits, r.rows_hit, r.n_rows, r.share) for r in entity_profile(df, "t", ["source"]).collect()}
    assert got == {("s1", "EMAIL_ADDRESS"): (2, 1, 2, 0.5), ("s2", "IP_ADDRESS_V4"): (1, 1, 1, 1.0)}


def test_texts_with_the_mark_of_the_cutter(spark):
    """A text that holds the character which stands for matches has the same spans."""
    texts = ["\u0001 a@b.co\u0001 07123456789 \u0001\u0001é c@d.co", "a@b.co", "\u0001", "é a@b.co, c@d.co é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    hits = detect(rows, ["id"], "text", ["EMAIL_ADDRESS"]).collect()
    found = sorted((r.id, r.start, r.end, r.match) for r in hits)
    assert found == [
        (0, 2, 8, "a@b.co"), (0, 27, 33, "c@d.co"),
        (1, 0, 6, "a@b.co"), (3, 3, 9, "a@b.co"), (3, 11, 17, "c@d.co"),
    ]
