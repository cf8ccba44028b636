"""Treatments of values, texts and tables."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from checks.views import view
from veilspark.functions import treatments as R
from veilspark.functions.detectors import SAFE, analyze
from veilspark.functions.texts import anonymise_text, anonymise_value, anonymise_value_report, truncate_text
from veilspark.plans import reads
from veilspark.plans import tables as P

KEY = bytes(range(32))
OTHER = bytes(range(64))


def one(spark, value, treatment, entity="EMAIL_ADDRESS"):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(treatment.apply(F.col("v"), F.lit(entity)).alias("r")).first().r


def test_simple_treatments(spark):
    assert one(spark, "jo@example.org", R.redact()) == "<redacted: EMAIL_ADDRESS>"
    assert one(spark, "jo", R.replace()) == "[REPLACED]"
    assert one(spark, "jo", R.replace("")) == "[REPLACED]"
    assert one(spark, "jo", R.replace("x")) == "x"
    assert one(spark, "jo", R.custom()) == "jo"
    assert one(spark, "jo", R.custom(lambda v, e: F.concat(e, F.upper(v)))) == "EMAIL_ADDRESSJO"
    assert one(spark, "jo", R.hash_with(None)) == "[hash requires HMAC key]"
    assert one(spark, "jo", R.pseudonymise(None)) == "[pseudonymise requires key]"


@pytest.mark.parametrize(
    "value, keep, want",
    [
        ("12345678", 4, "****5678"),
        ("1234", 4, "****"),
        ("", 4, ""),
        ("123", 4, "***"),
        ("éèêëabcd", 2, "******cd"),
        ("12345678", 0, "****5678"),
    ],
)
def test_mask(spark, value, keep, want):
    assert one(spark, value, R.mask(keep)) == want


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"long" * 40])
def test_hash_is_hmac(spark, key):
    for value in ("jo@example.org", "", "é"):
        want = hmac.new(key, value.encode(), hashlib.sha256).hexdigest()
        assert one(spark, value, R.hash_with(key)) == want


@pytest.mark.parametrize("key", [KEY, OTHER])
def test_tokens(spark, key):
    values = ["jo@example.org", "é", "x" * 1000, "jo@example.org", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    tokens = df.withColumn("t", R.pseudonymise(key).apply(F.col("v"), F.lit("")))
    opened = tokens.withColumn("d", R.detokenise(F.col("t"), key)).orderBy("i").collect()
    assert [r.d.value for r in opened[:4]] == values[:4]
    assert opened[0].t == opened[3].t and opened[0].t.startswith("pii:")
    assert opened[4].t == ""  # an empty value stays as it is


def test_bad_tokens(spark):
    good = one(spark, "jo", R.pseudonymise(KEY))
    foreign = one(spark, "jo", R.pseudonymise(bytes(32)))
    changed = good[:-1] + ("0" if good[-1] != "0" else "1")
    df = spark.createDataFrame(
        [(good,), (foreign,), (changed,), ("pii:xyz",), ("pii:",), ("jo",), ("pii:00",), (None,)], "t string"
    )
    got = [r.d for r in df.select(R.detokenise(F.col("t"), KEY).alias("d")).collect()]
    wrong = "wrong key or changed token"
    assert [d.value for d in got] == ["jo"] + [None] * 7
    assert [d.error for d in got] == [
        None, wrong, wrong, "invalid token encoding", "invalid token encoding", "not a token", wrong, None,
    ]
    no_key = df.select(R.detokenise(F.col("t"), None).alias("d")).first().d
    assert no_key.error == "no key"
    with pytest.raises(ValueError):
        R.pseudonymise(b"short")
    with pytest.raises(ValueError, match="not a token"):
        reads.open_token(spark, "jo", KEY)


def test_two_users_share_tokens_only_with_one_key(spark):
    assert one(spark, "jo", R.pseudonymise(KEY)) == one(spark, "jo", R.pseudonymise(KEY))
    assert one(spark, "jo", R.pseudonymise(KEY)) != one(spark, "jo", R.pseudonymise(OTHER))


def test_treatment_map():
    chosen = R.TreatmentMap.from_config("mask", {"email_address": "hash"}, b"k")
    assert chosen.of("EMAIL_ADDRESS").name == "hash" and chosen.of("IBAN").name == "mask"
    with pytest.raises(ValueError):
        R.TreatmentMap.from_config("shred")


def treated(spark, text, **options):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(anonymise_text("t", **options).alias("a")).first().a


def test_text(spark):
    a = treated(spark, "é jo@example.org or 10.0.0.1, é")
    assert a.text == "é <redacted: EMAIL_ADDRESS> or <redacted: IP_ADDRESS_V4>, é"
    assert a.report.detected and a.report.treatment == "redacted" and len(a.report.entities) == 2
    untouched = treated(spark, "nothing é")
    assert untouched.text == "nothing é" and untouched.report.treatment == "none"
    assert treated(spark, None).text is None


def test_text_kinds(spark):
    chosen = R.TreatmentMap(R.redact(), {"EMAIL_ADDRESS": R.mask()})
    a = treated(spark, "jo@example.org 10.0.0.1", treatments=chosen)
    assert a.text == "**********.org <redacted: IP_ADDRESS_V4>" and a.report.treatment == "masked,redacted"


def test_long_text_is_withheld(spark):
    long = "x" * 600 + " jo@example.org"
    a = treated(spark, long, withhold_over=512)
    assert a.text == "<content truncated and redacted>"
    assert (a.report.treatment, a.report.original_length, a.report.truncated_at) == (
        "truncated_and_redacted",
        615,
        512,
    )
    assert treated(spark, "x" * 600, withhold_over=512).text == "x" * 600
    assert treated(spark, long).text == "x" * 600 + " <redacted: EMAIL_ADDRESS>"


def test_leading_phone_is_covered_whole(spark):
    assert treated(spark, "+44 7700 900123 now").text == "<redacted: PHONE_NUMBER> now"
    cut = treated(spark, "+44 7700 900123 now", mode="reference").text
    assert cut == "<redacted: PHONE_NUMBER>23 now"
    both = treated(spark, "10.0.0.0/8 and 10.1.1.1").text
    assert both == "<redacted: IP_ADDRESS_V4> and <redacted: IP_ADDRESS_V4>"


def test_no_span_is_left_after_redaction(spark, folder):
    corpus = view(spark, folder, "corpus")
    clean = corpus.select(anonymise_text("text")["text"].alias("t"))
    assert clean.count() == corpus.count()
    left = clean.select(F.explode(analyze("t", mode=SAFE)).alias("s")).select("s.*")
    assert left.count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("call (212)5551234.john.smith@example.com now", "call <redacted: EMAIL_ADDRESS> now"),
        ("a GB82WEST12345698765432 b", "a <redacted: IBAN> b"),
        ("x jo@example.org, 10.0.0.1 y", "x <redacted: EMAIL_ADDRESS>, <redacted: IP_ADDRESS_V4> y"),
    ],
)
def test_overlapping_spans_are_one(spark, text, want):
    assert treated(spark, text).text == want


def test_values(spark):
    df = spark.createDataFrame([("jo", "PERSON"), (None, "PERSON"), ("x", None)], "v string, e string")
    rows = df.select(
        anonymise_value(F.col("v"), F.col("e")).alias("v"),
        anonymise_value_report(F.col("v"), F.col("e")).alias("r"),
    ).collect()
    assert [r.v for r in rows] == ["<redacted: PERSON>", None, "x"]
    assert rows[0].r.entities[0].recognizer == "direct" and rows[0].r.entities[0].score == 1.0
    assert [r.r.detected for r in rows] == [True, False, False]
    assert df.select(truncate_text(F.lit("é" * 10), 15).alias("t")).first().t == "<content truncated at 15>"


# --- whole tables -------------------------------------------------------------------------------
def people(spark):
    rows = [
        (i, f"Jo{i}", f"jo{i}@example.org", f"row {i}", f"P{i:08d}", bytearray(b"x"), {"ip": f"10.0.0.{i}"})
        for i in range(30)
    ]
    kind = "id int, first_name string, col_a string, memo string, code string, raw binary, extra map<string,string>"
    return spark.createDataFrame(rows, kind)


def test_process_table(spark):
    treated_rows, report = P.process_table(people(spark), order_by=["id"])
    got = {r.column_name: r for r in report.collect()}
    assert got["first_name"].source == "name_heuristic" and got["first_name"].entities == ["PERSON"]
    assert got["col_a"].source == "value_scan" and got["col_a"].entities == ["EMAIL_ADDRESS"]
    assert got["memo"].source == "none" and got["memo"].treatment == "none"
    assert (got["code"].entities, got["code"].confidence) == (["PASSPORT_NUMBER"], 0.8)
    assert got["raw"].source == "opaque_type" and got["raw"].treatment == "stripped"
    assert got["id"].scan_policy == "safe"
    row = treated_rows.filter("id = 3").first()
    assert row.first_name == "<redacted: PERSON>" and row.memo == "row 3"
    assert row.raw == "<binary data removed>" and row.extra == "<redacted: IP_ADDRESS_V4>"
    assert treated_rows.count() == 30


def test_json_text(spark):
    treated_rows, report = P.process_table(P.with_json_text(people(spark)), order_by=["id"])
    assert {r.column_name: r.source for r in report.collect()}["extra"] == "value_scan"
    assert treated_rows.filter("id = 3").first().extra == "<redacted: IP_ADDRESS_V4>"


def test_policies_beat_hints(spark):
    policies = {"memo": P.ColumnPolicy(forced=True), "id": P.ColumnPolicy("deny")}
    chosen = R.TreatmentMap(R.mask())
    treated_rows, report = P.process_table(people(spark), policies=policies, order_by=["id"], treatments=chosen)
    got = {r.column_name: r for r in report.collect()}
    assert (got["memo"].source, got["memo"].confidence, got["memo"].treatment) == ("static_policy", 1.0, "masked")
    assert got["id"].treatment == "stripped" and got["col_a"].treatment == "masked"
    assert {r.id for r in treated_rows.select("id").collect()} == {"<access denied>"}


def test_given_hints(spark):
    _, report = P.process_table(people(spark), hints={"col_a": "full", "memo": "name_only"}, order_by=["id"])
    got = {r.column_name: r for r in report.collect()}
    assert got["col_a"].detected and got["first_name"].detected and got["memo"].treatment == "none"


def test_names_alone_are_treated(spark):
    df = spark.createDataFrame([("Bob", "1 High St", "London")], "cust_last_name string, home_address_line1 string, city string")
    df = df.withColumn("dob", F.to_date(F.lit("1980-01-02")))
    row, report = P.process_table(df)
    assert row.first() == ("<redacted: PERSON>", "<redacted: UK_POSTCODE>", "<redacted: UK_POSTCODE>", None)
    assert {r.column_name: r.treatment for r in report.collect()}["dob"] == "nulled"


def test_no_detectable_span_is_left_in_any_column(spark, folder):
    """Columns renamed to say nothing: what the detectors can find is found in all rows, not in the first."""
    contacts = view(spark, folder, "contacts")
    notes = view(spark, folder, "notes")
    for df in (contacts, notes):
        plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        treated_rows, _ = P.process_table(plain)
        texts = [c for c, kind in treated_rows.dtypes if kind == "string"]
        left = treated_rows.select(F.explode(F.array(*texts)).alias("t")).select(F.explode(analyze("t", mode=SAFE)))
        assert left.count() == 0


def test_lineage_and_result_columns(spark, folder):
    contacts = view(spark, folder, "contacts")
    contacts.createOrReplaceTempView("contacts")
    sql = "SELECT cont_firstname || '!' AS a, lower(cont_email) AS cont_id, count(*) AS n FROM contacts GROUP BY ALL"
    names = reads.lineage(spark.sql(sql))
    assert names["a"][0] == "cont_firstname" and names["cont_id"][0] == "cont_email"
    rows, _ = reads.treated_select(spark, sql, max_rows=5, tables={"contacts": contacts})
    assert {(r.a, r.cont_id, r.n) for r in rows.collect()} == {("<redacted: PERSON>", "<redacted: EMAIL_ADDRESS>", 1)}


def test_tokens_join_without_pairs_of_defaults(spark):
    left = spark.createDataFrame([("", 1)] * 50 + [(None, 1)] * 50 + [("t1", 1), ("t1", 2)], "k string, a int")
    right = spark.createDataFrame([("", 9)] * 50 + [("t1", 7)], "k string, b int")
    assert sorted(tuple(r) for r in reads.token_join(left, right, ["k"]).collect()) == [("t1", 1, 7), ("t1", 2, 7)]
    with pytest.raises(Exception, match="several rows"):
        reads.token_join(left, right.union(right), ["k"]).collect()


def test_sample_and_full_scan(spark):
    rows = [(i, "jo@example.org" if i == 25 else "x") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, v string")
    assert not P.decide(df, sample=20, order_by=["id"])["v"].detected
    assert P.decide(df, sample=20, order_by=["id"])["v"].sampled_rows == 20
    assert P.decide(df)["v"].entities == ("EMAIL_ADDRESS",) and P.decide(df)["v"].sampled_rows is None


def test_sample_is_the_first_rows_by_key(spark):
    keys = [5, None, 3, None, 9, 3, 1]
    df = spark.createDataFrame([(k, f"v{i}") for i, k in enumerate(keys)], "k int, v string")
    for n, want in ((1, [None]), (2, [None, None]), (4, [None, None, 1, 3]), (20, [None, None, 1, 3, 3, 5, 9])):
        assert [r.k for r in P.table_sample(df, ["k"], n).collect()] == want
    text = spark.createDataFrame([("a'b", 1), ("a", 2)], "k string, v int")
    assert [r.v for r in P.table_sample(text, ["k"], 2).collect()] == [2, 1]


def test_empty_table(spark):
    treated_rows, report = P.process_table(people(spark).limit(0), order_by=["id"])
    assert treated_rows.count() == 0 and report.count() == 7


def test_treated_select_without_known_table(spark, folder):
    view(spark, folder, "contacts").createOrReplaceTempView("contacts")
    rows, report = reads.treated_select(
        spark,
        "WITH c AS (SELECT cont_id, cont_firstname AS who_name, cont_email FROM contacts) SELECT * FROM c",
        max_rows=5,
        order_by=["cont_id"],
    )
    got = {r.column_name: (r.scan_policy, r.source) for r in report.collect()}
    assert got["who_name"] == ("name_only", "name_heuristic") and got["cont_email"] == ("full", "name_heuristic")
    assert rows.count() == 5


def test_pandas_treatment_of_whole_columns(spark):
    import pandas as pd

    @F.pandas_udf("string")
    def turned(values: pd.Series) -> pd.Series:
        return values.str[::-1]

    chosen = R.TreatmentMap(R.custom(lambda value, entity: turned(value)))
    treated_rows, _ = P.process_table(people(spark), order_by=["id"], treatments=chosen)
    assert treated_rows.filter("id = 3").first().col_a == "gro.elpmaxe@3oj"
