"""Arrow-batch recognizers and treatments, entities from a dictionary table."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import names as N
from veilspark.functions.treatments import TreatmentMap, custom_batches
from veilspark.operators.detect import detect_batches


# by value, as the workers cannot import this module
_stars = lambda texts: [[(i, i + 1, 0.9) for i, c in enumerate(t) if c == "*"] for t in texts]


def test_recognizer_of_batches(spark):
    rows = spark.createDataFrame([(1, "é*b*"), (2, None), (3, ""), (4, "none"), (5, "**")], "id int, t string")
    hits = detect_batches(rows, ["id"], "t", _stars, "STAR", "Stars", lambda t: t.contains("*"))
    got = sorted((r.id, r.start, r.end, r.match, r.entity, r.recognizer) for r in hits.collect())
    assert [g[:3] for g in got] == [(1, 2, 3), (1, 4, 5), (5, 0, 1), (5, 1, 2)]
    assert {g[3:] for g in got} == {("*", "STAR", "Stars")}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Contains(")
    assert hits.filter("score > 1").count() == 0 and detect_batches(rows, ["id"], "t", _stars, "S", "S", min_score=1.0).count() == 0


@pytest.mark.parametrize("bad", [lambda texts: [], lambda texts: [[(0, 99, 1.0)] for _ in texts], lambda texts: [[(1, 1, 1.0)] for _ in texts]])
def test_recognizer_that_misbehaves_is_an_error(spark, bad):
    rows = spark.createDataFrame([(1, "abc")], "id int, t string")
    with pytest.raises(Exception, match="hit|lists"):
        detect_batches(rows, ["id"], "t", bad, "S", "S").collect()


def test_treatment_of_batches_leaves_nulls(spark):
    seen_null = lambda v, e: v.map(lambda x: f"{len(x)}") + e.str.slice(0, 1)  # noqa: E731 (len of a null fails)
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id int, v string")
    chosen = TreatmentMap(custom_batches(seen_null))
    got = rows.select("id", chosen.apply(F.col("v"), F.lit("EMAIL")).alias("v"))
    assert {r.id: r.v for r in got.collect()} == {1: "3E", 2: None, 3: "0E"}
    assert rows.filter("v IS NULL").select(chosen.apply(F.col("v"), F.lit("X")).alias("v")).collect()[0].v is None
    with pytest.raises(Exception, match="values for"):
        rows.select(custom_batches(lambda v, e: v[:0]).apply(F.col("v"), F.lit("X"))).collect()


def test_dictionary_of_many_endings(spark):
    big = spark.range(10_000).selectExpr("concat('Code_', id) AS ending", "concat('E', id % 100) AS entity")
    more = spark.createDataFrame([("7", "SHORT"), ("code_7", "A_FIRST"), (None, "X"), ("", "EMPTY"), ("y", None)], "ending string, entity string")
    names = ["my_code_7", "CODE_7", "xcode_7", "mycode_8", "a_code_9999", "", None, "y", "other", "a__code_1"]
    columns = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, column_name string")
    got = [r.column_entity for r in N.dictionary_entities(columns, big.unionByName(more)).orderBy("id").collect()]
    assert got == ["A_FIRST", "A_FIRST", "SHORT", "", "E99", "", "", "", "", "E1"]
    assert N.dictionary_entities(columns, big.limit(0)).filter("column_entity <> ''").count() == 0
    assert N.dictionary_entities(columns, big).columns == ["id", "column_name", "column_entity"]


def test_built_in_dictionary_gives_what_the_rule_gives(spark):
    words = [w for ws in N.ENTITY_NAMES.values() for w in ws]
    names = [f"{front}{w.lower()}" for w in words for front in ("", "x_", "x", "a_b_")] + ["", "_", "name_email_"]
    columns = spark.createDataFrame([(n,) for n in names], "column_name string").withColumn("want", F.expr(N.column_entity("column_name")))
    assert N.dictionary_entities(columns, N.entity_dictionary(spark)).filter("NOT want <=> column_entity").collect() == []
