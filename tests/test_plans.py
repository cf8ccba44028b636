"""Plans: nothing leaves the JVM, nothing is shuffled or read without need."""

import re

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from checks.views import view
from veilspark.functions.texts import anonymise_text
from veilspark.operators import detect as D
from veilspark.operators import keys as K
from veilspark.plans import tables as P
from veilspark.sources import guard
from veilspark.sources.tables import scan_table


USERS_PYTHON = {"detect_batches", "treat_custom_batches"}  # queries of which a user's Python function is the point


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES)))
def test_no_python_and_no_cross_join(spark, folder, key):
    plan = plan_of(QUERIES[key](spark, folder))
    python = ("PythonUDF", "ArrowEvalPython", "MapInPandas")
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", *(() if key in USERS_PYTHON else python)):
        assert bad not in plan, bad


def test_detection_and_treatment_are_narrow(spark, folder):
    documents = scan_table(spark, "documents", folder)
    jobs = [
        D.detect(documents, ["doc_id"], "text"),
        D.analyze_texts(documents, ["doc_id"], "text"),
        documents.select("doc_id", anonymise_text("text")),
        P.treat_table(documents, P.decide(documents, order_by=["doc_id"])),
    ]
    for job in jobs:
        assert "Exchange" not in plan_of(job)
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(jobs[0]))) == {"doc_id:bigint,text:string"}


def test_spans_are_computed_once(spark, folder):
    """Using several fields of the result must not repeat the search."""
    documents = scan_table(spark, "documents", folder)
    treated = documents.select(anonymise_text("text").alias("t"))
    single = plan_of(treated).count("'EmailRecognizer'") or plan_of(treated).count("EmailRecognizer")
    several = plan_of(treated.select("t.text", "t.report.treatment", "t.report.detected"))
    assert several.count("EmailRecognizer") == single


def test_guarded_read_is_a_top_k(spark, folder):
    scan_table(spark, "orders", folder).createOrReplaceTempView("orders")
    df = guard.guarded_select(
        spark, "SELECT o_orderkey FROM orders WHERE o_custkey = :c", {"c": 7}, order_by=["o_orderkey"]
    )
    plan = plan_of(df)
    assert "TakeOrderedAndProject" in plan and "EqualTo(o_custkey,7)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_orphans_are_counted_before_the_join(spark, folder):
    orders, customers = scan_table(spark, "orders", folder), scan_table(spark, "customer", folder)
    plan = plan_of(K.fk_violations(orders, ["o_custkey"], customers, ["c_custkey"]))
    child = plan[: plan.index("c_custkey:bigint")]
    assert plan.index("LeftOuter") < plan.index("partial_count") < child.rindex("o_custkey:bigint")
    assert "ReadSchema: struct<o_custkey:bigint>" in plan and "ReadSchema: struct<c_custkey:bigint>" in plan


def test_profile_shuffles_groups_only(spark, folder):
    documents = scan_table(spark, "documents", folder)
    plan = plan_of(D.entity_profile(documents, "text", ["source"]))
    # partial counts are below the first exchange, so a hot source does not weigh on one task
    assert plan.rindex("partial_sum") > plan.rindex("Exchange hashpartitioning")


def test_settled_columns_are_not_scanned(spark, folder):
    contacts = view(spark, folder, "contacts")
    hits = D.column_hits(contacts, ["ref_card", "ref_iban"])
    assert "cont_email" not in plan_of(hits) and "c_acctbal" not in plan_of(hits)


def test_sketches_read_their_columns_only(spark, folder):
    plan = plan_of(K.sketched(scan_table(spark, "orders", folder), ["o_orderkey", "o_totalprice"]))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"o_orderkey:bigint,o_totalprice:double"}


def test_filter_reaches_the_scan_through_treatment(spark, folder):
    customers = scan_table(spark, "customer", folder)
    treated = P.treat_table(customers, P.decide(customers, order_by=["c_custkey"]))
    assert "GreaterThan(c_custkey,10)" in plan_of(treated.filter(F.col("c_custkey") > 10))


def test_column_hits_keep_sums_not_rows(spark, folder):
    """The least of a struct would make the aggregate sort all values of a task."""
    contacts = view(spark, folder, "contacts")
    assert "SortAggregate" not in plan_of(D.column_hits(contacts, ["cont_email", "ref_card"]))


def test_lead_is_the_first_then_the_longest(spark):
    values = [("x 12/12/2001",), ("10.0.0.1/24 é 10.0.0.2",), ("zz 10.0.0.1",), (None,), ("",)]
    hits = D.column_hits(spark.createDataFrame(values, "v string"), ["v"])
    found = {r.entity: (r.hits, r.heads, r.lead and tuple(r.lead)) for r in hits.collect()}
    assert found == {None: (1, 1, None), "DATE_OF_BIRTH": (1, 1, (2, -12)), "IP_ADDRESS_V4": (2, 2, (0, -11))}
    assert hits.schema["lead"].dataType.simpleString() == "struct<start:int,neg_end:int>"


def test_one_row_group_is_searched_by_all_cores(spark, folder):
    for name in ("contacts", "notes", "variants"):
        assert view(spark, folder, name).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_column_hits_search_texts_in_a_compiled_step(spark, folder):
    """A generator is interpreted with all that it holds, so only what was found may be left in it."""
    hits = D.column_hits(view(spark, folder, "contacts"), ["cont_email", "ref_card"])
    generators = [line for line in plan_of(hits).splitlines() if "Generate posexplode" in line]
    assert generators and not any("RLIKE" in line for line in generators)


def test_hits_of_values_with_one_and_with_several_matches(spark):
    values = ["é a@b.co $1", "a@b.co, é c@d.co $0 x\u0001", "a@b.co 10.0.0.1 \\", "z 1.2.3.4", "none", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    found = {r.entity: (r.hits, r.heads, r.score, r.lead and tuple(r.lead)) for r in D.column_hits(df, ["v"]).collect()}
    assert found == {
        None: (1, 1, None, None),
        "EMAIL_ADDRESS": (3, 3, 0.85, (0, -6)),
        "IP_ADDRESS_V4": (2, 1, 0.85, (2, -9)),
    }
