"""Statistics per file, distinct values, samples of groups, ways between tables, decisions that run along a stream."""

import os

import pytest
from pyspark.sql import functions as F

from veilspark.operators import statistics as ST
from veilspark.operators.detect import entity_values
from veilspark.operators.keys import related_paths
from veilspark.plans.tables import sample_groups
from veilspark.streaming import treat as S


def _files(folder):
    return sorted(f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet"))


@pytest.fixture
def numbers(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).selectExpr(
        "id", "if(id % 10 = 0, NULL, id % 7) AS few", "-id / 4 AS real", "concat('v', id) AS text", "date_add('2020-01-01', CAST(id AS int)) AS day",
        "array(id) AS many", "id % 2 = 0 AS even", "CAST('x' AS binary) AS raw", "repeat('y', 5000) AS `long ``text`",
    )
    rows.coalesce(1).write.parquet(path)
    return rows, path


def test_statistics_of_a_new_file_alone_are_read(spark, numbers, tmp_path):
    rows, path = numbers
    state, (old,) = str(tmp_path / "s"), _files(path)
    assert len(ST.refresh_statistics(spark, path, state)) == 1
    assert ST.refresh_statistics(spark, path, state) == []
    # what is known is not opened again: its content is no Parquet any more, its time stays
    stat, content = os.stat(old), open(old, "rb").read()
    with open(old, "wb") as f:
        f.write(b"x" * len(content))
    os.utime(old, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    rows.withColumn("id", F.col("id") + 500).coalesce(1).write.mode("append").parquet(path)
    read = ST.refresh_statistics(spark, path, state, rows.schema)
    assert len(read) == 1 and os.path.basename(old) not in read[0]
    got = {r.column_name: r for r in ST.merged_statistics(spark, path, state, rows.schema).collect()}
    assert [got["id"][c] for c in ("n_rows", "n_nulls", "low_whole", "high_whole")] == [2000, 0, 0, 1499]
    assert abs(got["id"].n_distinct - 1500) < 75 and got["few"].n_distinct == 7 and got["few"].n_nulls == 200
    assert (got["real"].low_real, got["real"].high_real) == (-249.75, 0.0) and str(got["real"].high_real) == "0.0"
    assert (got["text"].low_text, got["text"].high_text, got["day"].low_text) == ("v0", "v999", "2020-01-01")
    assert got["many"].n_distinct is None and got["even"].high_whole == 1 and got["raw"].n_distinct == 1
    assert got["long `text"].n_rows == 2000 and len(got["long `text"].low_text) == 5000


def test_statistics_forget_files_that_are_gone_or_changed(spark, numbers, tmp_path):
    rows, path = numbers
    state = str(tmp_path / "s")
    ST.refresh_statistics(spark, path, state)
    spark.read.parquet(state).coalesce(1).write.mode("append").parquet(state)  # a refresh done twice counts once
    rows.limit(10).coalesce(1).write.mode("append").parquet(path)
    ST.refresh_statistics(spark, path, state)
    total = lambda: ST.merged_statistics(spark, path, state, rows.schema).filter("column_name = 'id'").first().n_rows
    assert total() == 1010
    rows.limit(3).coalesce(1).write.mode("overwrite").parquet(path)
    assert total() == 0  # nothing of the present files is known yet
    ST.refresh_statistics(spark, path, state)
    assert total() == 3


def test_statistics_of_an_empty_table(spark, tmp_path):
    path, state = str(tmp_path / "t"), str(tmp_path / "s")
    spark.createDataFrame([], "a int, b array<int>").write.parquet(path)
    ST.refresh_statistics(spark, path, state)
    rows = ST.merged_statistics(spark, path, state).orderBy("position").collect()
    assert [(r.column_name, r.n_rows, r.n_distinct, r.low_whole) for r in rows] == [("a", 0, 0, None), ("b", 0, None, None)]


def _texts(spark):
    rows = [("a", "x", "mail ann@example.com and bob@example.com"), ("a", "y", "ann@example.com"), ("b", None, "ann@example.com"), ("b", "x", None), ("b", "x", "")]
    return spark.createDataFrame(rows, "source string, lang string, text string")


@pytest.mark.parametrize("sketch", [False, True])
def test_distinct_values_per_level(spark, sketch):
    got = entity_values(_texts(spark), "text", ["source", "lang"], cube=True, sketch=sketch)
    found = {(r.source, r.lang, r.level): r.n_distinct for r in got.filter("entity = 'EMAIL_ADDRESS'").collect()}
    assert found == {
        ("a", "x", 0): 2, ("a", "y", 0): 1, ("b", None, 0): 1, ("a", None, 1): 2, ("b", None, 1): 1,
        (None, "x", 2): 2, (None, "y", 2): 1, (None, None, 2): 1, (None, None, 3): 2,
    }


def test_distinct_values_expand_after_the_first_aggregate(spark):
    plan = entity_values(_texts(spark), "text", ["source"], cube=True)._jdf.queryExecution().optimizedPlan().toString()
    levels = plan.index("Generate explode(")
    assert "Aggregate" in plan[levels:] and plan.count("Generate inline") + plan.count("inline(") >= 1


def test_sample_of_groups(spark):
    rows = spark.range(1000).selectExpr("id", "if(id < 900, 'hot', if(id < 998, NULL, 'two')) AS g", "repeat('z', 100) AS wide")
    rows = rows.unionByName(spark.createDataFrame([(None, "hot", "no key")], "id long, g string, wide string"))
    taken = sample_groups(rows, ["g"], ["id"], 5, "s")
    assert {r.g: r["count"] for r in taken.groupBy("g").count().collect()} == {"hot": 5, None: 5, "two": 2}
    ids = {r.id for r in taken.collect()}
    assert ids == {r.id for r in sample_groups(rows.repartition(7), ["g"], ["id"], 5, "s").collect()}
    assert ids != {r.id for r in sample_groups(rows, ["g"], ["id"], 5, "t").collect()}
    plan = taken._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert sample_groups(rows.limit(0), ["g"], ["id"]).count() == 0


def test_ways_between_tables(spark):
    # a refers to b and c, both to d, d back to a and on to e, e to f; f to itself
    pairs = ["ab", "ac", "bd", "cd", "da", "de", "ef", "ff", "za", "ab"]
    edges = spark.createDataFrame([(p[0], p[1]) for p in pairs], "child_table string, parent_table string")
    got = {(r.relation, r.table_name): (r.depth, r.path) for r in related_paths(edges, "a", 3).collect()}
    up = {t: way for (relation, t), way in got.items() if relation == "references"}
    assert up == {"b": (1, "a > b"), "c": (1, "a > c"), "d": (2, "a > b > d"), "e": (3, "a > b > d > e")}
    down = {t: way[0] for (relation, t), way in got.items() if relation == "referenced_by"}
    assert down == {"d": 1, "z": 1, "b": 2, "c": 2}
    assert related_paths(edges, "unknown").count() == 0


def _stream(spark, place, parts):
    schema = "id int, remark string"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{place}/in")
    rows = S.read_files(spark, f"{place}/in", schema, options={"maxFilesPerTrigger": "1"})
    S.running_writer(rows, f"{place}/out", f"{place}/checkpoint", f"{place}/state").awaitTermination()
    return {r.id: r.remark for r in spark.read.parquet(f"{place}/out").collect()}


def test_running_decisions_are_never_weaker(spark, tmp_path):
    none, mail = [(i, "none") for i in range(5)], [(i, f"u{i}@example.com") for i in range(10, 13)]
    got = _stream(spark, tmp_path, [none, mail])
    assert all(got[i] == "none" for i in range(5)) and all(got[i] == "<redacted: EMAIL_ADDRESS>" for i in range(10, 13))
    # a restart: many values without a hit, then a null and another kind of hit
    got = _stream(spark, tmp_path, [[(i, "none") for i in range(20, 60)], [(70, None), (71, "call 192.168.10.20")]])
    assert all(got[i] == "<redacted: EMAIL_ADDRESS>" for i in (*range(20, 60), 71)) and got[70] is None
    assert len(got) == 5 + 3 + 40 + 2


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    scan = lambda n, rows: S._running_scan(spark, str(tmp_path), n, None, 0.5)(spark.createDataFrame(rows, "c string"), ["c"]).collect()
    scan(0, [("ann@example.com",)])
    first = scan(1, [("bob@example.com",), ("x",)])
    again = scan(1, [("bob@example.com",), ("x",)])
    assert first == again and [(r.entity, r.hits, r.n_values) for r in again][0] == ("EMAIL_ADDRESS", 2, 3)
