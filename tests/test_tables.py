"""Reads, writes, catalog, keys and streams on small tables."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from checks.views import view
from veilspark.functions import names as N
from veilspark.operators import catalog as C
from veilspark.operators import composites as M
from veilspark.operators import keys as K
from veilspark.operators import querylog as Q
from veilspark.plans import tables as P
from veilspark.sources import guard, writes
from veilspark.sources.tables import footer_tables, list_tables, scan_table, scan_tables
from veilspark.streaming import treat as S


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(1, "a", 10.0), (2, None, 20.0), (3, "c", None), (4, "a", 40.0)]
    return spark.createDataFrame(rows, "id int, tag string, total double")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- reads --------------------------------------------------------------------------------------
def test_only_queries_are_read(spark):
    for sql in ("DELETE FROM t", "drop table t", "", "EXPLAIN SELECT 1"):
        with pytest.raises(ValueError):
            guard.guarded_select(spark, sql)


def test_cap_and_order(spark):
    assert guard.guarded_select(spark, "SELECT id FROM range(5000)").count() == 100
    with pytest.raises(ValueError, match="1000"):
        guard.guarded_select(spark, "SELECT id FROM range(5000)", max_rows=9999)
    for n, more in ((50, False), (49, True)):
        got = guard.guarded_select(spark, "SELECT id FROM range(50)", max_rows=n, cut_flag="more")
        assert {r.more for r in got.collect()} == {more} and got.count() == n
    got = guard.guarded_select(spark, "SELECT id FROM range(50) -- ROWNUM", max_rows=2, order_by=["id"])
    assert [r.id for r in got.collect()] == [0, 1]
    assert guard.guarded_select(spark, "SELECT 1 AS a, map(1, 2) AS m").count() == 1


@pytest.mark.parametrize(
    "sql",
    [
        "WITH t AS (SELECT 1 AS k) INSERT OVERWRITE DIRECTORY '{path}' USING parquet SELECT * FROM t",
        " /* a */ WITH t AS (SELECT 1 AS k) INSERT OVERWRITE DIRECTORY '{path}' USING parquet SELECT * FROM t",
        "WITH t AS (SELECT 1 AS k) /* b */ INSERT INTO written SELECT * FROM t",
        "WITH t AS (SELECT 1 AS k) FROM t INSERT INTO written SELECT k INSERT INTO written SELECT k + 1",
        "WITH t AS (SELECT 1 AS k) DELETE FROM written",
        "WITH t AS (SELECT 1 AS k) UPDATE written SET k = 1",
        "WITH t AS (SELECT 1 AS k) MERGE INTO written USING t ON written.k = t.k WHEN MATCHED THEN DELETE",
        "FROM range(3) INSERT INTO written SELECT id",
        "SELECT TRANSFORM(id) USING 'touch {path}' AS (a) FROM range(3)",
        "SELECT reflect('java.lang.System', 'currentTimeMillis')",
    ],
)
def test_writes_are_refused_and_leave_nothing(spark, tmp_path, sql):
    path = tmp_path / "out"
    with pytest.raises(ValueError):
        guard.guarded_select(spark, sql.replace("{path}", str(path)))
    assert not path.exists()


def test_unsorted_reads_sort_nothing(spark):
    plan = guard.guarded_select(spark, "SELECT id FROM range(50)")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "TakeOrdered" not in plan


def test_parameters_are_values(spark):
    got = guard.guarded_select(spark, "SELECT :v AS v", {"v": "1' OR '1'='1"})
    assert got.first().v == "1' OR '1'='1"


@pytest.mark.parametrize(
    "sql, want",
    [
        ("select a from app.customer where x", "CUSTOMER"),
        ("SELECT a\nFROM t", "T"),
        ("WITH c AS (SELECT 1 FROM x) SELECT * FROM c", ""),
        ("SELECT 1", ""),
    ],
)
def test_query_table(sql, want):
    assert guard.query_table(sql) == want


def test_scan(spark, folder):
    assert scan_table(spark, "customer", folder, ["c_custkey"]).columns == ["c_custkey"]
    assert "lineitem" in list_tables(spark, folder)
    view(spark, folder, "contacts").createOrReplaceTempView("known")
    assert scan_table(spark, "known").columns[0] == "cont_id"


# --- writes -------------------------------------------------------------------------------------
def test_preview_stores_nothing_and_commit_does(spark, orders, tmp_path):
    change = writes.update(orders, {"tag": "'x'", "total": "total + 1"}, "id > :low", {"low": 2})
    assert rows_of(writes.preview(change)) == [("update", 2, False)]
    path = str(tmp_path / "new")
    assert rows_of(writes.commit(change, path)) == [("update", 2, True)]
    assert rows_of(spark.read.parquet(path)) == [(1, "a", 10.0), (2, None, 20.0), (3, "x", None), (4, "x", 41.0)]
    with pytest.raises(Exception, match="already exists"):
        writes.commit(change, path)
    with pytest.raises(PermissionError):
        writes.commit(change, str(tmp_path / "other"), read_only=True)


def test_insert_appends(spark, orders, tmp_path):
    path = str(tmp_path / "t")
    orders.write.parquet(path)
    extra = spark.createDataFrame([(9, 1.5)], "id long, total double")
    target = spark.read.parquet(path)
    assert rows_of(writes.commit(writes.insert(target, extra), path)) == [("insert", 1, True)]
    assert spark.read.parquet(path).filter("id = 9").first().tag is None
    with pytest.raises(ValueError):
        writes.insert(target, extra.withColumnRenamed("total", "sum"))


def test_unknown_condition_keeps_rows(orders):
    change = writes.delete(orders, "tag = 'a'")
    assert [r[0] for r in rows_of(change.rows)] == [2, 3] and change.affected.first()[0] == 2


def test_merge(spark, orders):
    source = spark.createDataFrame([(1, 11.0), (7, 70.0), (2, None)], "id int, total double")
    change = writes.merge(orders, source, ["id"])
    assert rows_of(change.rows) == [
        (1, "a", 11.0), (2, None, None), (3, "c", None), (4, "a", 40.0), (7, None, 70.0),
    ]
    assert change.affected.first().rows_affected == 3
    with pytest.raises(Exception, match="several rows"):
        writes.merge(orders, source.union(source), ["id"]).rows.collect()


def test_parameters_in_assignments(orders):
    change = writes.update(orders, {"tag": ":new"}, "id = :id", {"new": "it's", "id": 2})
    assert rows_of(change.rows)[1] == (2, "it's", 20.0) and change.affected.first()[0] == 1


# --- catalog and keys ---------------------------------------------------------------------------
def test_names(spark):
    cases = [
        # name, type, pii, entity, policy, hint entity, name hint
        ("CONT_FIRSTNAME", "VARCHAR2(10)", True, "PERSON", "name_only", "PERSON", "PERSON"),
        ("BIRTHNAMES", "VARCHAR2(10)", False, "", "full", "", ""),
        ("EVENT_NAME", "VARCHAR2(10)", False, "", "full", "", ""),
        ("SHOP_EVENT_NAME", "VARCHAR2(10)", False, "", "name_only", "PERSON", ""),
        ("CAPACITY", "NUMBER", False, "", "name_only", "", ""),
        ("cust_email_addr", "VARCHAR2(10)", True, "EMAIL_ADDRESS", "full", "EMAIL_ADDRESS", ""),
        ("RAW_SSN", "CHAR(9)", True, "US_SSN", "full", "US_SSN", "US_SSN"),
        ("ZIP", "NUMBER(5)", True, "US_POSTCODE", "safe", "", "UK_POSTCODE"),
        ("FLAG", "CHAR(1)", False, "", "safe", "", ""),
        ("PIC", "RAW(16)", False, "", "strip", "", ""),
        ("BODY", "CLOB", False, "", "truncate_scan", "", ""),
        ("BODY", "array<struct<a:int>>", False, "", "truncate_scan", "", ""),
        ("SINCE", "TIMESTAMP(6)", False, "", "name_only", "", ""),
        ("GAP", "interval day to second", False, "", "safe", "", ""),
        ("N", "decimal(10,2)", False, "", "safe", "", ""),
        ("SHAPE", "SDO_GEOMETRY", False, "", "full", "", ""),
    ]
    df = spark.createDataFrame([(c[0], c[1]) for c in cases], "column_name string, data_type string")
    got = N.classify(df).select(
        "column_name", "data_type", "is_pii", "column_entity", "scan_policy", "hint_entity", "name_hint"
    )
    assert sorted(map(tuple, got.collect())) == sorted(cases)


def test_describe(spark, folder):
    tables = {t: scan_table(spark, t, folder) for t in ("nation", "customer", "orders")}
    edges = K.fk_discovery(tables).filter("name_match")
    catalog = C.column_catalog(tables, distinct="approx")
    links = {r.column_name: r.links for r in C.describe_table(catalog, edges, "customer").collect()}
    assert links["c_nationkey"] == ["-> nation.n_nationkey"] and links["c_custkey"] == ["<- orders.o_custkey"]
    assert links["c_acctbal"] == [] and "n_distinct" in catalog.columns
    exact = C.column_catalog({"nation": tables["nation"]}, distinct="exact", classified=False)
    assert {r.column_name: r.n_distinct for r in exact.collect()}["n_nationkey"] == 25
    found = C.search_columns(C.names_catalog(tables), "KEY", 1)
    assert rows_of(found.select("table_name", "column_name")) == [("customer", "c_custkey"), ("customer", "c_nationkey")]


def test_searches_read_names_only(spark, folder):
    many = {f"t{i:03d}": scan_table(spark, "region", folder) for i in range(101)}
    many["zz_orders"] = scan_table(spark, "orders", folder)
    catalog = C.names_catalog(many)
    assert [r.table_name for r in C.search_tables(catalog, "orders").collect()] == ["zz_orders"]
    for df in (C.search_tables(catalog, "orders"), C.search_columns(catalog, "key")):
        assert "FileScan" not in df._jdf.queryExecution().executedPlan().toString()


def test_any_column_name(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "`it's` int, `a``b\\c` string")
    names = {"it's", "a`b\\c"}
    assert {r.column_name for r in C.column_catalog({"o'k": df}, lengths=True).collect()} == names
    assert {r.columns for r in K.candidate_keys({"o'k": df}).collect()} == names
    assert C.table_inventory({"o'k": df}).first().n_rows == 2
    assert K.fk_discovery({"o'k": df, "p": df}).count() == 4


def test_many_tables(spark):
    """Statistics of many tables are independent jobs; the candidate pairs are rows, not part of the plan."""
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    ranges = [
        r for i in range(500)
        for r in (K.ColumnRange(f"t{i}", "id", "int", 2, 2, 1, 2), K.ColumnRange(f"t{i}", "t", "text", 2, 2, "a", "b"))
    ]
    tables = {f"t{i}": one for i in range(500)}
    edges = K.fk_discovery(tables, ranges=ranges, keys=[("t0", "id")])
    assert len(edges._jdf.queryExecution().analyzed().toString()) < 3_000_000


def test_search_is_literal(spark):
    tables = spark.createDataFrame([("a_b",), ("axb",), ("a%b",)], "table_name string")
    assert [r[0] for r in C.search_tables(tables, "A_B").collect()] == ["a_b"]


def test_candidate_keys_against_counting(spark):
    rows = [(1, 1, "a", None, "x" * 100, 5), (2, 1, "b", "q", "x" * 99 + "y", 5), (3, 2, "c", None, "x" * 100, None)]
    df = spark.createDataFrame(rows, "id int, n int, t string, u string, long string, m int")
    got = {r.columns: (r.n_nulls, r.is_unique, r.kind) for r in K.candidate_keys({"t": df}, {"t": [["n", "t"], ["n", "m"]]}).collect()}
    assert got == {
        "id": (0, True, "PRIMARY KEY"),
        "n": (0, False, ""),
        "t": (0, True, "PRIMARY KEY"),
        "u": (2, True, "UNIQUE"),
        "long": (0, False, ""),
        "m": (1, False, ""),
        "n,t": (0, True, "PRIMARY KEY"),
        "n,m": (1, False, ""),
    }


def test_a_late_repeat_is_counted(spark):
    """A sketch cannot tell all values from all but one: such columns are counted exactly."""
    df = spark.range(30_001).selectExpr("CAST(if(id = 30000, 0, id) AS string) AS c", "CAST(id AS string) AS d")
    got = {r.columns: r.is_unique for r in K.candidate_keys({"t": df}).collect()}
    assert got == {"c": False, "d": True}


def test_fk_against_brute_force(spark):
    import random

    rng = random.Random(3)
    tables, values = {}, {}
    for t in range(6):
        # one value holds a third of all rows; 24 columns in all, some wholly null
        n = 60
        columns = {"key": rng.sample(range(100), n) if t % 2 else list(range(n))}
        for c in range(11):
            pool = rng.sample(range(100), 8)
            columns[f"c{c}"] = [pool[0] if i % 3 == 0 else rng.choice([*pool, None]) for i in range(n)]
        columns["s"] = [str(v) for v in columns["key"]]
        name = f"t{t}"
        kind = ", ".join(f"{c} {'string' if c == 's' else 'int'}" for c in columns)
        tables[name] = spark.createDataFrame(list(zip(*columns.values(), strict=True)), kind)
        values.update({(name, c): {v for v in vs if v is not None} for c, vs in columns.items()})
    keys = [(f"t{t}", c) for t in range(6) for c in ("key", "s")]
    for least in (1.0, 0.5):
        got = {
            ((r.child_table, r.child_column), (r.parent_table, r.parent_column)): (r.n_values, r.n_matched)
            for r in K.fk_discovery(tables, min_coverage=least).collect()
        }
        want = {
            (child, parent): (len(vs), len(vs & values[parent]))
            for child, vs in values.items()
            for parent in keys
            if child != parent and vs and (child[1] == "s") == (parent[1] == "s")
            and len(vs & values[parent]) / len(vs) >= least
        }
        assert got == want


def test_rules(spark, orders):
    got = {r.rule: r.n_violations for r in K.check_violations(orders, {"t": "total > 15", "n": "tag IS NOT NULL"}).collect()}
    assert got == {"t": 1, "n": 1}
    assert [r.id for r in K.rule_breakers(orders, "total > 15").collect()] == [1]


def test_orphans_of_a_composite_key(spark):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None)], "x int, y string")
    parent = spark.createDataFrame([(1, "a")], "p int, q string")
    assert rows_of(K.fk_violations(child, ["x", "y"], parent, ["p", "q"])) == [(1, "b", 2)]


@pytest.mark.parametrize(
    "sql, kind, table",
    [
        ("  select * from s.t where 1=1", "select", "T"),
        ("WITH x AS (SELECT 1) SELECT * FROM x", "select", ""),
        ("insert into s.t values (1)", "write", "T"),
        ("Update t set a = 1", "write", "T"),
        ("DELETE FROM s.t", "write", "T"),
        ("delete t", "write", ""),
        ("MERGE INTO t USING u", "write", ""),
        ("BEGIN", "other", ""),
    ],
)
def test_statements(spark, sql, kind, table):
    df = spark.createDataFrame([(sql,)], "s string")
    row = df.select(Q.statement_class(F.col("s")).alias("k"), Q.target_table(F.col("s")).alias("t")).first()
    assert (row.k, row.t) == (kind, table)


def test_advice(spark):
    df = spark.createDataFrame([("SELECT a FROM t WHERE b IN (SELECT c FROM d) AND EXISTS (SELECT 1 FROM e)",), ("select 1",)], "s string")
    assert [r.a for r in df.select(Q.advice(F.col("s")).alias("a")).collect()] == [[], []]


# --- streams ------------------------------------------------------------------------------------
def test_stream_equals_batch_and_goes_on(spark, folder, tmp_path):
    contacts = view(spark, folder, "contacts")
    decisions = P.decide(contacts, order_by=["cont_id"])
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first, second = contacts.filter("cont_id < 50"), contacts.filter("cont_id >= 50")
    first.write.parquet(source)
    for more in (second, None):
        stream = S.treat_stream(S.read_files(spark, source, contacts.schema), decisions)
        S.write_files(stream, out, mark).awaitTermination()
        if more is not None:
            more.write.mode("append").parquet(source)
    assert rows_of(spark.read.parquet(out)) == rows_of(P.treat_table(contacts, decisions))


def test_text_stream(spark, tmp_path):
    notes = spark.createDataFrame([(1, "jo@example.org"), (2, "none")], "id int, t string")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    notes.write.parquet(source)
    stream = S.treat_text_stream(S.read_files(spark, source, notes.schema), "t")
    S.write_files(stream, out, str(tmp_path / "mark")).awaitTermination()
    assert rows_of(spark.read.parquet(out).select("id", "t", "report.treatment")) == [
        (1, "<redacted: EMAIL_ADDRESS>", "redacted"), (2, "none", "none"),
    ]


def test_refreshed_decisions(spark, tmp_path):
    notes = spark.createDataFrame([(1, "jo@example.org")], "id int, v string")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    notes.write.parquet(source)
    run = S.refreshed_writer(
        S.read_files(spark, source, notes.schema),
        lambda batch: P.decide(batch, order_by=["id"]),
        out,
        str(tmp_path / "mark"),
    )
    run.awaitTermination()
    assert spark.read.parquet(out).first().v == "<redacted: EMAIL_ADDRESS>"


# --- footers ------------------------------------------------------------------------------------
def test_footer_counts_read_no_pages(spark, folder):
    tables = footer_tables(spark, folder, ["lineitem", "embeddings"])
    plan = C.table_inventory(tables)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""
    plain = scan_tables(spark, folder, ["lineitem", "embeddings"])
    assert rows_of(C.table_inventory(tables)) == rows_of(C.table_inventory(plain))
    assert sorted(K.column_ranges(tables), key=str) == sorted(K.column_ranges(plain), key=str)


# --- tables as Spark writes them ----------------------------------------------------------------
def test_footer_jobs_on_long_texts_nulls_and_empty_files(spark, tmp_path):
    """A writer leaves statistics out of a footer where texts are long; the jobs must give the same anyhow."""
    rows = [(i, i % 7, "x" * n + str(i), None) for i, n in enumerate([10, 2000, 5000, 5000] * 5)]
    kind = "k long, r long, body string, none string"
    made = spark.createDataFrame(rows, kind)
    made.repartition(3).write.parquet(str(tmp_path / "texts.parquet"))
    made.filter("k < 0").write.parquet(str(tmp_path / "empty.parquet"))
    made.filter("k < 7").select("k", "r", "none").coalesce(1).write.parquet(str(tmp_path / "plain.parquet"))
    names = ["texts", "empty", "plain"]
    whole, plain = footer_tables(spark, str(tmp_path), names), scan_tables(spark, str(tmp_path), names)
    assert whole["texts"].sparkSession is spark and whole["plain"].sparkSession is not spark
    assert rows_of(C.table_inventory(whole)) == rows_of(C.table_inventory(plain))
    assert rows_of(C.table_inventory(whole)) == [("empty", 0, 4, 0.0), ("plain", 7, 3, 1 - 14 / 21), ("texts", 20, 4, 0.25)]
    keys = rows_of(K.candidate_keys(whole))
    assert keys == rows_of(K.candidate_keys(plain)) and ("texts", "body", 20, 0, True, "PRIMARY KEY") in keys
    edges = K.fk_discovery(whole).filter("name_match")
    assert rows_of(edges) == rows_of(K.fk_discovery(plain).filter("name_match"))
    assert [(r.child_table, r.child_column, r.parent_table) for r in edges.filter("parent_table = 'texts'").collect()] == [
        ("plain", "k", "texts")
    ]
    assert rows_of(K.related_tables(edges, "plain")) == [("referenced_by", "texts"), ("references", "texts")]


# --- keys of several columns --------------------------------------------------------------------
def brute_keys(rows, columns, widths=(2, 3)):
    """The least groups of columns whose filled tuples differ, by trying all."""
    found = []
    for width in (1, *widths):
        for group in combinations(range(len(columns)), width):
            tuples = [t for t in (tuple(r[i] for i in group) for r in rows) if None not in t]
            smaller = any(set(k) <= set(group) for k in found)
            if tuples and len(set(tuples)) == len(tuples) and not smaller:
                found.append(group)
    return {",".join(columns[i] for i in g) for g in found if len(g) > 1}


def test_composite_keys_against_brute_force(spark):
    rng = random.Random(6)
    for n, width, most in ((60, 6, 9), (200, 5, 30), (1, 3, 2), (40, 4, 4)):
        columns = [f"c{i}" for i in range(width - 1)] + ["odd `name`"]
        rows = [tuple(rng.randrange(most) if rng.random() < 0.95 else None for _ in columns) for _ in range(n)]
        df = spark.createDataFrame(rows, ", ".join(f"`{c.replace('`', '``')}` int" for c in columns))
        got = {r.columns for r in M.composite_keys({"t": df}).collect()}
        assert got == brute_keys(rows, columns)
    assert M.composite_keys({"t": df.filter("false")}).collect() == []


def test_composite_keys_of_a_wide_table_end(spark):
    """30 columns: what cannot be a key is refused by bounds, not by a pass each."""
    columns = [f"id % {2 + i % 3} AS small{i}" for i in range(28)]
    df = spark.range(5000).selectExpr("id div 50 AS a", "id % 50 AS b", *columns)
    assert {r.columns for r in M.composite_keys({"t": df}).collect()} == {"a,b"}
    lattice = M._Lattice(df, K.column_ranges({"t": df}), set())
    assert lattice.keys(3) == [(("a", "b"), 5000)] and lattice.sketched < 30 + 28 * 27 // 2


def test_composite_foreign_keys(spark):
    parent = spark.createDataFrame([(i, j, f"{i}-{j}") for i in range(20) for j in range(10)], "a long, b int, c string")
    rows = [(i % 20, i % 10, i % 7, "x") for i in range(0, 60, 3)] + [(3, None, 1, "x"), (None, 4, 1, "x")]
    child = spark.createDataFrame(rows, "k int, l long, m int, t string")
    edges = M.composite_fks({"p": parent, "c": child}, parents=[("p", ["a", "b"])])
    got = {(r.child_table, r.child_columns): (r.n_values, r.n_matched) for r in edges.collect()}
    pairs = {("k", "l"), ("k", "m"), ("l", "m"), ("m", "l"), ("l", "k"), ("m", "k")}
    at = {"k": 0, "l": 1, "m": 2}
    want = {}
    for x, y in pairs:
        tuples = {(r[at[x]], r[at[y]]) for r in rows if None not in (r[at[x]], r[at[y]])}
        if all(0 <= p < 20 and 0 <= q < 10 for p, q in tuples):
            want["c", f"{x},{y}"] = (len(tuples), len(tuples))
    assert got == want
    # part of the tuples only: each column alone is inside, together they are not
    half = {"p": parent.filter("(a + b) % 2 = 0"), "c": child}
    assert M.composite_fks(half, parents=[("p", ["a", "b"])]).filter("child_columns = 'k,m'").collect() == []
    some = M.composite_fks(half, min_coverage=0.3, parents=[("p", ["a", "b"])]).filter("child_columns = 'k,m'").first()
    assert 0.3 <= some.coverage < 1 and some.n_matched < some.n_values
    assert M.composite_fks({"c": child.select("t")}).collect() == []


def test_candidate_pairs_are_the_ones_that_ranges_allow(spark):
    """The join over blocks of bins gives each pair once, and the same pairs as a loop; 5,000 columns end soon."""
    rng = random.Random(9)

    def made(n, spread):
        out = []
        for i in range(n):
            kind = rng.choice(["int", "int", "text"])
            low, high = sorted(rng.randrange(spread) for _ in range(2))
            ends = (low, high) if kind == "int" else (f"w{low:05d}", f"w{high:05d}")
            out.append((K.ColumnRange(f"t{i % 9}", f"c{i}", kind, 10, 10, *ends), i % 5 == 0))
        return out

    def pairs(columns):
        levels, bins = K.range_bins([r for r, _ in columns])
        rows = [(i, r.table, r.column, r.kind, K._sortable(r.low), K._sortable(r.high), r.column, key, *bins[i]) for i, (r, key) in enumerate(columns)]
        return levels, K.candidate_pairs(spark.createDataFrame(rows, K._COLUMN_TYPE), levels).selectExpr("c.id AS c", "p.id AS p")

    for n, spread in ((300, 50), (40, 1000), (600, 10**4)):
        columns = made(n, spread)
        want = [
            (i, j) for i, (c, _) in enumerate(columns) for j, (p, key) in enumerate(columns)
            if key and i != j and c.kind == p.kind and p.low <= c.low and c.high <= p.high
        ]
        levels, got = pairs(columns)
        assert sorted(map(tuple, got.collect())) == want and levels == min(6, (n // 32).bit_length())
    # narrow ranges: few pairs, though the kinds are two
    narrow = [(K.ColumnRange("t", f"c{i}", "int", 9, 9, 10 * (i // 2), 10 * (i // 2) + i % 2), i % 2 == 1) for i in range(5000)]
    assert pairs(narrow)[1].count() == 2500


def test_sketches_refute_no_true_pair_and_keep_columns_unread(spark):
    n = 20_000
    p = spark.range(n).selectExpr("id AS k", "id * 2 AS even", "concat('v', id) AS name")
    c = spark.range(5000).selectExpr("id * 3 AS inside", "id * 2 + 1 AS odd", "concat('v', id) AS label", "concat('w', id) AS other")
    tables = {"p": p, "c": c}
    known = {("p", "k"), ("p", "even"), ("p", "name")}
    ranges, pairs = K._pairs(tables, K.column_ranges(tables), known, 1.0)
    left = {(r.child_column, r.parent_column) for r in pairs.collect()}
    assert left == {("inside", "k"), ("odd", "k"), ("label", "name")}  # 'other' is outside by range, odd in even by sketch
    edges = {(r.child_column, r.parent_column) for r in K.fk_discovery(tables, keys=sorted(known)).collect()}
    assert edges == left
    used = K._used(pairs)
    read = {ranges[i].column for i in used}
    assert "even" not in read and "other" not in read
    plan = K._union_values(tables, K._by_table(ranges, used))._jdf.queryExecution().optimizedPlan().toString()
    assert "even" not in plan and "'w'" not in plan


def test_stream_of_a_table_in_one_file_or_a_folder(spark, folder, tmp_path):
    customers = scan_table(spark, "customer", folder)
    customers.repartition(3).write.parquet(str(tmp_path / "in" / "customer.parquet"))
    for place, out in ((folder, "a"), (str(tmp_path / "in"), "b")):
        run = S.write_files(S.read_table(spark, place, "customer"), str(tmp_path / out), str(tmp_path / f"{out}-log"))
        run.awaitTermination()
        assert rows_of(spark.read.parquet(str(tmp_path / out))) == rows_of(customers)


def test_composite_keys_are_refuted_by_a_part_of_the_tuples(spark, monkeypatch):
    """A repeated tuple among those of some digests ends the count; keys and rare repeats are still counted whole."""
    rows = spark.range(20000).selectExpr("id % 200 AS a", "id div 200 AS b", "id div 400 AS c", "if(id = 19999, 198, id % 200) AS d")
    monkeypatch.setattr(M, "_LARGE", 1000)
    seen, exact = {}, M._Lattice._exact
    monkeypatch.setattr(M._Lattice, "_exact", lambda self, s: seen.setdefault(s, exact(self, s)))
    found = M.composite_keys({"t": rows}, max_width=2).collect()
    assert [(r.columns, r.n_rows, r.kind) for r in found] == [("a,b", 20000, "PRIMARY KEY")]
    lattice = M._Lattice(rows, K.column_ranges({"t": rows}), set())
    assert exact(lattice, ("a", "b")) == (20000, 20000)
    n, distinct = exact(lattice, ("a", "c"))
    assert distinct < n < 2000
    n, distinct = exact(lattice, ("b", "d"))
    assert distinct == n - 1 and seen[("b", "d")] == (n, distinct)
