"""One Spark query per operator, over whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import names as N
from veilspark.functions import texts as X
from veilspark.functions import treatments as R
from veilspark.functions.detectors import REFERENCE, SAFE, choose, regex_detector
from veilspark.operators import catalog as C
from veilspark.operators import composites as M
from veilspark.operators import detect as D
from veilspark.operators import keys as K
from veilspark.operators import querylog as Q
from veilspark.operators import statistics as ST
from veilspark.plans import reads, tables as P
from veilspark.session import shared_folder
from veilspark.sources import guard, writes
from veilspark.sources.tables import footer_tables, per_table, scan_table, scan_tables, table_path
from veilspark.streaming import treat as S

from .views import CONTACT_VALUES, CONTACTS, frame, view

# keys for checks only
HASH_KEY = b"a key for the checks alone"
TOKEN_KEY = bytes(range(32))

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
COMPOSITES = {"lineitem": [["l_orderkey", "l_linenumber"]], "conversations": [["conv_id", "turn"]]}
PAIR_TABLES = {
    "lineitem": ("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"),
    "conversations": ("conv_id", "turn", "role"),
}
PAIR_VIEWS = {
    "returned": "SELECT l_orderkey AS r_orderkey, l_linenumber AS r_line, l_suppkey AS r_supplier FROM lineitem WHERE l_returnflag = 'R'",
    "answers": "SELECT turn AS a_turn, conv_id AS a_conv, role AS a_role FROM conversations WHERE role = 'assistant'",
}
RULES = {
    "quantity_positive": "l_quantity > 0",
    "discount_low": "l_discount <= 0.05",
    "shipped": "l_shipdate IS NOT NULL",
    "flag_known": "l_returnflag IN ('A', 'N')",
}
OWN_DETECTOR = regex_detector(
    "GivenNameRecognizer", "GIVEN_NAME", r"(?<![0-9A-Za-z_])Given[0-9]+", valid=lambda m: f"length({m}) > 6"
)
STRONG_DETECTOR = regex_detector("MobileRecognizer", "UK_MOBILE", r"(?<![0-9])07[0-9]{9}(?![0-9])", 0.95)
MIXED = {"email_address": "mask", "phone_number": "hash", "credit_card": "replace"}

Query = Callable[[SparkSession, str], DataFrame]


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "corpus")


def _spans(df: DataFrame) -> DataFrame:
    return df.select("src", "id", "entity", "start", "end", "match", "score", "recognizer")


# --- reads and writes ---------------------------------------------------------------------------
def scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_table(spark, "customer", folder)


def guarded_select(spark: SparkSession, folder: str) -> DataFrame:
    frame(spark, folder, "orders").createOrReplaceTempView("orders")
    return guard.guarded_select(
        spark,
        "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
        max_rows=1000,
        order_by=["o_totalprice", "o_orderkey"],
    )


def bind_params(spark: SparkSession, folder: str) -> DataFrame:
    frame(spark, folder, "orders").createOrReplaceTempView("orders")
    return guard.guarded_select(
        spark,
        "SELECT o_orderpriority, count(*) AS n_orders FROM orders"
        " WHERE o_orderstatus = :status AND o_totalprice > :low GROUP BY o_orderpriority",
        {"status": "O", "low": 1000.0},
    )


def treated_select(spark: SparkSession, folder: str) -> DataFrame:
    contacts = view(spark, folder, "contacts")
    contacts.createOrReplaceTempView("contacts")
    rows, _ = reads.treated_select(
        spark,
        "SELECT * FROM contacts WHERE cont_id > :low",
        {"low": 10},
        order_by=["cont_id"],
        tables={"contacts": contacts},
    )
    return rows


def token_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    contacts = view(spark, folder, "contacts")
    contacts.createOrReplaceTempView("contacts")
    read = partial(
        reads.treated_select,
        spark,
        order_by=["cont_id"],
        tables={"contacts": contacts},
        treatments=R.TreatmentMap(R.pseudonymise(TOKEN_KEY)),
        token_key=TOKEN_KEY,
    )
    first, _ = read("SELECT cont_id, cont_email FROM contacts", max_rows=1)
    token = first.first()["cont_email"]
    again, _ = read(
        "SELECT cont_id, cont_email, cont_phone FROM contacts WHERE cont_email = :email", {"email": token}
    )
    return again.select(
        "cont_id",
        (F.col("cont_email") == token).alias("same_token"),
        R.detokenise(F.col("cont_phone"), TOKEN_KEY)["value"].alias("cont_phone"),
    )


def table_sample(spark: SparkSession, folder: str) -> DataFrame:
    return P.table_sample(view(spark, folder, "contacts"), ["cont_id"])


def sample_groups(spark: SparkSession, folder: str) -> DataFrame:
    return P.sample_groups(frame(spark, folder, "documents"), ["source", "lang"], ["doc_id"], 5, "checks")


def _orders_changes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = frame(spark, folder, "orders")
    fresh = orders.filter("o_orderstatus = 'P'")
    return orders, fresh


def write_insert(spark: SparkSession, folder: str) -> DataFrame:
    orders, fresh = _orders_changes(spark, folder)
    rows = fresh.selectExpr("o_orderkey + 10000000 AS o_orderkey", "o_custkey", "o_totalprice")
    return writes.preview(writes.insert(orders, rows))


def write_update(spark: SparkSession, folder: str) -> DataFrame:
    orders, _ = _orders_changes(spark, folder)
    assign = {"o_orderstatus": ":new", "o_totalprice": "o_totalprice * :times"}
    return writes.update(orders, assign, "o_custkey < :top", {"top": 100, "new": "X", "times": 2}).rows


def write_delete(spark: SparkSession, folder: str) -> DataFrame:
    orders, _ = _orders_changes(spark, folder)
    return writes.delete(orders, "nullif(o_orderstatus, 'O') = 'F'").rows


def write_merge(spark: SparkSession, folder: str) -> DataFrame:
    orders, _ = _orders_changes(spark, folder)
    customers = frame(spark, folder, "customer")
    source = customers.selectExpr("c_custkey * 20 AS o_orderkey", "c_acctbal AS o_totalprice")
    return writes.merge(orders, source, ["o_orderkey"]).rows


def write_preview(spark: SparkSession, folder: str) -> DataFrame:
    orders, fresh = _orders_changes(spark, folder)
    customers = frame(spark, folder, "customer")
    source = customers.selectExpr("c_custkey * 20 AS o_orderkey", "c_acctbal AS o_totalprice")
    changes = [
        writes.insert(orders, fresh),
        writes.update(orders, {"o_orderstatus": "'X'"}, "o_custkey < 100"),
        writes.delete(orders, "nullif(o_orderstatus, 'O') = 'F'"),
        writes.merge(orders, source, ["o_orderkey"]),
    ]
    first, *rest = [writes.preview(c) for c in changes]
    for other in rest:
        first = first.unionByName(other)
    return first


def _committed(op: str, spark: SparkSession, folder: str) -> DataFrame:
    """What a reader finds after the commit, and the count that the commit gave."""
    orders, fresh = _orders_changes(spark, folder)
    source = frame(spark, folder, "customer").selectExpr("c_custkey * 20 AS o_orderkey", "c_acctbal AS o_totalprice")
    change = {
        "insert": lambda: writes.insert(orders, fresh.selectExpr("o_orderkey + 10000000 AS o_orderkey", "o_totalprice")),
        "update": lambda: writes.update(orders, {"o_orderstatus": ":new"}, "o_custkey < :top", {"top": 100, "new": "X"}),
        "delete": lambda: writes.delete(orders, "nullif(o_orderstatus, 'O') = 'F'"),
        "merge": lambda: writes.merge(orders, source, ["o_orderkey"]),
    }[op]()
    path = f"{shared_folder(spark, 'commit')}/orders"
    done = writes.commit(change, path).first()
    return spark.read.parquet(path).withColumn("rows_affected", F.lit(done["rows_affected"]))


# --- catalog and keys ---------------------------------------------------------------------------
def table_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return C.table_inventory(footer_tables(spark, folder, TABLES))


def column_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return C.column_catalog(scan_tables(spark, folder, TABLES), lengths=True).select(
        "table_name", "position", "column_name", "data_type", "nullable", "n_rows", "n_nulls",
        "min_length", "max_length", "scan_policy",
    )


def search_tables(spark: SparkSession, folder: str) -> DataFrame:
    return C.search_tables(C.names_catalog(scan_tables(spark, folder, TABLES)), "er")


def search_columns(spark: SparkSession, folder: str) -> DataFrame:
    catalog = C.names_catalog(scan_tables(spark, folder, TABLES))
    return C.search_columns(catalog, "key").select("table_name", "position", "column_name", "data_type")


def candidate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return K.candidate_keys(footer_tables(spark, folder, TABLES), COMPOSITES)


def key_violations(spark: SparkSession, folder: str) -> DataFrame:
    return K.key_violations(frame(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def check_violations(spark: SparkSession, folder: str) -> DataFrame:
    return K.check_violations(frame(spark, folder, "lineitem"), RULES)


def fk_discovery(spark: SparkSession, folder: str) -> DataFrame:
    return K.fk_discovery(footer_tables(spark, folder, TABLES))


def composite_keys(spark: SparkSession, folder: str) -> DataFrame:
    return M.composite_keys(footer_tables(spark, folder, TABLES))


def fk_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return K.fk_candidates(footer_tables(spark, folder, TABLES))


def composite_fks(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of two columns, with two tables beside that refer to them."""
    tables = {t: frame(spark, folder, t).select(*c) for t, c in PAIR_TABLES.items()}
    for name, sql in PAIR_VIEWS.items():
        source = sql.rsplit(" FROM ", 1)[1].split()[0]
        tables[name] = spark.sql(sql.replace(f" FROM {source}", f" FROM {{{source}}}"), **{source: frame(spark, folder, source)})
    return M.composite_fks(tables, max_width=2)


def fk_violations(spark: SparkSession, folder: str) -> DataFrame:
    orders = frame(spark, folder, "orders").withColumn("o_custkey", F.expr("o_custkey + o_orderkey % 7 * 40"))
    return K.fk_violations(orders, ["o_custkey"], frame(spark, folder, "customer"), ["c_custkey"])


def related_tables(spark: SparkSession, folder: str) -> DataFrame:
    edges = K.fk_discovery(footer_tables(spark, folder, TABLES)).filter("name_match")
    return K.related_tables(edges, "orders")


def related_paths(spark: SparkSession, folder: str) -> DataFrame:
    edges = K.fk_discovery(footer_tables(spark, folder, TABLES)).filter("name_match")
    return K.related_paths(edges, "orders", 3)


def column_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Refreshed twice; the second time finds nothing to read."""
    state = shared_folder(spark, "statistics")

    def one(name: str) -> DataFrame:
        path = table_path(folder, name)
        ST.refresh_statistics(spark, path, f"{state}/{name}")
        if again := ST.refresh_statistics(spark, path, f"{state}/{name}"):
            raise AssertionError(f"read again: {again}")
        rows = ST.merged_statistics(spark, path, f"{state}/{name}")
        return rows.drop("n_distinct").withColumn("table_name", F.lit(name))

    return reduce(DataFrame.unionByName, per_table(spark, one, TABLES))


# --- column names and statements ----------------------------------------------------------------
def _cases(spark: SparkSession, folder: str) -> DataFrame:
    """The made cases, and under negative numbers every column of the tables."""
    real = C.names_catalog(scan_tables(spark, folder, TABLES))
    number = F.expr(f"-100 * array_position(array({', '.join(repr(t) for t in TABLES)}), table_name) - position")
    real = real.select(number.cast("long").alias("case_id"), "column_name", "data_type")
    return view(spark, folder, "column_cases").unionByName(real)


def _classified(spark: SparkSession, folder: str, *columns: str, typed: bool = True) -> DataFrame:
    cases = _cases(spark, folder)
    classes = N.classify(cases, data_type="data_type" if typed else None)
    return classes.select("case_id", "column_name", *columns)


def column_entity_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return N.dictionary_entities(_cases(spark, folder), N.entity_dictionary(spark)).select("case_id", "column_name", "column_entity")


def address_columns(spark: SparkSession, folder: str) -> DataFrame:
    cases = _cases(spark, folder)
    strict = N.is_address_column("column_name", strict=True)
    return cases.selectExpr(
        "case_id",
        "column_name",
        f"{N.is_address_column('column_name')} AS is_address",
        f"{strict} AS is_address_strict",
    )


def query_log_audit(spark: SparkSession, folder: str) -> DataFrame:
    return Q.query_log_audit(view(spark, folder, "query_log"), "sql_text")


def query_log_lint(spark: SparkSession, folder: str) -> DataFrame:
    return Q.query_log_lint(view(spark, folder, "query_log"), "sql_text")


# --- detection ----------------------------------------------------------------------------------
def detect_entity(entity: str, spark: SparkSession, folder: str) -> DataFrame:
    return _spans(D.detect(corpus(spark, folder), ["src", "id"], "text", [entity]))


def analyze_text(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(D.analyze_texts(corpus(spark, folder), ["src", "id"], "text"))


def min_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(D.analyze_texts(corpus(spark, folder), ["src", "id"], "text", min_score=0.1))


def entity_filter(spark: SparkSession, folder: str) -> DataFrame:
    wanted = ["EMAIL_ADDRESS", "IP_ADDRESS_V4", "CREDIT_CARD", "GIVEN_NAME"]
    chosen = choose(wanted, add=[OWN_DETECTOR], remove=["CreditCardRecognizer"])
    return _spans(D.detect(corpus(spark, folder), ["src", "id"], "text", detectors=chosen))


def _given_names(texts):
    """A user's recognizer: hits of a batch of texts, in characters."""
    pattern = re.compile(r"(?<![0-9A-Za-z_])Given[0-9]{2,}")
    return [[(m.start(), m.end(), 0.85) for m in pattern.finditer(t)] for t in texts]


def detect_batches(spark: SparkSession, folder: str) -> DataFrame:
    hits = D.detect_batches(
        corpus(spark, folder), ["src", "id"], "text", _given_names, "GIVEN_NAME", "GivenNameBatches", lambda t: t.contains("Given")
    )
    return _spans(hits)


def analyze_column(spark: SparkSession, folder: str) -> DataFrame:
    contacts = view(spark, folder, "contacts")
    return D.analyze_columns(contacts, CONTACT_VALUES)


def analyze_column_named(spark: SparkSession, folder: str) -> DataFrame:
    return D.analyze_columns(view(spark, folder, "contacts"), CONTACT_VALUES, use_names=True)


def entity_profile(spark: SparkSession, folder: str) -> DataFrame:
    documents = scan_table(spark, "documents", folder, ["doc_id", "text", "source", "lang"])
    return D.entity_profile(documents, "text", ["source", "lang"], cube=True)


def entity_values(spark: SparkSession, folder: str) -> DataFrame:
    documents = scan_table(spark, "documents", folder, ["text", "source", "lang"])
    return D.entity_values(documents, "text", ["source", "lang"], cube=True)


# --- treatment ----------------------------------------------------------------------------------
def _treated_contacts(treatment: R.Treatment, spark: SparkSession, folder: str) -> DataFrame:
    contacts = view(spark, folder, "contacts")
    return contacts.select(
        "cont_id",
        treatment.apply(F.col("cont_email"), F.lit("EMAIL_ADDRESS")).alias("cont_email"),
        treatment.apply(F.col("ref_card"), F.lit("CREDIT_CARD")).alias("ref_card"),
    )


def _initials(value, entity):
    return F.concat(F.lower(entity), F.lit(":"), F.upper(F.substring(value, 1, 2)))


def treat_pseudonymise(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _treated_contacts(R.pseudonymise(TOKEN_KEY), spark, folder)
    return tokens.select(
        "cont_id",
        F.col("cont_email").startswith("pii:").alias("is_token"),
        F.length("cont_email").alias("token_length"),
        F.col("cont_email").contains("example").alias("is_clear"),
    )


def detokenise(spark: SparkSession, folder: str) -> DataFrame:
    """Good tokens, tokens under another key, changed ones, bad hex and plain values, a fifth each."""
    token = R.pseudonymise(TOKEN_KEY).apply(F.col("cont_email"), F.lit(""))
    foreign = R.pseudonymise(bytes(range(32, 64))).apply(F.col("cont_email"), F.lit(""))
    turned = F.translate(F.substring(token, 5, 1), "0123456789abcdef", "123456789abcdef0")
    case = F.col("cont_id") % 5
    given = (
        F.when(case == 0, foreign)
        .when(case == 1, F.concat(F.lit("pii:"), turned, F.substr(token, F.lit(6))))
        .when(case == 2, F.concat(F.lit("pii:xyz"), F.col("cont_email")))
        .when(case == 3, F.col("cont_email"))
        .otherwise(token)
    )
    opened = R.detokenise(given, TOKEN_KEY)
    return view(spark, folder, "contacts").select(
        "cont_id", opened["value"].alias("value"), opened["error"].alias("error")
    )


def treat_custom(spark: SparkSession, folder: str) -> DataFrame:
    return _treated_contacts(R.custom(_initials), spark, folder)


def _initials_of_batch(values, entities):
    return entities.str.lower() + ":" + values.str.slice(0, 2).str.upper()


def treat_custom_batches(spark: SparkSession, folder: str) -> DataFrame:
    return _treated_contacts(R.custom_batches(_initials_of_batch), spark, folder)


def _anonymised(spark: SparkSession, folder: str, **options) -> DataFrame:
    treated = corpus(spark, folder).withColumn("t", X.anonymise_text("text", **options))
    return treated.select("src", "id", "t.text", "t.report.treatment", "t.report.truncated_at")


def anonymise_value(spark: SparkSession, folder: str) -> DataFrame:
    treatments = R.TreatmentMap.from_config("redact", MIXED, HASH_KEY)
    contacts = view(spark, folder, "contacts")
    columns = {"cont_email": "EMAIL_ADDRESS", "cont_phone": "PHONE_NUMBER", "ref_nino": "UK_NINO"}
    return contacts.select(
        "cont_id",
        *[X.anonymise_value(F.col(c), F.lit(e), treatments).alias(c) for c, e in columns.items()],
        X.anonymise_value_report(F.col("cont_email"), F.lit("EMAIL_ADDRESS"), treatments)[
            "treatment"
        ].alias("treatment"),
    )


def treat_truncate(spark: SparkSession, folder: str) -> DataFrame:
    documents = frame(spark, folder, "documents")
    return documents.select("doc_id", X.truncate_text(F.col("text"), 512).alias("text"))


def treat_strip_binary(spark: SparkSession, folder: str) -> DataFrame:
    pages = frame(spark, folder, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("body"))
    return P.treat_table(pages, P.decide(pages))


def treat_deny(spark: SparkSession, folder: str) -> DataFrame:
    customers = frame(spark, folder, "customer")
    policies = {"c_name": P.ColumnPolicy("deny"), "c_acctbal": P.ColumnPolicy("deny")}
    return P.treat_table(customers, P.decide(customers, policies=policies))


# --- whole tables -------------------------------------------------------------------------------
def process_table(spark: SparkSession, folder: str) -> DataFrame:
    contacts = view(spark, folder, "contacts")
    treated, _ = P.process_table(contacts)
    return treated


def process_table_late_hits(spark: SparkSession, folder: str) -> DataFrame:
    """A column whose first personal data stands after a thousand rows."""
    contacts = view(spark, folder, "contacts")
    remark = F.expr("CASE WHEN cont_id > 1000 THEN cont_email ELSE 'none' END").alias("remark")
    return P.process_table(contacts.select("cont_id", remark))[0]


def process_table_nested(spark: SparkSession, folder: str) -> DataFrame:
    contacts = view(spark, folder, "contacts")
    payload = F.expr("named_struct('mail', cont_email, 'tags', array('a', 'b'))").alias("payload")
    plain = F.expr("named_struct('n', cont_id % 7)").alias("plain")
    treated, _ = P.process_table(contacts.select("cont_id", payload, plain))
    return treated.select("cont_id", "payload", F.col("plain.n").alias("n"))


def _treated_query(sql: str, spark: SparkSession, folder: str) -> DataFrame:
    contacts = view(spark, folder, "contacts")
    contacts.createOrReplaceTempView("contacts")
    frame(spark, folder, "customer").createOrReplaceTempView("customer")
    return reads.treated_select(spark, sql, order_by=["cont_id"], tables={"contacts": contacts})[0]


def _report(spark: SparkSession, folder: str, **options) -> DataFrame:
    contacts = view(spark, folder, "contacts")
    _, report = P.process_table(contacts, **options)
    return report.withColumn("entities", F.concat_ws(",", "entities"))


def static_policy(spark: SparkSession, folder: str) -> DataFrame:
    policies = {"cont_email": P.ColumnPolicy("deny"), "ref_card": P.ColumnPolicy(forced=True)}
    return _report(spark, folder, policies=policies)


def name_vs_value(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder, use_names=False, detectors=choose(add=[STRONG_DETECTOR]))


def treat_stream(spark: SparkSession, folder: str) -> DataFrame:
    decisions = P.decide(view(spark, folder, "contacts"))
    customers = S.read_table(spark, folder, "customer")
    contacts = spark.sql(CONTACTS.replace("FROM customer", "FROM {customer}"), customer=customers)
    out = shared_folder(spark, "stream")
    run = S.write_files(S.treat_stream(contacts, decisions), f"{out}/rows", f"{out}/checkpoint")
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def treat_stream_running(spark: SparkSession, folder: str) -> DataFrame:
    """Three files, a batch each: only the second one has personal data in its remarks."""
    place = shared_folder(spark, "running")
    remark = F.expr("CASE WHEN cont_id % 3 = 1 THEN cont_email ELSE 'none' END").alias("remark")
    rows = view(spark, folder, "contacts").select("cont_id", remark)
    for part in range(3):
        rows.filter(F.col("cont_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{place}/in")
    stream = S.read_files(spark, f"{place}/in", rows.schema, options={"maxFilesPerTrigger": "1"})
    S.running_writer(stream, f"{place}/out", f"{place}/checkpoint", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("cont_id", "remark")


def token_join(spark: SparkSession, folder: str) -> DataFrame:
    hashed = R.TreatmentMap(R.hash_with(HASH_KEY))
    contacts = view(spark, folder, "contacts").select("cont_id", "cont_email")
    left, _ = P.process_table(contacts, treatments=hashed)
    customers = frame(spark, folder, "customer").selectExpr(
        "lower(replace(c_name, '#', '.')) || '@example.com' AS email", "c_nationkey", "c_mktsegment"
    )
    right, _ = P.process_table(customers, treatments=hashed)
    joined = reads.token_join(left, right.withColumnRenamed("email", "cont_email"), ["cont_email"])
    return joined.groupBy("c_nationkey", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_contacts"), F.min("cont_email").alias("first_token")
    )


DETECT = {
    "detect_email": "EMAIL_ADDRESS",
    "detect_phone": "PHONE_NUMBER",
    "detect_postcode": "UK_POSTCODE",
    "detect_nino": "UK_NINO",
    "detect_nhs": "UK_NHS_NUMBER",
    "detect_card": "CREDIT_CARD",
    "detect_iban": "IBAN",
    "detect_ipv4": "IP_ADDRESS_V4",
    "detect_ipv6": "IP_ADDRESS_V6",
    "detect_dob": "DATE_OF_BIRTH",
    "detect_ssn": "US_SSN",
    "detect_passport": "PASSPORT_NUMBER",
}

QUERIES: dict[str, Query] = {
    "scan_table": scan,
    "guarded_select": guarded_select,
    "bind_params": bind_params,
    "treated_select": treated_select,
    "treated_select_alias": partial(
        _treated_query, "SELECT cont_id, cont_email AS e, cont_firstname AS f, upper(cont_phone) AS p FROM contacts"
    ),
    "treated_select_join": partial(
        _treated_query,
        "WITH named AS (SELECT c_custkey AS k, c_name AS who, c_nationkey FROM customer) SELECT c.cont_id,"
        " c.cont_email AS buyer, n.who AS w, n.c_nationkey FROM contacts c JOIN named n ON n.k = c.cont_id",
    ),
    "token_roundtrip": token_roundtrip,
    "table_sample": table_sample,
    "sample_groups": sample_groups,
    "write_insert": write_insert,
    "write_update": write_update,
    "write_delete": write_delete,
    "write_merge": write_merge,
    "write_preview": write_preview,
    **{f"write_commit_{op}": partial(_committed, op) for op in ("insert", "update", "delete", "merge")},
    "table_inventory": table_inventory,
    "column_catalog": column_catalog,
    "search_tables": search_tables,
    "search_columns": search_columns,
    "candidate_keys": candidate_keys,
    "key_violations": key_violations,
    "check_violations": check_violations,
    "fk_discovery": fk_discovery,
    "composite_keys": composite_keys,
    "fk_candidates": fk_candidates,
    "composite_fks": composite_fks,
    "fk_violations": fk_violations,
    "related_tables": related_tables,
    "related_paths": related_paths,
    "column_statistics": column_statistics,
    "is_pii_column": lambda s, d: _classified(s, d, "is_pii", typed=False),
    "column_entity": lambda s, d: _classified(s, d, "column_entity", typed=False),
    "column_entity_dictionary": column_entity_dictionary,
    "name_columns": lambda s, d: _classified(s, d, "is_person", typed=False),
    "address_columns": address_columns,
    "dob_columns": lambda s, d: _classified(s, d, "is_birth", typed=False),
    "scan_policy": lambda s, d: _classified(s, d, "data_type", "scan_policy"),
    "column_hints_typed": lambda s, d: _classified(s, d, "data_type", "hint_policy", "hint_entity"),
    "column_hints_untyped": lambda s, d: _classified(s, d, "hint_policy", "hint_entity", typed=False),
    "name_hint_match": lambda s, d: _classified(s, d, "name_hint", "name_hint_score", typed=False),
    "query_log_audit": query_log_audit,
    "query_log_lint": query_log_lint,
    **{key: partial(detect_entity, entity) for key, entity in DETECT.items()},
    "analyze_text": analyze_text,
    "analyze_column": analyze_column,
    "analyze_column_named": analyze_column_named,
    "entity_filter": entity_filter,
    "detect_batches": detect_batches,
    "min_confidence": min_confidence,
    "entity_profile": entity_profile,
    "entity_values": entity_values,
    "treat_redact": partial(_treated_contacts, R.redact()),
    "treat_hash": partial(_treated_contacts, R.hash_with(HASH_KEY)),
    "treat_mask": partial(_treated_contacts, R.mask()),
    "treat_pseudonymise": treat_pseudonymise,
    "detokenise": detokenise,
    "treat_replace": partial(_treated_contacts, R.replace()),
    "treat_custom": treat_custom,
    "treat_custom_batches": treat_custom_batches,
    "anonymise_text": lambda s, d: _anonymised(s, d, mode=SAFE),
    "anonymise_text_reference": lambda s, d: _anonymised(s, d, mode=REFERENCE),
    "anonymise_value": anonymise_value,
    "treat_truncate": treat_truncate,
    "treat_strip_binary": treat_strip_binary,
    "treat_deny": treat_deny,
    "operator_map": lambda s, d: _anonymised(
        s, d, treatments=R.TreatmentMap.from_config("redact", MIXED, HASH_KEY)
    ),
    "process_table": process_table,
    "process_table_late_hits": process_table_late_hits,
    "process_table_nested": process_table_nested,
    "column_report": _report,
    "static_policy": static_policy,
    "name_vs_value": name_vs_value,
    "treat_stream": treat_stream,
    "treat_stream_running": treat_stream_running,
    "token_join": token_join,
}
