"""For every query, SQL that DuckDB runs on the same tables to the same result."""

from __future__ import annotations

from itertools import combinations, permutations

from . import duck, expected as N, expected as Q
from .queries import COMPOSITES, DETECT, HASH_KEY, PAIR_TABLES, PAIR_VIEWS, RULES, TABLES, TOKEN_KEY
from .views import CONTACT_VALUES, with_views

SPAN_COLUMNS = 'src, id, entity, "start", "end", match, score, recognizer'

# columns of the test tables with the types Spark reads
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
    " l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
    " props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
COLUMNS = {t: [tuple(c.strip().split(" ")) for c in s.split(",")] for t, s in SCHEMAS.items()}


def _words(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


# --- catalog and keys ---------------------------------------------------------------------------
def _inventory(tables=TABLES) -> str:
    def one(t: str) -> str:
        cells = f"count(*) * {len(COLUMNS[t])}"
        filled = " + ".join(f"count({c})" for c, _ in COLUMNS[t])
        return (
            f"SELECT '{t}' AS table_name, count(*) AS n_rows, {len(COLUMNS[t])} AS n_columns,"
            f" CASE WHEN count(*) = 0 THEN 0.0 ELSE 1 - ({filled})::DOUBLE / ({cells}) END AS null_share FROM {t}"
        )

    return _union(one(t) for t in tables)


def _person(n: str) -> str:
    ends = " OR ".join(f"ends_with({n}, '{e}')" for e in N.PERSON_ENDINGS)
    technical = _words(N.TECHNICAL_NAMES)
    return f"({n} IN {_words(N.PERSON_EXACT)} OR {ends} OR (ends_with({n}, '_NAME') AND {n} NOT IN {technical}))"


def _address(n: str, strict: bool = False) -> str:
    if strict:
        return "(" + " OR ".join(
            f"{n} = '{e}' OR ends_with({n}, '_{e}')" for e in N.ADDRESS_ENDINGS
        ) + ")"
    return "(" + " OR ".join(f"ends_with({n}, '{e}')" for e in N.ADDRESS_ENDINGS) + ")"


def _birth(n: str) -> str:
    return "(" + " OR ".join(f"ends_with({n}, '{e}')" for e in N.BIRTH_ENDINGS) + ")"


def _pii(n: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({n}, '(^|_){e}$')" for e in N.PII_NAME_ENDINGS) + ")"


def _kind(t: str) -> str:
    """Class of a type name in capitals, for the type names that occur in the tests."""
    return f"""CASE
      WHEN {t} IN ('NUMBER','INTEGER','INT','SMALLINT','FLOAT','REAL','BINARY_FLOAT','BINARY_DOUBLE','BIGINT','DOUBLE')
        OR {t} LIKE 'NUMBER(%' OR {t} LIKE 'FLOAT(%' THEN 'numeric'
      WHEN {t} IN ('BOOLEAN','RAW(1)','CHAR(1)') THEN 'boolean'
      WHEN {t} LIKE 'INTERVAL%' THEN 'interval'
      WHEN {t} IN ('RAW','BLOB','BFILE','LONG RAW','BINARY') OR {t} LIKE 'RAW(%' THEN 'binary'
      WHEN {t} IN ('CLOB','NCLOB','LONG') THEN 'large_text'
      WHEN {t} IN ('DATE','TIMESTAMP','TIMESTAMP_NTZ') OR {t} LIKE 'TIMESTAMP(%' OR {t} LIKE 'TIMESTAMP WITH%' THEN 'date'
      WHEN {t} LIKE 'VARCHAR2%' OR {t} LIKE 'NVARCHAR2%' OR {t} LIKE 'CHAR%' OR {t} LIKE 'NCHAR%' OR {t} = 'STRING' THEN 'text'
      WHEN {t} IN ('XMLTYPE','JSON') OR {t} LIKE 'ARRAY<%' THEN 'structured'
      ELSE 'other' END"""


def _policy(n: str, t: str) -> str:
    k = f"({_kind(t)})"
    return f"""CASE WHEN {_person(n)} OR {_address(n)} OR {_birth(n)} OR {k} = 'date' THEN 'name_only'
      WHEN {k} IN ('numeric','boolean','interval') THEN 'safe' WHEN {k} = 'binary' THEN 'strip'
      WHEN {k} IN ('large_text','structured') THEN 'truncate_scan'
      ELSE 'full' END"""


def _catalog() -> str:
    def one(t: str, i: int, c: str, kind: str) -> str:
        size = (
            f"CAST(min(strlen({c})) AS INTEGER) AS min_length, CAST(max(strlen({c})) AS INTEGER) AS max_length"
            if kind == "string"
            else "CAST(NULL AS INTEGER) AS min_length, CAST(NULL AS INTEGER) AS max_length"
        )
        return (
            f"SELECT '{t}' AS table_name, {i} AS position, '{c}' AS column_name, '{kind}' AS data_type,"
            f" true AS nullable, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, {size} FROM {t}"
        )

    return _union(one(t, i + 1, c, k) for t in TABLES for i, (c, k) in enumerate(COLUMNS[t]))


def _catalog_with_policy() -> str:
    return f"SELECT *, {_policy('upper(column_name)', 'upper(data_type)')} AS scan_policy FROM ({_catalog()})"


def _candidate_keys() -> str:
    def one(t: str, columns) -> str:
        columns = list(columns)
        value = columns[0] if len(columns) == 1 else f"({', '.join(columns)})"
        filled = " AND ".join(f"{c} IS NOT NULL" for c in columns)
        return f"""SELECT table_name, columns, n_rows, n_rows - filled AS n_nulls, u AS is_unique,
            CASE WHEN u AND n_rows = filled THEN 'PRIMARY KEY' WHEN u THEN 'UNIQUE' ELSE '' END AS kind
          FROM (SELECT '{t}' AS table_name, '{",".join(columns)}' AS columns, count(*) AS n_rows,
            count(*) FILTER ({filled}) AS filled,
            count(DISTINCT {value}) FILTER ({filled}) = count(*) FILTER ({filled}) AS u FROM {t})"""

    return _union(
        one(t, group)
        for t in TABLES
        for group in [[c] for c, k in COLUMNS[t] if not k.startswith("array")] + COMPOSITES.get(t, [])
    )


def _fk_edges(tables) -> str:
    kinds = {"int": "i", "bigint": "i", "string": "s", "timestamp_ntz": "d"}

    def columns(t):
        return [(c, kinds[k]) for c, k in COLUMNS[t] if k in kinds]

    values = _union(
        f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {f'CAST({c} AS BIGINT)' if k == 'i' else 'NULL'} AS i,"
        f" {c if k == 's' else 'NULL'} AS s, {f'CAST({c} AS TIMESTAMP)' if k == 'd' else 'NULL'} AS d FROM {t}"
        f" WHERE {c} IS NOT NULL"
        for t in tables
        for c, k in columns(t)
    )
    keys = _union(
        f"SELECT '{t}' AS t, '{c}' AS c FROM {t} HAVING count({c}) = count(DISTINCT {c})"
        for t in tables
        for c, _ in columns(t)
    )
    return f"""SELECT a.t AS child_table, a.c AS child_column, b.t AS parent_table, b.c AS parent_column,
        max(n.n) AS n_values, count(*) AS n_matched, count(*)::DOUBLE / max(n.n) AS coverage,
        regexp_replace(a.c, '^[^_]*_', '') = regexp_replace(b.c, '^[^_]*_', '') AS name_match
      FROM (SELECT v.* FROM vals v) a
      JOIN (SELECT v.* FROM vals v JOIN ukeys k ON k.t = v.t AND k.c = v.c) b
        ON (a.t <> b.t OR a.c <> b.c) AND a.i IS NOT DISTINCT FROM b.i AND a.s IS NOT DISTINCT FROM b.s
          AND a.d IS NOT DISTINCT FROM b.d
      JOIN (SELECT t, c, count(*) AS n FROM vals GROUP BY t, c) n ON n.t = a.t AND n.c = a.c
      GROUP BY ALL HAVING count(*) = max(n.n)""", f"vals AS MATERIALIZED ({values}), ukeys AS MATERIALIZED ({keys})"


def _fk(tables, select: str = "SELECT * FROM edges") -> str:
    body, ctes = _fk_edges(tables)
    # n in GROUP BY ALL would split groups, so the plain columns are named
    body = body.replace("GROUP BY ALL", "GROUP BY a.t, a.c, b.t, b.c")
    return f"WITH {ctes}, edges AS ({body}) {select}"


_KEYED = {"int": "i", "bigint": "i", "string": "s", "timestamp_ntz": "d"}


def _unique_sets(table: str, columns, widths) -> str:
    """(t, c, w, filled, n): the sets of columns of these widths that are unique where filled, and hold no smaller one."""

    def one(group) -> str:
        value = group[0] if len(group) == 1 else f"({', '.join(group)})"
        filled = " AND ".join(f"{c} IS NOT NULL" for c in group)
        return (
            f"SELECT '{table}' AS t, [{', '.join(repr(c) for c in group)}] AS c, {len(group)} AS w, count(*) AS n,"
            f" count(*) FILTER ({filled}) AS filled FROM {table} HAVING count(*) FILTER ({filled}) > 0 AND"
            f" count(DISTINCT {value}) FILTER ({filled}) = count(*) FILTER ({filled})"
        )

    return _union(one(g) for w in range(1, max(widths) + 1) for g in combinations(columns, w))


def _minimal(sets: str) -> str:
    return (
        f"SELECT * FROM ({sets}) x WHERE w > 1 AND NOT EXISTS (SELECT 1 FROM ({sets}) y WHERE y.t = x.t AND y.w < x.w"
        " AND list_has_all(x.c, y.c))"
    )


def _composite_keys() -> str:
    parts = [
        (t, [c for c, k in COLUMNS[t] if k in _KEYED])
        for t in TABLES
    ]
    sets = _union(_unique_sets(t, columns, (2, 3)) for t, columns in parts if columns)
    return f"""WITH sets AS MATERIALIZED ({sets})
      SELECT t AS table_name, array_to_string(c, ',') AS columns, CAST(w AS INTEGER) AS width, n AS n_rows, n - filled AS n_nulls,
        CASE WHEN n = filled THEN 'PRIMARY KEY' ELSE 'UNIQUE' END AS kind FROM ({_minimal("SELECT * FROM sets")})"""


def _fk_candidates() -> str:
    columns = [(t, c, _KEYED[k]) for t in TABLES for c, k in COLUMNS[t] if k in _KEYED]

    def one(t: str, c: str, k: str) -> str:
        low, high = (f"{f}({c if k == 'i' else f'{c}[1:64]'})" if k in "is" else "NULL" for f in ("min", "max"))
        i = [f"CAST({x} AS BIGINT)" if k == "i" else "NULL" for x in (low, high)]
        s = [f"CAST({x} AS VARCHAR)" if k == "s" else "''" for x in (low, high)]
        return (
            f"SELECT '{t}' AS t, '{c}' AS c, '{k}' AS k, {i[0]} AS li, {i[1]} AS hi, encode({s[0]}) AS ls, encode({s[1]}) AS hs,"
            f" count({c}) = count(DISTINCT {c}) AS u FROM {t} HAVING count({c}) > 0"
        )

    return f"""WITH cols AS MATERIALIZED ({_union(one(*x) for x in columns)})
      SELECT a.t AS child_table, a.c AS child_column, b.t AS parent_table, b.c AS parent_column FROM cols a JOIN cols b
        ON a.k = b.k AND b.u AND (a.t <> b.t OR a.c <> b.c)
          AND (a.k <> 'i' OR (a.li >= b.li AND a.hi <= b.hi)) AND (a.k <> 's' OR (a.ls >= b.ls AND a.hs <= b.hs))"""


def _composite_fks() -> str:
    """Every pair of columns of every table against every key of two columns, column by column of one kind."""
    kinds = {c: k for t in COLUMNS for c, k in COLUMNS[t]} | {"r_orderkey": "bigint", "r_line": "int", "r_supplier": "bigint"}
    kinds |= {"a_turn": "bigint", "a_conv": "bigint", "a_role": "string"}
    kind = {c: _KEYED.get(k) for c, k in kinds.items()}
    tables = {t: list(c) for t, c in PAIR_TABLES.items()} | {
        "returned": ["r_orderkey", "r_line", "r_supplier"], "answers": ["a_turn", "a_conv", "a_role"]
    }
    views = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in PAIR_VIEWS.items())
    sets = _union(_unique_sets(t, columns, (2,)) for t, columns in tables.items())

    def one(child, a, b, parent, x, y) -> str:
        values = f"SELECT DISTINCT {a}, {b} FROM {child} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        return f"""SELECT '{child}' AS child_table, '{a},{b}' AS child_columns, '{parent}' AS parent_table, '{x},{y}' AS parent_columns,
            (SELECT count(*) FROM ({values})) AS n_values,
            (SELECT count(*) FROM ({values} INTERSECT SELECT {x}, {y} FROM {parent})) AS n_matched
          WHERE EXISTS (SELECT 1 FROM keys WHERE t = '{parent}' AND c = ['{x}', '{y}'])"""

    found = _union(
        one(child, a, b, parent, x, y)
        for parent, columns in tables.items()
        for x, y in combinations(columns, 2)
        for child, others in tables.items()
        for a, b in permutations(others, 2)
        if kind[a] == kind[x] and kind[b] == kind[y] and (child != parent or (a != x and b != y))
    )
    return f"""WITH {views}, sets AS MATERIALIZED ({sets}), keys AS MATERIALIZED ({_minimal("SELECT * FROM sets")}), found AS ({found})
      SELECT *, n_matched::DOUBLE / n_values AS coverage FROM found WHERE n_values > 0 AND n_matched = n_values"""


# --- columns ------------------------------------------------------------------------------------
NAME = "upper(column_name)"
REAL_CASES = ", ".join(
    f"({-100 * (TABLES.index(t) + 1) - i - 1}, '{c}', '{k}')" for t in TABLES for i, (c, k) in enumerate(COLUMNS[t])
)
ALL_CASES = (
    "all_cases AS (SELECT * FROM column_cases UNION ALL SELECT CAST(case_id AS BIGINT), column_name, data_type"
    f" FROM (VALUES {REAL_CASES}) v(case_id, column_name, data_type))"
)


def _entity_join() -> str:
    pairs = ", ".join(f"('{w}', '{e}')" for e, words in N.ENTITY_NAMES.items() for w in words)
    return f"""(SELECT c.case_id, coalesce(arg_max(v.entity, length(v.word)), '') AS column_entity
      FROM all_cases c LEFT JOIN (VALUES {pairs}) v(word, entity)
        ON upper(c.column_name) = v.word OR ends_with(upper(c.column_name), '_' || v.word) GROUP BY c.case_id)"""


def _hint() -> str:
    bare = f"regexp_replace({NAME}, '^(CONT_|TBL_|TMP_|STG_|RAW_)', '')"
    cases = " ".join(
        f"WHEN {' OR '.join(f'''regexp_full_match({bare}, '{w}')''' for w in words)} THEN '{e}'"
        for e, words in N.HINT_NAMES.items()
    )
    return f"CASE {cases} ELSE '' END"


def _cases(columns: str, source: str = "all_cases") -> str:
    return with_views(f"SELECT case_id, column_name, {columns} FROM {source}", ALL_CASES)


def _hint_entity(tail: str) -> str:
    return (
        f"CASE WHEN {_person(NAME)} THEN 'PERSON' WHEN {_address(NAME)} THEN 'UK_POSTCODE'"
        f" WHEN {_birth(NAME)} THEN 'DATE_OF_BIRTH' {tail} ELSE '' END"
    )


def _typed_hints() -> str:
    kind = _kind("upper(data_type)")
    policy = _policy(NAME, "upper(data_type)")
    tail = f"WHEN {_pii(NAME)} THEN column_entity"
    return with_views(
        f"""SELECT case_id, column_name, data_type,
          CASE WHEN ({kind}) = 'numeric' THEN 'safe' ELSE {policy} END AS hint_policy,
          CASE WHEN ({kind}) = 'numeric' THEN '' ELSE {_hint_entity(tail)} END AS hint_entity
        FROM all_cases JOIN {_entity_join()} USING (case_id)""",
        ALL_CASES,
    )


_SQL = "trim(upper(sql_text))"


def _audit() -> str:
    reads = " OR ".join(f"starts_with(u, '{w}')" for w in Q.READ_WORDS)
    writes = " OR ".join(f"starts_with(u, '{w}')" for w in Q.WRITE_WORDS)
    words = "string_split_regex(u, '\\s+')"
    after = "ltrim(u[strpos(u, 'FROM') + 4:])"
    table = f"""CASE WHEN starts_with(u, 'SELECT') AND strpos(u, 'FROM') > 0 THEN string_split_regex({after}, '\\s+')[1]
      WHEN starts_with(u, 'INSERT') THEN {words}[3] WHEN starts_with(u, 'UPDATE') THEN {words}[2]
      WHEN starts_with(u, 'DELETE') AND {words}[2] = 'FROM' THEN {words}[3] ELSE '' END"""
    return with_views(
        f"""SELECT statement_class, CASE WHEN contains(t, '.') THEN t[strpos(t, '.') + 1:] ELSE t END AS target_table,
          count(*) AS n_statements FROM (SELECT CASE WHEN {reads} THEN 'select' WHEN {writes} THEN 'write' ELSE 'other' END
            AS statement_class, {table} AS t FROM (SELECT {_SQL} AS u FROM query_log)) GROUP BY ALL"""
    )


def _lint() -> str:
    u = "upper(sql_text)"
    rules = [
        (f"contains({u}, 'SELECT *')", f"'{Q.ADVICE_STAR}'"),
        (f"contains({u}, ' LIKE ''%')", f"'{Q.ADVICE_LIKE}'"),
        (f"contains({u}, ' IN (SELECT ') AND NOT contains({u}, ' EXISTS')", f"'{Q.ADVICE_IN}'"),
        (f"contains({u}, ' OR ')", f"'{Q.ADVICE_OR}'"),
        (
            f"len(string_split({u}, ' JOIN ')) > 3",
            f"'{Q.ADVICE_JOINS[0]}' || len(string_split({u}, ' JOIN ')) || '{Q.ADVICE_JOINS[1]}'",
        ),
    ]
    parts = _union(f"SELECT {text} AS advice FROM query_log WHERE {rule}" for rule, text in rules)
    return with_views(f"SELECT advice, count(*) AS n_statements FROM ({parts}) GROUP BY advice")


# --- detection ----------------------------------------------------------------------------------
def _detect(name: str) -> str:
    return with_views(f"SELECT {SPAN_COLUMNS} FROM ({duck.detector(name, 'corpus')})")


def _analyze(min_score: float) -> str:
    return with_views(
        f"SELECT {SPAN_COLUMNS} FROM ({duck.merged('raw', min_score)})",
        f"raw AS MATERIALIZED ({duck.all_spans('corpus')})",
    )


def _entity_filter() -> str:
    own = duck.spans("corpus", r"\bGiven[0-9]+", "GIVEN_NAME", "GivenNameRecognizer", "length({m}) > 6")
    parts = [duck.detector("email", "corpus"), duck.detector("ipv4", "corpus"), own]
    return with_views(f"SELECT {SPAN_COLUMNS} FROM ({_union(f'SELECT * FROM ({p})' for p in parts)})")


def _column_hits(source: str, names=duck.ALL, extra_spans: str = "", boost: bool = True, min_score: float = 0.5) -> tuple[str, str]:
    """CTEs ending in ``found`` (column_name, entity, hits, n_values, score, rank) over (src, id, text)."""
    raw = duck.all_spans(source, names=names) + extra_spans
    lifted = (
        "CASE WHEN hits >= n_values // 2 THEN greatest(score, 0.8) ELSE score END" if boost else "score"
    )
    return f"""raw AS MATERIALIZED ({raw}),
      best AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (
        PARTITION BY src, id, "start", "end" ORDER BY score DESC, entity) AS nth FROM raw) WHERE nth = 1),
      per_entity AS (SELECT r.src, r.entity, count(DISTINCT r.id) AS hits, max(r.score) AS score FROM raw r GROUP BY ALL),
      leads AS (SELECT src, entity, min(struct_pack(s := "start", ne := -"end")) AS lead FROM best GROUP BY ALL),
      sizes AS (SELECT src, count(text) AS n_values FROM {source} GROUP BY src),
      found AS (SELECT src AS column_name, entity, hits, n_values, score,
          CAST(row_number() OVER (PARTITION BY src ORDER BY lead.s, lead.ne, score DESC, entity) AS INTEGER) AS rank
        FROM (SELECT src, entity, hits, n_values, {lifted} AS score, lead
          FROM per_entity JOIN leads USING (src, entity) JOIN sizes USING (src)) WHERE score >= {min_score})"""


def _contact_values(columns, where: str = "true", source: str = "contacts") -> str:
    return _union(
        f"SELECT '{c}' AS src, CAST(cont_id AS string) AS id, {c} AS text FROM {source} WHERE {where}"
        for c in columns
    )


def _analyze_column() -> str:
    return with_views(
        "SELECT column_name, entity, hits, n_values, score, rank FROM found",
        f"vals AS ({_contact_values(CONTACT_VALUES)}), " + _column_hits("vals"),
    )


def _detect_batches() -> str:
    own = duck.spans("corpus", r"\bGiven[0-9]{2,}", "GIVEN_NAME", "GivenNameBatches")
    return with_views(f"SELECT {SPAN_COLUMNS} FROM ({own})")


def _profile() -> str:
    source = "(SELECT 'documents' AS src, CAST(doc_id AS string) AS id, text FROM documents)"
    return f"""WITH raw AS MATERIALIZED ({duck.all_spans(source)}), best AS ({duck.merged('raw')}),
      per_row AS (SELECT id, entity, count(*) AS hits FROM best GROUP BY ALL),
      hits AS (SELECT d.source, d.lang, p.entity, sum(p.hits) AS hits, count(*) AS rows_hit,
          grouping(d.source, d.lang) AS g
        FROM per_row p JOIN documents d ON CAST(d.doc_id AS string) = p.id
        GROUP BY GROUPING SETS ((d.source, d.lang, entity), (d.source, entity), (d.lang, entity), (entity))),
      totals AS (SELECT source, lang, count(*) AS n_rows, grouping(source, lang) AS g
        FROM documents GROUP BY CUBE (source, lang))
      SELECT h.source, h.lang, h.entity, CAST(h.hits AS BIGINT) AS hits, h.rows_hit, t.n_rows,
        h.rows_hit::DOUBLE / t.n_rows AS share
      FROM hits h JOIN totals t ON h.g = t.g AND h.source IS NOT DISTINCT FROM t.source
        AND h.lang IS NOT DISTINCT FROM t.lang"""


def _entity_values() -> str:
    source = "(SELECT 'documents' AS src, CAST(doc_id AS string) AS id, text FROM documents)"
    return f"""WITH raw AS MATERIALIZED ({duck.all_spans(source)}), best AS ({duck.merged('raw')})
      SELECT d.source, d.lang, p.entity, CAST(grouping(d.source, d.lang) AS INTEGER) AS level, count(DISTINCT p.match) AS n_distinct
      FROM best p JOIN documents d ON CAST(d.doc_id AS string) = p.id
      GROUP BY GROUPING SETS ((d.source, d.lang, entity), (d.source, entity), (d.lang, entity), (entity))"""


def _column_statistics() -> str:
    def end(f: str, c: str, kind: str, wanted: str) -> str:
        whole, real = kind in ("int", "bigint"), kind in ("double", "float")
        is_ = "whole" if whole else "real" if real else "none" if kind.startswith("array") else "text"
        to = {"whole": "BIGINT", "real": "DOUBLE", "text": "VARCHAR"}[wanted]
        plus = " + 0" if wanted == "real" else ""
        return f"CAST({f}({c}) AS {to}){plus}" if is_ == wanted else f"CAST(NULL AS {to})"

    return _union(
        f"SELECT '{t}' AS table_name, {i} AS position, '{c}' AS column_name, '{kind}' AS data_type, count(*) AS n_rows,"
        f" count(*) - count({c}) AS n_nulls, "
        + ", ".join(
            f"{end(f, c, kind, e)} AS {side}_{e}" for e in ("whole", "real", "text") for side, f in (("low", "min"), ("high", "max"))
        )
        + f" FROM {t}"
        for t in TABLES
        for i, (c, kind) in enumerate(COLUMNS[t], 1)
    )


def _related_paths() -> str:
    def walk(name: str, near: str, far: str) -> str:
        return f"""{name}(table_name, depth, path) AS (SELECT 'orders', 0, ['orders'] UNION ALL
          SELECT l.{far}, s.depth + 1, list_append(s.path, l.{far}) FROM {name} s JOIN links l ON l.{near} = s.table_name
          WHERE s.depth < 3 AND NOT list_contains(s.path, l.{far}))"""

    def best(relation: str, name: str) -> str:
        return f"""SELECT '{relation}' AS relation, table_name, depth, array_to_string(path, ' > ') AS path FROM (SELECT *, row_number()
          OVER (PARTITION BY table_name ORDER BY depth, path) AS nth FROM {name} WHERE depth > 0) WHERE nth = 1"""

    links = "links AS (SELECT DISTINCT child_table, parent_table FROM edges WHERE name_match AND child_table <> parent_table)"
    tail = f", {links}, {walk('up', 'child_table', 'parent_table')}, {walk('down', 'parent_table', 'child_table')} "
    tail += f"{best('references', 'up')} UNION ALL {best('referenced_by', 'down')}"
    return _fk(TABLES, tail).replace("WITH ", "WITH RECURSIVE ", 1)


# --- treatment ----------------------------------------------------------------------------------
def _contacts(email: str, card: str) -> str:
    return with_views(f"SELECT cont_id, {email} AS cont_email, {card} AS ref_card FROM contacts")


def _mask(v: str) -> str:
    return (
        f"CASE WHEN length({v}) <= 4 THEN repeat('*', length({v}))"
        f" ELSE repeat('*', length({v}) - 4) || right({v}, 4) END"
    )


def _each(template: str) -> str:
    return _contacts(
        template.format(v="cont_email", e="EMAIL_ADDRESS"), template.format(v="ref_card", e="CREDIT_CARD")
    )


def _hashed(v: str) -> str:
    return duck.hmac_sha256(v, HASH_KEY)


def _anonymised(mode: str, replacement: str, kind: str) -> str:
    raw = duck.all_spans("corpus", mode)
    kept = duck.joined_ctes("best", "corpus") if mode == "safe" else duck.kept_ctes("best")
    body = f"""SELECT c.src, c.id, s.text, coalesce(k.kinds, 'none') AS treatment, 0 AS truncated_at
      FROM corpus c JOIN ({duck.spliced('corpus', replacement)}) s ON s.src = c.src AND s.id = c.id
      LEFT JOIN (SELECT src, id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds
        FROM (SELECT src, id, {kind} AS kind FROM (SELECT src, id, k.en AS en FROM kept)) GROUP BY src, id) k ON k.src = c.src AND k.id = c.id"""
    extra = (
        f"raw AS MATERIALIZED ({raw}), best AS MATERIALIZED ({duck.merged('raw')}), {kept}"
    )
    return with_views(body, extra).replace("WITH ", "WITH RECURSIVE ", 1)


REDACTED = "'<redacted: ' || en || '>'"
MIXED_REPLACEMENT = (
    f"CASE en WHEN 'EMAIL_ADDRESS' THEN {_mask('m')} WHEN 'PHONE_NUMBER' THEN {_hashed('m')}"
    f" WHEN 'CREDIT_CARD' THEN '[REPLACED]' ELSE {REDACTED} END"
)
MIXED_KIND = "CASE en WHEN 'EMAIL_ADDRESS' THEN 'masked' WHEN 'PHONE_NUMBER' THEN 'hashed' ELSE 'redacted' END"

# --- whole tables -------------------------------------------------------------------------------
# contact columns whose name says what they hold
NAMED = {
    "cont_firstname": "PERSON", "cont_email": "EMAIL_ADDRESS", "cont_phone": "PHONE_NUMBER", "ref_dob": "DATE_OF_BIRTH",
    "ref_ssn": "US_SSN", "ref_postcode": "UK_POSTCODE", "ref_passport": "PASSPORT_NUMBER",
}
SCANNED = tuple(c for c in CONTACT_VALUES if c not in NAMED)
CONTACT_COLUMNS = ("cont_id", *CONTACT_VALUES)


def _decided(columns=SCANNED, low: int = -1, limit: str = "", **options) -> str:
    ctes = _column_hits("vals", **options)
    sample = f"sampled AS (SELECT * FROM contacts WHERE cont_id > {low} {limit})"
    return f"{sample}, vals AS ({_contact_values(columns, source='sampled')}), {ctes}"


def _treated_rows(low: int = -1, limit: str = "") -> str:
    """Contacts with each column treated as its first entity."""
    known = NAMED

    def one(c: str) -> str:
        if c in known:
            return f"CASE WHEN {c} IS NULL THEN NULL ELSE '<redacted: {known[c]}>' END AS {c}"
        if c in SCANNED:
            entity = f"(SELECT entity FROM found WHERE column_name = '{c}' AND rank = 1)"
            return f"CASE WHEN {c} IS NULL OR {entity} IS NULL THEN {c} ELSE '<redacted: ' || {entity} || '>' END AS {c}"
        return c

    return with_views(
        f"SELECT {', '.join(one(c) for c in CONTACT_COLUMNS)} FROM contacts WHERE cont_id > {low} {limit}",
        _decided(low=low, limit=limit),
    )


def _report(denied=(), forced=(), strong: bool = False) -> str:
    """The column report of contacts; ``strong`` adds the own detector and scans named columns too."""
    scanned = [c for c in SCANNED if c not in denied and c not in forced]
    options: dict = {}
    if strong:
        scanned += list(NAMED)
        own = duck.spans(
            "vals", r"\b07[0-9]{9}\b", "UK_MOBILE", "MobileRecognizer", score=0.95
        )
        options = {"extra_spans": f" UNION ALL SELECT * FROM ({own})", "boost": False}
    named = NAMED

    def row(c: str) -> str:
        kind = "bigint" if c == "cont_id" else "string"
        scan = "safe" if c == "cont_id" else (
            "name_only" if c in ("cont_firstname", "ref_postcode", "ref_dob") else "full"
        )

        def line(scan, detected, entities, confidence, source, treatment, reason) -> str:
            return (
                f"SELECT '{c}' AS column_name, '{kind}' AS data_type, '{scan}' AS scan_policy, {detected} AS detected,"
                f" {entities} AS entities, CAST({confidence} AS DOUBLE) AS confidence, {source} AS source,"
                f" {treatment} AS treatment, {reason} AS reason, CAST(NULL AS BIGINT) AS sampled_rows"
            )

        if c in denied:
            return line("safe", "true", "''", 0, "'static_policy'", "'stripped'", "'access denied by policy'")
        if c in forced:
            return line("safe", "true", "'PERSON'", 1, "'static_policy'", "'redacted'", "'forced by policy'")
        first = f"(SELECT {{}} FROM found WHERE column_name = '{c}' AND rank = 1)"
        if c in named:
            entity, score, source = f"'{named[c]}'", "0.85", "'name_heuristic'"
            if strong:
                better = f"coalesce({first.format('score')}, 0) > 0.85"
                entity = f"CASE WHEN {better} THEN {first.format('entity')} ELSE '{named[c]}' END"
                score = f"CASE WHEN {better} THEN {first.format('score')} ELSE 0.85 END"
                source = f"CASE WHEN {better} THEN 'value_scan' ELSE 'name_heuristic' END"
            return line(scan, "true", entity, score, source, "'redacted'", "'pii from column name'")
        if c not in scanned:
            return line(scan, "false", "''", 0, "'none'", "'none'", "''")
        hit = f"{first.format('entity')} IS NOT NULL"
        entities = (
            f"coalesce((SELECT string_agg(entity, ',' ORDER BY rank) FROM found WHERE column_name = '{c}'), '')"
        )
        return line(
            scan, hit, entities, f"coalesce({first.format('score')}, 0)",
            f"CASE WHEN {hit} THEN 'value_scan' ELSE 'none' END",
            f"CASE WHEN {hit} THEN 'redacted' ELSE 'none' END",
            f"CASE WHEN {hit} THEN 'pii detected in values' ELSE '' END",
        )

    return with_views(_union(row(c) for c in CONTACT_COLUMNS), _decided(scanned, **options))


def _write_merge() -> str:
    return f"""WITH src AS (SELECT c_custkey * 20 AS k, c_acctbal AS p FROM customer)
      SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN k IS NULL THEN o_totalprice ELSE p END AS o_totalprice,
        o_orderdate, o_orderpriority FROM orders LEFT JOIN src ON k = o_orderkey
      UNION ALL SELECT k, NULL, NULL, p, NULL, NULL FROM src WHERE k NOT IN (SELECT o_orderkey FROM orders)"""


def _write_preview() -> str:
    counts = {
        "insert": "SELECT count(*) FROM orders WHERE o_orderstatus = 'P'",
        "update": "SELECT count(*) FROM orders WHERE o_custkey < 100",
        "delete": "SELECT count(*) FROM orders WHERE o_orderstatus = 'F'",
        "merge": "SELECT count(*) FROM customer",
    }
    return _union(
        f"SELECT '{op}' AS op, ({count}) AS rows_affected, false AS committed" for op, count in counts.items()
    )


TOKEN_LENGTH = "4 + 2 * (12 + strlen(cont_email) + 16)"

ANSWERS: dict[str, str] = {
    "scan_table": "SELECT * FROM customer",
    "guarded_select": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"
    " ORDER BY o_totalprice, o_orderkey LIMIT 1000",
    "bind_params": "SELECT o_orderpriority, count(*) AS n_orders FROM orders"
    " WHERE o_orderstatus = 'O' AND o_totalprice > 1000 GROUP BY o_orderpriority",
    "treated_select": _treated_rows(10, "ORDER BY cont_id LIMIT 100"),
    "treated_select_alias": with_views(
        "SELECT cont_id, '<redacted: EMAIL_ADDRESS>' AS e, '<redacted: PERSON>' AS f, '<redacted: PHONE_NUMBER>' AS p"
        " FROM contacts ORDER BY cont_id LIMIT 100"
    ),
    "treated_select_join": with_views(
        "SELECT cont_id, '<redacted: EMAIL_ADDRESS>' AS buyer, '<redacted: PERSON>' AS w, c_nationkey FROM contacts"
        " JOIN customer ON c_custkey = cont_id ORDER BY cont_id LIMIT 100"
    ),
    "token_roundtrip": with_views(
        "SELECT cont_id, true AS same_token, cont_phone FROM contacts WHERE cont_email ="
        " (SELECT cont_email FROM contacts ORDER BY cont_id LIMIT 1)"
    ),
    "table_sample": with_views("SELECT * FROM contacts ORDER BY cont_id LIMIT 20"),
    "sample_groups": "SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang"
    " ORDER BY md5('checks' || chr(31) || CAST(doc_id AS VARCHAR)), doc_id) <= 5",
    "write_insert": "SELECT 'insert' AS op, count(*) AS rows_affected, false AS committed FROM orders"
    " WHERE o_orderstatus = 'P'",
    "write_update": "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey < 100 THEN 'X' ELSE o_orderstatus END"
    " AS o_orderstatus, CASE WHEN o_custkey < 100 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,"
    " o_orderdate, o_orderpriority FROM orders",
    "write_delete": "SELECT * FROM orders WHERE o_orderstatus <> 'F'",
    "write_merge": _write_merge(),
    "write_preview": _write_preview(),
    "write_commit_insert": "SELECT o_orderkey + 10000000 AS o_orderkey, CAST(NULL AS BIGINT) AS o_custkey, CAST(NULL AS VARCHAR) AS"
    " o_orderstatus, o_totalprice, CAST(NULL AS TIMESTAMP) AS o_orderdate, CAST(NULL AS VARCHAR) AS o_orderpriority,"
    " count(*) OVER () AS rows_affected FROM orders WHERE o_orderstatus = 'P'",
    "write_commit_update": "SELECT * REPLACE (CASE WHEN o_custkey < 100 THEN 'X' ELSE o_orderstatus END AS o_orderstatus),"
    " (SELECT count(*) FROM orders WHERE o_custkey < 100) AS rows_affected FROM orders",
    "write_commit_delete": "SELECT *, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS rows_affected"
    " FROM orders WHERE o_orderstatus <> 'F'",
    "write_commit_merge": f"SELECT *, (SELECT count(*) FROM customer) AS rows_affected FROM ({_write_merge()})",
    "table_inventory": _inventory(),
    "column_catalog": _catalog_with_policy(),
    "search_tables": f"SELECT table_name, n_columns::BIGINT AS n_columns FROM ({_inventory()}) WHERE table_name ILIKE '%er%'",
    "search_columns": f"SELECT table_name, position, column_name, data_type FROM ({_catalog()}) WHERE column_name ILIKE '%key%'",
    "candidate_keys": _candidate_keys(),
    "key_violations": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem"
    " GROUP BY ALL HAVING count(*) > 1",
    "check_violations": _union(
        f"SELECT '{name}' AS rule, '{rule.replace(chr(39), chr(39) * 2)}' AS condition, count(*) AS n_rows,"
        f" count(*) FILTER (NOT coalesce({rule}, true)) AS n_violations FROM lineitem"
        for name, rule in RULES.items()
    ),
    "fk_discovery": _fk(TABLES),
    "composite_keys": _composite_keys(),
    "fk_candidates": _fk_candidates(),
    "composite_fks": _composite_fks(),
    "fk_violations": "SELECT o_custkey, count(*) AS n_rows FROM (SELECT o_custkey + o_orderkey % 7 * 40 AS o_custkey"
    " FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey",
    "related_tables": _fk(
        TABLES,
        "SELECT DISTINCT 'references' AS relation, parent_table AS table_name FROM edges"
        " WHERE child_table = 'orders' AND name_match UNION SELECT 'referenced_by', child_table FROM edges"
        " WHERE parent_table = 'orders' AND name_match",
    ),
    "related_paths": _related_paths(),
    "column_statistics": _column_statistics(),
    "is_pii_column": _cases(f"{_pii(NAME)} AS is_pii"),
    "column_entity": with_views(
        f"SELECT case_id, column_name, column_entity FROM all_cases JOIN {_entity_join()} USING (case_id)",
        ALL_CASES,
    ),
    "name_columns": _cases(f"{_person(NAME)} AS is_person"),
    "address_columns": _cases(
        f"{_address(NAME)} AS is_address, {_address(NAME, True)} AS is_address_strict"
    ),
    "dob_columns": _cases(f"{_birth(NAME)} AS is_birth"),
    "scan_policy": _cases(
        "data_type, scan_policy",
        f"(SELECT *, {_policy(NAME, 'upper(data_type)')} AS scan_policy FROM all_cases)",
    ),
    "column_hints_typed": _typed_hints(),
    "column_hints_untyped": _cases(
        f"CASE WHEN {_person(NAME)} OR {_address(NAME)} OR {_birth(NAME)} THEN 'name_only' ELSE 'full' END"
        f" AS hint_policy, {_hint_entity('')} AS hint_entity"
    ),
    "name_hint_match": _cases(
        "name_hint, CASE WHEN name_hint = '' THEN 0.0::DOUBLE ELSE 0.85::DOUBLE END AS name_hint_score",
        f"(SELECT *, {_hint()} AS name_hint FROM all_cases)",
    ),
    "query_log_audit": _audit(),
    "query_log_lint": _lint(),
    **{key: _detect(key.removeprefix("detect_")) for key in DETECT},
    "analyze_text": _analyze(0.5),
    "analyze_column": _analyze_column(),
    "analyze_column_named": with_views(
        "SELECT column_name, entity, hits, n_values, score, rank FROM found UNION ALL SELECT * FROM (VALUES"
        " ('cont_firstname', 'PERSON', NULL, NULL, 0.85, 1), ('cont_email', 'EMAIL_ADDRESS', NULL, NULL, 0.85, 1),"
        " ('cont_phone', 'PHONE_NUMBER', NULL, NULL, 0.85, 1))",
        f"vals AS ({_contact_values([c for c in CONTACT_VALUES if c.startswith('ref_')])}), " + _column_hits("vals"),
    ),
    "entity_filter": _entity_filter(),
    "detect_batches": _detect_batches(),
    "min_confidence": _analyze(0.1),
    "entity_profile": _profile(),
    "entity_values": _entity_values(),
    "treat_redact": _each("'<redacted: {e}>'"),
    "treat_hash": _contacts(_hashed("cont_email"), _hashed("ref_card")),
    "treat_mask": _contacts(_mask("cont_email"), _mask("ref_card")),
    "treat_pseudonymise": with_views(
        f"SELECT cont_id, true AS is_token, CAST({TOKEN_LENGTH} AS INTEGER) AS token_length, false AS is_clear FROM contacts"
    ),
    "detokenise": with_views(
        "SELECT cont_id, CASE WHEN cont_id % 5 = 4 THEN cont_email END AS value, CASE cont_id % 5"
        " WHEN 0 THEN 'wrong key or changed token' WHEN 1 THEN 'wrong key or changed token'"
        " WHEN 2 THEN 'invalid token encoding' WHEN 3 THEN 'not a token' END AS error FROM contacts"
    ),
    "treat_replace": _each("'[REPLACED]'"),
    "treat_custom": _contacts(
        "'email_address:' || upper(cont_email[1:2])", "'credit_card:' || upper(ref_card[1:2])"
    ),
    "anonymise_text": _anonymised("safe", REDACTED, "'redacted'"),
    "anonymise_text_reference": _anonymised("reference", REDACTED, "'redacted'"),
    "anonymise_value": with_views(
        f"SELECT cont_id, {_mask('cont_email')} AS cont_email, {_hashed('cont_phone')} AS cont_phone,"
        " '<redacted: UK_NINO>' AS ref_nino, 'masked' AS treatment FROM contacts"
    ),
    "treat_truncate": "SELECT doc_id, CASE WHEN strlen(text) > 512 THEN '<content truncated at 512>' ELSE text END"
    " AS text FROM documents",
    "treat_strip_binary": "SELECT page_id, url, CASE WHEN html IS NOT NULL THEN '<binary data removed>' END AS body"
    " FROM pages",
    "treat_deny": "SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '<access denied>' END AS c_name, c_nationkey,"
    " CASE WHEN c_acctbal IS NOT NULL THEN '<access denied>' END AS c_acctbal, c_mktsegment FROM customer",
    "operator_map": _anonymised("safe", MIXED_REPLACEMENT, MIXED_KIND),
    "process_table": _treated_rows(),
    "process_table_late_hits": with_views(
        "SELECT cont_id, CASE WHEN (SELECT max(cont_id) FROM contacts) > 1000 THEN '<redacted: EMAIL_ADDRESS>'"
        " ELSE 'none' END AS remark FROM contacts"
    ),
    "process_table_nested": with_views(
        "SELECT cont_id, '<redacted: EMAIL_ADDRESS>' AS payload, cont_id % 7 AS n FROM contacts"
    ),
    "column_report": _report(),
    "static_policy": _report(denied=("cont_email",), forced=("ref_card",)),
    "name_vs_value": _report(strong=True),
    "treat_stream": _treated_rows(),
    "treat_stream_running": with_views(
        "SELECT cont_id, CASE WHEN cont_id % 3 = 0 THEN 'none' WHEN cont_id % 3 = 1 AND cont_email IS NULL THEN NULL"
        " ELSE '<redacted: EMAIL_ADDRESS>' END AS remark FROM contacts"
    ),
    "token_join": with_views(
        f"SELECT c_nationkey, c_mktsegment, count(*) AS n_contacts, min(h) AS first_token FROM (SELECT cont_id,"
        f" {_hashed('cont_email')} AS h FROM contacts) JOIN customer ON c_custkey = cont_id GROUP BY ALL"
    ),
}
# the same results by other means
ANSWERS |= {"column_entity_dictionary": ANSWERS["column_entity"], "treat_custom_batches": ANSWERS["treat_custom"]}
