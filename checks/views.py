"""Views over the test tables whose text runs unchanged in Spark SQL and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from veilspark.sources.tables import scan_table, spread

_KEY = "CAST(c_custkey AS string)"


def _pad(width: int, factor: int = 1) -> str:
    value = _KEY if factor == 1 else f"CAST(c_custkey * {factor} AS string)"
    return f"lpad({value}, {width}, '0')"


CONTACTS = f"""SELECT c_custkey AS cont_id,
  'Given' || CAST(c_custkey % 97 AS string) AS cont_firstname,
  lower(replace(c_name, '#', '.')) || '@example.com' AS cont_email,
  '07' || {_pad(9)} AS cont_phone,
  '19' || CAST(50 + c_custkey % 50 AS string) || '-' || lpad(CAST(1 + c_custkey % 13 AS string), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 31 AS string), 2, '0') AS ref_dob,
  'AB' || lpad(CAST(c_custkey % 100 AS string), 2, '0') || '3456' || substr('ABCD', CAST(c_custkey % 4 AS int) + 1, 1) AS ref_nino,
  lpad(CAST((c_custkey * 7919) % 1000 AS string), 3, '0') || '-' || lpad(CAST(c_custkey % 100 AS string), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS string), 4, '0') AS ref_ssn,
  'SW' || CAST(c_custkey % 10 AS string) || 'A ' || CAST((c_custkey + 3) % 10 AS string) || 'AA' AS ref_postcode,
  '10.' || CAST(c_custkey % 300 AS string) || '.0.' || CAST(c_custkey % 256 AS string) || CASE WHEN c_custkey % 5 = 0 THEN '/24' ELSE '' END AS ref_ipv4,
  '2001:db8:0:' || CAST(c_custkey % 10000 AS string) || ':0:0:0:1' AS ref_ipv6,
  '4' || {_pad(15, 7919)} AS ref_card,
  {_pad(10, 104729)} AS ref_nhs,
  'GB' || lpad(CAST(c_custkey % 100 AS string), 2, '0') || 'WEST' || lpad(CAST(c_custkey * 13 AS string), 14, '0') AS ref_iban,
  'P' || {_pad(8)} AS ref_passport
FROM customer"""

CONTACT_VALUES = (
    "cont_firstname", "cont_email", "cont_phone", "ref_dob", "ref_nino", "ref_ssn", "ref_postcode",
    "ref_ipv4", "ref_ipv6", "ref_card", "ref_nhs", "ref_iban", "ref_passport",
)

NOTES = """SELECT cont_id, concat_ws(' ', 'Café 12.', 'mail', cont_email, 'tel', cont_phone, 'ni', ref_nino, 'ip', ref_ipv4,
  'born', ref_dob, 'iban', ref_iban, 'card', ref_card) AS note
FROM contacts"""

QUERY_LOG = """SELECT event_id, user_id,
  CASE CAST(event_id % 8 AS int)
    WHEN 0 THEN 'SELECT * FROM orders'
    WHEN 1 THEN 'select c_name from app.customer where c_name LIKE ''%9'''
    WHEN 2 THEN 'SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)'
    WHEN 3 THEN 'SELECT 1 FROM a JOIN b ON 1=1 JOIN c ON 1=1 JOIN d ON 1=1 WHERE x = 1 OR y = 2'
    WHEN 4 THEN 'WITH t AS (SELECT 1 AS k) SELECT k FROM t'
    WHEN 5 THEN 'INSERT INTO app.orders VALUES (1)'
    WHEN 6 THEN 'update orders set o_orderstatus = ''F'' where o_orderkey = ' || CAST(event_id AS string)
    ELSE 'DELETE FROM lineitem WHERE l_orderkey = ' || CAST(event_id AS string)
  END AS sql_text
FROM events"""

# one shape of personal data, or of a near miss, per customer; digits vary with the key
_D2, _D4, _D7, _D9 = (
    "lpad(CAST(c_custkey % 100 AS string), 2, '0')",
    "lpad(CAST(c_custkey % 10000 AS string), 4, '0')",
    _pad(7, 31),
    _pad(9, 97),
)
SHAPES = (
    f"'+44 7700 ' || lpad(CAST(c_custkey % 1000000 AS string), 6, '0')",
    f"'+447700' || lpad(CAST(c_custkey % 1000000 AS string), 6, '0') || ' or later'",
    f"'+1 212 555 ' || {_D4}",
    f"'+1 212 5'",
    f"'0 7 7 0 0 ' || {_D7} || ' evenings'",
    f"'020 7946 ' || {_D4}",
    f"'01632 96' || {_D4} || 'x'",
    f"'089 ' || {_D2}",
    f"'call (212) 555-' || {_D4} || ', é212.555.' || {_D4} || ' or +4915' || {_D9}",
    f"'ring 212 555 ' || {_D4} || '; 212555' || {_D4} || 'é'",
    f"'ext +44 ' || {_D9} || ' and 07' || {_D9} || ' and 0123456789012'",
    f"'é+1212555' || {_D4} || 'é 03' || {_D7}",
    f"'a.b+' || {_D4} || '@mail.example.co.uk, x@y'",
    f"'<u' || {_D4} || '@ex-1.example.org>; a@.com b@c..d @e.com'",
    f"'x@@y.com q@b.c-_x' || {_D2} || '@d.ee.'",
    f"'naïve' || {_D2} || '@exämple.com z''{{}}@a.b1.c'",
    f"'SW1A ' || CAST(c_custkey % 10 AS string) || 'AA, éM1 1AE, xM1 1AE, M1 1AEx'",
    f"'EC' || CAST(c_custkey % 10 AS string) || 'A1BB W1A1HQ sw1a 1aa B33 8THé'",
    f"'AB ' || {_D2} || ' 34 56 C, ab' || {_D2} || '3456d'",
    f"'DA' || {_D2} || '3456A QQ' || {_D2} || '3456A JG ' || {_D2} || ' 1122 A'",
    f"'nhs ' || substr({_pad(10, 104729)}, 1, 3) || ' ' || substr({_pad(10, 104729)}, 4, 3) || ' ' || substr({_pad(10, 104729)}, 7, 4)",
    f"'nhs ' || substr({_pad(10, 7907)}, 1, 3) || '-' || substr({_pad(10, 7907)}, 4, 3) || '-' || substr({_pad(10, 7907)}, 7, 4) || 'é'",
    f"'card 4111-1111-' || {_D4} || '-' || {_D4}",
    f"'card é5500 0000 ' || {_D4} || ' ' || {_D4} || ', 0000 0000 0000 0000'",
    f"'card 41111111' || {_D4} || '1 x3782822463' || {_D4}",
    f"'DE89370400440532013000 DE8937040044050513100000 GB82WEST' || {_pad(14, 13)}",
    f"'éFR' || {_D2} || '30006000011234567890189 GB' || {_D2} || 'A'",
    f"'hosts 192.168.' || CAST(c_custkey % 300 AS string) || '.1 and 10.0.0.' || CAST(c_custkey % 256 AS string)",
    f"'net 10.0.0.0/' || CAST(c_custkey % 40 AS string) || ' host 10.0.0.' || CAST(c_custkey % 256 AS string)",
    f"'v1.2.3.4 1.2.3.4.5 256.1.1.' || CAST(c_custkey % 256 AS string) || 'é'",
    f"'é ::1'",
    f"'x::1' || CAST(c_custkey % 10 AS string) || ' y ::1'",
    f"'fe80::/10 é'",
    f"'é ::/128'",
    f"'é a ::/' || CAST(c_custkey % 129 AS string)",
    f"'a ::/x ::/64'",
    f"'::'",
    f"'at 12:' || {_D2} || ' and fe80:0:0:' || {_D4} || ':1/64'",
    f"'2001:DB8:' || {_D4} || ':0:0:0:0:1 é1:2 ab:cd:ef'",
    f"'born ' || CAST(1 + c_custkey % 31 AS string) || '/' || CAST(1 + c_custkey % 12 AS string) || '/19' || {_D2} || 'é'",
    f"'born 3' || CAST(c_custkey % 3 AS string) || '-0' || CAST(1 + c_custkey % 9 AS string) || '-2000'",
    f"'born 29-02-19' || {_D2} || ' 02/29/19' || {_D2} || ' 5-6-2000 05/06/99'",
    f"CAST(c_custkey % 34 AS string) || '-Feb-' || CAST(1890 + c_custkey % 220 AS string) || ' 1-Foo-2000'",
    f"'12/31/1999 31/12/1999 13/13/1999 1/2/199 1-2/1999 é' || {_D2} || '/11/2001'",
    f"'ssn 123-' || {_D2} || '-' || {_D4} || ', 666-12-3456 000-12-3456'",
    f"'ssn 123.' || {_D2} || '.' || {_D4} || ' 123-45.6789 123-456789é'",
    f"'ssn 078-05-1120 078051120 078.05.1120 9' || {_pad(8, 3)}",
    f"'pass A' || {_pad(8, 7)} || ' AB' || {_D7} || ' éAB1' || {_D7} || ' A1 ' || {_pad(8, 11)}",
    f"'nothing here, été 12 and 345'",
    f"CASE WHEN c_custkey % 2 = 0 THEN '' END",
)
VARIANTS = (
    "SELECT c_custkey AS var_id, CASE CAST(c_custkey % {} AS int) {} END AS txt FROM customer".format(
        len(SHAPES), " ".join(f"WHEN {i} THEN {shape}" for i, shape in enumerate(SHAPES))
    ).replace("{{}}", "{}")
)

_COLUMN_NAMES = (
    "CONT_FIRSTNAME", "cont_surname", "cust_last_name", "FULL_NAME", "NAME", "FILE_NAME", "MY_FILE_NAME",
    "HOSTNAME", "HOST_NAME", "company_name", "EMAIL", "cont_email_addr", "EMAIL_ADDRESS", "EMAILS",
    "HOMEPHONE", "HOME_PHONE", "PHONE_NO", "mobile_num", "FAX_NUMBER", "CONT_FAX", "POST_CODE",
    "ship_postcode", "ZIP", "ZIP_CODE", "ZIPCODE", "ADDR", "ADDRESS_LINE1", "HOME_ADDRESS_LINE2",
    "CAPACITY", "CITY", "home_town", "REGION", "real_estate", "COUNTRY_CODE", "DOB", "cust_dob",
    "DATE_OF_BIRTH", "BIRTHDAY", "NI", "NI_NO", "ALUMNI", "OMNI_NUMBER", "SSN", "SSN_NUMBER", "PASSPORT",
    "PASSPORT_NO", "stg_passport_number", "RAW_IBAN", "TBL_CC", "TMP_IP", "HOST_IP", "IPV6", "ip_v4",
    "NHS_NUMBER", "HEALTHNUMBER", "CARD_NUMBER", "BANKACCOUNT", "telno", "TELEPHONE", "ORDER_ID",
    "AMOUNT", "CREATED_AT", "NOTES", "PAYLOAD", "INITIALS", "middle_initial", "PREFERRED_NAME",
    "GIVENNAME", "FAMILY_NAME", "known_name",
)
_TYPES = (
    "VARCHAR2(100)", "NUMBER", "NUMBER(10,2)", "INTEGER", "CHAR(1)", "RAW(1)", "RAW(16)", "BLOB", "CLOB",
    "LONG", "LONG RAW", "DATE", "TIMESTAMP(6)", "TIMESTAMP WITH TIME ZONE", "NCHAR(4)", "XMLTYPE",
    "JSON", "INTERVAL DAY TO SECOND", "BINARY_DOUBLE", "FLOAT(126)", "SDO_GEOMETRY", "BOOLEAN",
    "string",
)


def _pick(key: str, values: tuple[str, ...]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE CAST({key} % {len(values)} AS int) {whens} END"


COLUMN_CASES = f"""SELECT o_orderkey AS case_id, {_pick("o_orderkey", _COLUMN_NAMES)} AS column_name,
  {_pick("o_custkey", _TYPES)} AS data_type FROM orders"""

CORPUS = (
    "SELECT 'documents' AS src, CAST(doc_id AS string) AS id, text FROM documents"
    " UNION ALL SELECT 'pages', CAST(page_id AS string), html FROM pages"
    " UNION ALL SELECT 'conversations', CAST(conv_id AS string) || ':' || CAST(turn AS string), text"
    " FROM conversations"
    " UNION ALL SELECT 'notes', CAST(cont_id AS string), note FROM notes"
    " UNION ALL SELECT 'variants', CAST(var_id AS string), txt FROM variants"
    + "".join(
        f" UNION ALL SELECT '{c}', CAST(cont_id AS string), {c} FROM contacts" for c in CONTACT_VALUES
    )
)

VIEWS = {
    "contacts": CONTACTS,
    "notes": NOTES,
    "query_log": QUERY_LOG,
    "variants": VARIANTS,
    "column_cases": COLUMN_CASES,
    "corpus": CORPUS,
}


def needed(name: str) -> list[str]:
    """The views a view or statement reads, in an order in which they can be defined."""
    found: list[str] = []

    def visit(text: str) -> None:
        for view, body in VIEWS.items():
            if re.search(rf"\bFROM {view}\b", text) and view not in found:
                visit(body)
                found.append(view)

    visit(VIEWS.get(name, name))
    return found + [name] if name in VIEWS else found


def with_views(sql: str, extra: str = "") -> str:
    """A statement for DuckDB with the views it needs in front."""
    ctes = [f"{v} AS ({VIEWS[v]})" for v in needed(extra + sql)]
    if extra:
        ctes.append(extra)
    return (f"WITH {', '.join(ctes)} " if ctes else "") + sql


INPUTS = {
    "contacts": ("customer",),
    "notes": ("contacts",),
    "query_log": ("events",),
    "variants": ("customer",),
    "column_cases": ("orders",),
}

# a short row of the input becomes many texts to search; the inputs of these views are dealt over all cores first
DEALT = ("contacts", "variants")


def frame(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view or a table as DataFrame."""
    return view(spark, folder, name) if name in VIEWS else scan_table(spark, name, folder)


def statement(spark: SparkSession, folder: str, text: str, inputs: tuple[str, ...], dealt: bool = False) -> DataFrame:
    """Run SQL text over the named views and tables, without touching the session's own views."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in inputs:
        text = re.sub(rf"\bFROM {name}\b", f"FROM {{{name}}}", text)
    frames = {name: frame(spark, folder, name) for name in inputs}
    return spark.sql(text, **{name: spread(df) if dealt else df for name, df in frames.items()})


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view as DataFrame over the Parquet tables of ``folder``."""
    if name == "corpus":
        return _corpus(spark, folder)
    return statement(spark, folder, VIEWS[name], INPUTS[name], name in DEALT)


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    """As the view ``corpus``, with the contact values unpivoted in one pass over the customers."""
    head = CORPUS.split(" UNION ALL SELECT 'cont_firstname'")[0]
    texts = statement(
        spark, folder, head, ("documents", "pages", "conversations", "notes", "variants")
    )
    values = (
        view(spark, folder, "contacts")
        .unpivot(["cont_id"], list(CONTACT_VALUES), "src", "text")
        .selectExpr("src", "CAST(cont_id AS string) AS id", "text")
    )
    return texts.unionByName(values)
