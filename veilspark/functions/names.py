"""Rules on column names and types, as SQL expressions over a table of columns.

A lake can hold millions of columns, so these run as one projection over a catalog DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: endings of personal-data column names ---------------------------------------
PII_NAME_ENDINGS = (
    "FIRST_?NAME", "LAST_?NAME", "SURNAME", "FORENAME", "GIVEN_?NAME", "FAMILY_?NAME", "FULL_?NAME",
    "MIDDLE_?NAME", "EMAIL(_ADDR(ESS)?)?", "PHONE(_NO|_NUM|_NUMBER)?", "MOBILE(_NO|_NUM|_NUMBER)?",
    "FAX(_NO|_NUM|_NUMBER)?", "POST_?CODE", "ZIP(_CODE)?", "ADDR(ESS)?(_LINE[0-9])?", "DOB",
    "DATE_OF_BIRTH", "NI_?(NO|NUMBER)?", "SSN", "PASSPORT(_NO|_NUMBER)?",
)

# --- fixed values: entity of a column name or of its last words ---------------------------------
ENTITY_NAMES = {
    "EMAIL_ADDRESS": ("EMAIL", "EMAIL_ADDR", "EMAIL_ADDRESS"),
    "PERSON": (
        "FIRSTNAME", "FIRST_NAME", "LASTNAME", "LAST_NAME", "SURNAME", "FORENAME", "GIVENNAME",
        "GIVEN_NAME", "FULLNAME", "FULL_NAME", "MIDDLENAME", "MIDDLE_NAME",
    ),
    "PHONE_NUMBER": (
        "PHONE", "PHONE_NO", "PHONE_NUM", "PHONE_NUMBER", "MOBILE", "MOBILE_NO", "MOBILE_NUM",
        "MOBILE_NUMBER", "FAX", "FAX_NO", "FAX_NUM", "FAX_NUMBER",
    ),
    "UK_POSTCODE": ("POSTCODE", "POST_CODE"),
    "US_POSTCODE": ("ZIP", "ZIP_CODE"),
    "DATE_OF_BIRTH": ("DOB", "DATE_OF_BIRTH"),
    "UK_NINO": ("NI", "NI_NO", "NI_NUMBER"),
    "US_SSN": ("SSN",),
    "PASSPORT_NUMBER": ("PASSPORT", "PASSPORT_NO", "PASSPORT_NUMBER"),
}

# --- fixed values: people, address and birth-date columns ---------------------------------------
PERSON_EXACT = ("NAME", "FULLNAME", "FULL_NAME")
PERSON_ENDINGS = (
    "FIRSTNAME", "FIRST_NAME", "FORENAME", "FORE_NAME", "GIVENNAME", "GIVEN_NAME", "LASTNAME",
    "LAST_NAME", "SURNAME", "FAMILYNAME", "FAMILY_NAME", "MIDDLENAME", "MIDDLE_NAME", "MIDDLEINITIAL",
    "MIDDLE_INITIAL", "FULLNAME", "FULL_NAME", "PREFERREDNAME", "PREFERRED_NAME", "KNOWNNAME",
    "KNOWN_NAME", "INITIALS",
)
# technical names: whole column names that end in _NAME but name no person. Those without an underscore
# (FILENAME, HOSTNAME, USERNAME and the like) do not end in _NAME and need no entry.
TECHNICAL_NAMES = (
    "FILE_NAME", "TABLE_NAME", "SCHEMA_NAME", "COLUMN_NAME", "INDEX_NAME", "OBJECT_NAME", "ROLE_NAME", "TYPE_NAME",
    "PROC_NAME", "FUNC_NAME", "EVENT_NAME", "CLASS_NAME", "HOST_NAME", "SERVER_NAME", "DB_NAME", "APP_NAME",
    "QUEUE_NAME", "TOPIC_NAME",
)
ADDRESS_ENDINGS = (
    "ADDRESSLINE1", "ADDRESSLINE2", "ADDRESSLINE3", "ADDRESS_LINE1", "ADDRESS_LINE2", "ADDRESS_LINE3",
    "ADDRESS1", "ADDRESS2", "ADDRESS3", "STREETADDRESS", "STREET_ADDRESS", "STREET", "CITY", "TOWN",
    "COUNTY", "DISTRICT", "REGION", "STATE", "COUNTRY", "COUNTRYCODE", "COUNTRY_CODE", "POSTCODE",
    "POST_CODE", "POSTALCODE", "POSTAL_CODE", "ZIPCODE", "ZIP_CODE",
)
BIRTH_ENDINGS = (
    "DOB", "DATEOFBIRTH", "DATE_OF_BIRTH", "BIRTHDATE", "BIRTH_DATE", "BIRTHDAY", "BIRTH_DAY",
)

# --- fixed values: whole column names (less one known prefix) that give an entity ----------------
HINT_PREFIXES = ("CONT_", "TBL_", "TMP_", "STG_", "RAW_")
HINT_NAMES = {
    "EMAIL_ADDRESS": ("EMAIL", "EMAIL_?ADDRESS", "E_?MAIL", "CONTACT_?EMAIL"),
    "PHONE_NUMBER": ("PHONE", "TELEPHONE", "MOBILE", "CELL_?PHONE", "TEL_?NO", "PHONE_?NUMBER"),
    "UK_POSTCODE": ("POSTCODE", "POSTAL_?CODE", "ZIP", "ZIP_?CODE"),
    "UK_NINO": ("NINO", "NATIONAL_?INSURANCE", "NI_?NUMBER"),
    "UK_NHS_NUMBER": ("NHS", "NHS_?NUMBER", "HEALTH_?NUMBER"),
    "CREDIT_CARD": ("CREDIT_?CARD", "CC_?NUMBER", "CARD_?NUMBER", "CC"),
    "IBAN": ("IBAN", "BANK_?ACCOUNT", "ACCOUNT_?IBAN"),
    "IP_ADDRESS_V4": ("IP_?ADDRESS", "IP", "IP_?V4", "HOST_?IP"),
    "IP_ADDRESS_V6": ("IPV6", "IP_?V6"),
    "DATE_OF_BIRTH": ("DOB", "DATE_?OF_?BIRTH", "BIRTH_?DATE", "BIRTHDAY"),
    "PERSON": (
        "NAME", "FIRST_?NAME", "LAST_?NAME", "FULL_?NAME", "SURNAME", "FORENAME", "GIVEN_?NAME",
    ),
    "US_SSN": ("SSN", "SOCIAL_?SECURITY", "SSN_?NUMBER"),
    "PASSPORT_NUMBER": ("PASSPORT", "PASSPORT_?NUMBER", "PASSPORT_?NO"),
}
HINT_SCORE = 0.85

# --- fixed values: scan policies ----------------------------------------------------------------
SAFE, NAME_ONLY, FULL = "safe", "name_only", "full"
STRIP, TRUNCATE_SCAN = "strip", "truncate_scan"


def _any(words) -> str:
    return "|".join(words)


def is_pii_column(name: str) -> str:
    return rf"rlike(upper({name}), r'(^|_)(?:{_any(PII_NAME_ENDINGS)})\z')"


def column_entity(name: str) -> str:
    """Entity by whole name or by the words after an underscore; the longest ending wins; '' if none."""
    endings = [w for words in ENTITY_NAMES.values() for w in words]
    # a search takes the leftmost match, which at a fixed end is the longest ending
    found = rf"regexp_extract(upper({name}), r'(?:^|_)({_any(endings)})\z', 1)"
    cases = " ".join(
        f"WHEN {found} IN ({', '.join(repr(w) for w in words)}) THEN '{entity}'"
        for entity, words in ENTITY_NAMES.items()
    )
    return f"CASE {cases} ELSE '' END"


def entity_dictionary(spark: SparkSession) -> DataFrame:
    """The built-in endings of column names as a table (ending, entity), to be extended or replaced."""
    rows = [(word, entity) for entity, words in ENTITY_NAMES.items() for word in words]
    return spark.createDataFrame(rows, "ending string, entity string")


def dictionary_entities(columns: DataFrame, dictionary: DataFrame, name: str = "column_name", entity: str = "column_entity") -> DataFrame:
    """``columns`` with the entity that a dictionary (ending, entity) gives each name, '' if none.

    As ``column_entity``, for dictionaries of any size: an ending is the whole name or the words after an underscore, case
    does not count, the longest ending wins, and of an ending that is there twice the first entity by name. Each distinct name gives
    one row per word, these meet the dictionary in an equi-join, and one row per name goes back. Nothing is broadcast
    by hint: Spark does so where it knows a side to be small.
    """
    words = F.split(F.col("name_"), "_")
    ending = F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), "_")))
    names = columns.select(F.upper(name).alias("name_")).filter("name_ IS NOT NULL").distinct()
    known = dictionary.select(F.upper("ending").alias("ending_"), F.col("entity").alias("entity_")).dropna().filter("ending_ <> ''")
    met = names.select("name_", ending.alias("ending_")).join(known, "ending_")
    best = met.groupBy("name_").agg(F.min(F.struct((-F.length("ending_")).alias("n"), "entity_")).alias("best_"))
    joined = columns.withColumn("upper_", F.upper(name)).join(best, F.col("upper_") == F.col("name_"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in columns.columns], F.coalesce("best_.entity_", F.lit("")).alias(entity))


def is_person_column(name: str) -> str:
    n = f"upper({name})"
    return (
        rf"({n} IN ({', '.join(repr(w) for w in PERSON_EXACT)})"
        rf" OR rlike({n}, r'(?:{_any(PERSON_ENDINGS)})\z')"
        rf" OR (endswith({n}, '_NAME') AND {n} NOT IN ({', '.join(repr(w) for w in TECHNICAL_NAMES)})))"
    )


def is_address_column(name: str, strict: bool = False) -> str:
    """``strict`` asks for a word edge, so that CAPACITY is no CITY."""
    edge = "(?:^|_)" if strict else ""
    return rf"rlike(upper({name}), r'{edge}(?:{_any(ADDRESS_ENDINGS)})\z')"


def is_birth_column(name: str) -> str:
    return rf"rlike(upper({name}), r'(?:{_any(BIRTH_ENDINGS)})\z')"


def type_class(data_type: str) -> str:
    """Class of a type name, from a source database or from Spark."""
    t = f"upper({data_type})"
    return rf"""CASE
      WHEN rlike({t}, r'\A(?:(?:NUMBER|FLOAT)(?:\(.*)?|INTEGER|INT|SMALLINT|REAL|BINARY_FLOAT|BINARY_DOUBLE|TINYINT|BIGINT|DOUBLE|DECIMAL(?:\(.*)?)\z') THEN 'numeric'
      WHEN {t} IN ('BOOLEAN', 'RAW(1)', 'CHAR(1)') THEN 'boolean'
      WHEN rlike({t}, r'\AINTERVAL(?: (?:YEAR|MONTH|DAY|HOUR|MINUTE|SECOND)(?: TO (?:MONTH|HOUR|MINUTE|SECOND))?)?\z') THEN 'interval'
      WHEN rlike({t}, r'\A(?:RAW|BLOB|BFILE|LONG RAW|BINARY|RAW\(.*)\z') THEN 'binary'
      WHEN {t} IN ('CLOB', 'NCLOB', 'LONG') THEN 'large_text'
      WHEN rlike({t}, r'\A(?:DATE|TIMESTAMP|TIMESTAMP_NTZ|TIMESTAMP\(.*|TIMESTAMP WITH.*)\z') THEN 'date'
      WHEN rlike({t}, r'\A(?:N?VARCHAR2|N?CHAR|VARCHAR|STRING)') THEN 'text'
      WHEN rlike({t}, r'\A(?:XMLTYPE|JSON|VARIANT|STRUCT<.*|ARRAY<.*|MAP<.*)\z') THEN 'structured'
      ELSE 'other' END"""


def scan_policy(person: str, address: str, birth: str, kind: str) -> str:
    """The name decides first, then the type class ``kind``. Large and structured types are ``truncate_scan``, which
    names the class only: their values are scanned whole."""
    return f"""CASE
      WHEN {person} OR {address} OR {birth} THEN '{NAME_ONLY}'
      WHEN {kind} IN ('numeric', 'boolean', 'interval') THEN '{SAFE}'
      WHEN {kind} = 'binary' THEN '{STRIP}'
      WHEN {kind} = 'date' THEN '{NAME_ONLY}'
      WHEN {kind} IN ('large_text', 'structured') THEN '{TRUNCATE_SCAN}'
      ELSE '{FULL}' END"""


def hint_policy_typed(policy: str, kind: str) -> str:
    """Policy of a result column when its type is known: a number is safe whatever its name."""
    return f"if({kind} = 'numeric', '{SAFE}', {policy})"


def hint_policy_untyped(person: str, address: str, birth: str) -> str:
    """Policy when only a result column's name is known."""
    return f"if({person} OR {address} OR {birth}, '{NAME_ONLY}', '{FULL}')"


def hint_entity_untyped(person: str, address: str, birth: str) -> str:
    return f"""CASE WHEN {person} THEN 'PERSON' WHEN {address} THEN 'UK_POSTCODE'
      WHEN {birth} THEN 'DATE_OF_BIRTH' ELSE '' END"""


def hint_entity_typed(person: str, address: str, birth: str, kind: str, name: str) -> str:
    return f"""CASE WHEN {kind} = 'numeric' THEN ''
      WHEN {person} OR {address} OR {birth} THEN {hint_entity_untyped(person, address, birth)}
      WHEN {is_pii_column(name)} THEN {column_entity(name)} ELSE '' END"""


def name_hint(name: str) -> str:
    """Entity by the whole column name, less one known prefix; '' if none."""
    bare = rf"regexp_replace(upper({name}), r'\A(?:{_any(HINT_PREFIXES)})', '')"
    cases = " ".join(
        rf"WHEN rlike({bare}, r'\A(?:{_any(words)})\z') THEN '{entity}'"
        for entity, words in HINT_NAMES.items()
    )
    return f"CASE {cases} ELSE '' END"


def classify(
    columns: DataFrame,
    name: str = "column_name",
    data_type: str | None = "data_type",
    strict: bool = False,
) -> DataFrame:
    """Add every class to a table of columns; the name rules are evaluated once per column.

    Without ``data_type`` only the names count.
    """
    named = columns.selectExpr(
        "*",
        f"{is_pii_column(name)} AS is_pii",
        f"{column_entity(name)} AS column_entity",
        f"{is_person_column(name)} AS is_person",
        f"{is_address_column(name, strict)} AS is_address",
        f"{is_birth_column(name)} AS is_birth",
        f"{name_hint(name)} AS name_hint",
        *([f"{type_class(data_type)} AS type_class"] if data_type else []),
    )
    flags = ("is_person", "is_address", "is_birth")
    scored = named.withColumn("name_hint_score", F.expr(f"if(name_hint = '', 0.0D, {HINT_SCORE}D)"))
    if data_type is None:
        return scored.selectExpr(
            "*",
            f"{hint_policy_untyped(*flags)} AS hint_policy",
            f"{hint_entity_untyped(*flags)} AS hint_entity",
        )
    with_policy = scored.withColumn("scan_policy", F.expr(scan_policy(*flags, "type_class")))
    return with_policy.selectExpr(
        "*",
        f"{hint_policy_typed('scan_policy', 'type_class')} AS hint_policy",
        f"{hint_entity_typed(*flags, 'type_class', name)} AS hint_entity",
    )
