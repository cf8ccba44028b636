"""What the rules on names and statements must give: fixed values, written a second time for the checks."""

# --- fixed values: column names -----------------------------------------------------------------
PERSON_EXACT = ("NAME", "FULLNAME", "FULL_NAME")
PII_NAME_ENDINGS = (
    "FIRST_?NAME", "LAST_?NAME", "SURNAME", "FORENAME", "GIVEN_?NAME", "FAMILY_?NAME", "FULL_?NAME",
    "MIDDLE_?NAME", "EMAIL(_ADDR(ESS)?)?", "PHONE(_NO|_NUM|_NUMBER)?", "MOBILE(_NO|_NUM|_NUMBER)?",
    "FAX(_NO|_NUM|_NUMBER)?", "POST_?CODE", "ZIP(_CODE)?", "ADDR(ESS)?(_LINE[0-9])?", "DOB",
    "DATE_OF_BIRTH", "NI_?(NO|NUMBER)?", "SSN", "PASSPORT(_NO|_NUMBER)?",
)
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
PERSON_ENDINGS = (
    "FIRSTNAME", "FIRST_NAME", "FORENAME", "FORE_NAME", "GIVENNAME", "GIVEN_NAME", "LASTNAME",
    "LAST_NAME", "SURNAME", "FAMILYNAME", "FAMILY_NAME", "MIDDLENAME", "MIDDLE_NAME", "MIDDLEINITIAL",
    "MIDDLE_INITIAL", "FULLNAME", "FULL_NAME", "PREFERREDNAME", "PREFERRED_NAME", "KNOWNNAME",
    "KNOWN_NAME", "INITIALS",
)
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

# --- fixed values: statements --------------------------------------------------------------------
READ_WORDS = ("SELECT", "WITH")
WRITE_WORDS = (
    "INSERT", "UPDATE", "DELETE", "MERGE", "DROP", "CREATE", "ALTER", "TRUNCATE", "GRANT", "REVOKE",
)
ADVICE_STAR = "Consider selecting only needed columns instead of SELECT *"
ADVICE_LIKE = "Leading wildcards in LIKE predicates prevent index usage"
ADVICE_IN = "Consider using EXISTS instead of IN with subqueries for better performance"
ADVICE_OR = "OR conditions may prevent index usage. Consider UNION ALL of separated queries"
ADVICE_JOINS = ("Query joins ", " tables - consider reviewing join order and conditions")
