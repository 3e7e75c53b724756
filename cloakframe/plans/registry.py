"""Registered queries of the detection and redaction engine, with their oracle SQL.

The test tables hold little personal data by name, so some queries build such columns from
keys, in Spark and in SQL alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cascade, names, validators
from ..functions.rules import PATTERNS
from ..operators import mask as masking
from ..operators import retro, scan
from ..sources import audit, catalog_dumps
from ..streaming import proxy
from .config import Config
from .inspect_sql import masked_sql

DEFAULT = Config()
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _case(value: str, rules: list[tuple[str, str, float]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, '{regex}') THEN '{name}'" for name, regex, _ in rules) + f" ELSE {default} END"


SURE = [r for r in PATTERNS if r[2] >= 0.8]
WEAK = sorted([r for r in PATTERNS if r[2] < 0.8], key=lambda r: -r[2])


# detection and redaction of text


def _outcomes(df: DataFrame, column: str) -> DataFrame:
    found = cascade.judged(df.select(column), {"__v": F.col(column)}, DEFAULT)
    return found.select(F.coalesce("__v.label", F.lit("none")).alias("masked_as"), F.coalesce("__v.pattern", F.lit("none")).alias("warned_as")).groupBy("masked_as", "warned_as").count()


def _outcomes_sql(table: str, column: str) -> str:
    return f"""SELECT coalesce(hit, 'none') AS masked_as, coalesce(CASE WHEN hit IS NULL THEN weak END, 'none') AS warned_as, count(*) AS count
FROM (SELECT {_case(column, SURE)} AS hit, {_case(column, WEAK)} AS weak FROM {table}) GROUP BY ALL"""


def detect_documents(spark, d):
    return _outcomes(read(spark, d, "documents"), "text")


def detect_pages(spark, d):
    return _outcomes(read(spark, d, "pages"), "html")


def mask_documents(spark, d):
    return masking.mask(read(spark, d, "documents").select("doc_id", "text"), DEFAULT).data


def low_confidence_documents(spark, d):
    return masking.mask(read(spark, d, "documents").select("doc_id", "text"), DEFAULT).warnings()


def summary_documents(spark, d):
    return masking.mask(read(spark, d, "documents").select("text"), DEFAULT).counts()


def explain_pages(spark, d):
    found = cascade.judged(read(spark, d, "pages").select("page_id", "html"), {"__v": F.col("html")}, DEFAULT)
    masks = F.col("__v.label").isNotNull()
    return found.select("page_id", F.when(masks, F.col("__v.step")).alias("step"), F.col("__v.label").alias("label"))


# check digits


def _digits(key: Column, size: int) -> Column:
    """A number of ``size`` digits that looks random, from a key."""
    return F.lpad(((key * 2654435761 + 97) % 10**size).cast("string"), size, "0")


def _digits_sql(key: str, size: int) -> str:
    return f"lpad((({key} * 2654435761 + 97) % {10**size})::VARCHAR, {size}, '0')"


def _checked(df: DataFrame, key: str, value: Column, check) -> DataFrame:
    return df.select(F.col(key).alias("id"), value.alias("value")).select("id", "value", check(F.col("value")).alias("valid"))


def luhn_orders(spark, d):
    return _checked(read(spark, d, "orders"), "o_orderkey", F.concat(F.lit("4"), _digits(F.col("o_orderkey"), 15)), validators.is_card)


def abn_orders(spark, d):
    return _checked(read(spark, d, "orders"), "o_orderkey", _digits(F.col("o_orderkey"), 11), validators.is_abn)


def medicare_orders(spark, d):
    return _checked(read(spark, d, "orders"), "o_orderkey", _digits(F.col("o_orderkey"), 10), validators.is_medicare)


def _parted(key: Column) -> Column:
    n = _digits(key, 9)
    return F.concat_ws("-", F.substring(n, 1, 3), F.substring(n, 4, 3), F.substring(n, 7, 3))


def tfn_orders(spark, d):
    return _checked(read(spark, d, "orders"), "o_orderkey", _parted(F.col("o_orderkey")), validators.is_tfn)


def ird_orders(spark, d):
    return _checked(read(spark, d, "orders"), "o_orderkey", _parted(F.col("o_orderkey")), validators.is_ird)


def _nhi(key: Column) -> Column:
    letter = lambda n: F.substring(F.lit("ABCDEFGHJKLMNPQRSTUVWXYZ"), ((key * (7 + 2 * n)) % 24 + 1).cast("int"), F.lit(1))
    return F.concat(letter(1), letter(2), letter(3), _digits(key, 4))


def nhi_orders(spark, d):
    return _checked(read(spark, d, "orders"), "o_orderkey", _nhi(F.col("o_orderkey")), validators.is_nhi)


def _dot_sql(weights: list[int]) -> str:
    return "(" + " + ".join(f"substr(n, {k}, 1)::INT * {w}" for k, w in enumerate(weights, 1)) + ")"


def _check_sql(value: str, bare: str, rule: str) -> str:
    return f"SELECT id, value, {rule} AS valid FROM (SELECT *, {bare} AS n FROM (SELECT o_orderkey AS id, {value} AS value FROM orders))"


_PARTED_SQL = f"substr({_digits_sql('o_orderkey', 9)}, 1, 3) || '-' || substr({_digits_sql('o_orderkey', 9)}, 4, 3) || '-' || substr({_digits_sql('o_orderkey', 9)}, 7, 3)"
_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
_NHI_SQL = " || ".join(f"substr('{_LETTERS}', ((o_orderkey * {7 + 2 * n}) % 24 + 1)::INT, 1)" for n in (1, 2, 3)) + f" || {_digits_sql('o_orderkey', 4)}"
_LUHN_SQL = "(" + " + ".join(f"(CASE WHEN substr(n, {k}, 1)::INT > 4 THEN substr(n, {k}, 1)::INT * 2 - 9 ELSE substr(n, {k}, 1)::INT * 2 END)" if k % 2 else f"substr(n, {k}, 1)::INT" for k in range(1, 17)) + ") % 10 = 0"
_NHI_SUM = "(" + " + ".join(f"strpos('{_LETTERS}', substr(n, {k}, 1)) * {w}" for k, w in ((1, 7), (2, 6), (3, 5))) + " + " + " + ".join(f"substr(n, {k}, 1)::INT * {w}" for k, w in ((4, 4), (5, 3), (6, 2))) + ")"
_IRD_SQL = f"""CASE WHEN (11 - {_dot_sql(validators.IRD_WEIGHTS)} % 11) % 11 <> 10 THEN (11 - {_dot_sql(validators.IRD_WEIGHTS)} % 11) % 11
 ELSE (11 - {_dot_sql(validators.IRD_SECOND_WEIGHTS)} % 11) % 11 END = substr(n, 9, 1)::INT"""


# names


def classify_names(spark, d):
    """Names of all test tables and of a made-up schema, classified as data."""
    made = [("people", n) for n in MADE_NAMES]
    real = catalog_dumps.of_frames(spark, {t: read(spark, d, t) for t in TABLES})
    pairs = real.unionByName(spark.createDataFrame(made, "table_name string, column_name string"))
    return pairs.select("table_name", "column_name", names.classify_column(F.col("column_name")).alias("label"))


MADE_NAMES = {
    "userEmail": "email", "SSNField": "ssn", "dateOfBirth": "dob", "country_of_birth": "lob", "first_names": "name", "product_name": None, "mail_at": None,
    "sex_at_birth": "gender", "zip_code": "address", "licence_number": "license", "account_name": "name", "customerNumber": "id", "next_of_kin": "next_of_kin", "face-scan": "biometric", "city": None,
}
#: Names of the test tables that have a type.
REAL_HITS = {("events", "user_id"): "id"}


def _columns_sql() -> str:
    """Table and column names as DuckDB knows them."""
    return "SELECT table_name, column_name FROM duckdb_columns() WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"


def _made_sql() -> str:
    return ", ".join(f"('people', '{n}', {f"'{t}'" if t else 'NULL'})" for n, t in MADE_NAMES.items())


CLASSIFY_SQL = f"""SELECT table_name, column_name, CASE WHEN table_name = 'events' AND column_name = 'user_id' THEN 'id' END AS label FROM ({_columns_sql()})
UNION ALL SELECT * FROM (VALUES {_made_sql()})"""


def _catalog(spark, d):
    return catalog_dumps.of_frames(spark, {t: read(spark, d, t) for t in TABLES})


def scan_risk(spark, d):
    return scan.risk(_catalog(spark, d))


def scan_by_category(spark, d):
    made = spark.createDataFrame([("people", n) for n in MADE_NAMES], "table_name string, column_name string")
    return scan.by_category(_catalog(spark, d).unionByName(made))


def scan_by_label(spark, d):
    return scan.by_label(_catalog(spark, d)).select("category", "label", "count")


# named columns, hashing, nested data


def _people(spark, d):
    """Customers with columns that look like a person's."""
    c, key = read(spark, d, "customer"), F.col("c_custkey")
    card = F.concat(F.lit("4"), _digits(key, 15))
    return c.select(
        key.alias("id"), F.col("c_name").alias("full_name"), F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com")).alias("contact"),
        F.when(key % 3 == 0, card).otherwise(F.col("c_mktsegment")).alias("reference"), F.col("c_mktsegment").alias("segment"),
    )


_PEOPLE_SQL = f"""(SELECT c_custkey AS id, c_name AS full_name, 'user' || c_custkey || '@example.com' AS contact,
 CASE WHEN c_custkey % 3 = 0 THEN '4' || {_digits_sql("c_custkey", 15)} ELSE c_mktsegment END AS reference, c_mktsegment AS segment FROM customer)"""
_IS_CARD = f"(regexp_full_match(reference, '[0-9]{{16}}') AND (SELECT {_LUHN_SQL} FROM (SELECT CASE WHEN regexp_full_match(reference, '[0-9]{{16}}') THEN reference ELSE '0000000000000001' END AS n)))"


def mask_customers(spark, d):
    return masking.mask(_people(spark, d), DEFAULT).data


def summary_customers(spark, d):
    return masking.mask(_people(spark, d), DEFAULT).counts()


def _fnv_sql(value: str, salt: str) -> str:
    step = "((xor(a, b)::HUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT"
    raw = f"list_transform(generate_series(1, 2 * (1 + octet_length(encode({value}))) - 1, 2), lambda i: ('0x' || substr('00' || hex(encode({value})), i, 2))::UBIGINT)"
    first = 14695981039346656037
    for b in salt.encode():
        first = ((first ^ b) * 1099511628211) % 2**64
    return f"list_reduce({raw}, lambda a, b: {step}, {first}::UBIGINT)"


def hash_customers(spark, d):
    return masking.mask(read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("full_name")), Config(hash_values=True, hash_salt="pepper")).data


HASH_SQL = f"SELECT c_custkey, '[PII:name:' || lower(lpad(to_hex((xor(h, h >> 32)) & 4294967295), 8, '0')) || ']' AS full_name FROM (SELECT c_custkey, {_fnv_sql('c_name', 'pepper')} AS h FROM customer)"


def pseudonym_join(spark, d):
    """Orders a customer, joined on pseudonyms only: on all 64 bits, as eight digits are shared by different customers."""
    hashed = Config(hash_values=True, hash_salt="pepper", hash_digits=16)
    padded = lambda text: F.lpad(text, F.greatest(F.length(text), F.lit(9)), "0")  # noqa: E731  a key of more digits is not cut
    key = lambda c: F.concat(F.lit("Customer#"), padded(F.col(c).cast("string"))).alias("full_name")
    left = masking.mask(read(spark, d, "customer").select(key("c_custkey"), "c_mktsegment"), hashed).data
    right = masking.mask(read(spark, d, "orders").select(key("o_custkey"), "o_totalprice"), hashed).data
    return left.join(right, "full_name").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"))


def mask_nested_customers(spark, d):
    people = _people(spark, d).select("id", F.struct("full_name", F.col("contact").alias("note")).alias("person"), F.array("reference", "segment").alias("refs"), F.create_map(F.lit("email"), F.col("segment"), F.lit("other"), F.col("contact")).alias("attributes"))
    out = masking.mask(people, DEFAULT).data
    return out.select("id", "person.full_name", "person.note", F.element_at("refs", 1).alias("ref1"), F.element_at("refs", 2).alias("ref2"), F.col("attributes")["email"].alias("attr_email"), F.col("attributes")["other"].alias("attr_other"))


def mask_events_props(spark, d):
    """JSON text in a column, with an address added to it."""
    props = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "by": "u'), F.col("user_id").cast("string"), F.lit('@example.com"}'))
    return masking.mask(read(spark, d, "events").select("event_id", props.alias("props")), DEFAULT).data


def mask_json_customers(spark, d):
    made = _people(spark, d).select("id", F.concat(F.lit('{"email":"'), F.col("contact"), F.lit('","segment":"'), F.col("segment"), F.lit('","n":1.50}')).alias("payload"))
    return masking.mask(made, DEFAULT, json_columns={"payload"}).data


def mask_payload_rows(spark, d):
    """Columnar payloads in envelope mode."""
    made = _people(spark, d).select("id", F.concat(F.lit('{"columns":["id","email"],"rows":[['), F.col("id").cast("string"), F.lit(',"'), F.col("segment"), F.lit('"]]}')).alias("payload"))
    return masking.mask_payloads(made, "payload", Config(include_summary=False)).select("id", "masked.value", "masked.total")


# queries as text


def masked_sql_alias(spark, d):
    read(spark, d, "customer").createOrReplaceTempView("cf_customer")
    sql = "SELECT c_custkey AS id, c_name AS label, upper(c_mktsegment) AS segment FROM cf_customer "
    return masked_sql(spark, sql, Config(denylist=("c_name",)))


def masked_sql_allowed(spark, d):
    read(spark, d, "customer").createOrReplaceTempView("cf_customer")
    sql = "SELECT c_custkey AS id, c_name AS full_name, 'a' || c_custkey || '@b.org' AS email FROM cf_customer"
    return masked_sql(spark, sql, Config(allowlist=("full_name", "EMAIL")))


def masked_sql_lineage(spark, d):
    read(spark, d, "customer").createOrReplaceTempView("cf_customer")
    sql = "SELECT c_custkey AS id, lower(c_name) AS label FROM cf_customer UNION ALL SELECT c_custkey, c_mktsegment FROM cf_customer"
    return masked_sql(spark, sql, Config(denylist=("c_name",)), by_lineage=True)


# audit log


def _events(spark, d):
    """Audit events made from the event table; every 97th line is broken."""
    e = read(spark, d, "events")
    n = F.col("event_id") % 4
    types = F.concat(F.lit('{"email":'), (n + 1).cast("string"), F.when(F.col("event_id") % 5 == 0, F.lit(',"ssn":2')).otherwise(F.lit("")), F.lit(',"colour":1}'))
    line = F.concat(F.lit('{"ts":'), F.col("event_id").cast("string"), F.lit(',"path":"run","tool":"'), F.col("event_type"), F.lit('","fields_redacted":'), n.cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"overhead_us":'), (F.col("event_id") % 100).cast("string"))).otherwise(F.lit("")), F.lit(',"types":'), types, F.lit("}"))
    return audit.parse(e.select(F.when(F.col("event_id") % 97 == 0, F.lit("{broken")).otherwise(line).alias("value")))


_EVENTS_SQL = "(SELECT event_id, event_type AS tool, event_id % 4 AS fields, CASE WHEN event_id % 2 = 0 THEN event_id % 100 ELSE 0 END AS us, event_id % 97 = 0 AS bad FROM events)"
_TYPES_SQL = f"""(SELECT 'email' AS label, sum(fields + 1)::BIGINT AS n, 'Contact' AS category FROM {_EVENTS_SQL} WHERE NOT bad
 UNION ALL SELECT 'ssn', sum(2)::BIGINT, 'Government IDs' FROM {_EVENTS_SQL} WHERE NOT bad AND event_id % 5 = 0
 UNION ALL SELECT 'colour', count(*), 'Other' FROM {_EVENTS_SQL} WHERE NOT bad)"""


def retro_totals(spark, d):
    return retro.totals(_events(spark, d)).withColumns({c: F.round(c, 6) for c in ("hit_rate", "mean_overhead_ms")})


def retro_by_tool(spark, d):
    return retro.by_tool(_events(spark, d)).withColumn("hit_rate", F.round("hit_rate", 6))


def retro_top_types(spark, d):
    return retro.top_types(_events(spark, d)).withColumn("share", F.round("share", 6))


# message streams


def _messages(spark, d):
    """Requests, answers and other lines, made from conversations."""
    c = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session"), (F.col("turn") * 2).alias("seq"), F.col("turn").cast("string").alias("id"))
    method = F.when(F.col("id").cast("long") % 3 == 2, F.lit("tools/list")).otherwise(F.lit("tools/call"))
    ask = c.select("session", "seq", F.concat(F.lit('{"jsonrpc":"2.0","id":'), "id", F.lit(',"method":"'), method, F.lit('"}')).alias("value"))
    answer = c.select("session", (F.col("seq") + 1).alias("seq"), F.concat(F.lit('{"jsonrpc":"2.0","id":'), "id", F.lit(',"result":{"email":"x'), "session", F.lit('"}}')).alias("value"))
    return ask.unionByName(answer)


def proxy_messages(spark, d):
    return proxy.proxy_batch(_messages(spark, d).dropDuplicates(["session", "seq"]), Config(include_summary=False)).select("session", "seq", "value", "total")


_ANSWER = """'{"jsonrpc":"2.0","id":' || turn || ',"result":{"email":"' || """
PROXY_SQL = f"""WITH c AS (SELECT DISTINCT conv_id::VARCHAR AS session, turn FROM conversations)
SELECT session, turn * 2 AS seq, '{{"jsonrpc":"2.0","id":' || turn || ',"method":"' || CASE WHEN turn % 3 = 2 THEN 'tools/list' ELSE 'tools/call' END || '"}}' AS value, 0::BIGINT AS total FROM c
UNION ALL SELECT session, turn * 2 + 1, {_ANSWER} CASE WHEN turn % 3 = 2 THEN 'x' || session ELSE '[PII:email]' END || '"}}}}', CASE WHEN turn % 3 = 2 THEN 0 ELSE 1 END FROM c"""


QUERIES = {
    f.__name__: f
    for f in (
        detect_documents, detect_pages, mask_documents, low_confidence_documents, summary_documents, explain_pages, luhn_orders, abn_orders, medicare_orders, tfn_orders,
        ird_orders, nhi_orders, classify_names, scan_risk, scan_by_category, scan_by_label, mask_customers, summary_customers, hash_customers, pseudonym_join,
        mask_nested_customers, mask_events_props, mask_json_customers, mask_payload_rows, masked_sql_alias, masked_sql_allowed, masked_sql_lineage, retro_totals, retro_by_tool, retro_top_types, proxy_messages,
    )
}

_HIT = _case("text", SURE)
_CARD = f"CASE WHEN {_IS_CARD} THEN '[PII:credit_card]' ELSE reference END"
SQL = {
    "detect_documents": _outcomes_sql("documents", "text"),
    "detect_pages": _outcomes_sql("pages", "html"),
    "mask_documents": f"SELECT doc_id, coalesce('[PII:' || {_HIT} || ']', text) AS text FROM documents",
    "low_confidence_documents": f"SELECT 'text' AS \"column\", weak AS pattern, max(score) AS score, count(*) AS count FROM (SELECT {_HIT} AS hit, {_case('text', WEAK)} AS weak, CASE " + " ".join(f"WHEN regexp_matches(text, '{r}') THEN {s}::DOUBLE" for _, r, s in WEAK) + " END AS score FROM documents) WHERE hit IS NULL AND weak IS NOT NULL GROUP BY ALL",
    "summary_documents": f"SELECT hit AS label, count(*) AS count FROM (SELECT {_HIT} AS hit FROM documents) WHERE hit IS NOT NULL GROUP BY ALL",
    "explain_pages": f"SELECT page_id, CASE WHEN hit IS NOT NULL THEN 'pattern' END AS step, hit AS label FROM (SELECT page_id, {_case('html', SURE)} AS hit FROM pages)",
    "luhn_orders": _check_sql(f"'4' || {_digits_sql('o_orderkey', 15)}", "value", _LUHN_SQL),
    "abn_orders": _check_sql(_digits_sql("o_orderkey", 11), "value", f"substr(n, 1, 1) <> '0' AND ({_dot_sql(validators.ABN_WEIGHTS)} - 10) % 89 = 0"),
    "medicare_orders": _check_sql(_digits_sql("o_orderkey", 10), "value", f"substr(n, 1, 1)::INT BETWEEN 2 AND 6 AND {_dot_sql(validators.MEDICARE_WEIGHTS)} % 10 = substr(n, 9, 1)::INT"),
    "tfn_orders": _check_sql(_PARTED_SQL, "replace(value, '-', '')", f"{_dot_sql(validators.TFN_WEIGHTS)} % 11 = 0"),
    "ird_orders": _check_sql(_PARTED_SQL, "replace(value, '-', '')", _IRD_SQL),
    "nhi_orders": _check_sql(_NHI_SQL, "value", f"(11 - {_NHI_SUM} % 11) % 11 = substr(n, 7, 1)::INT"),
    "classify_names": CLASSIFY_SQL,
    "scan_risk": f"SELECT 'LOW' AS risk_level, count(DISTINCT table_name) AS tables_scanned, count(*) AS columns_scanned, count(*) FILTER (table_name = 'events' AND column_name = 'user_id') AS pii_columns, count(*) FILTER (NOT (table_name = 'events' AND column_name = 'user_id')) AS non_pii_columns, round(100.0 / count(*), 1) AS pii_percentage FROM ({_columns_sql()})",
    "scan_by_category": "SELECT * FROM (VALUES ('Names', 'elevated', 2::BIGINT, 15.4::DOUBLE), ('Demographics', 'standard', 1, 7.7), ('Government IDs', 'critical', 2, 15.4), ('Contact', 'elevated', 1, 7.7), ('Date of birth', 'elevated', 1, 7.7), ('Location of birth', 'elevated', 1, 7.7), ('Address & location', 'standard', 1, 7.7), ('Online & technical', 'standard', 2, 15.4), ('Biometric', 'critical', 1, 7.7), ('Family & relationships', 'elevated', 1, 7.7)) t(category, sensitivity, count, share)",
    "scan_by_label": f"SELECT CASE WHEN hit THEN 'Online & technical' ELSE 'No PII' END AS category, CASE WHEN hit THEN 'id' ELSE 'No PII' END AS label, count(*) AS count FROM (SELECT table_name = 'events' AND column_name = 'user_id' AS hit FROM ({_columns_sql()})) GROUP BY hit",
    "mask_customers": f"SELECT id, '[PII:name]' AS full_name, '[PII:email]' AS contact, {_CARD} AS reference, segment FROM {_PEOPLE_SQL}",
    "summary_customers": f"SELECT label, count(*) AS count FROM (SELECT unnest(CASE WHEN {_IS_CARD} THEN ['name', 'email', 'credit_card'] ELSE ['name', 'email'] END) AS label FROM {_PEOPLE_SQL}) GROUP BY ALL",
    "hash_customers": HASH_SQL,
    "pseudonym_join": "SELECT c_mktsegment, count(*) AS orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL",
    "mask_nested_customers": f"SELECT id, '[PII:name]' AS full_name, '[PII:email]' AS note, {_CARD} AS ref1, segment AS ref2, '[PII:email]' AS attr_email, '[PII:email]' AS attr_other FROM {_PEOPLE_SQL}",
    "mask_events_props": """SELECT event_id, '{"k":' || regexp_extract(props, '[0-9]+') || ',"by":"[PII:email]"}' AS props FROM events""",
    "mask_json_customers": f"""SELECT id, '{{"email":"[PII:email]","segment":"' || segment || '","n":1.50}}' AS payload FROM {_PEOPLE_SQL}""",
    "mask_payload_rows": f"""SELECT id, '{{"columns":["id","email"],"rows":[[' || id || ',"[PII:email]"]]}}' AS value, 1::BIGINT AS total FROM {_PEOPLE_SQL}""",
    "masked_sql_alias": "SELECT c_custkey AS id, '[PII:c_name]' AS label, upper(c_mktsegment) AS segment FROM customer ",
    "masked_sql_allowed": "SELECT c_custkey AS id, c_name AS full_name, '[PII:email]' AS email FROM customer",
    "masked_sql_lineage": "SELECT c_custkey AS id, '[PII:c_name]' AS label FROM customer UNION ALL SELECT c_custkey, '[PII:c_name]' FROM customer",
    "retro_totals": f"SELECT count(*) FILTER (NOT bad) AS queries, count(*) FILTER (NOT bad AND fields > 0) AS queries_with_pii, (sum(fields) FILTER (NOT bad))::BIGINT AS fields_redacted, round(100.0 * count(*) FILTER (NOT bad AND fields > 0) / count(*) FILTER (NOT bad), 6) AS hit_rate, round((avg(us) FILTER (NOT bad AND us > 0)) / 1000.0, 6) AS mean_overhead_ms, count(*) FILTER (bad) AS malformed FROM {_EVENTS_SQL}",
    "retro_by_tool": f"SELECT tool, count(*) AS queries, count(*) FILTER (fields > 0) AS queries_with_pii, round(100.0 * count(*) FILTER (fields > 0) / count(*), 6) AS hit_rate FROM {_EVENTS_SQL} WHERE NOT bad GROUP BY tool",
    "retro_top_types": f"SELECT label, category, n AS count, round(100.0 * n / sum(n) OVER (), 6) AS share FROM {_TYPES_SQL}",
    "proxy_messages": PROXY_SQL,
}
