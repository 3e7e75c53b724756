"""Registered queries of sources, sinks, inspection, reports and streams, with their oracle SQL.

The oracle's values are written out: none of them is made from the tables of rules.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql_functions
from ..operators import mask as masking
from ..operators import retro, scan
from ..sources import audit, catalog_dumps, embedded, payloads
from ..sources.work import work_folder
from ..streaming import proxy
from .config import Config, QueryRejected, validate
from .inspect_sql import inspect, masked_sql, run_masked_sql
from .registry import MADE_NAMES, TABLES, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _made(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


# sources and sinks


def _payload(spark: SparkSession, d: str) -> DataFrame:
    """One JSON payload a nation: an array of objects with a name that is masked."""
    n = read(spark, d, "nation")
    text = F.concat(F.lit('{"rows":[{"id":'), F.col("n_nationkey").cast("string"), F.lit(',"full_name":"'), "n_name", F.lit('"}],"count":1}'))
    return n.select(text.alias("value"))


_NATION_OUT = """'{"rows":[{"id":' || n_nationkey || ',"full_name":"[PII:name]"}],"count":1}'"""


@_query(f"SELECT {_NATION_OUT} AS value, 1::BIGINT AS total FROM nation")
def source_payload_files(spark, d):
    """Payloads that another program wrote, one a file."""
    folder = work_folder(spark, "payloads")
    _payload(spark, d).repartition(25, "value").write.text(folder)
    every = payloads.payload_files(spark, folder)
    one = every.select(F.explode(F.split("value", "\n")).alias("value")).where("value <> ''")  # a file has several where keys meet in a task
    return masking.mask_payloads(one, "value", Config(include_summary=False)).select("masked.value", "masked.total")


@_query(f"SELECT {_NATION_OUT} AS value, 1::BIGINT AS total FROM nation UNION ALL SELECT 'plain ' || n_name, 0 FROM nation")
def source_lines(spark, d):
    """One payload a line; a line that is no JSON passes unchanged."""
    folder = work_folder(spark, "lines")
    text = _payload(spark, d).unionByName(read(spark, d, "nation").select(F.concat(F.lit("plain "), "n_name").alias("value")))
    text.write.text(folder)
    return masking.mask_payloads(payloads.lines(spark, folder), "value", Config(include_summary=False)).select("masked.value", "masked.total")


def _delimited(spark, d, sep):
    folder = work_folder(spark, "delimited")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("last_name"), F.concat(F.lit('a"'), F.lit(sep), F.col("c_mktsegment")).alias("note"))
    c.write.option("header", True).option("escape", '"').option("sep", sep).csv(folder)
    return masking.mask(payloads.delimited(spark, folder, sep), json_columns=set()).data


@_query("""SELECT c_custkey::VARCHAR AS id, '[PII:name]' AS last_name, 'a",' || c_mktsegment AS note FROM customer""")
def source_csv(spark, d):
    return _delimited(spark, d, ",")


@_query("""SELECT c_custkey::VARCHAR AS id, '[PII:name]' AS last_name, 'a"' || chr(9) || c_mktsegment AS note FROM customer""")
def source_tsv(spark, d):
    return _delimited(spark, d, "\t")


@_query("SELECT c_custkey AS ID, '[PII:name]' AS FULL_NAME, c_mktsegment AS SEGMENT FROM customer WHERE c_custkey >= 10")
def source_database(spark, d):
    """The result of a query in a database, which executors read from the shared folder."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("FULL_NAME"), F.col("c_mktsegment").alias("SEGMENT"))
    url = embedded.packed(spark, c, "PEOPLE", "ID bigint, FULL_NAME clob, SEGMENT clob")
    found = payloads.database(spark, url, "select ID, FULL_NAME, SEGMENT from PEOPLE where ID >= 10", driver=embedded.DRIVER)
    return masking.mask(found, json_columns=set()).data


@_query("""SELECT '{"id":' || c_custkey || ',"full_name":"[PII:name]","note":' || CASE WHEN c_custkey % 2 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS value FROM customer""")
def sink_json(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment")).alias("note"))
    return payloads.as_json(masking.mask(c, json_columns=set()).data)


@_query("SELECT c_custkey AS id, c_name AS full_name FROM customer")
def switched_off(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"))
    return masking.mask(c, Config(enabled=False)).data


@_query("""SELECT '{"error":"the query selects columns that the settings forbid"}' AS value""")
def rejected_query(spark, d):
    """What takes the place of the result of a query that the settings forbid; nothing is run."""
    read(spark, d, "customer").createOrReplaceTempView("cf_customer")
    try:
        return payloads.as_json(masked_sql(spark, "SELECT c_name AS email, ssn FROM cf_customer", Config(action="reject")))
    except QueryRejected as e:
        return _made(spark, [(json.dumps(payloads.error(str(e)), separators=(",", ":")),)], "value string")


# schema dumps


def _dump(name: str, pairs: list[tuple[str, str]]) -> str:
    """Pairs as a database tool prints them."""
    if name == "arrays":
        return json.dumps({"columns": ["column_name", "Table_Name"], "rows": [[c, t] for t, c in pairs]})
    if name == "objects":
        return json.dumps({"rows": [{"TABLE_NAME": t, "column_name": c, "n": 1} for t, c in pairs]})
    if name == "manifest":
        return json.dumps({"manifest": {"schema": {"columns": [{"name": "column_name", "position": 1}, {"name": "table_name", "position": 0}]}}, "result": {"data_array": [[t, c] for t, c in pairs]}})
    if name == "bars":
        return "\n".join([" table_name | column_name ", "------------+-------------", *(f" {t} | {c}" for t, c in pairs), f"({len(pairs)} rows)", " x | y"])
    if name == "commas":
        return "\ufeff" + "\r\n".join(["column_name,n,table_name", *(f'{c},"1,2",{t}' for t, c in pairs), ""])
    return "\n".join([f"{'table_name':20} {'column_name':20}", "-" * 20 + " " + "-" * 20, *(f"{t:20} {c:20}" for t, c in pairs), "", "(rows affected)"])


_COLUMNS = "SELECT table_name, column_name FROM duckdb_columns() WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')"


@_query(f"SELECT format, table_name, column_name FROM ({_COLUMNS}) CROSS JOIN (VALUES ('arrays'), ('objects'), ('manifest'), ('bars'), ('commas'), ('fixed')) f(format)")
def dump_formats(spark, d):
    """The columns of all test tables, printed in each format and read back by recognising it."""
    pairs = [(t, c) for t in TABLES for c in read(spark, d, t).columns]
    out = None
    for name in ("arrays", "objects", "manifest", "bars", "commas", "fixed"):
        one = catalog_dumps.read(spark, _dump(name, pairs)).select(F.lit(name).alias("format"), "table_name", "column_name")
        out = one if out is None else out.unionByName(one)
    return out


@_query("SELECT * FROM (VALUES ('cf_customer', 'c_acctbal'), ('cf_customer', 'c_custkey'), ('cf_customer', 'c_mktsegment'), ('cf_customer', 'c_name'), ('cf_customer', 'c_nationkey')) t(table_name, column_name)")
def catalog_columns(spark, d):
    read(spark, d, "customer").createOrReplaceTempView("cf_customer")
    return catalog_dumps.catalog(spark).where("table_name = 'cf_customer'")


# inspection of queries

_INSPECTED = [
    ("plain", "SELECT id, Email AS Contact FROM t", {}),
    ("cte", "WITH c AS (SELECT ssn FROM t) SELECT c.ssn AS s, id FROM c", {}),
    ("union", "SELECT a FROM x UNION ALL SELECT phone_number FROM y", {}),
    ("distinct", "SELECT DISTINCT dob, id FROM t", {}),
    ("subquery", "SELECT (SELECT ssn FROM x) AS s, id FROM t", {}),
    ("function", "SELECT upper(email) AS e FROM t", {}),
    ("literal", "SELECT 'ssn' AS a, id -- , ssn\n FROM t /* email */", {}),
    ("quoted", 'SELECT "Home Address", `a b` FROM t', {}),
    ("alias", "SELECT passport p FROM t", {}),
    ("wildcard", "SELECT t.*, id FROM t", {}),
    ("wildcard-reject", "SELECT * FROM t", {"wildcard_policy": "reject"}),
    ("warn", "SELECT ssn, phone FROM t", {"action": "warn"}),
    ("reject", "SELECT id, ssn FROM t", {"action": "reject"}),
    ("reject-clean", "SELECT id, colour FROM t", {"action": "reject"}),
    ("own", "SELECT badge_no FROM t", {"denylist": ("Badge",)}),
    ("no-select", "UPDATE t SET email = 1", {}),
]


@_query("""SELECT * FROM (VALUES ('plain', 'contact=email', 0, false), ('cte', 's=ssn', 0, false), ('union', 'phone_number=phone_number', 0, false), ('distinct', 'dob=dob', 0, false),
('subquery', '', 0, false), ('function', '', 0, false), ('literal', '', 0, false), ('quoted', 'home address=home address', 0, false), ('alias', 'p=passport', 0, false), ('wildcard', '', 1, false),
('wildcard-reject', '', 0, true), ('warn', '', 2, false), ('reject', '', 0, true), ('reject-clean', '', 0, false), ('own', 'badge_no=badge_no', 0, false), ('no-select', '', 0, false)) t(name, forced, warnings, rejected)""")
def inspected_queries(spark, d):
    rows = [(name, (p := inspect(sql, Config(**more))), len(p.warnings), p.rejected) for name, sql, more in _INSPECTED]
    return _made(spark, [(n, ",".join(f"{k}={v}" for k, v in sorted(p.forced.items())), w, r) for n, p, w, r in rows], "name string, forced string, warnings int, rejected boolean")


def _view(spark, d):
    read(spark, d, "customer").createOrReplaceTempView("cf_customer")


@_query("SELECT c_custkey AS id, '[PII:c_name]' AS label FROM customer")
def masked_sql_cte(spark, d):
    _view(spark, d)
    return masked_sql(spark, "WITH k AS (SELECT c_custkey, c_name FROM cf_customer) SELECT c_custkey AS id, c_name AS label FROM k", Config(denylist=("c_name",)))


@_query("SELECT DISTINCT '[PII:c_mktsegment]' AS kind, c_nationkey AS nation, c_mktsegment AS k FROM customer")
def masked_sql_distinct(spark, d):
    _view(spark, d)
    return masked_sql(spark, "SELECT DISTINCT c_mktsegment AS kind, c_nationkey AS nation, concat(c_mktsegment, '') AS k FROM cf_customer", Config(denylist=("c_mktsegment",)))


@_query("SELECT c_custkey AS id, '[PII:name]' AS full_name, '[PII:email]' AS note FROM customer")
def masked_sql_wildcard(spark, d):
    """All columns are selected, so only rules on names and values protect them."""
    _view(spark, d)
    return masked_sql(spark, "SELECT * FROM (SELECT c_custkey AS id, c_name AS full_name, concat('u', c_custkey, '@example.com') AS note FROM cf_customer)")


@_query("SELECT c_custkey AS id, c_name AS label FROM customer")
def masked_sql_warn(spark, d):
    """With the action ``warn`` a denied column is only warned of."""
    _view(spark, d)
    return masked_sql(spark, "SELECT c_custkey AS id, c_name AS label FROM cf_customer", Config(denylist=("c_name",), action="warn"))


@_query("SELECT c_custkey AS id, '[PII:c_name]' AS label FROM customer")
def masked_sql_in_json(spark, d):
    _view(spark, d)
    argument = json.dumps({"request": {"statement": "SELECT c_custkey AS id, c_name AS label FROM cf_customer", "limit": 5}})
    return masked_sql(spark, argument, Config(denylist=("c_name",)), path="request.statement")


# the cascade


@_query("SELECT c_custkey AS id, '[PII:seen]' AS a, CASE WHEN c_custkey % 2 = 0 THEN '[PII:old]' ELSE '[PII:email]' END AS email, '[PII:]' AS b, '[PII:badge]' AS badge, 'x' AS budge FROM customer")
def mask_placeholders(spark, d):
    """What is a placeholder already stays; a denied name matches as a whole."""
    c = read(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.lit("[PII:seen]").alias("a"), F.when(F.col("c_custkey") % 2 == 0, "[PII:old]").otherwise("q").alias("email"), F.lit("[PII:]").alias("b"), F.lit("x").alias("badge"), F.lit("x").alias("budge"))
    return masking.mask(rows, Config(denylist=("Badge",)), json_columns=set()).data


@_query("""SELECT c_custkey AS id, '{"rows":[{"email":"[PII:email]","note":"[PII:ssn]","pin":"' || pin || '"}],"_redaction_summary":{"redacted":2,"types":["email","ssn"],"warnings":[' || CASE WHEN c_custkey % 2 = 0 THEN '"possible phone in pin (0.70)"' ELSE '' END || ']}}' AS value
FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '555-123-4567' ELSE 'none' END AS pin FROM customer)""")
def mask_payload_summary(spark, d):
    """The summary is attached; an array becomes an object with rows."""
    pin = F.when(F.col("c_custkey") % 2 == 0, "555-123-4567").otherwise("none")
    made = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit('[{"email":"a","note":"123-45-6789","pin":"'), pin, F.lit('"}]')).alias("payload"))
    return masking.mask_payloads(made, "payload").select("id", "masked.value")


@_query("SELECT 'name' AS label, count(*) AS count FROM customer UNION ALL SELECT 'email', count(*) FROM customer")
def mask_hash_types(spark, d):
    """With pseudonyms in the cells, the types of the summary stay bare."""
    c = read(spark, d, "customer").select(F.col("c_name").alias("full_name"), F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("contact"))
    return masking.mask(c, Config(hash_values=True, hash_salt="s"), json_columns=set()).counts()


@_query("SELECT c_custkey AS id, '[PII:badge]' AS a, CASE WHEN c_custkey % 2 = 0 THEN '[PII:phone]' ELSE 'call 12' END AS b, '123-45-6789' AS c FROM customer")
def mask_user_patterns(spark, d):
    """A user's pattern is added or replaces one of its name; the threshold applies; a broken one is left out."""
    tree = {"pii": {"patterns": {"badge": {"regex": r"B-\d+", "confidence": 0.95}, "phone": {"regex": r"tel \d{3}", "confidence": 0.96}, "broken": {"regex": "(", "confidence": 1.0}}, "confidence_threshold": 0.92}}
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("B-"), F.col("c_custkey").cast("string")).alias("a"), F.when(F.col("c_custkey") % 2 == 0, "tel 123").otherwise("call 12").alias("b"), F.lit("123-45-6789").alias("c"))
    return masking.mask(c, Config.from_dict(tree), json_columns=set()).data


@_query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '{"email":"[PII:email]","list":["[PII:ssn]",1]}' ELSE '{"n": 1,  "s":"kept as it is"}' END AS text, '[[]' AS broken FROM customer""")
def mask_json_cells(spark, d):
    """JSON text in cells is walked, and written anew only if something in it was masked."""
    c = read(spark, d, "customer")
    text = F.when(F.col("c_custkey") % 2 == 0, '{"email":"q","list":["123-45-6789",1]}').otherwise('{"n": 1,  "s":"kept as it is"}')
    return masking.mask(c.select(F.col("c_custkey").alias("id"), text.alias("text"), F.lit("[[]").alias("broken"))).data


@_query("""SELECT id, u."column" AS "column", u.step AS step, u.label AS label, u.pattern AS pattern, u.score AS score, u.name_checks AS name_checks FROM (SELECT c_custkey AS id, unnest([
 {'column': 'full_name', 'step': 'name', 'label': 'name', 'pattern': NULL::VARCHAR, 'score': NULL::DOUBLE, 'name_checks': true},
 {'column': 'seg', 'step': 'forced', 'label': 'c_seg', 'pattern': NULL, 'score': NULL, 'name_checks': true},
 {'column': 'badge', 'step': 'denylist', 'label': 'badge', 'pattern': NULL, 'score': NULL, 'name_checks': true},
 {'column': 'email', 'step': CASE WHEN c_custkey % 2 = 0 THEN 'pattern' ELSE 'none' END, 'label': CASE WHEN c_custkey % 2 = 0 THEN 'email' END, 'pattern': NULL, 'score': NULL, 'name_checks': false},
 {'column': 'props', 'step': CASE WHEN c_custkey % 2 = 0 THEN 'json' ELSE 'json-clean' END, 'label': CASE WHEN c_custkey % 2 = 0 THEN 'email,ssn' END, 'pattern': NULL, 'score': NULL, 'name_checks': true},
 {'column': 'card', 'step': 'luhn', 'label': 'credit_card', 'pattern': NULL, 'score': NULL, 'name_checks': true},
 {'column': 'tel_no', 'step': 'name', 'label': 'phone', 'pattern': NULL, 'score': NULL, 'name_checks': true},
 {'column': 'misc', 'step': 'doubt', 'label': NULL, 'pattern': 'phone', 'score': 0.7, 'name_checks': true},
 {'column': 'old', 'step': 'placeholder', 'label': NULL, 'pattern': NULL, 'score': NULL, 'name_checks': true}]) AS u FROM customer) WHERE u."column" <> 'card'""")
def decisions_customers(spark, d):
    """Why each cell was masked or not."""
    even, col = F.col("c_custkey") % 2 == 0, lambda v, n: F.lit(v).alias(n)
    rows = read(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("seg"), col("b", "badge"), F.when(even, "a@b.co").otherwise("none").alias("email"),
        F.when(even, '{"mail":"q","x":"123-45-6789"}').otherwise('{"k":"v"}').alias("props"), col("1", "tel_no"), col("555-123-4567", "misc"), col("[PII:x]", "old"), F.lit(None).cast("string").alias("nothing"),
    )
    return masking.decisions(rows, Config(allowlist=("email",), denylist=("badge",)), {"seg": "c_seg"}, keys=("id",))


@_query("SELECT c_custkey AS id, '[PII:name]' AS n, '[PII:email]' AS v, 'name' AS t, 'Names' AS c, '{\"email\":\"[PII:email]\"}' AS j FROM customer")
def sql_function_calls(spark, d):
    """The rules called from SQL."""
    _view(spark, d)
    sql_functions.register(spark, Config(include_summary=False))
    return spark.sql("""SELECT c_custkey AS id, mask_value(c_name, 'full_name') AS n, mask_value(concat('u', c_custkey, '@b.org'), 'x') AS v, pii_type('firstName') AS t, pii_category('firstName') AS c, mask_json('{"email":"q"}') AS j FROM cf_customer""")


# settings


@_query("SELECT * FROM (VALUES ('error', 'column_name_boost must lie between 0 and 1'), ('error', 'action must be mask, warn or reject'), ('error', 'wildcard_policy must be warn or reject'), ('error', 'pattern a: look-around and back-references are not supported'), ('error', 'pattern b: confidence must lie between 0 and 1'), ('notice', 'pattern email replaces a fixed one')) t(kind, message)")
def settings_problems(spark, d):
    c = Config(column_name_boost=2.0, action="none", wildcard_policy="none", patterns={"a": ("(?=x)", 0.5), "b": ("x", 3.0), "email": ("@", 0.9)})
    errors, notices = validate(c)
    return _made(spark, [*(("error", e) for e in errors), *(("notice", n) for n in notices)], "kind string, message string")


@_query("SELECT * FROM (VALUES ('first', 'a,b'), ('after', 'b'), ('user_email', 'kept')) t(step, names)")
def settings_allowlist(spark, d):
    c = Config().allow("a", "b", "a")
    kept = masking.mask(_made(spark, [("kept",)], "user_email string"), Config().allow("USER_EMAIL"), json_columns=set()).data.first()[0]
    return _made(spark, [("first", ",".join(c.allowlist)), ("after", ",".join(c.disallow("a").allowlist)), ("user_email", kept)], "step string, names string")


# reports


def _schema(spark: SparkSession, typed: list[str], plain: int) -> DataFrame:
    return _made(spark, [("t", n) for n in typed] + [("u", f"c{k}") for k in range(plain)], "table_name string, column_name string")


_LEVELS = [
    ("three critical", ["ssn"] * 3, 97), ("a critical of few", ["ssn"], 5), ("a critical of many", ["ssn"], 50), ("elevated, over a quarter", ["email"] * 3, 7), ("elevated, a tenth", ["email"], 9),
    ("elevated, a fiftieth", ["email"], 50), ("standard, over a quarter", ["gender"] * 3, 7), ("standard, a tenth", ["gender"], 9), ("nothing", [], 4), ("no columns", [], 0),
]


@_query("""SELECT * FROM (VALUES ('three critical', 'CRITICAL', 2::BIGINT, 100::BIGINT, 3::BIGINT, 97::BIGINT, 3.0::DOUBLE, true), ('a critical of few', 'CRITICAL', 2, 6, 1, 5, 16.7, true), ('a critical of many', 'HIGH', 2, 51, 1, 50, 2.0, true),
('elevated, over a quarter', 'CRITICAL', 2, 10, 3, 7, 30.0, true), ('elevated, a tenth', 'HIGH', 2, 10, 1, 9, 10.0, true), ('elevated, a fiftieth', 'LOW', 2, 51, 1, 50, 2.0, true), ('standard, over a quarter', 'HIGH', 2, 10, 3, 7, 30.0, true),
('standard, a tenth', 'LOW', 2, 10, 1, 9, 10.0, true), ('nothing', 'NONE', 1, 4, 0, 4, 0.0, false), ('no columns', 'NONE', 0, 0, 0, 0, 0.0, false)) t(name, risk_level, tables_scanned, columns_scanned, pii_columns, non_pii_columns, pii_percentage, exposed)""")
def scan_risk_levels(spark, d):
    """Every branch of the risk level, and the exit code's condition."""
    out = None
    for name, typed, plain in _LEVELS:
        pairs = _schema(spark, typed, plain)
        one = scan.risk(pairs).select(F.lit(name).alias("name"), "*", F.lit(scan.exposed(pairs)).alias("exposed"))
        out = one if out is None else out.unionByName(one)
    return out


def _people_schema(spark: SparkSession) -> DataFrame:
    return _made(spark, [("people", n) for n in MADE_NAMES], "table_name string, column_name string")


@_query("""SELECT * FROM (VALUES (0, 'Names', 'elevated', 2, 'people.account_name people.first_names'), (1, 'Demographics', 'standard', 1, 'people.sex_at_birth'), (2, 'Government IDs', 'critical', 2, 'people.SSNField people.licence_number'),
(3, 'Contact', 'elevated', 1, 'people.userEmail'), (4, 'Date of birth', 'elevated', 1, 'people.dateOfBirth'), (5, 'Location of birth', 'elevated', 1, 'people.country_of_birth'), (6, 'Address & location', 'standard', 1, 'people.zip_code'),
(7, 'Online & technical', 'standard', 1, 'people.customerNumber'), (8, 'Biometric', 'critical', 1, 'people.face-scan'), (9, 'Family & relationships', 'elevated', 1, 'people.next_of_kin')) t(place, name, sensitivity, count, columns)""")
def scan_report(spark, d):
    """The categories of the JSON report, in its order, with their columns."""
    r = scan.report(_people_schema(spark))
    return _made(spark, [(k, c["name"], c["sensitivity"], c["count"], " ".join(c["columns"])) for k, c in enumerate(r["categories"])], "place int, name string, sensitivity string, count int, columns string")


@_query("""SELECT * FROM (VALUES (0, 'Risk: CRITICAL'), (1, '5 of 7 columns in 1 tables (71.4 %)'), (2, 'Contact [elevated]: 4 (80.0 %)'), (3, '  t.email'), (4, '  t.mail'), (5, '  t.mobile'), (6, 'Government IDs [critical]: 1 (20.0 %)'), (7, '  t.ssn')) t(line, text)""")
def scan_text_report(spark, d):
    """Three examples a category, the largest category first."""
    pairs = _made(spark, [("t", n) for n in ("ssn", "phone", "email", "mail", "mobile", "x", "y")], "table_name string, column_name string")
    return _made(spark, list(enumerate(scan.text_report(pairs).split("\n"))), "line int, text string")


@_query("SELECT * FROM (VALUES ('first_names', 'name', 1::BIGINT), ('account_name', 'name', 1), ('sex_at_birth', 'gender', 1), ('ssnfield', 'ssn', 1), ('licence_number', 'license', 1), ('dateofbirth', 'dob', 1), ('country_of_birth', 'lob', 1), ('zip_code', 'address', 1), ('customernumber', 'id', 1), ('next_of_kin', 'next_of_kin', 1)) t(column_name, label, count)")
def scan_review(spark, d):
    """Typed names that the allowlist does not name yet."""
    return scan.review(_people_schema(spark), {"useremail", "face-scan"})


# audit log


def _log(spark, d) -> str:
    """A log of one event an order, written in two parts."""
    folder = work_folder(spark, "audit")
    o, key = read(spark, d, "orders"), F.col("o_orderkey")
    n = (key % 3).cast("long")
    types = F.when(n > 0, F.create_map(F.lit("email"), n)).otherwise(F.create_map().cast("map<string,bigint>"))
    e = o.select((key * 3_600_000).alias("ts"), F.lit("sql").alias("path"), F.concat(F.lit("t"), (key % 5).cast("string")).alias("tool"), n.alias("fields_redacted"), (key % 7).cast("long").alias("overhead_us"), types.alias("types"))
    for part in (0, 1):
        audit.append(e.where(key % 2 == part), folder)
    return folder


@_query("SELECT count(*) AS queries, count(*) FILTER (n > 0) AS queries_with_pii, sum(n)::BIGINT AS fields_redacted, round(100.0 * count(*) FILTER (n > 0) / count(*), 6) AS hit_rate, round((avg(us) FILTER (us > 0)) / 1000.0, 6) AS mean_overhead_ms, 0::BIGINT AS malformed FROM (SELECT o_orderkey % 3 AS n, o_orderkey % 7 AS us FROM orders)")
def audit_round_trip(spark, d):
    return retro.totals(audit.read(spark, _log(spark, d))).withColumns({c: F.round(c, 6) for c in ("hit_rate", "mean_overhead_ms")})


@_query("SELECT DATE '1970-01-01' + (o_orderkey // 24)::INT AS day, count(*) AS queries FROM orders GROUP BY ALL")
def audit_days(spark, d):
    return audit.by_day(audit.read(spark, _log(spark, d)))


@_query("""SELECT 'sql' AS path, 'report' AS tool, 2 * count(*) AS fields_redacted, '{"c_name":' || count(*) || ',"email":' || count(*) || '}' AS types, 1::BIGINT AS logged FROM customer""")
def audit_of_a_query(spark, d):
    """A masked query writes its rows and then one event, with the counts of the same scan."""
    _view(spark, d)
    out, log = work_folder(spark, "rows"), work_folder(spark, "audit")
    sql = "SELECT c_name AS label, concat('u', c_custkey, '@example.com') AS note FROM cf_customer"
    run_masked_sql(spark, sql, lambda df: df.write.parquet(out), log, "report", Config(denylist=("c_name",)))
    e = audit.read(spark, log)
    return e.select("path", "tool", "fields_redacted", F.to_json(F.map_from_entries(F.sort_array(F.map_entries("types")))).alias("types"), F.lit(e.count()).cast("long").alias("logged"))


# message streams


def _calls(spark, d, ident: str, result: str) -> DataFrame:
    """A call and its answer for each distinct turn of a conversation; ``{id}`` stands for the turn."""
    c = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("t")).distinct()
    put = lambda text: F.replace(F.lit(text), F.lit("{id}"), F.col("t").cast("string"))
    ask = c.select("session", (F.col("t") * 2).alias("seq"), put('{"jsonrpc":"2.0","id":' + ident + ',"method":"tools/call"}').alias("value"))
    answer = c.select("session", (F.col("t") * 2 + 1).alias("seq"), put('{"jsonrpc":"2.0","id":' + ident + ',"result":' + result + "}").alias("value"))
    return ask.unionByName(answer).select("session", F.col("seq").cast("long").alias("seq"), "value")


def _calls_sql(ident: str, answer: str, total: int) -> str:
    put = lambda text: f"replace('{text}', '{{id}}', t::VARCHAR)"
    return f"""WITH c AS (SELECT DISTINCT conv_id::VARCHAR AS session, turn AS t FROM conversations)
SELECT session, (t * 2)::BIGINT AS seq, {put('{"jsonrpc":"2.0","id":' + ident + ',"method":"tools/call"}')} AS value, 0::BIGINT AS total FROM c
UNION ALL SELECT session, (t * 2 + 1)::BIGINT, {put('{"jsonrpc":"2.0","id":' + ident + "," + answer + "}")}, {total} FROM c"""


_EMAIL = '{"email":"q"}'


@_query(_calls_sql('"k{id}"', '"result":{"email":"[PII:email]"}', 1))
def proxy_string_ids(spark, d):
    return proxy.proxy_batch(_calls(spark, d, '"k{id}"', _EMAIL), Config(include_summary=False)).select("session", "seq", "value", "total")


_SIZE = """' || (20 + length('{"jsonrpc":"2.0","id":,"result":{"x":""}}') + length(t::VARCHAR)) || '"""


@_query(_calls_sql("{id}", f'"error":{{"code":-32603,"message":"result of {_SIZE} bytes exceeds the limit of 40"}}', 0))
def proxy_oversize(spark, d):
    """An answer beyond the limit is replaced by an error with its id."""
    return proxy.proxy_batch(_calls(spark, d, "{id}", '{"x":"' + "y" * 20 + '"}'), Config(max_payload_bytes=40)).select("session", "seq", "value", "total")


@_query(_calls_sql("{id}", '"result":{"email":"q"}', 0))
def proxy_switched_off(spark, d):
    return proxy.proxy_batch(_calls(spark, d, "{id}", _EMAIL), Config(mask_results=False)).select("session", "seq", "value", "total")


@_query(_calls_sql("{id}", '"result":{"email":"[PII:email]"}', 1))
def proxy_stream(spark, d):
    """The same messages through the stream: files in, state by id, files out, with audit events."""
    folders = {name: work_folder(spark, f"stream-{name}") for name in ("in", "out", "state", "audit")}
    _calls(spark, d, "{id}", _EMAIL).write.json(folders["in"])
    answers = proxy.proxy_stream(proxy.read_messages(spark, folders["in"]), Config(include_summary=False))
    query = proxy.write_answers(answers, folders["out"], folders["state"], "srv", folders["audit"], available_now=True)
    if not query.awaitTermination(600):
        query.stop()
        raise RuntimeError("the stream did not end")
    return spark.read.schema(f"{proxy.MESSAGE}, total long").json(f"{folders['out']}/batch=*")


@_query("SELECT * FROM (VALUES ('npx -y /opt/mcp-server-db', 'db'), ('server.py --port 1', '1'), ('run C:\\bin\\mcp-server-files', 'files'), ('-x', '')) t(command, label)")
def server_labels(spark, d):
    commands = ["npx -y /opt/mcp-server-db", "server.py --port 1", "run C:\\bin\\mcp-server-files", "-x"]
    return _made(spark, [(c, proxy.server_label(c.split(" "))) for c in commands], "command string, label string")
