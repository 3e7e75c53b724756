"""Vectors of names, values, queries, dumps, payloads and reports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import cascade, validators
from cloakframe.functions.hashing import pseudonym, pseudonym_column
from cloakframe.functions.names import category, classify, classify_column
from cloakframe.functions.rules import DENYLIST, JOINED
from cloakframe.functions.walk import Walker, dump, parse
from cloakframe.operators import mask as masking
from cloakframe.operators import retro, scan
from cloakframe.plans.config import Config, QueryRejected, validate
from cloakframe.plans.inspect_sql import UNKNOWN, WILDCARD, checked_plan, inspect, lineage, masked_sql, selected, statement
from cloakframe.sources import audit, catalog_dumps, payloads

NAMES = {
    "userEmail": "email", "email_address": "email", "mail": "email", "EMAIL": "email", "SSNField": "ssn", "social_security_number": "ssn", "dateOfBirth": "dob", "birth_date": "dob",
    "country_of_birth": "lob", "birth_city": "lob", "first_names": "name", "contact_name": "name", "account_name": "name", "name": None, "product_name": None, "vendor_name": None,
    "company_name": None, "last_login_at": None, "email_at": None, "sex_at_birth": "gender", "zip_code": "address", "street_address": "address", "city": None, "state": None,
    "licence_number": "license", "user_id": "id", "external_number": "id", "order_id": None, "": None, "user2Email": None, "ÉmailAddress": "address", "a-b": None,
}
VALUES = {
    "card": (validators.is_card, validators.card, ["4111111111111111", "371449635398431", "4111 1111 1111 1111", "4111-1111-1111-1111"], ["4111111111111112", "411111111111", "4" * 20, "4111111111111111x", "4111111111111111\n", ""]),
    "tfn": (validators.is_tfn, validators.tfn, ["123 456 782", "123-456-782"], ["123456782", "123 456 783", "12 345 678", "123 456 7821"]),
    "abn": (validators.is_abn, validators.abn, ["53 004 085 616", "53004085616"], ["53 004 085 617", "03 004 085 616", "5300408561", "- -"]),
    "medicare": (validators.is_medicare, validators.medicare, ["2950987601", "2950 98760 1"], ["2950987611", "1950987601", "7950987601", "295098760", "29509876011"]),
    "ird": (validators.is_ird, validators.ird, ["49-098-576", "49 098 576", "136-410-132"], ["49098576", "49-098-577", "4-9"]),
    "nhi": (validators.is_nhi, validators.nhi, ["ABD1230", "abd1230", "ABD12EK"], ["ABD1231", "IBD1230", "ABD12EL", "ABD123", "ABD12300", "ABD123０", "ſBD1230"]),
}


def test_names(spark):
    assert {n: classify(n) for n in NAMES} == NAMES
    df = spark.createDataFrame([(n,) for n in [*NAMES, *DENYLIST, *JOINED]], "n string")
    assert all(r.c == classify(r.n) for r in df.select("n", classify_column(F.col("n")).alias("c")).collect())
    assert all(classify(n) for n in DENYLIST) and category("unheard") == "Other" and category("id") == "Online & technical"


@pytest.mark.parametrize("name", sorted(VALUES))
def test_validators(spark, name):
    column, function, good, bad = VALUES[name]
    rng = random.Random(1)
    shapes = ["########", "#########", "##########", "###########", "################", "##-###-###", "### ### ###", "@@@####", "@@@##@@"]
    some = ["".join(str(rng.randrange(10)) if c == "#" else rng.choice("ABCDHIJKOPXYZ") if c == "@" else c for c in rng.choice(shapes)) for _ in range(3000)]
    assert all(map(function, good)) and not any(map(function, bad))
    df = spark.createDataFrame([(v,) for v in [*good, *bad, *some]] + [(None,)], "v string")
    for r in df.select("v", column(F.col("v")).alias("ok")).collect():
        assert r.ok == (r.v is not None and function(r.v)), r.v


CELLS = [
    "user@example.com", "UPPER@EXAMPLE.COM", "john.doe+tag@company.co.uk", "notanemail", "123-45-6789", "123456789", "555-123-4567", "(555) 123-4567", "1234567890123456", "4111 1111 1111 1111",
    "ABD1231", "02-1234-1234567-00", "0412 345 678", "+61 412 345 678", "AB123456", "A1234567", "123 456 782", "[PII:email]", "[PII:]", '{"email": "x"}', '{"n": 1.50, "s": "ok"}', "[1,", '["a@b.co", 5]', "", "x" * 9000 + " a@b.co", "{a@b.co",
]


def test_cascade_equals_the_walk(spark):
    for config in (Config(), Config(confidence_threshold=0.7), Config(hash_values=True, hash_salt="s"), Config(patterns={"phone": (r"\d{3}", 0.9), "badge": (r"B-\d+", 0.95), "bad": ("(", 1.0)})):
        df = spark.createDataFrame([(i, v) for i, v in enumerate([*CELLS, "B-77", None])], "i int, v string")
        r = masking.mask(df, config)
        w = Walker(config)
        want = {i: w.walk(v, "v") for i, v in enumerate([*CELLS, "B-77", None])}
        assert {x.i: x.v for x in r.data.collect()} == want
        assert {x.label: x["count"] for x in r.counts().collect()} == dict(w.summary.counts)
        assert sum(x["count"] for x in r.warnings().collect()) == len(w.summary.warnings)


def test_nested_columns_equal_the_walk(spark):
    schema = "id long, email string, p struct<note:string,who:struct<last_name:string>>, tags array<string>, m map<string,string>, rows array<struct<ssn:string,ref:string>>, n double"
    value = {"id": 1, "email": "x", "p": {"note": "a@b.co", "who": {"last_name": "N"}}, "tags": ["k", "c@d.ef"], "m": {"phone": "1", "z": "123-45-6789", "y": "ok"}, "rows": [{"ssn": "1", "ref": "555-123-4567"}, {"ssn": None, "ref": None}], "n": 1.5}
    df = spark.createDataFrame([value, {"id": 2}], schema)
    for config in (Config(), Config(allowlist=("EMAIL", "phone")), Config(denylist=("REF",)), Config(hash_values=True, hash_salt="é")):
        r = masking.mask(df, config)
        w = Walker(config)
        want = w.walk({k: v for k, v in value.items()}, None)
        got = r.data.orderBy("id").collect()
        assert r.data.schema.simpleString() == df.schema.simpleString()
        assert got[0].asDict(recursive=True) == want and all(v is None for k, v in got[1].asDict().items() if k != "id")
        assert {x.label: x["count"] for x in r.counts().collect()} == dict(w.summary.counts)


def test_hash(spark):
    assert [pseudonym("s", v) for v in ("alice@example.com", "", "é中")] == ["82d1a665", "bda1e4c1", "85b8c810"]
    df = spark.createDataFrame([("alice@example.com",), ("",), ("é中",), (None,), ("",)], "v string")
    rows = df.select(pseudonym_column(F.col("v"), "s").alias("a"), masking.pseudonym_native(F.col("v"), "s").alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(x, x) for x in ("82d1a665", "bda1e4c1", "85b8c810", None, "bda1e4c1")]


def payload(text, **more):
    w = Walker(Config(**more))
    return json.loads(dump(w.payload(parse(text)))), w.summary


def test_payload_shapes():
    out, s = payload('{"rows":[{"id":1,"email":"a","ssn":"b"}],"count":1}')
    assert s.redacted == 2 and out["count"] == 1 and out["_redaction_summary"]["types"] == ["email", "ssn"]
    out, _ = payload('[{"id":1,"email":"a"}]')
    assert out["rows"] == [{"id": 1, "email": "[PII:email]"}]
    assert payload('[{"email":"a"}]', include_summary=False)[0] == [{"email": "[PII:email]"}]
    for header, rows in (("columns", "rows"), ("headers", "records"), ("keys", "results"), ("fields", "data")):
        out, s = payload(json.dumps({header: ["id", "email"], rows: [[1, "a", "x@y.zz"], [2, None]], "n": 2}))
        assert out[rows] == [[1, "[PII:email]", "[PII:email]"], [2, None]] and out[header] == ["id", "email"] and s.redacted == 2
    assert payload('{"error":"a@b.co"}') [0] == {"error": "a@b.co"}
    for e in ("null", "false", '""'):
        assert payload(f'{{"error":{e},"email":"x"}}')[1].redacted == 1
    assert payload('{"columns":["email"],"rows":[{"a":"b"}]}')[1].redacted == 0
    assert payload('{"manifest":{},"result":{"data_array":[["a@b.co","x"]]}}')[1].redacted == 1
    assert dump(parse('{"b":1.50,"a":[1e5,"é"]}')) == '{"b":1.50,"a":[1e5,"é"]}'
    with pytest.raises(ValueError):
        parse("[NaN]")


def test_payload_column(spark):
    df = spark.createDataFrame([("not json",), (None,), ('{"email":"q"}',)], "v string")
    got = [r.masked for r in masking.mask_payloads(df, "v", Config(include_summary=False)).collect()]
    assert [(g.value, g.total, g.type_counts) for g in got] == [("not json", 0, {}), (None, 0, {}), ('{"email":"[PII:email]"}', 1, {"email": 1})]


SELECTS = {
    "SELECT id, email FROM t": [("id", "id"), ("email", "email")], "select Email AS x, phone p from t": [("x", "email"), ("p", "phone")], "SELECT u.email, s.u.ssn FROM u": [("email", "email"), ("ssn", "ssn")],
    "SELECT * FROM t": WILDCARD, "SELECT t.* FROM t": WILDCARD, "SELECT *, id FROM t": WILDCARD, "SELECT *": WILDCARD, "SELECT DISTINCT email FROM t": [("email", "email")],
    "SELECT COUNT(*) FROM t": UNKNOWN, "SELECT lower(a), email FROM t": [("email", "email")], "SELECT /* x, */ id -- , email\n, \"My Col\" FROM t": [("id", "id"), ("my col", "my col")],
    "WITH c AS (SELECT ssn FROM t) SELECT id FROM c": [("id", "id")], "SELECT (SELECT ssn FROM x) s, id FROM t": [("id", "id")], "UPDATE t SET a = 1": UNKNOWN, "": UNKNOWN,
    "SELECT 'lit' AS x, `a b` FROM t": [("a b", "a b")], "SELECT a FROM x UNION SELECT email FROM y": [("email", "email")], "SELECT a + b FROM t": [("b", "a")],
}


def test_inspection(spark):
    assert {q: selected(q) for q in SELECTS} == SELECTS
    assert inspect("SELECT user_email_x AS a, id FROM t", Config()).forced == {"a": "user_email_x"}
    assert inspect("SELECT ssn FROM t", Config(action="warn")).warnings and inspect("SELECT ssn FROM t", Config(action="reject")).rejected
    assert inspect("SELECT * FROM t", Config()).warnings and inspect("SELECT * FROM t", Config(wildcard_policy="reject")).rejected
    spark.createDataFrame([(1, "a", "b")], "id int, email string, note string").createOrReplaceTempView("cf_people")
    with pytest.raises(QueryRejected):
        checked_plan(spark, "SELECT email FROM cf_people", Config(action="reject"))
    q = "SELECT lower(email) AS x, note FROM (SELECT * FROM cf_people) UNION ALL SELECT note, email FROM cf_people"
    assert ("x", "email") in lineage(spark, q) and ("note", "email") in lineage(spark, q)
    assert masked_sql(spark, "SELECT email AS tag, note FROM cf_people").first() == ("[PII:email]", "b")
    assert masked_sql(spark, "SELECT email FROM cf_people", Config(enabled=False)).first() == ("a",)


def test_config():
    tree = {"pii": {"column_names": ["Badge"], "confidence_threshold": 2, "patterns": {"email": {"regex": "(?=x)", "confidence": 0.5}}}, "stream": {"max_payload_bytes": 7}}
    c = Config.from_dict(tree)
    errors, notices = validate(c)
    assert len(errors) == 2 and len(notices) == 1 and c.denied[-1] == "badge" and c.max_payload_bytes == 7
    assert Config(confidence_threshold=0.7).certain(0.7) and Config().allow("a").disallow("a").allowlist == ()


DUMPS = [
    '{"columns":["Table_Name","x","column_name"],"rows":[["t",1,"email"],["t",2,"id"]]}', '{"rows":[{"TABLE_NAME":"t","column_name":"email"},{"table_name":"t","COLUMN_NAME":"id"}]}',
    '{"manifest":{"schema":{"columns":[{"name":"column_name","position":1},{"name":"table_name","position":0}]}},"result":{"data_array":[["t","email"],["t","id"]]}}',
    " table_name | column_name \n------------+-------------\n t | email\n t | id\n(2 rows)\n x | y\n", '﻿"TABLE_NAME",z,column_name\r\nt,"a,""b",email\r\n\r\nt,1,id\r\n',
    "TABLE_NAME  COLUMN_NAME \n----------  ----------- \nt           email       \nt           id          \n\n(2 rows affected)\n",
]


@pytest.mark.parametrize("text", DUMPS)
def test_dumps(text):
    assert catalog_dumps.parse(text) == [("t", "email"), ("t", "id")]


def test_bad_dumps():
    for text in ("hello", "[]", '{"rows":[1]}', "a|b\n-\n", "a,b\n1,2", '{"rows":[{"x":1}]}', '{"columns":["a"],"rows":[["b"]]}'):
        with pytest.raises(ValueError):
            catalog_dumps.parse(text)
    assert catalog_dumps.parse('{"rows":[]}') == []


def risk(spark, typed, plain):
    pairs = [("t", n) for n in typed] + [("u", f"c{k}") for k in range(plain)]
    return scan.risk(spark.createDataFrame(pairs, "table_name string, column_name string")).first().risk_level


def test_scan(spark):
    assert [risk(spark, *x) for x in ((["ssn"] * 3, 97), (["ssn"], 5), (["ssn"], 50), (["email"] * 3, 7), (["email"], 9), (["email"], 50), (["gender"] * 3, 7), (["gender"], 9), ([], 4), ([], 0))] == ["CRITICAL", "CRITICAL", "HIGH", "CRITICAL", "HIGH", "LOW", "HIGH", "LOW", "NONE", "NONE"]
    pairs = catalog_dumps.read(spark, DUMPS[0])
    r = scan.report(pairs)
    assert r["categories"] == [{"name": "Contact", "sensitivity": "elevated", "count": 1, "columns": ["t.email"]}] and r["pii_percentage"] == 50.0
    assert "Contact" in scan.text_report(pairs) and scan.exposed(pairs) and scan.review(pairs, {"email"}).count() == 0


def test_audit_and_reports(spark, tmp_path):
    lines = ['{"ts":1,"path":"run","tool":"a","fields_redacted":5,"types":{"email":3,"ssn":2}}', '{"ts":2,"path":"run","tool":"b","fields_redacted":6,"overhead_us":4000,"types":{"email":4,"phone":2}}', "", "broken", '{"ts":3,"path":"run","tool":"a","fields_redacted":0,"types":{}}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    events = audit.read(spark, str(tmp_path / "log.jsonl"))
    t = retro.totals(events).first()
    assert (t.queries, t.queries_with_pii, t.fields_redacted, t.mean_overhead_ms, t.malformed) == (3, 2, 11, 4.0, 1)
    assert {r.label: r["count"] for r in retro.by_type(events).collect()} == {"email": 7, "ssn": 2, "phone": 2}
    assert [r.tool for r in retro.by_tool(events).collect()] == ["a", "b"]
    assert [r.label for r in retro.top_types(events).collect()] == ["email", "phone", "ssn"]
    audit.append(events.where("_bad is null"), str(tmp_path / "out"))
    assert retro.totals(audit.read(spark, str(tmp_path / "out"))).first().queries == 3
    assert retro.totals(events.limit(0)).first().hit_rate == 0.0


def test_redaction_stays_in_the_scan_stage(spark, sf_dir):
    df = masking.mask(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id > 5").select("doc_id", "text"), json_columns=set()).data
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan
    assert cascade.java("x") == "(?U)x"


def test_database(spark):
    """The result of a query in a database, from the one that comes with Spark, masked."""
    url, options = "jdbc:derby:memory:cf;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(1, "Ann Lee"), (2, "Bo Ray")], "ID int, FULL_NAME string")
    rows.write.format("jdbc").options(url=url, dbtable="PEOPLE", createTableColumnTypes="FULL_NAME varchar(40)", **options).mode("overwrite").save()
    found = payloads.database(spark, url, "select ID, FULL_NAME from PEOPLE where ID > 1", **options)
    assert [tuple(r) for r in masking.mask(found, json_columns=set()).data.collect()] == [(2, "[PII:name]")]


def test_rows_and_counts_of_one_scan(spark):
    df = spark.createDataFrame([("Ann", "a@b.co", "555-123-4567"), (None, "x", "y")], "full_name string, note string, misc string")
    data, seen = masking.mask(df, json_columns=set()).observed()
    assert [tuple(r) for r in data.collect()] == [("[PII:name]", "[PII:email]", "555-123-4567"), (None, "x", "y")]
    assert {k: v for k, v in seen.get.items() if v} == {"redacted": 2, "warned": 1, "name": 1, "email": 1}
    with pytest.raises(ValueError, match="of its own"):
        masking.mask(spark.createDataFrame([("a", "b")], "note string, __0 string"), json_columns=set())


def test_statement_in_json():
    assert statement("SELECT 1") == "SELECT 1"
    assert statement('{"a":{"b":"SELECT 1"}}', "a.b") == "SELECT 1"
    assert [statement(x, "a.b") for x in ("not json", "[]", '{"a":"x"}', '{"a":{"b":1}}', '{"a":[{"b":"x"}]}', "{}")] == [None] * 6
