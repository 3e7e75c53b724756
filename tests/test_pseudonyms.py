"""Pseudonyms that tell values apart: all three forms of them, and a join on them."""

import duckdb
from pyspark.sql import functions as F

from cloakframe.functions.hashing import pseudonym, pseudonym_column
from cloakframe.functions.walk import Walker
from cloakframe.operators import mask as masking
from cloakframe.plans import registry
from cloakframe.plans.config import Config, validate


def plain(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def test_join_of_keys_that_share_eight_digits(spark, tmp_path):
    """19370 and 49037 share eight digits; keys of ten digits differ in the last one."""
    assert pseudonym("pepper", "Customer#000019370") == pseudonym("pepper", "Customer#000049037")
    keys = [(19370, "A"), (49037, "B"), (1234567890, "C"), (1234567891, "D"), (-1, "E"), (None, "F")]
    spark.createDataFrame(keys, "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(k, 1.0) for k, _ in keys for _ in range(1 + (k or 0) % 3)] + [(7, 1.0)]
    spark.createDataFrame(orders, "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in registry.pseudonym_join(spark, str(tmp_path)).collect()]
    assert len(got) == 5 and sorted(got) == sorted(con.sql(registry.SQL["pseudonym_join"]).fetchall())


def test_sixteen_digits(spark):
    values = [None, "", "é中🙂", "\x00", "x" * 3000, *("ab" * (k % 7) + str(k) for k in range(80)), ""]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "i int, v string").coalesce(1)
    both = [pseudonym_column(F.col("v"), "s", 16).alias("a"), masking.pseudonym_native(F.col("v"), "s", 16).alias("b"), pseudonym_column(F.col("v"), "s").alias("c")]
    for r in df.select("v", *both).collect():
        want = None if r.v is None else f"{plain(b's' + bytes(1) + r.v.encode()):016x}"
        assert (r.a, r.b) == (want, want) and r.c == (None if r.v is None else pseudonym("s", r.v))
    config = Config.from_dict({"pii": {"hash_values": True, "hash_salt": "s", "hash_digits": 16}})
    cells = df.select("i", F.col("v").alias("email"), F.array("v").alias("phone"))
    for r in masking.mask(cells, config, json_columns=set()).data.collect():
        walked = Walker(config).walk({"email": values[r.i], "phone": [values[r.i]]}, None)
        assert (r.email, list(r.phone)) == (walked["email"], walked["phone"])
    assert pseudonym("s", "", 16) in Walker(config).walk({"email": ""}, None)["email"]
    assert validate(Config(hash_digits=12))[0] == ["hash_digits must be 8 or 16"] and not validate(config)[0]
