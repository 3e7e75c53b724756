"""What needs executors in processes of their own, and the database that they read."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pyspark

from cloakframe.plans import registry_more
from cloakframe.sources import embedded, payloads

RUN = """
import json, sys
from pyspark.sql import SparkSession
name, sf_dir, top = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{top}/shared", "spark.sql.warehouse.dir": f"{top}/warehouse", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
import __spark_entry__
rows = [list(r) for r in __spark_entry__.queries()[name](spark, sf_dir).collect()]
print("ROWS" + json.dumps(rows))
spark.stop()
"""


def test_database_on_a_cluster(tmp_path, sf_dir):
    """The executors find the tables, though none of them has made them."""
    (home := tmp_path / "home").mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "PYTHONPATH": str(Path(__file__).resolve().parent.parent)}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", RUN, "source_database", sf_dir, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    got = [tuple(r) for r in json.loads(next(x for x in done.stdout.splitlines() if x.startswith("ROWS"))[4:])]
    want = duckdb.sql(registry_more.SQL["source_database"].replace("FROM customer", f"FROM '{sf_dir}/customer.parquet'")).fetchall()
    assert want and sorted(got) == sorted(want)


def test_database_keeps_odd_text(spark):
    odd = [None, "", '"', '""', 'a"b', "a,b", "a\nb", "a\r\nb", "\r", " x ", "\t", "\\", '\\"', "é中🙂", "null", '","', "\x00z", 'a"\r,"b', "é" * 50_000]
    rows = [(k, v, odd[-1 - k]) for k, v in enumerate(odd)] + [(-1, None, None)]
    df = spark.createDataFrame(rows, "ID long, A string, B string")
    for parts, want in ((1, rows), (3, rows), (1, [])):
        url = embedded.packed(spark, df.limit(len(want)).repartition(parts), "T", "ID bigint, A clob, B clob")
        for _ in range(2):
            got = payloads.database(spark, url, "select ID, A, B from T", driver=embedded.DRIVER).collect()
            assert sorted(tuple(r) for r in got) == sorted(want)
