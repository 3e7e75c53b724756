import json

from cloakframe.plans.config import Config
from cloakframe.streaming import proxy

QUIET = Config(include_summary=False)


def call(i, method="tools/call"):
    return json.dumps({"jsonrpc": "2.0", "id": i, "method": method}, separators=(",", ":"))


def answer(i, **result):
    return json.dumps({"jsonrpc": "2.0", "id": i, "result": result}, separators=(",", ":"))


LOG = [
    call(1), call("1"), answer(1, email="a"), answer(1, email="again"), answer("1", content=[{"type": "text", "text": '{"email":"z"}'}, {"type": "image", "data": "QUJD"}]), call(2, "tools/list"), answer(2, email="b"),
    "not json", "", call(None), answer(None, email="n"), '{"method":"note"}', call(7), '{"jsonrpc":"2.0","id":7,"error":{"code":1,"message":"a@b.co"}}', '{"id":9,"result":null}',
]
WANT = {2: answer(1, email="[PII:email]"), 4: answer("1", content=[{"type": "text", "text": '{"email":"[PII:email]"}'}, {"type": "image", "data": "QUJD"}]), 10: answer(None, email="[PII:email]")}


def test_batch(spark):
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(LOG)] + [("other", 0, answer(1, email="q"))], "session string, seq long, value string")
    got = {(r.session, r.seq): r for r in proxy.proxy_batch(df, QUIET).collect()}
    assert len(got) == len(LOG) + 1 and got["other", 0].value == answer(1, email="q")
    assert {k: got["s", k].value for k in range(len(LOG))} == {k: WANT.get(k, v) for k, v in enumerate(LOG)}
    assert sum(r.total for r in got.values()) == 3 and proxy.audit_events(proxy.proxy_batch(df, QUIET), "srv").count() == 3


def test_oversize_and_failure():
    out = json.loads(proxy.protect(answer("k", x="y" * 100), Config(max_payload_bytes=50))[0])
    assert out["id"] == "k" and out["error"]["code"] == -32603
    assert json.loads(proxy.protect("{broken a@b.co", Config())[0])["error"]["code"] == -32603
    assert proxy.server_label(["npx", "-y", "/opt/mcp-server-db"]) == "db"


def test_stream(spark, tmp_path):
    """Two runs over a folder: state and counts go on, each micro-batch is written once."""
    folders = {k: str(tmp_path / k) for k in ("in", "out", "cp", "log")}
    kept = {k: spark.conf.get(k, None) for k in (proxy.ROCKS[0], proxy.NO_EMPTY[0])}

    def run(rows):
        spark.createDataFrame(rows, proxy.MESSAGE).coalesce(1).write.mode("append").json(folders["in"])
        stream = proxy.proxy_stream(proxy.read_messages(spark, folders["in"]), QUIET)
        assert proxy.write_answers(stream, folders["out"], folders["cp"], "srv", folders["log"], available_now=True).awaitTermination(120)
        return spark.read.json(folders["out"])

    rows = [("s", k, v) for k, v in enumerate(LOG)]
    first = run(rows[:2])
    assert first.count() == 2
    every = {r.seq: r.value for r in run(rows[2:]).collect()}
    assert every == {k: WANT.get(k, v) for k, v in enumerate(LOG)}
    events = spark.read.json(folders["log"])
    assert events.count() == 3 and {r.tool for r in events.collect()} == {"srv"}
    assert {k: spark.conf.get(k, None) for k in kept} == kept


def test_messages_from_a_log(spark):
    log = spark.createDataFrame([(bytearray(b"s"), 7, bytearray(b"{}"))], "key binary, offset long, value binary")
    assert [tuple(r) for r in proxy.from_log(log).collect()] == [("s", 7, "{}")]
