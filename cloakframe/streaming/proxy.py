"""Message streams: JSON-RPC lines in two directions; results of tracked calls are redacted.

A ``tools/call`` request is remembered by its id; the response with that id is redacted,
or answered by an error if it is too large; anything else passes unchanged. State is one
flag an id, in RocksDB, dropped when its response came or after ``ttl_ms``.

Order: the messages of one id are taken by ``seq`` within a micro-batch. An answer that comes in an
earlier micro-batch than its request passes unchanged, as an answer to no call; so let one
source deliver both directions of a session. The messages of one id in one micro-batch are held
in memory; a source option such as ``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger`` bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.walk import Walker, _Number, dump, parse
from ..plans.config import Config

OUT = "value string, kind string, total long, type_counts map<string,long>"
MESSAGE = "session string, seq long, value string"
STREAM_OUT = f"{MESSAGE}, kind string, total long, type_counts map<string,long>"
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
NO_EMPTY = ("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def id_key(value) -> str:
    """A typed id: the string "1" is not the number 1."""
    if value is None:
        return "null"
    if isinstance(value, _Number):
        return f"n:{value}"
    return f"s:{value}" if isinstance(value, str) else dump(value)


def look(line: str | None) -> tuple[str, str | None]:
    """(kind, id): ``request`` of a tracked method, ``response``, or ``other``."""
    try:
        m = parse((line or "").rstrip("\r\n"))
    except (ValueError, RecursionError):
        return "other", None
    if not isinstance(m, dict) or "id" not in m:
        return "other", None
    if "method" in m:
        return ("request" if m["method"] == "tools/call" and not isinstance(m["method"], _Number) else "other"), id_key(m["id"])
    return ("response" if m.get("result") is not None or m.get("error") is not None else "other"), id_key(m["id"])


def _error(ident, message: str) -> str:
    return dump({"jsonrpc": "2.0", "id": ident, "error": {"code": _Number("-32603"), "message": message}})


def protect(line: str, config: Config) -> tuple[str, int, dict]:
    """A tracked response with its result redacted; fails closed."""
    ident = None
    try:
        m = parse(line)
        ident = m.get("id")
        size = len(dump(m).encode())
        if size > config.max_payload_bytes:
            return _error(ident, f"result of {size} bytes exceeds the limit of {config.max_payload_bytes}"), 0, {}
        if not config.mask_results or m.get("result") is None:
            return line, 0, {}
        w = Walker(config)
        m["result"] = w.payload(m["result"])
        return dump(m), w.summary.redacted, dict(w.summary.counts)
    except Exception:  # noqa: BLE001  fail closed: never the raw line
        return _error(ident, "redaction failed"), 0, {}


def _keyed(messages: DataFrame) -> DataFrame:
    """``session, seq, value, kind, id``; a message that concerns no call has an id of its own, so
    such messages spread evenly."""

    @F.pandas_udf("kind string, id string")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([look(v) for v in values], columns=["kind", "id"])

    own = F.when(F.col("m.kind") == "other", F.concat(F.lit("-"), F.col("seq").cast("string"))).otherwise(F.col("m.id"))
    return messages.withColumn("m", run("value")).select(F.coalesce("session", F.lit("")).alias("session"), "seq", "value", "m.kind", own.alias("id"))


def proxy_batch(messages: DataFrame, config: Config | None = None) -> DataFrame:
    """A bounded log (``session, seq, value``) as the stream would answer it: ``session, seq`` and ``OUT``.

    A response is tracked if, of the messages with its id before it, the last is a request.
    """
    from pyspark.sql import Window

    config = config or Config()

    @F.pandas_udf(OUT)
    def run(values: pd.Series) -> pd.DataFrame:
        rows = [(v, "other", 0, {}) if v is None else (lambda p: (p[0], "response", p[1], p[2]))(protect(v, config)) for v in values]
        return pd.DataFrame(rows, columns=["value", "kind", "total", "type_counts"])

    order = Window.partitionBy("session", "id").orderBy("seq")
    known = _keyed(messages).withColumn("before", F.lag("kind").over(order))
    tracked = (F.col("kind") == "response") & F.coalesce(F.col("before") == "request", F.lit(False))
    done = known.withColumn("tracked", tracked).withColumn("r", run(F.when(F.col("tracked"), F.col("value"))))
    pick = lambda c, other: F.when(F.col("tracked"), F.col(f"r.{c}")).otherwise(other).alias(c)
    return done.select("session", "seq", pick("value", F.col("value")), "kind", pick("total", F.lit(0).cast("long")), pick("type_counts", F.create_map().cast("map<string,long>")))


def _processor(config: Config, ttl_ms: int) -> StatefulProcessor:
    class Calls(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.pending = handle.getValueState("pending", StructType([StructField("n", LongType())]), ttlDurationMs=ttl_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            frame = pd.concat([r[["seq", "value", "kind"]] for r in rows]).sort_values("seq", kind="stable")
            out = []
            for seq, value, kind in zip(frame["seq"], frame["value"], frame["kind"], strict=True):
                if kind == "request":
                    self.pending.update((1,))
                if kind == "response" and self.pending.exists():
                    self.pending.clear()
                    text, total, counts = protect(value, config)
                    out.append((key[0], seq, text, kind, total, counts))
                else:
                    out.append((key[0], seq, value, kind, 0, {}))
            yield pd.DataFrame(out, columns=["session", "seq", "value", "kind", "total", "type_counts"])

        def close(self) -> None:
            pass

    return Calls()


def proxy_stream(messages: DataFrame, config: Config | None = None, ttl_ms: int = 3_600_000) -> DataFrame:
    """A streaming DataFrame (``session, seq, value``) -> ``STREAM_OUT``; needs the RocksDB state store."""
    return _keyed(messages).groupBy("session", "id").transformWithStateInPandas(_processor(config or Config(), ttl_ms), STREAM_OUT, "Append", "ProcessingTime")


def read_messages(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of messages from JSON files (``MESSAGE``) that arrive in a folder."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def from_log(records: DataFrame) -> DataFrame:
    """``MESSAGE`` from the records of a message log (``key, offset, value``), batch or stream: a
    session is a key, so that its messages are in one partition and in order."""
    return records.select(F.col("key").cast("string").alias("session"), F.col("offset").cast("long").alias("seq"), F.col("value").cast("string").alias("value"))


def write_answers(answers: DataFrame, folder: str, checkpoint: str, server: str = "", log: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Write a stream of answers as JSON (``MESSAGE`` and ``total``) and, if ``log`` is a folder,
    an audit event for each answer in which something was masked. State is kept in RocksDB;
    ``available_now`` ends the query once what has arrived is answered.

    Each micro-batch has a folder of its own, which a repeated batch overwrites: rows are neither
    lost nor doubled."""

    def sink(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.select("session", "seq", "value", "total").write.mode("overwrite").json(f"{folder}/batch={number}")
        if log:
            audit_events(kept, server).write.mode("overwrite").json(f"{log}/batch={number}")
        kept.unpersist()

    writer = answers.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    spark, own = answers.sparkSession, dict([ROCKS])
    if available_now:
        own |= dict([NO_EMPTY])  # batches that only drop old state would never end the query
    had = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:  # a query keeps the settings that it starts with
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def server_label(arguments: list[str]) -> str:
    """The name of an upstream server: the last argument that is no option, without path and prefix."""
    plain = [a for a in arguments if not a.startswith("-")]
    name = plain[-1].replace("\\", "/").rsplit("/", 1)[-1] if plain else ""
    return name.removeprefix("mcp-server-")


def audit_events(answers: DataFrame, server: str) -> DataFrame:
    """Audit events of answers in which something was redacted."""
    from ..sources.audit import event

    return answers.where("total > 0").select(*event("stream", server, F.col("total"), F.col("type_counts"), F.lit(0).cast("long")))
