"""A database for tests: Derby, which comes with Spark, packed so that every executor can read it."""

from __future__ import annotations

import shutil
import tempfile
import zipfile
from pathlib import Path
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import work_folder

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def _connect(spark: SparkSession, url: str):
    return spark._jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(url, spark._jvm.java.util.Properties())


def _run(connection, sql: str, *values: str) -> None:
    statement = connection.prepareStatement(sql)
    for k, v in enumerate(values, 1):
        statement.setString(k, v)
    statement.execute()
    statement.close()


def _close(spark: SparkSession, url: str) -> None:
    """Shuts the database down, which Derby reports by an exception of its own."""
    try:
        _connect(spark, f"{url};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":
            raise


def packed(spark: SparkSession, df: DataFrame, table: str, types: str) -> str:
    """The URL of a read-only database that has the rows of ``df`` (numbers and strings) in ``table``;
    ``types`` declares its columns, in the order of ``df``.

    One process alone can open a Derby database that is written, and one in memory is seen by no other;
    an archive can be read by any number. So the executors write delimited text, the driver's
    process imports it file by file, as a server of a database would, and the closed database goes
    into an archive, not compressed as pages are read by their place, in the folder that all share.
    Nothing is collected; the folder has to be mounted, as Derby opens paths only.
    """
    rows, out = work_folder(spark, "rows"), work_folder(spark, "database")
    if urlparse(out).scheme not in ("", "file"):
        raise ValueError(f"a database needs a mounted folder, not {out}")
    place = lambda url: Path(unquote(urlparse(url).path))
    # for Derby null is nothing between separators, and the empty string two quotes
    cells = [F.coalesce(F.concat(F.lit('"'), F.replace(F.col(f"`{c}`").cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(",", *cells).alias("value")).write.text(rows)
    made = Path(tempfile.mkdtemp(prefix="cloakframe-database-"))
    try:
        url = f"jdbc:derby:{made / 'db'}"
        connection = _connect(spark, f"{url};create=true")
        _run(connection, f"CREATE TABLE {table} ({types})")
        for part in sorted(place(rows).glob("part-*")):
            _run(connection, "CALL SYSCS_UTIL.SYSCS_IMPORT_DATA(null, ?, null, null, ?, ',', '\"', 'UTF-8', 0)", table, str(part))
        connection.close()
        _close(spark, url)
        place(out).mkdir(parents=True)
        with zipfile.ZipFile(place(out) / "db.jar", "w", zipfile.ZIP_STORED) as z:
            for p in sorted((made / "db").rglob("*")):
                if p.is_file():
                    z.write(p, p.relative_to(made))
    finally:
        shutil.rmtree(made, ignore_errors=True)
    return f"jdbc:derby:jar:({place(out) / 'db.jar'})db"
