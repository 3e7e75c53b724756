"""cloakframe: personal-data detection, redaction and exposure reports as Spark plans."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

__version__ = "0.1.0"

BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()
_set: dict[str, str] = {}


def ship(spark, batch: str = BATCH_BYTES) -> None:
    """Send this package to the executors of the session, once for each application.

    Spark's own file server hands the archive out, so nothing needs to be installed there.
    Arrow batches of the session are bounded to ``batch`` where it has Spark's default, or what an
    earlier call has set.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, None) in ("67108864b", "64MB", "64m", _set.get(sc.applicationId)):
        spark.conf.set(_BATCH, batch)
        _set[sc.applicationId] = batch
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="cloakframe-ship-")) / "cloakframe.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
