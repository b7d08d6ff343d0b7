"""Prepares a session for Python code in tasks: sources at the executors, batches of bounded size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()

#: Bytes of the batches that Python code gets; rows can be long documents, and tasks hold several.
BATCH_BYTES = 8 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application's Python files, once for each application, and
    bound the session's batches unless it has a bound of its own."""
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sources-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # tasks fetch the file while the driver lives
    path = Path(folder) / "snapweave.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name) / file.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)
