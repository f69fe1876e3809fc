"""Makes the package importable on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import loomstat

# rows of long texts go to Python in batches of this size, so that a worker holds a few copies of it;
# batches of short rows end at Spark's own number of rows long before
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT = "67108864b"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application, and bound Arrow batches.

    A batch size that the session sets itself is kept.
    """
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(loomstat.__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="loomstat-ship-"), "loomstat")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "loomstat"))
        _shipped.add(app)
