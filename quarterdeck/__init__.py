"""quarterdeck: company financials as Spark DataFrame jobs."""

from __future__ import annotations

import os
import tempfile
import zipfile


#: Bytes of an Arrow batch where the session keeps Spark's own bound: 10,000 long texts at once would fill a Python worker.
SPARKS_BOUND, BATCH_BYTES = "67108864b", 4 << 20


def ship(spark) -> None:
    """Send this package to the executors' Python workers, once a Spark context; bound their Arrow batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == SPARKS_BOUND:
        spark.conf.set(name, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_quarterdeck_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(here)
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith((".py", ".json")):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, here)))
    context.addPyFile(archive)
    context._quarterdeck_shipped = True
