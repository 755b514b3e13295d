"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once per application, unless PYTHONPATH already gives it to them."""
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root in on_path or app in _shipped:
        return
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="maskwright-")), "maskwright_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


#: Rows of an Arrow batch where rows are wide (a page, a screen with the rows of its units).
WIDE_ROWS = 1000


#: Bytes of such a batch, where single rows are large.
WIDE_BYTES = 8 << 20
#: Spark's own limits, which are replaced.
DEFAULT_ROWS, DEFAULT_BYTES = "10000", "67108864b"


def wide_rows(spark: SparkSession) -> None:
    """Batches of fewer rows and bytes for Python, unless the user has set how many: a worker holds a whole batch, several
    times over, and Spark's defaults of 10,000 rows and 64 MB let its memory grow with a task up to that."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == DEFAULT_ROWS:
        spark.conf.set(rows, str(WIDE_ROWS))
    if spark.conf.get(size, DEFAULT_BYTES) == DEFAULT_BYTES:
        spark.conf.set(size, str(WIDE_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) is it a folder of this machine; elsewhere other machines
    would not see it. What an application writes there is of no use after its end.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="maskwright-")
    return _local[app]


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: written as a table in the shared folder and read again, which survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/maskwright-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
