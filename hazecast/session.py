"""Session settings the engine relies on."""

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

HUGE_METHOD, COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000


def configure(spark: SparkSession) -> SparkSession:
    """Pin the session zone, keep generated code compilable and hand the shared checkpoint folder to Spark."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # HotSpot compiles no method beyond 8000 bytes of code: whole-stage code that large, such as
    # that of the index, would be interpreted for every row; operators one by one have small methods
    if int(spark.conf.get(HUGE_METHOD)) > COMPILED_BYTES:
        spark.conf.set(HUGE_METHOD, str(COMPILED_BYTES))
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return spark


@functools.cache
def _local_folder() -> str:
    """One temporary folder per process, removed when the process ends."""
    made = tempfile.TemporaryDirectory(prefix="hazecast-", ignore_cleanup_errors=True)
    atexit.register(made.cleanup)
    return made.name


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables written on the way to a result.

    It lies in the shared folder the cluster names. Only a local session,
    whose executors all see this machine's disk, may go without that setting.
    """
    shared = (spark.conf.get("spark.checkpoint.dir", None)
              or spark.sparkContext.getCheckpointDir())
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors see")
        shared = _local_folder()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
