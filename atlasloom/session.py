"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Applied by `build_session`; a cluster may override any of them at submit time.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "atlasloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


#: Bytes of rows that go to a Python worker at a time. Both sides of the pipe hold such a batch, and its answer, outside the
#: heap; Spark's own bound is 64 MB, which long texts reach in every task.
BATCH_BYTES = 4 * 1024 * 1024
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Send at most about `BATCH_BYTES` at a time to Python workers, unless the session says otherwise itself."""
    if _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


_SHIPPED: set[tuple[str, str]] = set()


def ship_package(spark: SparkSession, *more: str) -> None:
    """Make this package (and further package folders) importable in the Python workers.

    Needed once per application wherever the package is not installed on the executors.
    """
    sc = spark.sparkContext
    for folder in (Path(__file__).resolve().parent, *map(Path, more)):
        key = (sc.applicationId, folder.name)
        if key in _SHIPPED:
            continue
        archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{folder.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(folder.rglob("*.py")):
                out.write(file, file.relative_to(folder.parent))
        sc.addPyFile(str(archive))
        _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by `spark.checkpoint.dir`.

    A folder of our own is only set where none is configured and the session is local; on a
    cluster a machine-local folder would not survive the loss of an executor, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
