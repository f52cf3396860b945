"""Session settings and durable cut points."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Files a core in which a narrow frame is kept at most.
NARROW_FILES = 2

_FOLDERS: list[tempfile.TemporaryDirectory] = []


def _own_folder() -> str:
    """A folder of the driver's own that lasts as long as the process."""
    _FOLDERS.append(tempfile.TemporaryDirectory(prefix="galeframe-", ignore_cleanup_errors=True))
    return _FOLDERS[-1].name


def build_session(app: str = "galeframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship(session)
    return session


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, so that it need not be installed there."""
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(str(source.relative_to(root.parent))), source.read_bytes())
    target = Path(_own_folder(), "galeframe.zip")
    target.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(target))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, reachable by every executor.

    It is the one the session names in ``spark.checkpoint.dir``. A local session without that
    setting (a test) gets a folder of its own, which goes when the process ends; on a cluster,
    where such a folder would be another on every machine, it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = _own_folder()
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Cuts the lineage of ``df`` in shared storage, so a lost executor costs no replay.

    A ``narrow`` frame, of a few numbers a row, is written in at most NARROW_FILES files a core,
    however many partitions a shuffle left it in: on a file system without native calls every file
    costs its executor processes of their own, which for a moment count as large as the executor.
    """
    context = df.sparkSession.sparkContext
    shared_folder(df.sparkSession)
    if narrow:
        df = df.coalesce(NARROW_FILES * context.defaultParallelism)
    return df.checkpoint(eager=True)
