"""Session helpers: a local session for tests, and staged tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[tuple[SparkSession, str]] = []


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, unless PYTHONPATH already does."""
    root = str(Path(__file__).resolve().parent.parent)
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_palimpsest_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="palimpsest-code-")) / "palimpsest.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((Path(root) / "palimpsest").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
    sc._palimpsest_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Only where no such setting exists and all runs on one machine (tests) a temporary folder is
    set; on a cluster the setting is a must, as executors would write to disks of their own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return d


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage and survives the loss of executors. The table is removed when
    the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_staged() -> None:
    """Remove the staged tables of this driver."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may have ended already
            pass


atexit.register(drop_staged)
