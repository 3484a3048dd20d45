"""Sessions: a local one for tests and bench, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local[cores] session with the settings that tests and bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stratocast")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once for each application, so Python operators import it anywhere."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = Path(__file__).resolve().parent
        fd, target = tempfile.mkstemp(suffix=".zip", prefix=f"{here.name}-")
        os.close(fd)
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for p in sorted(here.rglob("*.py")):
                out.write(p, p.relative_to(here.parent))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in spark.checkpoint.dir; in a local session (tests) a temporary folder of our own where it is unset."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/{spark.sparkContext.applicationId}"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table written to a scratch path and read back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
