"""Session defaults and tables kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "recordloom") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """This application's folder among those all executors share: in spark.checkpoint.dir, or a temporary one on a local master only. It is removed when the driver's Python ends."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _FOLDERS:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named:
            _FOLDERS[app] = f"{named.rstrip('/')}/recordloom-{app}"
        elif sc.master.startswith("local["):
            _FOLDERS[app] = f"file://{tempfile.mkdtemp(prefix='recordloom-')}"
            sc.setCheckpointDir(_FOLDERS[app])
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), _FOLDERS[app])
    return _FOLDERS[app]


def _remove(jvm, configuration, folder: str) -> None:  # noqa: ANN001
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(configuration).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone at exit
        shutil.rmtree(folder.removeprefix("file:"), ignore_errors=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once as parquet in the shared folder and read back: later steps neither recompute it nor lose it with an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """A table that lies in fewer parts than there are cores, dealt to all of them, for work that costs more than a shuffle of the columns it needs; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application; for clusters that don't have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="recordloom-code-")) / "recordloom.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"recordloom/{f.relative_to(root)}")
        sc.addPyFile(str(target))
        atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
        _SHIPPED.add(sc.applicationId)
    return spark


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers; the folder is the setting RECORDLOOM_TOKENIZERS, else /opt/tokenizers."""
    return os.path.join(os.environ.get("RECORDLOOM_TOKENIZERS", "/opt/tokenizers"), name)
