"""Session helpers: configuration, shared folders, spreading of small inputs."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package relies on.  AQE coalesces small shuffle
# partitions and splits skewed join partitions at run time; UTC keeps date
# arithmetic identical to the DuckDB oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows with whole texts travel to Python: small batches bound both sides' memory
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str = "local[*]", app: str = "tessera", shuffle_partitions: int = 8,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that can change on a live session and make
    the package importable by the Python workers."""
    for k in ("spark.sql.adaptive.enabled", "spark.sql.session.timeZone",
              "spark.sql.mapKeyDedupPolicy", "spark.sql.execution.arrow.pyspark.enabled",
              "spark.sql.execution.arrow.maxRecordsPerBatch"):
        try:
            spark.conf.set(k, DEFAULT_CONF[k])
        except Exception:  # pragma: no cover - immutable on some deployments
            pass
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Distribute this package to the executors (``addPyFile`` of a zip
    written once into the shared checkpoint folder), so UDFs defined here
    unpickle on workers whatever their working directory."""
    import hashlib
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    data = buf.getvalue()
    target = checkpoint_dir(spark).rstrip("/") + f"/pyfiles/{root.name}-{hashlib.sha1(data).hexdigest()[:12]}.zip"
    if "://" not in target or target.startswith("file:"):
        local = target.replace("file://", "").replace("file:", "")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        if not os.path.exists(local):
            with open(local, "wb") as fh:
                fh.write(data)
    else:  # shared file systems: write through the JVM Hadoop client
        jvm = sc._jvm
        path = jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(path):
            out = fs.create(path)
            out.write(bytearray(data))
            out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    On a cluster this is ``spark.checkpoint.dir`` (a shared file system); it is
    read from the session and never replaced, and a cluster without it is an
    error: a folder of one machine would be lost to the others.  Only in local
    mode a private temporary folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.conf.get("spark.master", "local")
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir is unset on {master}: name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return spark.conf.get("spark.checkpoint.dir", None) or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a staged table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


SPLIT_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small file scan over all cores before CPU-heavy
    per-row work, e.g. when a table is one small file.

    Decided from the plan and its size estimate alone: nothing runs.  An input
    whose scan already has a task per core (many files, or more bytes than one
    split per core) is returned as it is, so no shuffle is added at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or len(df.inputFiles()) >= cores:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, through Spark's file systems."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a staged folder, through Spark's file systems."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
