"""Session plumbing shared by all operators: shared storage, lineage cuts, shipping code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes in a batch for Python, about; one row may be more.
ARROW_BATCH = "8m"
_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application).

    Also bounds the batches that they get by bytes: rows of text vary too much for a count.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(tempfile.mkdtemp(prefix="locusframe-"), "locusframe.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "locusframe")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Unset, a temporary folder is used if the master is local (tests); on a cluster
    that would be a different disk on each machine, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="locusframe-shared-")
    return _LOCAL[app]


def cut(df: DataFrame, label: str, **settings: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, survives the loss of executors, is the same on
    every read, and has a known size, by which Spark decides on broadcasts.
    ``settings`` hold while it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/locusframe-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    # what the query shuffled is of no use once its result is written
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | settings
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def cut_shuffled(df: DataFrame, label: str) -> DataFrame:
    """:func:`cut`, with no broadcast that is not asked for.

    The size of files says little: ids and bases take some bytes in parquet and twenty times as much in a
    broadcast, and the least broadcast takes 16 MB; rounds of joins would send the driver gigabytes.
    """
    return cut(df, label, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})


def release(spark: SparkSession) -> None:
    """Delete what :func:`cut` has written in this application."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/locusframe-{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
