"""Session settings and the one place where a plan's lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "loomgraph", cpus: str = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder of its own; a
    cluster without the setting is an error, since a machine-local folder would
    lose its blocks with the executor that wrote them.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    global _LOCAL_FOLDER
    if _LOCAL_FOLDER is None:
        _LOCAL_FOLDER = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_FOLDER


_LOCAL_FOLDER: str | None = None


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/loomgraph/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, so that a query works from any folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "loomgraph.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table this application cut, once its results are written."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A written table survives lost executors, is columnar, and carries its true
    size, so the next join's broadcast decision rests on a measured number.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def together(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables of the same columns that ``cut`` has written, as one.

    They are one scan in later plans, however many they are; others are a union.
    """
    first, paths = tables[0], [getattr(table, "_written_to", None) for table in tables]
    if None in paths or any(table.dtypes != first.dtypes for table in tables):
        return reduce(DataFrame.unionByName, tables)
    return first.sparkSession.read.schema(first.schema).parquet(*paths)


def small_side(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """A written table with a broadcast hint if it is measured to be small, and with a merge hint otherwise."""
    texts = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind == "string"]
    row = df.agg(F.count("*"), *texts).first()
    return df.hint("broadcast" if 16 * len(df.columns) * row[0] + sum(v or 0 for v in row[1:]) <= limit else "merge")


def spread(scan: DataFrame) -> DataFrame:
    """Use every core on a scan that has fewer splits than the session has cores.

    Large inputs already have more splits than that and pass through without a
    shuffle. Only for plain scans, whose split count is known without running.
    """
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= wanted else scan.repartition(wanted)
