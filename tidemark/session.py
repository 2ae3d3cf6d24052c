"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: str | None = None


def build_session(app: str = "tidemark", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter configures its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship_code(spark)
    return spark


def ship_code(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per Spark context, so that they need no path of their own."""
    context = spark.sparkContext
    home = Path(__file__).parent
    if getattr(context, "_tidemark_shipped", False) or not home.is_dir():
        return
    archive = Path(SparkFiles.getRootDirectory()) / "code" / f"{home.name}.zip"
    archive.parent.mkdir(exist_ok=True)
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    context.addPyFile(str(archive))
    context._tidemark_shipped = True


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt out anew if it has fewer partitions than there are cores; for costly work on few small files.

    Large tables have more partitions and stay as they are. Only for a DataFrame without
    a shuffle, whose number of partitions is known without running it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it then gets a temporary
    folder that goes away with the process.
    """
    global _LOCAL_DIR
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
    return _LOCAL_DIR


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def clear_tables(spark: SparkSession) -> None:
    """Delete the tables this application wrote to the shared folder; results that were not written elsewhere go with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and lets several branches of a plan read one result; the
    table survives the loss of executors. It stays until :func:`clear_tables` or
    until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, label: str, max_rows: int, max_bytes: int) -> tuple[DataFrame, bool]:
    """``df`` written out and measured: a broadcast hint if it is within both bounds, else the plain table.

    The byte figure is the in-memory width of strings plus 16 bytes a column and 64 bytes an
    element of an array, whose elements must be of fixed width.
    Callers must join in a way that also works without the hint.
    """
    table = materialize(df, label)
    width = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            width = width + F.greatest(F.size(name), F.lit(0)) * 64
    row = table.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    small = row["n"] <= max_rows and (row["b"] or 0) <= max_bytes
    return (F.broadcast(table) if small else table), small
