"""Session, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "quillspark", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the session is given from outside."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application: they may run where it is not installed."""
    if spark.sparkContext.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quillspark-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/quillspark-code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, f"{home.name}/{p.relative_to(home)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)


_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary folder is made if all runs on
    one machine (tests), and removed when the process ends; on a cluster it is an error, as executors wouldn't find what
    others wrote."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    global _own
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return _own


_own: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there is deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/quillspark-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: the lineage ends there, and a lost executor
    takes nothing with it. The table is deleted when the driver's process ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may have ended first
        pass


#: What a broadcast or a collect may have at most, whatever its rows are: bytes before compression.
MOST_BYTES = 256 << 20


def _bytes_of(field) -> Column:
    kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
    if kind in ("string", "binary"):
        return F.octet_length(c)
    return F.length(F.to_json(F.struct(c))) if kind in ("array", "map", "struct") else F.lit(8)


def small(df: DataFrame, most_rows: int, most_bytes: int = MOST_BYTES) -> bool:
    """True if ``df`` has at most ``most_rows`` rows and ``most_bytes`` bytes: the check before a broadcast or a collect. It counts
    no further than the limit of rows."""
    size = sum((F.coalesce(_bytes_of(f), F.lit(0)) for f in df.schema.fields), F.lit(0).cast("bigint"))
    found = df.limit(most_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= most_rows and found["bytes"] <= most_bytes


def broadcast_if_small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it is ``small``, else as it is (a shuffled join)."""
    return F.broadcast(df) if small(df, most_rows) else df


def blank_to_null(c: Column) -> Column:
    """Null for null, empty or blank-only text."""
    return F.when(F.length(F.trim(c)) > 0, c)
