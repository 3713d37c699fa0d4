"""Readers, writers and versioned publishing.

Writes go through the DataFrame writer (one file per task, no driver
round-trip). Publishing writes a new ``version=`` folder, never overwrites, and
then logs it with a commit number; readers take the version with the highest
number and read its folder directly, with its own schema.
"""

from __future__ import annotations

import datetime as _dt

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardstat.session import scratch_folder

CORRUPT_COL = "_corrupt_record"


def read_incidents(spark: SparkSession, path: str, fmt: str = "csv", schema: StructType | str | None = None) -> DataFrame:
    """Read an incident table.

    CSV: header row, no type inference (every column is text unless ``schema``
    is given; the cleaner parses dates and labels), malformed lines kept in
    ``_corrupt_record`` when a schema names that column. Parquet/ORC/JSON read
    natively with column pruning and filter pushdown."""
    if fmt == "csv":
        r = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", False)
        if schema is not None:
            r = r.schema(schema)
            names = schema.fieldNames() if isinstance(schema, StructType) else []
            if CORRUPT_COL in names or (isinstance(schema, str) and CORRUPT_COL in schema):
                r = r.option("columnNameOfCorruptRecord", CORRUPT_COL)
        return r.csv(path)
    return spark.read.format(fmt).load(path) if schema is None else spark.read.schema(schema).format(fmt).load(path)


def read_upload(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """An uploaded dataset must be ``.csv`` files and hold at least one row."""
    if not path.endswith(".csv") and not path.endswith("/") and "." in path.rsplit("/", 1)[-1]:
        raise ValueError("only .csv uploads are accepted")
    names = spark.read.format("binaryFile").load(path).select("path")  # names only: no file is read
    if not names.where(~F.col("path").endswith(".csv")).isEmpty():
        raise ValueError("only .csv uploads are accepted: the folder holds other files")
    r = spark.read.option("header", True)
    df = (r.schema(schema) if schema is not None else r).csv(path)
    if df.isEmpty():
        raise ValueError("uploaded file holds no rows")
    return df


def probe(df: DataFrame) -> DataFrame:
    """S3: row count and column list (one row)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("columns", F.lit(",".join(df.columns)))


def write_processed(df: DataFrame, path: str, partition_by: str | None = "year") -> None:
    """Processed table as Parquet, partitioned by year when present."""
    w = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def write_aggregates(aggs: dict[str, DataFrame], root: str) -> list[str]:
    """Each aggregate to ``{root}/{name}_aggregated``."""
    out = []
    for name, df in aggs.items():
        p = f"{root.rstrip('/')}/{name}_aggregated"
        df.write.mode("overwrite").parquet(p)
        out.append(p)
    return out


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as JSON (one task; the frame is one row)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_training_summary(df: DataFrame, path: str) -> None:
    """Training summary as JSON without model/scaler object columns."""
    keep = df.drop(*[c for c in ("model", "scaler") if c in df.columns])
    keep.coalesce(1).write.mode("overwrite").json(path)


def new_version() -> str:
    return _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")


def _versions_path(root: str) -> str:
    # "_"-prefixed folders are hidden from Spark's file listing, so the data read of
    # ``root`` never sees this table.
    return f"{root.rstrip('/')}/_versions"


def publish(df: DataFrame, root: str, version: str | None = None) -> str:
    """Write the dataset as ``version=<v>``; older versions stay as backups
    and nothing is overwritten (an existing version is an error). After the data is
    committed, one row (version, commit number, time) is appended to the
    ``_versions`` table, so a reader never sees an unfinished version.

    Several publishers may work at once: a commit number is taken by creating its file under
    ``_commits`` exclusively, and whoever finds it taken tries the next one. So no two
    versions have the same number and the current one is that of the highest, whichever row was
    appended last. A publisher that dies after taking a number leaves it unused. Exclusive creation is
    the store's: the name node's on HDFS, the kernel's on a local folder; an object
    store must have conditional writes on (for S3A, ``fs.s3a.create.conditional.enabled``)."""
    v = version or new_version()
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(version_path(root, v))
    commit = _next_commit(spark, root)
    while not claim(spark, f"{_commits_path(root)}/{commit:012d}", v):
        commit += 1
    row = spark.createDataFrame([(v,)], "version string").withColumn("committed_at", F.current_timestamp())
    # a folder for each commit: two jobs that append to one folder would clear each other's temporary files
    row.write.mode("errorifexists").parquet(f"{_versions_path(root)}/commit={commit}")
    return v


def _commits_path(root: str) -> str:
    return f"{root.rstrip('/')}/_commits"


def _next_commit(spark: SparkSession, root: str) -> int:
    """The number after the last one logged; it may be taken by the time it is claimed."""
    log = _version_log(spark, root)
    return 1 + (0 if log is None else log.agg(F.max("commit")).first()[0] or 0)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file ``path`` with ``text``; False where it exists already. Of several callers one gets True."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where.getParent())
    data = bytearray(text.encode())
    try:
        if store.getUri().getScheme() == "file":  # Hadoop's local create looks first and creates then
            nio = spark._jvm.java.nio.file
            options = spark.sparkContext._gateway.new_array(nio.OpenOption, 1)
            options[0] = nio.StandardOpenOption.CREATE_NEW
            nio.Files.write(spark._jvm.java.io.File(where.toUri().getPath()).toPath(), data, options)
        else:
            out = store.create(where, False)
            try:
                out.write(data)
            finally:
                out.close()
    except Py4JJavaError as taken:
        if not taken.java_exception.getClass().getSimpleName().startswith("FileAlreadyExists"):
            raise
        return False
    return True


def version_path(root: str, version: str) -> str:
    return f"{root.rstrip('/')}/version={version}"


def _version_log(spark: SparkSession, root: str) -> DataFrame | None:
    """The ``_versions`` table, or None where nothing was ever published."""
    try:
        return spark.read.schema("version string, commit long, committed_at timestamp").parquet(_versions_path(root))
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_version(spark: SparkSession, root: str) -> str | None:
    """The version published last (by commit number, then time), from the
    one-row-per-version log; None where nothing is published."""
    log = _version_log(spark, root)
    if log is None:
        return None
    row = log.agg(F.max_by("version", F.struct("commit", "committed_at", "version"))).first()
    return row[0]


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The version published last, with its own schema; only its folder is
    listed. An error where nothing is published."""
    v = current_version(spark, root)
    if v is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.parquet(version_path(root, v))


def save_model(model, path: str) -> None:
    """Persist a fitted ``PipelineModel`` (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load a ``PipelineModel`` saved by ``save_model``."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def stage_csv(df: DataFrame, name: str) -> str:
    """Write a frame as headed CSV under the shared scratch folder; return the path.

    Spark's CSV writer trims field whitespace by default; the staged file keeps
    every text exactly (as a pandas-written upload would), so padding reaches the
    cleaner."""
    path = scratch_folder(df.sparkSession, name)
    w = df.write.mode("overwrite").option("header", True)
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path
