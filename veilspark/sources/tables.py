"""Reading tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_WORKERS = 8  # tables that are worked on at a time


def scan_table(
    spark: SparkSession,
    name: str,
    folder: str | None = None,
    columns: Iterable[str] | None = None,
    jdbc: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table as DataFrame: Parquet below ``folder``, over JDBC, or from the session catalog.

    A JDBC read is partitioned when the options name ``partitionColumn``, ``lowerBound``, ``upperBound``
    and ``numPartitions``; filters and column choices made on the result are pushed to the source.
    """
    if jdbc is not None:
        df = spark.read.format("jdbc").options(**{**jdbc, "dbtable": name}).load()
    elif folder is not None:
        df = spark.read.parquet(table_path(folder, name))
    else:
        df = spark.table(name)
    return df.select(*columns) if columns is not None else df


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores, for a narrow table each of whose rows becomes much work.

    A file with one row group is one task, however many cores wait. Only the columns that are used are shuffled.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks)


def table_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def scan_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: scan_table(spark, name, folder) for name in names}


def quoted(name: str) -> str:
    """A column name as SQL, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def per_table(spark: SparkSession, work: Callable, names: Sequence) -> list:
    """``work`` of each name, some at a time; each job carries the caller's session settings."""
    if not names:
        return []
    with ThreadPoolExecutor(min(_WORKERS, len(names))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), names))


def footer_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Tables whose row counts, value counts and ranges of numbers come from the Parquet footers where these have them.

    Such tables belong to a session beside the given one, in which Parquet files are read by the newer
    reader: it answers whole-table ``count``, ``min`` and ``max`` without reading a page. Everything else
    works as usual. The ordinary reader is left with tables that have nested columns, which have several leaves in a
    footer, and with tables that have a file without the statistics, as a writer leaves them out for columns whose
    least or greatest text is some thousand bytes long: one look at the footers of each table tells. So are tables
    without a row, whose count the newer reader gives as null.
    """
    side = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            side.conf.set(key, value)
    side.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    side.conf.set("spark.sql.sources.useV1SourceList", "")
    tables = {name: scan_table(side, name, folder) for name in names}
    flat = [name for name, df in tables.items() if not any(isinstance(f.dataType, _NESTED) for f in df.schema.fields)]
    whole = dict(zip(flat, per_table(side, lambda name: _footers_suffice(tables[name]), flat)))
    return {name: df if whole.get(name) else scan_table(spark, name, folder) for name, df in tables.items()}


def _footers_suffice(df: DataFrame) -> bool:
    """Whether every footer has the value counts of all columns and the ends of the whole numbers."""
    asked = [f"count({quoted(f.name)})" for f in df.schema.fields]
    for f in df.schema.fields:
        if isinstance(f.dataType, _INTEGRAL):
            asked += [f"min({quoted(f.name)})", f"max({quoted(f.name)})"]
    try:
        return df.selectExpr("count(1)", *asked).first()[0] is not None  # null where no file has a row
    except (PySparkException, Py4JJavaError) as error:
        if "aggregatePushdown" not in str(error):
            raise
        return False


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the Parquet tables in a folder of any file system Spark can reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = (PurePosixPath(status.getPath().toString()).name for status in found)
    return sorted(name[: -len(".parquet")] for name in names if name.endswith(".parquet"))
