"""Treatment of streams, with decisions frozen from a batch or running along."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import patterns as P
from ..functions.detectors import Detector
from ..functions.texts import anonymise_text
from ..operators.detect import column_hits, judge_hits
from ..plans.tables import TableDecisions, decide, treat_table
from ..sources.tables import scan_table, table_path


def read_files(
    spark: SparkSession,
    folder: str,
    schema,
    name_filter: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).options(**dict(options or {}))
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(folder)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a Parquet table below ``folder`` as a stream, be the table one file or a folder of files."""
    schema, place = scan_table(spark, name, folder).schema, table_path(folder, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return read_files(spark, place, schema)
    return read_files(spark, folder, schema, name_filter=path.getName())


def treat_stream(stream: DataFrame, decisions: TableDecisions) -> DataFrame:
    """The batch projection on a stream: no state, so no watermark and no growing store."""
    return treat_table(stream, decisions)


def treat_text_stream(stream: DataFrame, text: str, **options) -> DataFrame:
    """Free text of a stream treated span by span, with the report beside it."""
    treated = stream.withColumn("_treated", anonymise_text(text, **options))
    return treated.withColumns({text: treated["_treated.text"], "report": treated["_treated.report"]}).drop(
        "_treated"
    )


def write_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now and stop; a restart with the same checkpoint goes on from there.

    The file sink's log makes each input row appear once, also after a lost executor.
    """
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start(path)
    )


def refreshed_writer(
    stream: DataFrame,
    decide_now: Callable[[DataFrame], TableDecisions],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Decide anew on every micro-batch, for sources whose columns change meaning over time.

    Each batch writes to its own folder in overwrite mode, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        treated = treat_table(batch, decide_now(batch))
        treated.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


_TOTALS_TYPE = "column_name string, entity string, hits bigint, heads bigint, score double, lead struct<start: int, neg_end: int>"
_FOUND_TYPE = "column_name string, entity string, hits bigint, n_values bigint, score double, since bigint, nth int"


def _latest(spark: SparkSession, path: str, number: int, schema: str) -> DataFrame:
    """The table that the last batch before ``number`` left below ``path``; empty if there is none."""
    try:
        rows = spark.read.schema(f"{schema}, batch bigint").parquet(path).filter(F.col("batch") < number)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == F.lit(last)).drop("batch")


def _running_scan(
    spark: SparkSession, state: str, number: int, detectors: Iterable[Detector] | None, min_score: float
) -> Callable[[DataFrame, list[str]], DataFrame]:
    """A scan for ``decide`` that counts in all earlier batches and gives up no entity that they gave a column.

    Kept are sums and entities of each batch, (columns x entities) rows in a folder of its own below ``state``. A batch that is
    done again starts from the batch before it and replaces its own folder.
    """

    def add(path: str, rows: DataFrame, schema: str) -> DataFrame:
        place = f"{state}/{path}/batch={number}"
        rows.write.mode("overwrite").parquet(place)
        return spark.read.schema(schema).parquet(place)

    def scan(batch: DataFrame, columns: list[str]) -> DataFrame:
        fresh = column_hits(batch, columns, detectors).select(*[F.col(c) for c in ("column_name", "entity", "hits", "heads", "score", "lead")])
        both = _latest(spark, f"{state}/totals", number, _TOTALS_TYPE).unionByName(fresh)
        sums = both.groupBy("column_name", "entity").agg(
            F.sum("hits").alias("hits"), F.sum("heads").alias("heads"), F.max("score").alias("score"), F.min("lead").alias("lead")
        )
        totals = add("totals", sums, _TOTALS_TYPE)
        now = judge_hits(totals, min_score).select(
            "column_name", "entity", "hits", "n_values", "score", F.lit(number).cast("bigint").alias("since"), F.col("rank").alias("nth")
        )
        stood = _latest(spark, f"{state}/found", number, _FOUND_TYPE)
        kept = stood.unionByName(now).groupBy("column_name", "entity").agg(
            *[F.max(c).alias(c) for c in ("hits", "n_values", "score")], F.min(F.struct("since", "nth")).alias("first")
        )
        found = add("found", kept.select("column_name", "entity", "hits", "n_values", "score", "first.*"), _FOUND_TYPE)
        order = Window.partitionBy("column_name").orderBy("since", "nth", "entity")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("column_name").isin(columns))

    return scan


def running_writer(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    state: str,
    detectors: Iterable[Detector] | None = None,
    min_score: float = P.MIN_SCORE,
    **options,
) -> StreamingQuery:
    """Treat each micro-batch by what it and all batches before it hold; further options as for ``decide``.

    Shares of hits are taken over everything seen so far, and an entity that a column once had stays: a later batch may add
    to what is treated, never take from it, and the first entity, by which a column is treated, does not change. Rows
    written before the first hit of their column stay as written; freeze decisions from a batch where that matters.
    Batch, sums and entities go to folders of the batch's number, so a repeated batch replaces itself and a
    restart from ``checkpoint`` goes on from ``state``.
    """

    chosen = None if detectors is None else list(detectors)

    def write(batch: DataFrame, number: int) -> None:
        scan = _running_scan(batch.sparkSession, state, number, chosen, min_score)
        treated = treat_table(batch, decide(batch, scan=scan, **options))
        treated.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
