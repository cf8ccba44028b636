"""From raw documents to token ids: language ID, near-dedup, personal data, mixing, BPE.

Each stage takes (spark, docs, folder of the input tables) and returns the columns of ``docs``, the last one the
encoded documents. ``run`` writes each stage's rows as Parquet to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe, dedup, language, mixing, pii
from veilspark.llm.common import table, written

# Token shares of the domains in the mix. The total is set so that good documents gain a tenth. Documents
# that are likeliest good have rates of 1 at least, so that none of them is lost to rounding.
WEIGHTS = {"good": 0.9, "poor": 0.06, "toxic": 0.04}
GAIN = 1.1
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is known. The model learns from the documents that op9 may learn from; null and
    letterless texts go, and texts for which no language has the better half of the posterior."""
    return language.keep_identified(docs, language.train(language.learned(docs), "doc_id", "text", "lang"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near copies, that with the least id; a null id comes after all others. Rows are
    compared by their texts, also those that repeat an id or have none."""
    rows = written(docs.withColumn("row_", F.monotonically_increasing_id()), "numbered")
    named = dedup.near_duplicates(rows, "row_", percent=NEAR_PERCENT).select("row_", "component_id")
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row_")
    kept = rows.select("row_", "doc_id").join(named, "row_").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(kept.select(F.col("first.row_").alias("row_")), "row_", "left_semi").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as their rate says, so that domains have the target weights. Rows with a null id have
    no label and no rate of their own: they stay once."""
    model = mixing.train(docs, mixing.label_domains(table(spark, folder, "labels")))
    if "good" not in model[0]:
        return docs
    rates = mixing.mix_to_targets(docs, model, WEIGHTS, whole="good", factor=GAIN)
    copies = rates.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("rated_")).agg(F.max("copies").alias("copies_"))
    rows = docs.join(copies, docs["doc_id"] == copies["rated_"], "left")
    rows = rows.withColumn("copies_", F.coalesce("copies_", F.lit(1))).filter("copies_ > 0")
    return rows.withColumn("copy_", F.explode(F.expr("sequence(1, copies_)"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text that they decode to, a row per document."""
    rows = bpe.encode_documents(docs, decoded=True)
    return rows.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_copies),
    ("PII", hide_personal_data),
    ("mixing", mix_sources),
    ("BPE", encode),
]

#: The stages learn models and compare sets, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
