"""A training corpus from ``documents``: quality, toxicity, near duplicates, personal data, packing.

Each stage works on all documents that the one before kept, and its result is written and read again before the next.
All but the last return the columns of ``documents``; the last returns the pieces of packed sequences. ``labels`` serve to
fit the two classifiers, on bounded samples of rows outside the held-out folds of the operators' own queries.

Cases, alike in all stages: empty tables give no rows; null ids and repeated ids are rows like others; texts of any length
are taken whole; columns of ``documents`` alone are read and returned, whatever others the input has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.llm.common import id_crc, written
from veilgrid.llm.jaccard_join import near_components
from veilgrid.llm.packing import pack
from veilgrid.llm.quality import fit_quality, with_score
from veilgrid.llm.surrogates import replace
from veilgrid.llm.toxicity import fit_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5. Null, empty and blank texts are scored as texts without words; equal
    texts get equal scores, so repeated rows stay or go together; without labels of both kinds all scores are 0.5 and all
    documents stay."""
    corpus, labels = _tables(spark, sf_dir)
    model = fit_quality(corpus, labels, id_crc("doc_id") % 3 != 1)
    return with_score(docs.select(COLUMNS), model, "quality_score").where("quality_score >= 0.5").select(COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. Null, empty and blank texts are scored as texts without hits; repeated
    rows stay or go together; without labels of both kinds nothing is known to be toxic and all documents stay."""
    corpus, labels = _tables(spark, sf_dir)
    model = fit_toxicity(corpus, labels, id_crc("doc_id") % 5 != 0)
    if model.weights is None:
        return docs.select(COLUMNS)
    return with_score(docs.select(COLUMNS), model, "toxic_score").where("toxic_score < 0.5").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id; of several with that id, or without any id, the
    first that was read. So of repeated rows one stays, and of an id with several texts each text is judged by itself.
    Null, empty and blank texts are copies of nothing and stay, all of them."""
    # ids may repeat, so rows get numbers of their own, which the written table keeps
    rows = written(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_components(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first.alias("first")).select("first._row")
    return rows.join(kept.hint("shuffle_hash"), "_row", "left_semi").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars is counted anew. Null texts stay null, with a null count;
    empty ones, and texts without personal data, stay as they are; repeated rows become alike."""
    return replace(docs.select(COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens. A null or empty text gives its end id alone; repeated rows are packed
    each for itself."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("packing", packing),
]
#: SQL can express none of the classifiers, so the pipeline is held against plain versions of its stages in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
