"""From documents to packed token sequences, in five stages.

1. language: documents without letters, or whose language is all but a guess, go.
2. exact_dedup: of equal texts the one with the largest doc_id stays.
3. near_dedup: of each SimHash component one document stays, the one with the smallest doc_id. A document is its doc_id
   and text: null ids come last, and of equal ids that with the smallest digest of its text stays.
4. personal_data: spans are replaced by their kind; n_chars follows.
5. packing: sequences of at most 4096 tokens.

Each stage works on whole texts of all that the one before kept. Rows pass with all their columns. Null texts count as
empty: the first stage drops them, since they have no letters. Null ids are kept; of rows that repeat a whole document,
one stays. SQL can express none of the models, so there is no ORACLE_SQL; tests compare the stages with plain versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import dedup, langid, packing, pii, simhash
from lakeloom.llm._util import cut, new_folder, own_name
from lakeloom.llm.queries import WORD_FILE, tokenizer

#: A prediction below this share is a guess among four learned languages.
LEAST_SCORE = 0.3

ORACLE_SQL = None


def least_score(classes: int) -> float:
    """As far from an even guess among `classes` languages, on the way to certainty, as LEAST_SCORE is among four."""
    return 1 / classes + (1 - 1 / classes) * (LEAST_SCORE - 1 / 4) / (1 - 1 / 4)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known, with all their columns. Null and empty texts and those without letters go. With no
    labels to learn from, every text with letters stays."""
    model = langid.train(docs, "text", "lang", F.coalesce(F.col("doc_id"), F.lit(-1)))
    lang, score = own_name(docs, "_lang"), own_name(docs, "_score")
    out = langid.predict(docs, model, "text", lang, score)
    known = (F.col(lang) != "und") & (F.col(score) >= least_score(len(model["classes"]))) if model["classes"] else F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    return out.where(known).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, with all its columns; null ids lose, and of equal ids the row with the largest other columns stays."""
    return dedup.winners(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one document: the smallest doc_id, null ids last, of equal ids the smallest digest of the text. Rows that are equal in both stay or go together."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("digest"))
    found = simhash.near_duplicates(docs.select(row.alias("row"), "text"), "row")
    name = own_name(docs, "_row")
    gone = cut(found.where("row <> component_id").select(F.col("row").alias(name)).distinct())
    return docs.withColumn(name, row).join(gone, name, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; spans of personal data are replaced by their kind, and n_chars counts the new text. Null texts stay null."""
    out = pii.mask(docs, pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence. Null and empty texts are the end id alone."""
    out = packing.pack_documents(docs, tokenizer(WORD_FILE))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written as Parquet to the shared folder and read again by the next."""

    def step(docs: DataFrame, stage) -> DataFrame:
        name, f = stage
        at = new_folder(spark, name)
        f(spark, docs, sf_dir).write.parquet(at)
        return spark.read.parquet(at)

    return reduce(step, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
