"""The registered queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import bpe, dedup, forest, langid, linedup, packing, pii, quality, simhash, tokenfile
from lakeloom.llm._util import documents, held_out, new_folder, shared_dir

BYTE_FILE, WORD_FILE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    out = bpe.encode_documents(documents(spark, sf_dir), path or tokenizer(BYTE_FILE))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(documents(spark, sf_dir))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.where(~held_out("doc_id")), "text", "lang", F.col("doc_id"))
    return langid.predict(docs.select("doc_id", "text"), model, "text").select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings")
    return forest.nearest(rows, rows.where("vec_id % 20 = 0"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, documents(spark, sf_dir, "labels"), "doc_id", "text", "quality", ~held_out("doc_id"))
    return quality.score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = documents(spark, sf_dir)
    shared_dir(spark)
    folder = new_folder(spark, "tokens")
    files = tokenfile.write_token_files(docs, path or tokenizer(BYTE_FILE), folder)
    out = tokenfile.read_documents(spark, folder, files, docs.schema["doc_id"].dataType.simpleString())
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = pii.find(docs, pii.train(docs))
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *(count(k) for k in pii.KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op10_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    out = packing.pack_documents(documents(spark, sf_dir), path or tokenizer(WORD_FILE))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_exact_dedup, op3_langid, op4_forest, op5_quality, op6_line_dedup, op7_simhash, op8_token_files, op9_pii, op10_packing)}

ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
