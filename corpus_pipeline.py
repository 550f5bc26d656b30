"""From raw documents to training input: five stages, each written as Parquet and read again by the next.

All stages but the last return the columns of documents (doc_id, text, lang, source, n_chars); further columns pass through
the first two and are left by the third. Nulls, empty tables and repeated rows are treated as the operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithocube.llm import mixing, ngram_join, quality_rules, sentencepiece_codec, suffix_dedup
from lithocube.session import shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that a learned rule rejects go."""
    learned = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    # the row as it came travels in one column, so that none of its columns is taken for a statistic
    rows = docs.select("text", F.struct("*").alias("row"))
    return quality_rules.apply_rules(rows, learned).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8, the document of the smallest id stays, once for each of its texts.
    Documents without words and with a null id stay."""
    groups = ngram_join.ngram_jaccard_join(docs, 5, 80, 100)
    first = groups.where((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    alone = groups.where(F.col("n_shingles") == 0).select("doc_id").distinct()
    stay = first.union(alone).distinct()
    return docs.alias("d").join(stay.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi").dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out, to whole characters. A document goes if nothing is left of it."""
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), 100, payload=("lang", "source"), as_text=True)
    left = cut.where((F.size("spans") == 0) | (F.trim("kept") != ""))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    taken = mixing.mix(docs.select(*COLUMNS), payload=("text", "lang", "n_chars"))
    return taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, ids, n_pieces, round_trip): SentencePiece ids, decoded again as a check."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_texts(docs, path), path)
    return both.select("doc_id", "n_bytes", "ids", F.size("ids").cast("long").alias("n_pieces"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixture", mixture),
    ("pieces", pieces),
]

#: SQL can't learn the rules nor encode; the rows of the stages are tested against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder; a stage's rows go when the next one's are there."""
    folder = f"{shared_dir(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs
