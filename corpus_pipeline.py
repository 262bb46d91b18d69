"""From raw documents to packed training sequences, one table after another.

Each stage works on all that the one before it kept; its decisions take effect. All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm import line_dedup, packing, quality, simhash, suffix_dedup
from noticeflow.llm.common import Scratch, let_workers_import

#: Bytes of a passage that may not repeat: what fifty words take at least.
PASSAGE_BYTES = 256

#: Words of a shingle, and fingerprints of a text. Texts are near-duplicates if one of their fingerprints differs in CANDIDATE_BITS or fewer and all
#: together in MOST_BITS of their 512 or fewer, which texts at a similarity of 0.8 do in nearly all cases (77 are expected). No such pair is left out.
SHINGLE_WORDS, FINGERPRINTS, CANDIDATE_BITS, MOST_BITS = 5, 8, 7, 88


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the classifier, trained on this input's labelled rows, keep.

    A null, empty or blank text goes; rows with one id are judged each; without labelled rows the rules alone decide.
    """
    let_workers_import(spark)
    return quality.keep_good(spark, docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sites share, but for their first place; n_chars follows the text.

    A null text stays null; of rows with one id the first place goes by the text's hash, and rows that agree in both are treated alike.
    """
    out = line_dedup.remove_boilerplate(spark, docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id, without an id only where no other has one.

    Texts are near-duplicates if one of their eight fingerprints of five-word shingles is close and all eight together are; all such pairs come into one group,
    directly or over others. Texts without words are one group. Rows are told apart by id and text, so texts of one id (or none) that lie in different groups all stay.
    """
    let_workers_import(spark)
    text = F.coalesce("text", F.lit(""))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("text").isNull().alias("no_text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))
    marked = docs.withColumn("_row", row)
    groups = simhash.near_groups(spark, marked, id_col="_row", shingle=SHINGLE_WORDS, n=FINGERPRINTS, radius=CANDIDATE_BITS, most_bits=MOST_BITS)  # a group is named by its least row, so by no other group's
    kept = groups.where("doc_id = component_id").select(F.col("component_id").alias("_kept")).distinct()
    found = marked.join(kept, F.col("_row") == F.col("_kept"), "left_semi")
    return found.groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("_x")).select("_x.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that start elsewhere too; n_chars follows the text.

    A null text becomes empty. All places of a passage lose it, in the same document too, as do both of two whole copies; documents of any length are
    searched whole, and characters are never cut.
    """
    out = suffix_dedup.remove_repeats(spark, docs, PASSAGE_BYTES, as_text=True)
    return out.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and their places in training sequences; a null text is a piece with the end id alone."""
    return packing.pack(spark, packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_boilerplate),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]

#: The classifier, fingerprints, suffix arrays and tokens are beyond SQL. tests/llm holds each stage of a small chain against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    let_workers_import(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
