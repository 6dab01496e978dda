"""From raw documents to packed training sequences: five stages, each written and read again as Parquet.

Quality rules, quality classifier, SimHash near-duplicates and substring dedup hand on the columns of
``documents`` (doc_id, text, lang, source, n_chars); packing returns the pieces of sequences. The first two
judge row by row; near-dedup takes rows of one id and text as one document, substring dedup cuts them
alike; rows of one id and different texts are different documents, also where the id is null. A null
text is empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm._bpe import vocabulary
from lathework.llm._io import stash
from lathework.llm.packing import pack
from lathework.llm.quality_classifier import fit, score
from lathework.llm.quality_rules import quality_rules
from lathework.llm.simhash import deduplicate_similar
from lathework.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, carry=COLUMNS).filter("kept").select("carried.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; it learns from the raw documents, which show both classes."""
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, carry=COLUMNS).filter("predicted = 1").select("carried.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles: the one with the smallest id (null last), of one id that with the smallest hash."""
    return deduplicate_similar(docs.select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that start earlier; texts that lose nothing stay as they are."""
    rows = docs.select("doc_id", "text", "lang", "source", F.col("text").isNull().alias("_void"))
    cut = substring_dedup(rows, carry=("lang", "source", "_void"), untouched=True)
    text = F.when(~F.col("_void"), F.col("kept"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack(docs, vocabulary("byte_bpe_50k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substrings),
    ("packing", packing),
]

#: SQL can't express the fitted stages or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"pipeline-{k}")
    return docs
