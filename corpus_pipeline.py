"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, packing, quality, substring_dedup, toxicity
from tessera.llm.shared import stored
from tessera.package import ship

MOST_SENT = 1_000_000  # ids that may be broadcast; beyond, both sides are shuffled


def _fresh(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = "_" + name
    return name


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier finds rather good than bad.

    Null texts are judged as empty ones; rows of one id are judged each.
    """
    score = _fresh(docs, "quality_score")
    return quality.with_posterior(docs, _labels(spark, sf_dir), score).where(F.col(score) >= 0.5).drop(score)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below 0.7; null texts are judged as empty ones."""
    score = _fresh(docs, "toxic_score")
    return toxicity.with_score(docs, toxicity.fit(docs, _labels(spark, sf_dir)), score).where(F.col(score) < 0.7).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links join, the one of least id.

    Rows are judged, not ids: of rows of one id with different texts each
    belongs to the group of its own text, and of several rows of the least id
    in one group the one whose text has the least hash stays.  Rows with a null
    id, and texts without words, are in no group and stay, but of rows of the
    same id and text one.
    """
    ship(spark)
    key = _fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    found = stored(jaccard_join.link(keyed, row_key=F.col(key)), "components").where("doc_id is not null")
    rows = found.groupBy("doc_id", "row_key").agg(F.bool_and("kept").alias("kept"), F.min("n_shingles").alias("n"), F.min("set_id").alias("set_id"), F.count("*").alias("copies"))
    # texts that differ and have equal sets, of one id: one of them
    least = rows.where("kept and n > 0").groupBy("doc_id", "set_id").agg(F.min("row_key").alias("least"), F.count("*").alias("texts")).where("texts > 1").select("doc_id", "set_id", "least")
    rows = rows.join(least, ["doc_id", "set_id"], "left")
    stays = F.col("kept") & (F.col("least").isNull() | (F.col("least") == F.col("row_key")))
    marks = stored(rows.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), stays.alias("__stays"), (F.col("copies") > 1).alias("__repeated")).where("not __stays or __repeated"), "marks")

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= MOST_SENT else df

    of_row = (F.col("doc_id").cast("long") == F.col("__id")) & (F.col(key) == F.col("__key"))
    plain = keyed.join(sent(marks), of_row, "left_anti")
    repeated = keyed.join(sent(marks.where("__stays")), of_row, "left_semi").dropDuplicates(["doc_id", key])
    return plain.union(repeated).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has.

    A null text stays null; rows with a null id keep everything; columns
    other than text and n_chars are kept whatever their names.
    """
    ship(spark)
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}  # names that the operator doesn't use
    cleaned = substring_dedup.remove_repeats(docs.withColumnsRenamed(own), rejoin=False, id_col=own["doc_id"], text_col=own["text"])
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in own else None}
    return cleaned.select(*((new[c] if c in new else F.col(o)).alias(c) for c, o in own.items()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens; a null text has its end token only."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeats),
    ("packing", packed),
]

#: SQL can't express the classifiers and the packing; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written and read again."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "documents")
    return docs
