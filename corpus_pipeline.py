"""The corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage works on all that the one before kept. ``STAGES`` names them in order; ``run`` applies them to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portage.llm.bpe import tokenized, vocabulary
from portage.llm.common import staged, table, told_apart, without
from portage.llm.decontaminate import contamination
from portage.llm.langid import UNKNOWN, identify, train
from portage.llm.simhash import near_copies
from portage.llm.substring import repeated_text

#: A document stays if so many of its words belong to a known language for sure, whichever each of them belongs to.
LEAST_SURE = 0.5


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row as ``row`` with the key that the operators give it, whatever other columns there are."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        F.struct("*").alias("row"), F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("kid"), F.xxhash64(text, F.length(text)).alias("kh")
    )


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in known languages, one or several: rejects texts without a letter and those whose words are mostly of no sure language."""
    return identify(docs, train(docs), keep=lambda name, share, sure: name != UNKNOWN and sure >= LEAST_SURE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, Jaccard similarity 0.8 or more): the one with the
    smallest doc_id, null last; of several rows with that id the one with the smallest text hash, once. Of rows that agree
    in id and text the smallest by all columns stays; rows without id are documents like others."""
    found = staged(near_copies(docs), "near-duplicates")
    chosen = found.groupBy("root").agg(F.min(F.struct("kid", "kh")).alias("chosen"))
    judged = found.join(chosen, "root").select("kid", "kh", (F.struct("kid", "kh") == F.col("chosen")).alias("stays"))
    lost = staged(judged.where("not stays").select("kid", "kh").distinct(), "lost")
    kept = without(_keyed(docs), lost)
    repeated = staged(judged.where("stays").groupBy("kid", "kh").count().where("count > 1").select("kid", "kh"), "repeated")
    if repeated.isEmpty():
        return kept.select("row.*")
    asked = told_apart(kept, repeated)[0]
    once = asked.join(repeated, ["kid", "kh"], "left_semi").groupBy("kid", "kh").agg(F.min("row").alias("row"))
    return without(kept, repeated).select("row").unionByName(once.select("row")).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; a document of which nothing is left goes."""
    left = repeated_text(docs)[1]
    asked, others = told_apart(_keyed(docs), left)
    rows = others.withColumn("kept", F.lit(None).cast("string")).unionByName(asked.join(left, ["kid", "kh"], "left"))
    rows = rows.where("kept is null or kept <> ''")
    cut = F.col("kept").isNotNull()
    columns = [
        F.when(cut, F.col("kept")).otherwise(F.col("row.text")).alias("text") if c == "text"
        else F.when(cut, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars") if c == "n_chars"
        else F.col(f"row.`{c}`")
        for c in docs.columns
    ]
    return rows.select(columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    leaked = staged(found.where("contaminated").select("kid", "kh").distinct(), "leaked")
    return without(_keyed(docs), leaked).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with digests of the ids and of the text they decode to."""
    return tokenized(docs, vocabulary(), with_ids=True)


STAGES = [
    ("language ID", language), ("near dedup", near_dedup), ("substring dedup", substring_dedup),
    ("decontamination", decontamination), ("BPE", tokens),
]

#: Language ID and SimHash are beyond SQL; the tests hold all that follows language ID against plain Python, row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
