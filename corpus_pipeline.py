"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor kept and returns
a DataFrame. All but the last return the columns of documents, whatever their names. run() writes each result to the shared
folder and reads it again as the next stage's docs.

Defined results: null and empty texts and those without letters go with the first stage. Rows with one id and one text are
copies of one document to line dedup and one document to near-dedup, which keeps or drops all of them; rows with one id and
different texts are cut and judged each by its own text. A row without an id is no copy of another to near-dedup and stays
there. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm import decontam, langid, line_dedup, packing, simhash
from chronolex.llm.common import read, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts without letters and those of doubtful language go."""
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier; n_chars follows the text."""
    out = line_dedup.dedupe_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest, of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no whole window of the benchmark, and in which shorter items make up less than a twentieth."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_words(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("packing", sequences)]

#: Models, hashes and token ids are not SQL; tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
