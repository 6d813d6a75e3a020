"""A training corpus out of raw documents: language ID, exact dedup, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the shared checkpoint folder and rereads
it as the next stage's documents. All stages but the last return the columns of documents, whatever these are beside doc_id, text, lang and
source; no column's name clashes with a stage's own. An empty table goes through as one, and ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from billprism.llm import exact_dedup, langid, mixing, ngram_join, packing
from billprism.llm.common import read, stash
from billprism.llm.queries import held_out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null, empty and blank texts among them), those on which two languages tie, and those whose margin is narrower than
    labelled texts of that length have. Texts are read whole, however long; repeated rows have one fate."""
    known = langid.learn(docs.filter(~held_out()))
    return langid.identify(docs, known).filter("not rejected").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the largest id of each group of equal texts; of rows that repeat that id, one. Null counts as empty; a group whose ids are all null keeps one row."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component of linked documents. Texts without words link with nothing and stay. Where ids are null or repeat, rows get numbers of their own."""
    return ngram_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents as the mix takes them; those it takes no words of, null and blank texts among them, give no row. Null is a source of its own; ties in the seeded order are told by id and text."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. Null and empty texts are one token; only texts longer than a sequence are cut; each repeated row is packed."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("ngram_jaccard", near), ("source_mix", mixture), ("best_fit_packing", packed)]

#: Compression, components, apportionment and packing are not expressible in SQL; tests hold the ids and texts after each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs, name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
