"""The corpus pipeline: quality rules, exact dedup, near duplicates, mixing, packing.

Every stage reads what the stage before it has written, all of it, and its decisions take effect on the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm.common import dropped, set_aside, table, written
from blockloom.llm.exact_dedup import drop_exact_copies
from blockloom.llm.jaccard_join import one_of_each_class
from blockloom.llm.mixing import mix_sources, repeated
from blockloom.llm.packing import pack_documents
from blockloom.llm.quality_rules import quality_rules


#: Columns that the operators add, which the stages' documents may have themselves.
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "size", "source_size", "target", "taken"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them; rows that repeat are judged each.

    An empty table gives an empty one; null languages and sources are groups of their own. All columns stay as they are.
    """
    apart, back = set_aside(docs, ADDED)
    return quality_rules(apart).where("kept").select(*apart.columns).withColumnsRenamed(back)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; null counts as the empty text, a null id is below all others.

    Of rows equal in id and text one stays. An empty table gives an empty one. All columns stay as they are.
    """
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word Jaccard similarity 0.8 connect, the one with the least id stays, null before all others.

    Rows without words all stay; rows that repeat an id are documents of their own, and of rows equal in id and text
    one stays. Ids are whole numbers. An empty table gives an empty one. All columns stay as they are.
    """
    return one_of_each_class(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, or up to three times. Those without words are never taken.

    A null source is one of its own; rows alike in id are taken alike. An empty table gives an empty one. All columns stay as they are.
    """
    apart, back = set_aside(docs, ADDED)
    return repeated(mix_sources(apart)).select(*apart.columns).withColumnsRenamed(back)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words lie in which bin; copies never share one. Documents without words have a row without a bin.

    A null source is one of its own, rows that repeat are packed each, an empty table gives an empty one; other columns are ignored.
    """
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing", mixture), ("best-fit packing", packed)]

#: Sketch-based candidate search, a flow and best-fit search have no SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            dropped(before)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
