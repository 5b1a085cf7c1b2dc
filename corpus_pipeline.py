"""A training corpus from ``documents``: language, quality, repeated lines, near copies, then packed sequences.

Each stage works on all that the one before kept, and all but the last return the columns of ``documents``.
The stages that select do so by row, so that rows of null or repeated ids each have a verdict of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import jaccard_join, language_id, line_dedup, packing, quality_rules
from pixelloom.llm.common import Scratch, crc_mod, numbered, others, table

#: A text unlike all that was learned scores about a quarter.
MIN_LANGUAGE_SCORE = 0.3
#: Short documents are no fault in a corpus that is packed: only those of hardly any words go.
MIN_WORDS = 5


def with_rows(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Rows of ``docs`` (of ``numbered``) whose number is in ``rows``, without it."""
    return docs.join(rows.select(name), name, "left_semi").drop(name)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some learned language claims; texts without a letter, and those that no language claims, go.

    Where no document to learn from names a language there is nothing to judge by, and all documents stay."""
    model = language_id.train(docs.filter(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", "text", "lang"))
    if model is None:
        return docs
    rows = docs.select(F.struct(*others(docs)).alias("doc"), language_id.language_of(model)(F.col("text")).alias("language"))
    claimed = (F.col("language.lang_pred") != language_id.UNKNOWN) & (F.col("language.score") >= MIN_LANGUAGE_SCORE)
    return rows.filter(claimed).select("doc.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with a lower bound of words than op3's."""
    rows, name = numbered(docs)
    judged = quality_rules.judge(rows.select("doc_id", "source", "text", name), min_words=MIN_WORDS, row_col=name)
    return with_rows(rows, judged.filter("kept"), name)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur across them; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs, in_place=True)
    if "n_chars" not in docs.columns:
        return out
    chars = F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[chars if c == "n_chars" else F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that of the smallest id (a null one last); rows without a word all stay."""
    rows, name = numbered(docs)
    return with_rows(rows, jaccard_join.classes(rows.select("doc_id", "text", name), row_col=name).filter("kept"), name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie in sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", keep_languages),
    ("quality_rules", keep_quality),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_copies),
    ("packing", pack),
]
#: SQL cannot express the first stage and the last; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is removed once the next one's is stored."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.store(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
