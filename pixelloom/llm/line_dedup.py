"""Line dedup: drop lines that recur across documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPACE, ascii_lower, numbered, stored, table

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    """A line without the six white-space characters at either end, with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WORD_SPACE)))


def _digest(key: Column) -> Column:
    """128 bits that stand for a key: two xxhash64 of different seeds."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def _without(lines: Column, gone: Column) -> Column:
    """An array without the places ``gone`` (from 0, rising): the stretches between them, so time follows its length."""

    def stretches(of: Column) -> Column:
        ends = F.slice(of["bounds"], 2, F.size(of["bounds"]) - 1)
        return F.flatten(F.transform(ends, lambda end, k: F.slice(of["lines"], F.get(of["bounds"], k) + 2, end - F.get(of["bounds"], k) - 1)))

    bounds = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    both = F.array(F.struct(lines.alias("lines"), bounds.alias("bounds")))
    return F.element_at(F.transform(both, stretches), 1)  # what a lambda only names would be made again for each stretch


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", in_place: bool = False) -> DataFrame:
    """``docs`` with the columns ``dedup_n_lines``, ``dedup_n_dropped`` and ``dedup_text`` added, or with the text
    replaced where ``in_place``.

    A key of at least ``min_chars`` code points that at least ``min_docs`` documents hold loses its lines in all
    of them but the one with the largest id.  Documents are told apart by id: rows that repeat an id are one
    document when keys are counted, and each still gives a row.  A null id counts as one document, below all others.
    A null or empty text is one empty line.  Columns of the input pass through unchanged, whatever their names; those
    of the three added names are replaced.

    Lines are exploded with their row and position, and only digests of their keys are shuffled for the counts,
    combined before the shuffle.  The common keys, one row each, are stored before lines are joined to them: the join
    is then broadcast, or its sides have shuffles of their own and adaptive execution splits a very common line.  The
    positions that go are gathered by row (so rows of null ids never meet), and a text is shuffled once, to theirs.
    Time follows the number of lines, however many of a text's lines are common.
    """
    rows, _ = numbered(docs)
    plain = rows.toDF(*[f"c{i}" for i in range(len(docs.columns))], "row")  # names that clash with none
    where = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    doc, lines = F.coalesce(where[id_col], F.lit(-(2**63)).cast("bigint")), F.split(F.coalesce(where[text_col], F.lit("")), "\n", -1)
    keys = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key"))), lambda e: F.char_length(e["key"]) >= min_chars)
    held = plain.select("row", doc.alias("id"), F.explode(F.transform(keys, lambda e: F.struct(e["pos"].alias("pos"), _digest(e["key"]).alias("k")))).alias("l"))
    held = held.select("row", "id", "l.pos", "l.k.a", "l.k.b")
    common = held.groupBy("a", "b").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs).drop("n")
    common = stored(common, "common-lines")
    gone = held.join(common, ["a", "b"]).filter(F.col("id") != F.col("keeper")).groupBy("row").agg(F.array_sort(F.collect_list("pos")).alias("gone"))

    out = plain.join(gone, "row", "left").withColumn("n", F.size(lines).cast("long"))
    text = F.when(F.col("gone").isNull(), F.coalesce(where[text_col], F.lit(""))).otherwise(F.array_join(_without(lines, F.col("gone")), "\n"))
    if in_place:
        return out.select(*[(text if c == text_col else where[c]).alias(c) for c in docs.columns])
    kept = [where[c].alias(c) for c in docs.columns if c.lower() not in ("dedup_n_lines", "dedup_n_dropped", "dedup_text")]
    dropped = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return out.select(*kept, F.col("n").alias("dedup_n_lines"), dropped.alias("dedup_n_dropped"), text.alias("dedup_text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("dedup_n_lines").alias("n_lines"), F.col("dedup_n_dropped").alias("n_dropped"), F.sha2("dedup_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.pos, l.line, c.k IS NOT NULL AND c.keeper <> l.doc_id AS dropped
  FROM keyed l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
