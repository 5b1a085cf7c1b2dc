"""Quality rules: figures of each text, then cross-document line frequency per host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPACE, Scratch, sliced, table

MIN_WORDS, REPEAT_PERCENT = 50, 50
#: A line is boilerplate of its host when more than LINE_DOCS of the host's documents hold it, however large the host is.
LINE_DOCS = 5
#: A document is depleted when more than this share of its words is boilerplate, or fewer than MIN_WORDS words are not.
DEPLETED_PERCENT = 70
SYMBOLS = "#*$%&|<>"

FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SCHEMA = f"doc_id long, {FIGURES}, keys array<struct<a:long,b:long>>, key_words array<int>"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:  # three of them would not fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    inside[:-2] |= again
    inside[1:-1] |= again
    inside[2:] |= again
    return int(inside.sum())


def text_figures(text: str) -> tuple[int, int, int, int, int, dict[bytes, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words of each normalised line.

    A normalised line is its words, A-Z lower-cased, joined by one space; lines without a word have none.
    """
    words: list[bytes] = []
    seen: set[bytes] = set()
    dup = 0
    lines: dict[bytes, int] = {}
    for line in text.encode().split(b"\n"):
        if own := line.split():  # bytes are split at just the six ASCII white-space characters
            dup += line in seen
            seen.add(line)
            words += own
            key = b" ".join(own).lower()
            lines[key] = lines.get(key, 0) + len(own)
    chars = len(text) - sum(map(text.count, WORD_SPACE))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat_words(words), lines


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of each text; its lines as 128-bit hashes of host and line, with their words."""
    for batch in sliced(batches):
        ids, hosts, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        figures, ends, digests, counts = [], [0], [], []
        for host, text in zip(hosts, texts):
            *own, lines = text_figures(text.as_py() or "")
            prefix = (host or "").encode() + b"\0"
            figures.append(own)
            digests += [xxhash.xxh3_128_digest(prefix + k) for k in lines]
            counts += lines.values()
            ends.append(len(counts))
        columns = np.array(figures, np.int64).reshape(-1, 5).T
        a, b = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
        offsets = pa.array(ends, pa.int32())
        keys = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]))
        words = pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, batch.schema.names[3:]), ids, *map(pa.array, columns), keys, words],
            names=[*batch.schema.names[3:], "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "keys", "key_words"],
        )


def judge(docs: DataFrame, line_docs: int = LINE_DOCS, depleted_percent: int = DEPLETED_PERCENT, min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT, row_col: str | None = None) -> DataFrame:
    """Figures and a verdict for each row of ``docs`` (``doc_id, source, text``; other columns are left aside).

    ``base_failed`` is true below ``min_words`` words or with over ``repeat_percent`` % repeated words.  Then the
    normalised lines of all documents are hashed and counted for each host (``source``); rows that repeat an id are one
    document (with ``row_col`` each row is one).  A
    line that over ``line_docs`` documents of the host hold is removed from all of them but the one with the smallest
    id (so a group of copies is never removed whole).  A document that loses over ``depleted_percent`` % of its words,
    or of which fewer than ``min_words`` stay, is depleted and rejected.  The limit is a count, so it is the same in
    a host of a thousand documents and in one of a thousand million.

    A null text has no words and fails the base rules; a null source is the host ``''``; a null id is below all
    others.  Repeated rows each give a row: they are told apart by a row number made once and stored, or by
    ``row_col``, which is then returned; of equal ids that hold a line the smallest number in ``row_col`` keeps it,
    without ``row_col`` all rows of that id.  A very long
    text or line is one row like others: what is kept of a line is its hash.  The figures and hashes (not the texts)
    are stored in the shared folder, so texts are read and walked once.  Hot lines are counted with partial sums
    before the shuffle, and the frequent ones, one row each, are stored before lines are joined to them, so that the
    join is broadcast or splits a hot line.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    own = [F.col(row_col).alias("row")] if row_col else []
    fields = f"row {docs.schema[row_col].dataType.simpleString()}, " if row_col else ""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("host"), "text", *own).mapInArrow(_figures, fields + _SCHEMA)
    rows = scratch.store(rows if row_col else rows.withColumn("row", F.monotonically_increasing_id()), "figures")
    at = F.coalesce("doc_id", F.lit(-(2**63)).cast("bigint"))
    lines = rows.select("row", (F.struct(at.alias("id"), "row") if row_col else at).alias("id"), F.explode(F.arrays_zip("keys", "key_words")).alias("l"))
    lines = lines.select("row", "id", "l.keys.a", "l.keys.b", F.col("l.key_words").alias("words"))
    often = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("holder")).filter(F.col("n") > line_docs).drop("n")
    often = scratch.store(often, "frequent-lines")
    if not row_col:  # of the lines of so many rows those of so many documents, as rows may repeat an id
        several = lines.join(often, ["a", "b"]).groupBy("a", "b", "holder").agg(F.count_distinct("id").alias("n"))
        often = scratch.store(several.filter(F.col("n") > line_docs).drop("n"), "frequent-lines")
    lost = lines.join(often, ["a", "b"]).filter(F.col("id") != F.col("holder")).groupBy("row").agg(F.sum("words").alias("lost"))
    out = rows.drop("keys", "key_words").join(lost, "row", "left").withColumn("n_lost", F.coalesce("lost", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    depleted = (F.col("n_lost") * 100 > F.col("n_words") * depleted_percent) | (F.col("n_words") - F.col("n_lost") < min_words)
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
    return out.drop("lost").withColumnRenamed("row", row_col) if row_col else out.drop("row", "lost")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost")


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS host,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
split AS (
  SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM lines),
keyed AS (
  SELECT *, translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth
  FROM split WHERE len(words) > 0),
words AS (
  SELECT doc_id, pos, unnest(words) AS w, generate_subscripts(words, 1) AS q FROM keyed),
placed AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos, q) AS p FROM words),
windows AS (
  SELECT doc_id, p, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3
  FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
twice AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS again FROM windows WHERE w3 IS NOT NULL),
repeats AS (
  SELECT doc_id, count(DISTINCT p + d) AS n FROM twice, (VALUES (0), (1), (2)) AS o(d) WHERE again GROUP BY doc_id),
sums AS (
  SELECT doc_id, sum(len(words)) AS n_words, sum(list_sum(list_transform(words, lambda x: length(x)))) AS word_chars,
         count(*) FILTER (WHERE nth > 1) AS n_dup_lines
  FROM keyed GROUP BY doc_id),
often AS (
  SELECT host, k, min(doc_id) AS holder FROM keyed GROUP BY host, k HAVING count(DISTINCT doc_id) > 5),
lost AS (
  SELECT doc_id, sum(len(words)) AS n FROM keyed JOIN often USING (host, k) WHERE doc_id <> holder GROUP BY doc_id),
rows AS (
  SELECT d.doc_id, coalesce(s.n_words, 0)::BIGINT AS n_words, coalesce(s.word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(s.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         coalesce(l.n, 0)::BIGINT AS n_lost
  FROM documents d LEFT JOIN sums s USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN lost l USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_lost <= 70 * n_words AND n_words - n_lost >= 50 AS kept
FROM rows
"""
