"""Ranked lexical search by TPUT: list heads, one threshold for all lists of a query, then exact look-ups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, sliced, table

TOP = 10
#: Documents of each query whose exact score is looked up after the heads have been read.
PROBES = 50
#: Query terms that one pass over the documents looks for.
BLOCK_TERMS = 1 << 18
#: Letters and digits of ASCII with A-Z lower-cased, all bytes beyond ASCII as they are, the rest as spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        found = [sorted(set(terms(text.as_py()))) for text in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])


def _forward(known: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each document (row, id, text) the number of its terms, and which of ``known`` it holds how often."""

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, numbers, counts = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                words = terms(text.as_py())
                own = Counter(filter(None.__ne__, map(known.get, words)))
                sizes.append(len(words))
                numbers.append(list(own))
                counts.append(list(own.values()))
            lists = [pa.array(numbers, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *lists], names=["row", "id", "n", "terms", "tf"])

    return forward


def _score(docs: int, total: int) -> Column:
    """A term's part of a document's score, from ``w``, ``tf`` and ``n``; 64-bit integers, division rounding down."""
    return F.expr(f"w * ((1000000000 * tf) div (1000 * tf + 8 * (10 + (90 * n * {docs}L) div {max(1, total)}L)))")


def _best(df: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each item; Spark drops the rest before the shuffle too."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, probes: int = PROBES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """``item_col, rank, id_col, score``: the ``top`` documents of each row of ``items`` with a score above 0.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.  With N documents that
    have a term, L terms in all, n terms in a document and df documents that hold a term, the term's weight is
    ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and its part of a score ``w * (10^9 tf div (1000 tf + 8 m))`` with
    ``m = 10 + 90 n N div L``.  A score is the sum over the item's distinct terms.

    1. Documents are read once (once for each ``block_terms`` terms of the items): for each, its size and the counts
       of the items' terms.  From these, document frequencies, and postings by term in falling order of their parts,
       ranges of which are files, so that a term in most documents is many of them.
    2. The heads of the lists, ``top`` postings each, give partial sums; exact scores of the ``probes`` best documents
       of each item give a bound from below, that of the ``top``-th of them.
    3. A document among the best holds a part of at least that bound over the number of the item's lists.  All such
       postings are read and go to their documents, each once for all items; what a document may have besides is
       bounded by the threshold and by the best of each list, and those that cannot reach the bound go at once.
    4. Documents that can still reach the bound get their exact scores by a join with their counts.

    Nothing is left out: ``probes`` only bears on how soon lists end.  Equal scores rank by ascending id (null ids
    last), then in the order of rows.  A null or empty text has no terms; items without terms that occur give no rows.
    Rows that repeat an id are documents of their own, repeated items items of their own.  A very long text is one row
    of counts.  Empty tables give an empty result; other columns are left aside.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    own = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    own = scratch.store(own, "items")
    asked = own.select("item", "text").mapInArrow(_item_terms, "item long, terms array<binary>").select("item", F.explode("terms").alias("term"))
    vocabulary = scratch.store(asked.select("term").distinct().withColumn("number", F.monotonically_increasing_id()), "terms")
    asked = scratch.store(asked.join(vocabulary, "term").select("item", F.col("number").alias("term")), "asked")

    blocks = max(1, -(-vocabulary.count() // block_terms))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if blocks > 1:
        rows = scratch.store(rows, "documents")
    kind, parts = rows.schema["id"].dataType.simpleString(), []
    for block in range(blocks):
        known = vocabulary.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block).toArrow()
        known = dict(zip(known.column("term").to_pylist(), known.column("number").to_pylist()))
        parts.append(scratch.store(rows.mapInArrow(_forward(known), f"row long, id {kind}, n long, terms array<long>, tf array<long>"), "counts"))
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionAll(part)
    found = parts[0].agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("total")).first()
    docs_n, total = found["docs"], found["total"] or 0

    weight = F.floor(1000 * F.log((F.lit(2 * docs_n + 2) / (2 * F.col("df") + 1)).cast("double")))
    weights = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", weight.alias("w"))
    asked = scratch.store(asked.join(scratch.store(weights, "weights"), "term").filter(F.col("w") > 0), "weighted")
    part = _score(docs_n, total)

    def each(of: DataFrame) -> DataFrame:
        return of.select("row", "n", F.explode(F.arrays_zip("terms", "tf")).alias("t")).select("row", "n", F.col("t.terms").alias("term"), "t.tf")

    postings = each(counts).join(asked.select("term", "w").distinct(), "term").select("term", part.alias("part"), "row")
    postings = scratch.store(postings.repartitionByRange("term", "part", "row").sortWithinPartitions("term", F.desc("part"), "row"), "postings")

    heads = postings.withColumn("at", F.row_number().over(W.partitionBy("term").orderBy(F.desc("part"), "row"))).filter(F.col("at") <= top)
    heads = scratch.store(heads, "heads")
    lists = asked.join(heads.filter(F.col("at") == 1).select("term", F.col("part").alias("most")), "term")

    def exact(pairs: DataFrame) -> DataFrame:
        """Scores of (item, row) pairs, from the counts of their documents."""
        near = each(counts.join(pairs.select("row").distinct(), "row", "left_semi"))
        return near.join(pairs, "row").join(asked, ["item", "term"]).groupBy("item", "row").agg(F.sum(part).alias("score"))

    sums = heads.join(asked.select("item", "term"), "term").groupBy("item", "row").agg(F.sum("part").alias("sum"))
    probed = scratch.store(_best(sums, [F.desc("sum"), F.col("row")], probes).select("item", "row"), "probes")
    bound = _best(exact(probed), [F.desc("score"), F.col("row")], top).filter(F.col("rank") == top).select("item", F.col("score").alias("bound"))
    bars = lists.groupBy("item").agg(F.count(F.lit(1)).alias("lists")).join(bound, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    bars = bars.withColumn("bar", F.expr("(bound + lists - 1) div lists"))
    lists = lists.join(bars, "item").withColumn("rest", F.greatest(F.least(F.col("bar") - 1, "most"), F.lit(0)))
    lists = scratch.store(lists.select("item", "term", "bar", "bound", "rest"), "lists")

    # A posting that is high enough for any item goes to its document; items are met there, without another shuffle.
    least = lists.groupBy("term").agg(F.min("bar").alias("least"))
    high = postings.join(least, "term").filter(F.col("part") >= F.col("least")).select("row", "term", "part").repartition("row")
    high = high.join(lists.select("item", "term", "bar", "rest"), "term").filter(F.col("part") >= F.col("bar"))
    seen = high.groupBy("item", "row").agg(F.sum("part").alias("sum"), F.sum(F.col("part") - F.col("rest")).alias("over"))
    whole = lists.groupBy("item", "bound").agg(F.sum("rest").alias("rests"))
    seen = seen.join(whole, "item").withColumn("most", F.col("over") + F.col("rests")).filter(F.col("most") >= F.col("bound"))
    seen = scratch.store(seen.select("item", "row", "sum", "most"), "seen")
    again = _best(seen, [F.desc("sum"), F.col("row")], top).filter(F.col("rank") == top).select("item", F.col("sum").alias("again"))
    open_rows = seen.join(again, "item", "left").filter(F.col("most") >= F.coalesce("again", F.lit(0)))
    open_rows = scratch.store(open_rows.select("item", "row"), "open")

    scores = exact(open_rows).filter(F.col("score") > 0)
    named = scores.join(parts[0].select("row", "id"), "row")
    ranked = scratch.store(_best(named, [F.desc("score"), F.col("id").asc_nulls_last(), F.col("row")], top), "ranked")
    scratch.keep(own, ranked)
    return ranked.join(own.select("item", "item_id"), "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP12_SQL = r"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, len(words)::BIGINT AS n FROM found WHERE len(words) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
tf AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(words) AS term FROM found) AS x
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * (SELECT docs FROM totals) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) AS part
  FROM tf JOIN weights USING (term) JOIN sizes USING (doc_id), totals),
scores AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id HAVING sum(part) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
