"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, others, table

#: (action, canonical URL): what op4 applies first; the longest that fits wins.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: The list that op4 applies where no rule fits, read by the query and by its SQL.
BLOCKED = Path(__file__).with_name("blocked_urls.txt")

WORDS, BITS_PER_KEY = 4, 16
#: The filter is broadcast up to this many blocks of WORDS * 64 bits (some 20 MB); a larger one is joined by block.
BROADCAST_BLOCKS = 1 << 19


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    before = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(before, r"(?s)^([^/]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(before, r"(?s)^[^/]*(.*)$", 1)


def canonical(url: str) -> str:
    """Canonical form of a list entry: no scheme, query or fragment, host in lower case, at least the path ``/``."""
    bare = url.split("://", 1)[-1].split("?", 1)[0].split("#", 1)[0]
    host, slash, path = bare.partition("/")
    return host.lower() + "/" + path if slash else host.lower() + "/"


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """For each word of the key's block, two bits to set."""
    h = F.xxhash64(F.lit("bits"), key)
    one = F.lit(1).cast("bigint")
    bit = lambda at: F.call_function("shiftleft", one, F.shiftrightunsigned(h, at).bitwiseAND(63).cast("int"))
    return [bit(12 * i).bitwiseOR(bit(12 * i + 6)) for i in range(WORDS)]


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The non-empty blocks of the filter: one row of WORDS longs for each, built with partial ORs."""
    masks = _masks(F.col(key))
    out = keys.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(masks)])
    return out.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def match_urls(urls: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``path`` and ``entry`` (the fitting list entry as a struct, or null).

    ``listed``, a table of any size, has ``key`` (a canonical URL), ``host``, ``path``, ``action`` and ``rank``; an
    entry fits its host and all subdomains where the path starts with its path.  Of those that fit, the lowest rank,
    then the longest key, wins; of equal keys any one, by action.  A URL is judged once for all rows of its host and
    path.  Its candidates are the pairs of a host suffix and a path prefix whose shape (labels, path length) occurs in
    the list: for each number of labels the list's path lengths are one row of a small table, joined by that number.
    Candidates are probed against the blocked Bloom filter and only possible hits reach the exact join with the list.
    A null URL, or one without ``://``, has an empty host and path and fits nothing; empty tables give empty results
    or no entry.  Repeated rows each give a row.  Columns of the input pass through but for those three names, which
    are replaced.
    """
    scratch = Scratch(urls.sparkSession, "urls")
    own, (host, path) = others(urls, "host", "path", "entry"), host_path(F.col(url_col))
    out = urls.select(*own, host.alias("host"), path.alias("path"))
    listed = scratch.store(listed.select("key", "action", "rank", F.size(F.split("host", r"\.", -1)).alias("labels"), F.char_length("path").alias("chars")), "list")
    # At most as many rows as hosts have labels, each with the path lengths found at that depth.
    shapes = listed.groupBy("labels").agg(F.sort_array(F.collect_set("chars")).alias("lengths"))
    sites = out.filter(F.col("host") != "").select("host", "path").distinct()
    tried = sites.withColumn("labels", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.", -1))))).join(F.broadcast(shapes), "labels")
    tried = tried.withColumn("chars", F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))))
    tail = F.expr("substring_index(host, '.', -labels)")
    tried = tried.select("host", "path", F.concat(tail, F.expr("substring(path, 1, chars)")).alias("key"))

    blocks = max(1, listed.count() * BITS_PER_KEY // (WORDS * 64) + 1)
    bits = scratch.store(bloom_blocks(listed, "key", blocks), "filter")
    probed = F.broadcast(bits) if blocks <= BROADCAST_BLOCKS else bits
    masks = _masks(F.col("key"))
    hit = F.lit(True)
    for i, m in enumerate(masks):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    possible = tried.withColumn("block", _block(F.col("key"), blocks)).join(probed, "block").filter(hit).select("host", "path", "key")
    exact = possible.join(listed.select("key", "action", "rank"), "key")
    best = exact.groupBy("host", "path").agg(F.min_by(F.struct("key", "action", "rank"), F.struct("rank", -F.char_length("key"), "action")).alias("entry"))
    best = scratch.store(best, "best")
    scratch.drop(listed, bits)
    return out.join(best, ["host", "path"], "left").select(*own, "host", "path", "entry")


def read_list(path: Path = BLOCKED) -> list[str]:
    """The canonical URLs of a file: one a line, lines of ``#`` and empty ones left out."""
    lines = map(str.strip, path.read_text(encoding="utf-8").splitlines())
    return [canonical(line) for line in lines if line and not line.startswith("#")]


def entries(spark: SparkSession, rules: list[tuple[str, str]], blocked: list[str]) -> DataFrame:
    """A list table of short literal lists: rules (rank 0), then blocked sites (rank 1).  Large lists are read from files."""
    rows = [(canonical(u), a, 0) for a, u in rules] + [(canonical(u), "block", 1) for u in blocked]
    out = spark.createDataFrame(rows, "key string, action string, rank int")
    return list_table(out)


def list_table(rows: DataFrame) -> DataFrame:
    """The table that ``match_urls`` takes from ``key`` (canonical), ``action`` and ``rank``."""
    return rows.withColumns({"host": F.substring_index("key", "/", 1), "path": F.expr("substring(key, locate('/', key))")})


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = match_urls(table(spark, sf_dir, "pages").select("page_id", "url"), entries(spark, RULES, read_list()))
    rule = F.when(F.col("entry.rank") == 0, F.col("entry.key"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("entry.action", F.lit("allow")).alias("verdict"))


_VALUES = ", ".join(f"({rank}, '{action}', '{key.partition('/')[0]}', '/{key.partition('/')[2]}')" for rank, action, key in [*((0, a, u) for a, u in RULES), *((1, "block", u) for u in read_list())])
OP4_SQL = r"""
WITH split AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(split_part(rest, '/', 1)) + 1) AS path
  FROM split),
listed(rank, action, lhost, lpath) AS (VALUES {values}),
fit AS (
  SELECT r, rank, action, lhost || lpath AS key,
         row_number() OVER (PARTITION BY r ORDER BY rank, length(lhost || lpath) DESC) AS n
  FROM parts JOIN listed ON (host = lhost OR ends_with(host, '.' || lhost)) AND starts_with(path, lpath))
SELECT page_id, host, path, CASE WHEN rank = 0 THEN key END AS rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fit WHERE n = 1) USING (r)
""".replace("{values}", _VALUES)
