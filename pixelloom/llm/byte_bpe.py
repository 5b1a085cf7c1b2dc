"""Byte-level BPE encoding and decoding with Spark higher-order functions over distinct words."""

from __future__ import annotations

import base64
import functools
import heapq
import json
import struct
import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others, table

#: Distinct words whose ids are kept in the dictionary, their longest, and the documents they are found in; other words
#: that a task remembers.  They bear on speed alone.
KEPT_WORDS, KEPT_WORD_BYTES, SAMPLE_DOCS, CACHED_WORDS = 1 << 17, 32, 20_000, 100_000
NO_RANK = 2**31 - 1


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


class Map:
    """A literal map with string keys, cut into buckets by crc32, since Spark scans the keys of a map one by one."""

    def __init__(self, items: dict[str, object], kind: str):
        self.n = max(1, len(items))
        buckets: list[dict] = [{} for _ in range(self.n)]
        for key, value in items.items():
            buckets[zlib.crc32(key.encode()) % self.n][key] = value
        # from_json of a literal is folded into a literal when the query is planned.
        self.literal = F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,{kind}>>", {"mode": "FAILFAST"})

    def bound(self, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
        """``use(get)``: the literal stands once in the plan, however often ``get`` is called."""

        def get(buckets: Column, key: Column) -> Column:
            bucket = (F.crc32(key.cast("binary")) % self.n).cast("int") + 1
            return F.try_element_at(F.element_at(buckets, bucket), key)

        return _let(self.literal, lambda buckets: use(lambda key: get(buckets, key)))


def fold_word(word: Column, rank_of: Callable[[Column], Column]) -> Column:
    """Ids of a word: single bytes (as hex), of which the leftmost adjacent pair of lowest rank is merged, again and again.

    The state of the fold holds the pieces between two guards, the rank of each adjacent pair, and where the lowest is
    (0: none).  A merge looks up just the two new pairs.
    """
    rank = lambda piece: F.coalesce(rank_of(piece), F.lit(NO_RANK))

    def lowest(r: Column) -> Column:
        return F.when(F.array_min(r) < NO_RANK, F.array_position(r, F.array_min(r)).cast("int")).otherwise(0)

    def state(p: Column, r: Column) -> Column:
        return _let(F.struct(p.alias("p"), r.alias("r")), lambda s: F.struct(s["p"].alias("p"), s["r"].alias("r"), lowest(s["r"]).alias("k")))

    def merge(s: Column, _: Column) -> Column:
        p, r, k = s["p"], s["r"], s["k"]

        def merged(q: Column) -> Column:
            new = F.array(rank(F.concat(F.element_at(p, k - 1), q)), rank(F.concat(q, F.element_at(p, k + 2))))
            return state(
                F.concat(F.slice(p, F.lit(1), k - 1), F.array(q), F.slice(p, k + 2, F.size(p))),
                F.concat(F.slice(r, F.lit(1), k - 2), new, F.slice(r, k + 2, F.size(r))),
            )

        return F.when(k == 0, s).otherwise(_let(F.concat(F.element_at(p, k), F.element_at(p, k + 1)), merged))

    def fold(h: Column) -> Column:
        n = (F.length(h) / 2).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(h, i * 2 + 1, F.lit(2)))
        guarded = F.concat(F.array(F.lit("!")), pieces, F.array(F.lit("!")))
        first = _let(guarded, lambda p: state(p, F.transform(F.sequence(F.lit(1), n + 1), lambda i: rank(F.concat(F.element_at(p, i), F.element_at(p, i + 1))))))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), first, merge, lambda s: F.transform(F.slice(s["p"], F.lit(2), F.size(s["p"]) - 2), rank_of))

    return _let(F.hex(word.cast("binary")), lambda h: _let(rank_of(h), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(fold(h))))


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word, in the order of its length."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts at a byte; 0: merged away
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class WordIds(dict):
    """Ids of words as packed 32-bit numbers: those given, and any other word merged by the heap when it is first met."""

    def __init__(self, known: dict[str, bytes], ranks: dict[bytes, int]):
        super().__init__(known)
        self.ranks, self.known, self.extra = ranks, len(known), []

    def __missing__(self, word: str) -> bytes:
        if len(self.extra) >= CACHED_WORDS:
            for old in self.extra:
                del self[old]
            self.extra = []
        packed = struct.pack(f"<{len(ids)}i", *ids) if (ids := heap_merge(word.encode(), self.ranks)) else b""
        if len(word) <= KEPT_WORD_BYTES:
            self[word] = packed
            self.extra.append(word)
        return packed


def _encoder(known: dict[str, bytes], path: str, pattern: str) -> Callable:
    @F.arrow_udf("array<int>")
    def encode_texts(texts: pa.Array) -> pa.Array:
        ids, find = WordIds(known, ranks_of(path)), regex.compile(pattern).findall
        packed = [b"".join(map(ids.__getitem__, find(text.as_py() or ""))) for text in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))

    return encode_texts


def split_words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def frequent_words(docs: DataFrame, pattern: str, text_col: str) -> DataFrame:
    """The KEPT_WORDS most frequent words of about SAMPLE_DOCS documents, with how often each occurs."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    near = docs.filter((F.xxhash64(text_col, F.monotonically_increasing_id()) / 2.0**64 + 0.5) <= share)
    words = near.select(F.explode(split_words(F.col(text_col), pattern)).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.octet_length("word") <= KEPT_WORD_BYTES)
    return counts.orderBy(F.desc("n"), "word").limit(KEPT_WORDS)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``out_col``, the ids of each whole text by the rank file at ``path``; a null text has none.

    The text is cut into words by ``pattern`` and each word is encoded alone, without special tokens.  The frequent
    distinct words (of a bounded sample; a matter of speed only) are folded by Spark's higher-order functions, each
    once, and their ids kept in a dictionary of bounded size.  Words outside of it are merged by a heap where they
    stand, so that neither texts nor words are shuffled and no dictionary grows with the input.  A very long text or
    word takes time by its length (times its logarithm).  Repeated rows each give a row, an empty table an empty one.
    Other columns pass through; a column named ``out_col`` is replaced.
    """
    ranks = Map({k.hex().upper(): r for k, r in ranks_of(path).items()}, "int")
    found = frequent_words(docs.select(F.col(text_col).alias("text")), pattern, "text")
    folded = found.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism).select("word", ranks.bound(lambda get: fold_word(F.col("word"), get)).alias("ids"))
    got = folded.toArrow().combine_chunks()  # at most KEPT_WORDS short words
    ids = got.column("ids").combine_chunks()
    ends, packed = (ids.offsets.to_numpy() * 4).tolist(), ids.values.to_numpy().astype("<i4").tobytes()
    kept = {w: packed[a:b] for w, a, b in zip(got.column("word").to_pylist(), ends, ends[1:])}
    return docs.select(*others(docs, out_col), _encoder(kept, path, pattern)(text_col).alias(out_col))


def decode(ids: Column, path: str) -> Column:
    """The bytes that the ids stand for: their pieces, concatenated (as hex, so that it takes one pass)."""
    count = max(ranks_of(path).values()) + 1
    pieces = [""] * count
    for piece, rank in ranks_of(path).items():
        pieces[rank] = piece.hex()
    literal = F.from_json(F.lit(json.dumps(pieces)), T.ArrayType(T.StringType()), {"mode": "FAILFAST"})
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(literal, i + 1)), ""))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"))
