"""Language-model scoring by partial matching: a byte-context trie with escapes and symbol exclusion."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, crc_mod, sliced, table

#: Bytes of context of the trie's leaves.
ORDER = 5
#: Bytes of text of a block, whose distinct n-grams and words are counted together, and of text for each part of the keys.
BLOCK_BYTES, PART_BYTES, LEAST_PARTS = 16 << 20, 64 << 20, 47
#: No byte of a UTF-8 text: stands for the end of a text, and before its start.
END, SYMBOLS = 0xFF, 256
#: n-grams sorted at once.
CHUNK = 1 << 22


def normal(text: bytes | None) -> bytes:
    """The words of a text, A-Z lower-cased, with one space between them."""
    return b" ".join((text or b"").lower().split())


def windows(texts: list[bytes], order: int) -> np.ndarray:
    """For each byte of each text and then its end: it and the ``order`` bytes before it, as one number."""
    flat = np.frombuffer(b"".join(bytes([END]) * order + t + bytes([END]) for t in texts), np.uint8).astype(np.int64)
    out = np.zeros(max(0, len(flat) - order), np.int64)
    for i in range(order + 1):
        out = out << 8 | flat[i : len(flat) - order + i]
    ends = np.cumsum([len(t) + 1 + order for t in texts]) - order  # the windows that begin here reach into the next text
    inside = np.ones(len(out), bool)
    over = (ends[:, None] + np.arange(order)).ravel()
    inside[over[over < len(out)]] = False
    return out[inside]


def pieces(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``windows`` of a few texts at a time, and the number of windows of each."""
    held: list[bytes] = []
    for n, t in enumerate(texts, 1):
        held.append(t)
        if n == len(texts) or sum(map(len, held)) >= CHUNK:
            yield windows(held, order), np.array([len(x) + 1 for x in held])
            held = []


class Tally:
    """Sums of numbers by key, in sorted arrays."""

    def __init__(self) -> None:
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.held.append((keys, sums))
        self.pending += len(keys)
        if self.pending > max(CHUNK, len(self.keys)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            keys, sums = (np.concatenate(x) for x in zip((self.keys, self.sums), *self.held))
            order = np.argsort(keys, kind="stable")
            keys, sums = keys[order], sums[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.keys, self.sums = keys[first], np.add.reduceat(sums, first) if len(first) else sums
            self.held, self.pending = [], 0
        return self.keys, self.sums


def _parted(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by part, the parts that occur and the offsets of each."""
    order = np.argsort(part, kind="stable")
    own, first = np.unique(part[order], return_index=True)
    return order, own, np.append(first, len(part)).astype(np.int32)


#: What a row holds: documents, or a block's n-grams or words of one part; ``data`` is compressed, as sorted keys shrink well.
_ROW = "block long, kind int, part long, data binary"
DOCS, GRAMS, WORDS = 0, 1, 2
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def shrunk(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_OPTIONS) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def grown(data: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(data.as_buffer()).read_next_batch()


def key_batch(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Sorted keys, as differences, and a value each."""
    return pa.RecordBatch.from_arrays([pa.array(np.diff(keys, prepend=0)), pa.array(values)], names=["key", "value"])


def keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.asarray(batch.column(0))), np.asarray(batch.column(1))


def _rows(block: int, kind: int, parts: list[int | None], data: list[bytes]) -> pa.RecordBatch:
    n = len(data)
    return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(parts, pa.int64()), pa.array(data, pa.binary())], names=["block", "kind", "part", "data"])


def _blocks(order: int, parts: int, block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents (doc, trains, text) dealt into blocks as they come, and each block's n-grams and words, by part, with
    their counts in its training documents (0 for those of others alone)."""

    def closed(block: int, texts: dict[bool, list[bytes]]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for trains, own in texts.items():
            for grams, _ in pieces(own, order):
                keys, n = np.unique(grams, return_counts=True)
                tally.add(keys, n * trains)
        keys, n = tally.settle()
        at, own, ends = _parted(keys % parts, parts)
        keys, n = keys[at], n[at]
        yield _rows(block, GRAMS, own.tolist(), [shrunk(key_batch(keys[lo:hi], n[lo:hi])) for lo, hi in zip(ends, ends[1:])])
        count: Counter[bytes] = Counter()
        for t in texts[True]:
            count.update(t.split())
        count[bytes([END])] = len(texts[True])
        for t in texts[False]:
            for word in t.split():
                count.setdefault(word, 0)
        words = np.array(sorted(count), object)
        at, own, ends = _parted(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts, parts)
        words = words[at]
        lists = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([count[w] for w in words], pa.int64())], names=["key", "value"])
        yield _rows(block, WORDS, own.tolist(), [shrunk(lists.slice(lo, hi - lo)) for lo, hi in zip(ends.tolist(), ends[1:].tolist())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, texts = TaskContext.get().partitionId() << 32, 0, {True: [], False: []}
        for batch in sliced(batches):
            own = [normal(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            for trains, text in zip(batch.column("trains").to_pylist(), own):
                texts[trains].append(text)
            yield _rows(block, DOCS, [None], [shrunk(pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(own, pa.binary())], names=["doc", "text"]))])
            size += sum(map(len, own))
            if size >= block_bytes:
                yield from closed(block, texts)
                block, size, texts = block + 1, 0, {True: [], False: []}
        if texts[True] or texts[False]:
            yield from closed(block, texts)

    return blocks


def _gram_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums (gram, n) of rows (part, data) sorted by part."""

    def out(tally: Tally) -> Iterator[pa.RecordBatch]:
        keys, n = tally.settle()
        for lo in range(0, len(keys), CHUNK // 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + CHUNK // 16]), pa.array(n[lo : lo + CHUNK // 16])], names=["gram", "n"])

    part, tally = None, Tally()
    for whole in batches:
        for now, batch in _runs(whole, "part"):
            if now != part:
                yield from out(tally)
                part, tally = now, Tally()
            for data in batch.column("data"):
                tally.add(*keys_of(grown(data)))
    yield from out(tally)


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of equal values of a sorted column."""
    values = np.asarray(batch.column(column))
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else []
    for lo, hi in zip(starts, [*starts[1:], len(values)]):
        yield int(values[lo]), batch.slice(lo, hi - lo)


def _word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, part, data) of words sorted by part, with the sums of all blocks in place of their own counts; for
    each part also a row without a block: how many words occur in training, and how often in all."""
    names = ["block", "data", "distinct", "tokens"]

    def out(rows: list[tuple[int, list[bytes]]], total: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        for block, words in rows:
            data = shrunk(pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([total[w] for w in words], pa.int64())], names=["key", "value"]))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=names)
        if rows:
            sums = [sum(map(bool, total.values())), sum(total.values())]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *[pa.array([x], pa.int64()) for x in sums]], names=names)

    part, rows, total = None, [], defaultdict(int)
    for batch in batches:
        for block, now, data in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("data")):
            if now != part:
                yield from out(rows, total)
                part, rows, total = now, [], defaultdict(int)
            words, counts = (c.to_pylist() for c in grown(data).columns)
            rows.append((block, words))
            for w, n in zip(words, counts):
                total[w] += n
    yield from out(rows, total)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, block, data, gram, cost) sorted by part, the table's (block null) first: each block's costs."""
    part, keys, costs, table_ = None, [], [], None
    for whole in batches:
        for now, batch in _runs(whole, "part"):
            if now != part:
                part, keys, costs, table_ = now, [], [], None
            own = batch.filter(batch.column("block").is_null())
            if own.num_rows:
                keys.append(np.asarray(own.column("gram")))
                costs.append(np.asarray(own.column("cost")))
            asked = batch.filter(batch.column("block").is_valid())
            if asked.num_rows and table_ is None:
                flat = np.concatenate(keys)
                order = np.argsort(flat)
                table_, keys = (flat[order], np.concatenate(costs)[order]), []
            for block, data in zip(asked.column("block"), asked.column("data")):
                grams, _ = keys_of(grown(data))
                found = shrunk(key_batch(grams, table_[1][np.searchsorted(table_[0], grams)]))
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([GRAMS], pa.int32()), pa.array([found], pa.binary())], names=["block", "kind", "data"])


def _scores(order: int, distinct: int, tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, kind, data) sorted by block, the documents last: figures of each document."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, ready, count = None, [], None, {}
        for batch in batches:
            for block, kind, data in zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), batch.column("data")):
                if block != now:
                    now, found, ready, count = block, [], None, {}
                own = grown(data)
                if kind == GRAMS:
                    found.append(keys_of(own))
                elif kind == WORDS:
                    count.update(zip(*(c.to_pylist() for c in own.columns)))
                else:
                    if ready is None:
                        keys, costs = (np.concatenate(x) for x in zip(*found))
                        at = np.argsort(keys)
                        ready, found = (keys[at], costs[at]), []
                    yield figures(own, ready, count)

    def figures(docs: pa.RecordBatch, ready: tuple[np.ndarray, np.ndarray], count: dict[bytes, int]) -> pa.RecordBatch:
        texts = docs.column("text").to_pylist()
        score = [np.add.reduceat(ready[1][np.searchsorted(ready[0], grams)], np.cumsum(n) - n) for grams, n in pieces(texts, order)]
        n_tokens, n_known, base = [], [], []
        for text in texts:
            c = np.array([*map(count.__getitem__, text.split()), count[bytes([END])]])
            n_tokens.append(len(c))
            n_known.append(int((c > 0).sum()))
            base.append(float(np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1))).sum()))
        columns = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(np.concatenate(score))]
        return pa.RecordBatch.from_arrays([docs.column("doc"), *columns], names=["doc", "n_tokens", "n_known", "base_score", "score"])

    return scores


def _log_share(part: Column, of: Column) -> Column:
    return F.log10(part.cast("double") / of.cast("double"))


def code_lengths(grams: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """``gram, cost``: log10 probability of the last byte of each n-gram after the bytes before it.

    ``grams`` has ``gram, n``: n-grams of ``order + 1`` bytes as numbers and their counts in training, which may be 0.
    The levels of the trie are tables, from sums over shorter contexts.  With N and d, a context's count and distinct
    bytes in training, a byte seen there n times costs n / (N + d); else an escape of d / (N + d) is coded, and the
    context without its first byte is asked, where the bytes seen in the longer one are excluded from N, d.  After
    the empty context, all bytes not seen at all are alike.  A context never seen in training is passed over.

    A level is one join with the level below by the shorter n-gram (at most 256 rows a key) and one window over a
    context (at most 256 rows), so no key is hot.
    """
    levels = [grams]
    for k in range(order - 1, -1, -1):
        shorter = levels[0].groupBy(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n"))
        levels.insert(0, scratch.store(shorter, f"level-{k}"))
    total, seen = levels[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    rest = -math.log10(SYMBOLS - seen)
    escape = math.log10(seen / (total + seen)) if seen else 0.0
    cost = F.when(F.col("n") > 0, _log_share(F.col("n"), F.lit(total + seen))).otherwise(escape + rest)
    # excluded: the cost below the level, once its own bytes are excluded; total, seen: of the context
    low = levels[0].select("gram", "n", cost.alias("cost"), F.lit(rest).alias("excluded"), F.lit(total).alias("total"), F.lit(seen).alias("seen"))
    for k in range(order):
        below = low.select(F.col("gram").alias("short"), *[F.col(c).alias(f"low_{c}") for c in low.columns if c != "gram"])
        rows = levels[k + 1].withColumn("short", F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1)).join(below, "short")
        own = W.partitionBy(F.shiftright("gram", 8))
        rows = rows.withColumn("total", F.sum("n").over(own)).withColumn("seen", F.count_if(F.col("n") > 0).over(own))
        rows = rows.withColumn("taken", F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("low_n"))).over(own), F.lit(0)))
        left = F.col("low_seen") - F.col("seen")
        room = F.col("low_total") - F.col("taken") + left
        excluded = F.when(F.col("low_n") > 0, _log_share(F.col("low_n"), room)).otherwise(F.when(left > 0, _log_share(left, room)).otherwise(0.0) + F.col("low_excluded"))
        # where the byte has been seen in the longer context, it is excluded below, and this value is not used
        rows = rows.withColumn("excluded", F.when(F.col("n") == 0, excluded))
        all_ = F.col("total") + F.col("seen")
        cost = F.when(F.col("total") == 0, F.col("low_cost")).when(F.col("n") > 0, _log_share(F.col("n"), all_)).otherwise(_log_share(F.col("seen"), all_) + F.col("excluded"))
        more = ["n", "excluded", "total", "seen"] if k + 1 < order else []
        low = scratch.store(rows.select("gram", cost.alias("cost"), *more), f"costs-{k + 1}")
    scratch.drop(*levels)
    return low


def score(docs: DataFrame, trains: Column, order: int = ORDER, text_col: str = "text", block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` without its text, with ``n_tokens, n_known, train_tokens, base_score`` and ``score`` for each row.

    Texts are taken as their words, A-Z lower-cased, with one space between them, and an end.  ``score`` is the log10
    probability that a trie of byte contexts up to ``order``, counted in all rows where ``trains`` is true, gives to a
    text and its end (see ``code_lengths``); a null or empty text is its end alone.  ``base_score`` is that of single
    tokens (words and one end), each with log10((c + 0.5) / (N + 0.5 (V + 1))): c its count, N all and V the distinct
    tokens in training; ``n_known`` tokens have c > 0.  Null in ``trains`` is false.  Without any training row all
    symbols, and all tokens, are alike.

    The counts are tables that grow with the corpus; nothing of them is broadcast or gathered.  Texts are dealt into
    blocks of about ``block_bytes``, and a block's distinct n-grams and words (some hundredths of its length) go to the
    parts of the keys, are summed there, and come back with their costs, so that a frequent key is one number a block.
    A part's rows are bounded, as parts grow in number with the text.  The texts are shuffled once, by block.  A text
    longer than a block is a block of its own; repeated rows each give a row; an empty table gives an empty one;
    columns of the names that are added are replaced.
    """
    if not 0 < order <= 6:
        raise ValueError("an n-gram must fit in 63 bits: order from 1 to 6")
    spark = docs.sparkSession
    scratch = Scratch(spark, "match-model")
    added = {"n_tokens", "n_known", "train_tokens", "base_score", "score"}
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() not in added | {text_col.lower()}]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *kept).alias("doc"), F.coalesce(trains, F.lit(False)).alias("trains"), F.col(text_col).alias("text"))
    doc = rows.schema["doc"].dataType
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = next(p for p in range(max(LEAST_PARTS, size // part_bytes) | 1, 1 << 62, 2) if all(p % d for d in range(3, math.isqrt(p) + 1, 2)))
    made = scratch.store(rows.mapInArrow(_blocks(order, parts, block_bytes), _ROW), "blocks")
    kind = F.col("kind")

    by_part = made.filter(kind == GRAMS).select("part", "data").repartition("part").sortWithinPartitions("part")
    totals = scratch.store(by_part.mapInArrow(_gram_totals, "gram long, n long"), "totals")
    costs = code_lengths(totals, order, scratch)
    ask = made.filter(kind == GRAMS).select("part", "block", "data", F.lit(None).cast("long").alias("gram"), F.lit(None).cast("double").alias("cost"))
    ask = ask.unionAll(costs.select(F.pmod("gram", F.lit(parts)).alias("part"), F.lit(None).cast("long"), F.lit(None).cast("binary"), "gram", "cost"))
    ask = ask.repartition("part").sortWithinPartitions("part", "block")
    answers = ask.mapInArrow(_answers, "block long, kind int, data binary")

    by_part = made.filter(kind == WORDS).select("block", "part", "data").repartition("part").sortWithinPartitions("part")
    words = scratch.store(by_part.mapInArrow(_word_totals, "block long, data binary, distinct long, tokens long"), "words")
    distinct, tokens = words.agg(F.sum("distinct"), F.sum("tokens")).first()

    joined = answers.unionAll(words.filter(F.col("block").isNotNull()).select("block", F.lit(WORDS), "data")).unionAll(made.filter(kind == DOCS).select("block", "kind", "data"))
    joined = joined.repartition("block").sortWithinPartitions("block", F.desc("kind"))
    figures = StructType().add("doc", doc).add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
    out = joined.mapInArrow(_scores(order, distinct or 0, tokens or 0), figures)
    scratch.keep(made, costs, words)
    names = [c for c in docs.columns if c.lower() not in added | {text_col.lower()}]
    return out.select(*[F.col("doc")[c].alias(c) for c in names], "n_tokens", "n_known", F.lit(tokens or 0).cast("long").alias("train_tokens"), "base_score", "score")


def adaptive_length(text: bytes, order: int = ORDER) -> float:
    """log10 probability of a text by a trie that starts empty and counts each byte once it has been coded."""
    trie: defaultdict[bytes, Counter[int]] = defaultdict(Counter)
    history, total = bytes([END]) * order, 0.0
    for symbol in text + bytes([END]):
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            seen = {s: n for s, n in trie[history[order - k :]].items() if s not in excluded}
            room = sum(seen.values()) + len(seen)
            if symbol in seen:
                total += math.log10(seen[symbol] / room)
                break
            if seen:
                total += math.log10(len(seen) / room)
                excluded |= seen.keys()
        else:
            total -= math.log10(SYMBOLS - len(excluded))
        for k in range(order + 1):
            trie[history[order - k :]][symbol] += 1
        history = (history + bytes([symbol]))[1:]
    return total


def adaptive(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, adaptive_score``: each text by a model of its own, without a corpus (see ``adaptive_length``).

    The texts are those of ``score``.  Time and memory follow the length of a text; rows are told apart as they come.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [adaptive_length(normal(t.as_py()), order) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["id", "adaptive_score"])

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(lengths, f"id {kind}, adaptive_score double").withColumnRenamed("id", id_col)


def op11_match_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod(F.col("doc_id"), 5) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    out = score(docs, ~held)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
