"""Best-fit packing of tokenised documents into sequences of fixed capacity, by linear grouping."""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, sliced, table

CAPACITY = 2048
#: Lengths above CAPACITY / LARGE_PART are large: grouped, rounded up and packed by configurations.
LARGE_PART, GROUPS = 3, 256
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The one added token of ``byte_bpe_50k.json``: its tokenizer reads the string in a text as this id.
ADDED = (("<|endoftext|>", 50256),)


@functools.cache
def encoder(path: str, added: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    """Byte-level BPE by the rank file at ``path``; ``added`` are strings that are one token each, all others are ordinary text."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(added))


def _pieces(path: str, capacity: int, added: tuple[tuple[str, int], ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = functools.partial(encoder(path, added).encode, allowed_special="all")
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), 0], "<u4")
                first = len(ids) % capacity or capacity
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end])))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """One row for each piece of each document: its ids and an end id 0, cut only beyond ``capacity``; the first piece takes the remainder."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(vocabulary, capacity, added), _PIECES)


# The plan: made on the driver from the count of each length, so its size depends on the capacity alone.


def size_groups(counts: dict[int, int], groups: int) -> list[list[int]]:
    """Lengths in falling order, cut into runs of about the same number of documents."""
    share, out, held = sum(counts.values()) / groups, [[]], 0
    for length in sorted(counts, reverse=True):
        if out[-1] and held + counts[length] / 2 > share * len(out):
            out.append([])
        out[-1].append(length)
        held += counts[length]
    return [g for g in out if g]


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size to put in one sequence for the greatest total value."""
    most = capacity // int(sizes.min())
    best, picks = np.zeros(capacity + 1), []
    room = np.arange(capacity + 1)
    left = room - sizes[:, None]
    for _ in range(most):
        with_one = np.where(left >= 0, best[np.maximum(left, 0)] + values[:, None], -1.0)
        pick = with_one.argmax(0)
        gain = with_one[pick, room] > best + 1e-12
        picks.append(np.where(gain, pick, -1))
        best = np.where(gain, with_one[pick, room], best)
    chosen, at = np.zeros(len(sizes), int), capacity
    for pick in reversed(picks):
        if pick[at] >= 0:
            chosen[pick[at]] += 1
            at -= sizes[pick[at]]
    return chosen


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 500) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, so that ``demand`` is covered: linear programme by column generation, rounded down, and the rest by best configurations of what is left."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    # Plain sums: threads of a linear algebra library have stalled for minutes beside the driver's JVM.
    for _ in range(rounds):
        prices = inverse.sum(0)
        column = best_configuration(sizes, prices, capacity)
        if (prices * column).sum() <= 1 + 1e-6:
            break
        amounts, step = (inverse * demand).sum(1), (inverse * column).sum(1)
        ratio = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        pivot = inverse[out] / step[out]
        inverse -= step[:, None] * pivot
        inverse[out] = pivot
    amounts = (inverse * demand).sum(1)
    out, left = [], demand.astype(int).copy()
    for j in np.argsort(-amounts):
        pattern = basis[:, j].astype(int)
        n = int(min([amounts[j] + 1e-9, *(left[pattern > 0] // pattern[pattern > 0])]))
        if n > 0:
            out.append((pattern, n))
            left -= pattern * n
    while left.any():
        pattern, room = np.zeros(k, int), capacity
        for g in np.argsort(-sizes):
            pattern[g] = min(left[g], room // sizes[g])
            room -= pattern[g] * sizes[g]
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, n))
        left -= pattern * n
    return out


class Runs:
    """Sequences filled alike, held as runs: (first sequence, how many, tokens used, [(length, first rank, offset)])."""

    def __init__(self, capacity: int):
        self.capacity, self.total = capacity, 0
        self.by_room: dict[int, list[tuple[int, int, tuple]]] = {}

    def add(self, n: int, room: int, slots: tuple, first: int | None = None) -> None:
        if n:
            if first is None:
                first, self.total = self.total, self.total + n
            self.by_room.setdefault(room, []).append((first, n, slots))

    def fill(self, length: int, rank: int, n: int) -> None:
        """Best fit for ``n`` documents of one length, ranked from ``rank``."""
        rooms = sorted(r for r, runs in self.by_room.items() if r >= length and runs)
        for room in [*rooms, None]:
            each = (room or self.capacity) // length
            while n and (room is None or self.by_room[room]):
                per = min(each, n)
                first, have, slots = self.by_room[room].pop() if room is not None else (None, n // per, ())
                use = min(have, n // per)
                if room is not None and use < have:
                    self.add(have - use, room, tuple((a, b + use, c) for a, b, c in slots), first + use)
                used = self.capacity - (room if room is not None else self.capacity)
                more = tuple((length, rank + j * use, used + j * length) for j in range(per))
                self.add(use, self.capacity - used - per * length, slots + more, first)
                rank, n = rank + per * use, n - per * use
            if not n:
                return

    def segments(self) -> np.ndarray:
        """Rows (length, first rank, sequence of the first, offset), sorted."""
        rows = [(a, b, first, c) for runs in self.by_room.values() for first, _, slots in runs for a, b, c in slots]
        return np.array(sorted(rows), np.int64).reshape(-1, 4)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large_part: int = LARGE_PART) -> Runs:
    """Where the documents of each length go, from the number of documents of each length (1 to ``capacity``).

    Large lengths are cut into groups of equal cardinality and rounded up to the largest of the group.
    Configurations of these few sizes are optimised; then the actual documents replace the rounded ones, longest
    first, and the small documents go where they fit best.
    """
    runs, taken = Runs(capacity), dict.fromkeys(counts, 0)
    large = {n: c for n, c in counts.items() if n > capacity // large_part}
    if large:
        grouped = size_groups(large, groups)
        streams = [[[n, large[n]] for n in g] for g in grouped]
        demand = np.array([sum(large[n] for n in g) for g in grouped])
        for pattern, n in configurations(np.array([g[0] for g in grouped]), demand, capacity):
            slots = []
            for g in np.repeat(np.arange(len(pattern)), pattern):  # for each slot, the stretches of equal length that fill it
                stretch, need = [], n
                while need:
                    length, have = streams[g][0]
                    use = min(need, have)
                    stretch.append([length, taken[length], use])
                    taken[length] += use
                    need -= use
                    streams[g][0][1] -= use
                    if not streams[g][0][1]:
                        streams[g].pop(0)
                slots.append(stretch)
            while n:
                use = min(s[0][2] for s in slots)
                held, used = [], 0
                for s in slots:
                    length, rank, have = s[0]
                    held.append((length, rank, used))
                    used += length
                    s[0] = [length, rank + use, have - use]
                    if have == use:
                        s.pop(0)
                runs.add(use, capacity - used, tuple(held))
                n -= use
    for length in sorted(counts.keys() - large.keys(), reverse=True):
        runs.fill(length, 0, counts[length])
    return runs


def _place(segments: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = segments[:, 0] << 48 | segments[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(starts, batch.column("length").to_numpy() << 48 | rank, side="right") - 1
            own = segments[at]
            keep = [n for n in batch.schema.names if n != "rank"]
            new = [pa.array(own[:, 2] + rank - own[:, 1]), pa.array(own[:, 3])]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), *new], names=[*keep, "sequence_id", "offset"])

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, large_part: int = LARGE_PART) -> DataFrame:
    """``pieces`` (rows of ``_PIECES``, lengths 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Only the number of pieces of each length comes to the driver.  Pieces of one length are ranked without one task
    for a common length: they are dealt over salts, ranked within each, and moved on by the counts of the salts
    before.  A look-up of (length, rank) in the plan then gives the place.  Equal rows are placed one by one.
    An empty input gives an empty result; null ids and repeated documents are packed like others.
    """
    spark = pieces.sparkSession
    rows = Scratch(spark, "packing").store(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(64, sum(counts.values()) // 50_000)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)))
    ranked = salted.withColumn("own", F.row_number().over(W.partitionBy("length", "salt").orderBy("row")))
    ranked = ranked.join(before.drop("n"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.coalesce("before", F.lit(0)) + F.col("own") - 1).cast("long").alias("rank"))
    segments = plan(counts, capacity, groups, large_part).segments()
    if not len(segments):
        return spark.createDataFrame([], f"{_PIECES}, sequence_id long, offset long")
    return ranked.mapInArrow(_place(segments), f"{_PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, added: tuple[tuple[str, int], ...] = ADDED) -> DataFrame:
    """Tokenise ``docs`` (``doc_id, text``; a null text is empty and still gives its end id) and pack the pieces.

    Strings in ``added`` are one token each wherever a text has them, as in the tokenizer of the default vocabulary.
    Other columns are left aside.  A very long text is encoded whole and cut into pieces of ``capacity``; repeated
    rows are packed each; an empty table gives an empty one.
    """
    return pack(token_pieces(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity, added), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The rank file holds the vocabulary of byte_bpe_50k.json; tests hold the ids of both against each other.
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
