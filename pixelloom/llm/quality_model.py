"""Quality classifier: histogram gradient-boosted trees over statistics of a document, flattened for numpy."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, sliced, table

#: Most labelled documents to learn from, taken by hash of id.
SAMPLE = 12_000
BINS, TREES, DEPTH, RATE, RIDGE, MIN_ROWS = 64, 80, 4, 0.1, 1.0, 20
FEATURES = (
    "log_words", "mean_word", "long_word_share", "distinct_share", "top_word_share", "repeat_share", "symbol_share",
    "punctuation_share", "upper_share", "digit_share", "space_share", "wide_share", "alpha_word_share", "mean_line",
    "dup_line_share", "dup_line_chars", "end_mark_share", "bullet_share", "byte_entropy", "word_entropy",
)
_BYTES = np.arange(256)
_UPPER, _LOWER = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT, _WIDE = (_BYTES >= 48) & (_BYTES <= 57), _BYTES >= 128
_SPACE = np.isin(_BYTES, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_MARK = np.isin(_BYTES, np.frombuffer(b".,;:!?'\"()-", np.uint8))
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _WIDE | _SPACE | _MARK)


def entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum())


def statistics(text: bytes) -> list[float]:
    """The FEATURES of a whole text; all 0 for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    total = byte.sum()
    letters = max(1, int(byte[_UPPER | _LOWER | _WIDE].sum()))
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    often = np.fromiter(counts.values(), np.int64, len(counts))
    pairs = Counter(zip(words, words[1:], words[2:]))
    repeated = sum(c for c in pairs.values() if c > 1)
    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
    line_counts = Counter(lines)
    twice = {x: c - 1 for x, c in line_counts.items() if c > 1}
    return [
        math.log1p(n),
        float(sizes.mean()),
        float((sizes > 12).mean()),
        len(counts) / n,
        int(often.max()) / n,
        repeated / max(1, n - 2),
        byte[_SYMBOL].sum() / total,
        byte[_MARK].sum() / total,
        byte[_UPPER].sum() / letters,
        byte[_DIGIT].sum() / total,
        byte[_SPACE].sum() / total,
        byte[_WIDE].sum() / total,
        sum(map(bytes.isalpha, words)) / n,
        n / max(1, len(lines)),
        sum(twice.values()) / max(1, len(lines)),
        sum(len(x) * c for x, c in twice.items()) / total,
        sum(x[-1:] in b".!?" for x in lines) / max(1, len(lines)),
        sum(x[:1] in b"-*|>#" for x in lines) / max(1, len(lines)),
        entropy(byte),
        entropy(often) / max(1.0, math.log2(n)),
    ]


@dataclass
class Model:
    """Trees as arrays: node k of a tree has children 2k+1 and 2k+2; a row goes right where its feature exceeds the cut."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        at_row = np.arange(len(rows))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(rows), np.int64)
            for _ in range(int(math.log2(len(value)))):
                node = 2 * node + 1 + (rows[at_row, feature[node]] > cut[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Model:
    """Newton boosting of the logistic loss on histograms of binned features."""
    labels = labels.astype(float)
    share = min(1 - 1e-3, max(1e-3, labels.mean()))
    base = math.log(share / (1 - share))
    edges = [np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) for x in rows.T]
    binned = np.stack([np.searchsorted(e, x, side="left") for e, x in zip(edges, rows.T)], 1)
    offset = np.arange(rows.shape[1]) * bins
    inner = 2**depth - 1
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    margin = np.full(len(rows), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = labels - p, p * (1 - p)
        node = np.zeros(len(rows), np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            node[own] = 2 * k + 1  # all go left unless a cut is found
            if len(own) < 2 * MIN_ROWS:
                continue
            at = (binned[own] + offset).ravel()
            size = rows.shape[1] * bins
            wide = lambda x: np.bincount(at, np.repeat(x[own], rows.shape[1]), size).reshape(-1, bins).cumsum(1)
            g, h, n = wide(slope), wide(curve), wide(np.ones(len(rows)))
            g_all, h_all, n_all = g[0, -1], h[0, -1], n[0, -1]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(n < MIN_ROWS) | (n_all - n < MIN_ROWS)] = 0
            best = int(gain.argmax())
            f, b = divmod(best, bins)
            if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                continue
            feature[t, k], cut[t, k] = f, edges[f][b]
            node[own] = 2 * k + 1 + (rows[own, f] > cut[t, k])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        value[t] = rate * g / (h + RIDGE)
        margin += value[t][leaf]
    return Model(base, feature, cut, value)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([statistics(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())], float).reshape(-1, len(FEATURES))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(_rows(batch)), pa.list_(pa.float64())), batch.column("turn")], names=["label", "row", "turn"])


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_rows(batch)), pa.float64())], names=["id", "score"])

    return score


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from at most ``sample`` labelled documents, those of the lowest hash of id; only their statistics come to
    the driver.  Rows with a null id or a label other than 0 and 1 are left out; of an id labelled twice the larger
    label counts, and of rows that repeat an id at most ``sample`` are taken in all, by hash of text.  With nothing to
    learn from, every score is 0.5."""
    good = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    drawn = F.broadcast(good.orderBy(F.xxhash64(F.lit("label"), "id"), "id").limit(sample))  # at most sample rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(drawn, "id").select("label", "text", F.xxhash64(F.lit("row"), "id", "text").alias("turn"))
    got = rows.mapInArrow(_statistics, "label double, row array<double>, turn long").orderBy("turn", "label").limit(sample).collect()
    if not got:
        return Model(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    found = np.array([[r["label"], *r["row"]] for r in got])
    found = found[np.lexsort(found.T)]  # the same model, however the rows came
    return fit(found[:, 1:], found[:, 0])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for each row of ``docs``: from the text alone.  A null text is empty; repeated rows each give a row; a
    very long text is scored by the statistics of all of it; ties of gain go to the first feature and lowest cut."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model), "id long, score double").withColumnRenamed("id", id_col)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``; rows whose crc32 of the id leaves 1 by 3 are held out of learning, as are null ids."""
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(True))
    out = predict(docs, train(docs, labels.filter(~held)))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
