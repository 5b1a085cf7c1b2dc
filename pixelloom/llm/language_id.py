"""Language identification by a string kernel: blended-spectrum n-gram presence, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, others, sliced, stored, table

#: Lengths of the character n-grams of the blended spectrum, and hash cells for each document's presence vector.
GRAMS, CELLS = (1, 2, 3), 1 << 14
#: Bounds of the labelled sample: documents a language to learn from, and landmarks in all.
TRAIN_PER_LANGUAGE, LANDMARKS, RIDGE = 500, 256, 1e-2
#: Languages that are learned at most, the most frequent ones.
MOST_LANGUAGES = 256
#: Documents scored in one matrix product.
BATCH = 64
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def presence(text: str) -> np.ndarray:
    """Hash cells of the n-grams of the whole text, lower-cased, white space as one space; sorted, each once."""
    code = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le"), np.uint32)
    found = np.zeros(CELLS, bool)
    mixed = np.zeros(len(code), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(code) < n:
            break
        mixed = (mixed[: len(code) - n + 1] * np.uint32(0x9E3779B1)) ^ (code[n - 1 :] * np.uint32(0x85EBCA77))
        if n in GRAMS:
            cell = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            found[cell >> np.uint32(32 - CELLS.bit_length() + 1)] = True
    return np.flatnonzero(found).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # cells x languages: landmarks' presence times the ridge weights
    bias: np.ndarray


def kernel_rows(cells: list[np.ndarray]) -> np.ndarray:
    """Presence vectors of unit length: the product of two of them is the normalised presence kernel."""
    out = np.zeros((len(cells), CELLS), np.float32)
    for row, own in zip(out, cells):
        row[own] = 1 / np.sqrt(max(1, len(own)))
    return out


def fit(cells: list[np.ndarray], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest ridge regression on Nyström features of ``landmarks`` evenly chosen rows (languages take turns)."""
    names = sorted(set(languages))
    of = {name: [i for i, x in enumerate(languages) if x == name] for name in names}
    turns = [own[j] for j in range(max(map(len, of.values()))) for own in of.values() if j < len(own)][:landmarks]
    marks = kernel_rows([cells[i] for i in turns]).astype(np.float64)
    value, vector = np.linalg.eigh(marks @ marks.T)
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # K_mm^(-1/2)
    parts = range(0, len(cells), BATCH)  # never all rows at once
    features = np.concatenate([kernel_rows(cells[lo : lo + BATCH]) @ marks.T @ root for lo in parts])
    target = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
    count = np.maximum(1, np.array([len(of[n]) for n in names]))
    weight = (1 / count)[[names.index(n) for n in languages]][:, None]  # languages weigh alike
    weight /= weight.sum()
    centre, mean = (weight * features).sum(0), (weight * target).sum(0)
    f, t = features - centre, target - mean
    solved = np.linalg.solve(f.T @ (weight * f) + ridge / len(names) * 1e-2 * np.eye(f.shape[1]), f.T @ (weight * t))
    return Model(names, (marks.T @ (root @ solved)).astype(np.float32), (mean - centre @ solved).astype(np.float32))


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kernel rows times landmarks times weights; the last two are multiplied once, before."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 16 * BATCH):
            texts = batch.column(1)
            pred, scores = [], []
            for lo in range(0, batch.num_rows, BATCH):
                own = [t.as_py() or "" for t in texts[lo : lo + BATCH]]
                values = kernel_rows([presence(t) for t in own]) @ model.weights + model.bias
                best = values.argmax(1)
                for text, i, row in zip(own, best, values):
                    known = bool(_LETTER.search(text))
                    pred.append(model.languages[i] if known else UNKNOWN)
                    scores.append(float(min(1.0, max(0.0, (row[i] + 1) / 2))) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(scores, pa.float64())], names=[batch.schema.names[0], "lang_pred", "score"])

    return score


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        cells = [presence(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.list_(pa.int32())), batch.column(2)], names=["lang", "cells", "turn"])


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, landmarks: int = LANDMARKS, most: int = MOST_LANGUAGES) -> Model | None:
    """Learn from ``docs`` (``doc_id, text, lang``): of each of the ``most`` most frequent languages (ties by name) about ``per_language`` rows, those of the lowest
    hash of id and text, of equal rows one; never more than twice as many for all languages together.  Only their
    presence vectors (at most CELLS cells each) come to the driver.  None if no row has a language and a letter."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most), "languages")
    found = counts.count()
    if not found:
        return None
    turn = F.xxhash64(F.lit("train"), "doc_id", "text")
    rows = rows.join(F.broadcast(counts.select("lang", (per_language / F.col("n")).alias("share"))), "lang")  # at most ``most`` rows
    # A hash lies below its share of the range for about per_language documents, whatever the size of the input.
    chosen = rows.withColumn("turn", turn).filter((F.col("turn") / 2.0**64 + 0.5) <= F.col("share"))
    cells = chosen.select("lang", "text", "turn").mapInArrow(_cells, "lang string, cells array<int>, turn long").dropDuplicates(["lang", "turn"])
    got = cells.orderBy("turn", "lang").limit(2 * per_language * found).toPandas().sort_values(["turn", "lang"], kind="stable")
    if got.empty:
        return None
    return fit([np.asarray(c) for c in got["cells"]], got["lang"].tolist(), landmarks)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """``id_col, lang_pred, score`` for each row of ``docs``.  A null text, or one without a letter, is ``und`` with
    score 0; so is every text if nothing could be learned.  Ties go to the first language by name.  Repeated rows
    each give a row, a very long text is one row of the matrix products like any other, an empty table an empty one."""
    rows = docs.select(id_col, "text")
    if model is None:
        return rows.select(id_col, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_score(model), f"{id_col} {dict(rows.dtypes)[id_col]}, lang_pred string, score double")


def annotate(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` added, as ``predict`` gives them; columns of these names are replaced."""
    kept = others(docs, "lang_pred", "lang_score")
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("lang_score"))
    language = language_of(model)(F.col(text_col))
    out = docs.select(F.struct(*kept).alias("row"), language.alias("language"))
    return out.select("row.*", F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("lang_score"))


def language_of(model: Model) -> Callable:
    """A function of a text column: a struct of ``lang_pred`` and ``score``."""
    score = _score(model)

    @F.pandas_udf("lang_pred string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(texts)), pa.array(texts, pa.string(), from_pandas=True)], names=["id", "text"])
        return pa.Table.from_batches(score(iter([batch]))).select(["lang_pred", "score"]).to_pandas()

    return language


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from rows whose crc32 of the id is not divisible by 5, for all rows.

    Neither ``lang`` nor ``source`` nor the id enters a prediction.  Rows with a null id are held out.
    """
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(True))
    model = train(docs.filter(~held).select("doc_id", "text", "lang"))
    out = predict(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
