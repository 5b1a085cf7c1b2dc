"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where the session names none, as in tests on one machine, a temporary folder is set and removed at exit.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="pixelloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go as soon as it is written.

    Else they stay until the driver happens to collect its garbage, and a job of many steps holds those of all.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _written(df: DataFrame, path: str) -> DataFrame:
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    return _written(df, f"{shared_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells rows apart and is the same whenever it is read, and its name, a free one.

    Rows of files that are read as they are have their place there: file and index.  Where they come in another way,
    have no such index, or the session does not show how they come (Spark Connect), they are stored with a number.
    """
    name = "row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    plan = getattr(docs, "_jdf", None)
    if plan is not None and plan.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        with suppress(AnalysisException):
            return docs.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))), name
    return stored(docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "numbered"), name


class Scratch:
    """The intermediate tables of one job in the shared folder, each removed once nothing reads it any more.

    What the lazy result of a job reads is left there, for the owner of the folder to clear.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.top = spark, f"{shared_dir(spark).rstrip('/')}/{job}-{uuid.uuid4().hex}"
        self.held: dict[str, DataFrame] = {}
        self.made = 0

    def store(self, df: DataFrame, tag: str) -> DataFrame:
        self.made += 1
        path = f"{self.top}/{self.made}-{tag}"
        self.held[path] = out = _written(df, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables whose readers have all been stored themselves."""
        for path, one in list(self.held.items()):
            if any(one is t for t in tables):
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
                del self.held[path]

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables but these, which the result reads."""
        self.drop(*[one for one in self.held.values() if not any(one is t for t in tables)])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: what is made of a text may be larger than it."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def others(df: DataFrame, *added: str) -> list[Column]:
    """The columns of ``df`` but for those that ``added`` replaces (names compare without case, as Spark's do)."""
    new = {name.lower() for name in added}
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns if name.lower() not in new]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does that for texts of ASCII alone, and is faster than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
