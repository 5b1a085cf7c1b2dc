"""Live stacking: a running mean of each pixel over frames as they arrive."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.parts import store_of

PX = "stack_id int, frame_id long, y int, x int, c int, v double"


def arriving(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    """Frames written as Parquet pixels to a folder."""
    return spark.readStream.schema(PX).option("maxFilesPerTrigger", per_trigger).parquet(path)


def running_mean(px: DataFrame) -> DataFrame:
    """``stack_id, y, x, c, n, v``: state is a sum and a count a pixel, whatever the number of frames."""
    return px.groupBy("stack_id", "y", "x", "c").agg(F.count("v").alias("n"), F.avg("v").alias("v"))


def windowed_quality(frames: DataFrame, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Frames (``ts``, ``fwhm``) a window of time: their number and mean width, closed when the watermark passes."""
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("fwhm").alias("fwhm"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "fwhm")


def _batches(folder: str) -> tuple[fs.FileSystem, dict[str, str]]:
    """The store and the folders below a place, by name."""
    store, top = store_of(folder.rstrip("/"))
    found = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
    return store, {f.base_name: f.path for f in found if f.type == fs.FileType.Directory}


def _finish(folder: str) -> int:
    """End a merge that has been written whole: the batches it holds go, and it takes their place.  -1 without one."""
    store, found = _batches(folder)
    for name, path in found.items():
        if name.startswith("_merged-") and store.get_file_info(f"{path}/_SUCCESS").is_file:
            last = int(name.removeprefix("_merged-"))
            for other, place in found.items():
                if other.startswith("batch=") and int(other.removeprefix("batch=")) <= last:
                    store.delete_dir(place)
            store.move(path, f"{path.rpartition('/')[0]}/batch={last}")
            return last
    return -1


def run_to_folder(px: DataFrame, folder: str, checkpoint: str, merge_every: int = 64, **trigger: object) -> StreamingQuery:
    """The running mean kept in a folder: each micro-batch writes the pixels that it has changed, so that nothing but
    state passes from batch to batch and no image is gathered.  A batch that is repeated replaces what it wrote.

    After every ``merge_every`` batches what is newest of each pixel is written anew and replaces the batches so far,
    so the folder holds an image and ``merge_every`` batches at most, however long the stream runs.  A merge that broke
    off is ended, or written again, by the batch that is repeated."""

    def write(changed: DataFrame, batch: int) -> None:
        if _finish(folder) >= batch:
            return  # the batch is in it
        changed.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")
        if (batch + 1) % merge_every == 0:
            latest(changed.sparkSession, folder).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/_merged-{batch}")
            _finish(folder)

    out = running_mean(px).writeStream.outputMode("update").foreachBatch(write)
    return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The image as the last batches have left it: of each pixel the row of the largest batch."""
    rows = spark.read.parquet(folder)
    newest = rows.groupBy("stack_id", "y", "x", "c").agg(F.max_by(F.struct("n", "v"), "batch").alias("last"))
    return newest.select("stack_id", "y", "x", "c", "last.n", "last.v")
