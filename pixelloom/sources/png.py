"""PNG export: bands of rows deflated in tasks, joined in order with one checksum."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parts import spanned, write_parts
from .stage import staged

#: The signature, and colour types by number of channels.
SIGNATURE, COLOURS = b"\x89PNG\r\n\x1a\n", {1: 0, 3: 2}
#: Pixels of a band, about.
BAND = 1 << 20
_ADLER = 65521


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def joined_adler(first: int, second: int, length: int) -> int:
    """The Adler-32 of two texts in a row, from those of each and the length of the second."""
    a, b = first & 0xFFFF, first >> 16
    c, d = second & 0xFFFF, second >> 16
    return (a + c - 1) % _ADLER | (b + d + (a - 1) * length) % _ADLER << 16


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, band, rows, height, width, channels, y, x, c, v) sorted by path and band: deflated bands."""

    def packed(key: tuple, at: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
        path, band, rows, height, width, channels = key
        own = min(rows, height - band * rows)
        lines = np.zeros((own, 1 + width * channels), np.uint8)  # each line begins with its filter, 0 for none
        places = np.concatenate(at)
        lines[places // (width * channels), 1 + places % (width * channels)] = np.concatenate(v)
        plain = lines.tobytes()
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        last = (band + 1) * rows >= height
        data = deflate.compress(plain) + deflate.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)
        data = (b"\x78\x9c" if band == 0 else b"") + data
        columns = [pa.array([path]), pa.array([band], pa.int32()), pa.array([zlib.adler32(plain)], pa.int64()), pa.array([len(plain)], pa.int64()), pa.array([chunk(b"IDAT", data)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["path", "band", "adler", "length", "data"])

    now, at, v = None, [], []
    for batch in batches:
        names = ["path", "band", "rows", "height", "width", "channels"]
        keys = list(zip(*(batch.column(n).to_pylist() for n in names)))
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for lo, hi in zip(starts, [*starts[1:], len(keys)]):
            if keys[lo] != now:
                if now:
                    yield packed(now, at, v)
                now, at, v = keys[lo], [], []
            own = batch.slice(lo, hi - lo)
            own = own.filter(own.column("v").is_valid())
            y, x, c, value = (own.column(n).to_numpy() for n in ("y", "x", "c", "v"))
            at.append(((y.astype(np.int64) - now[1] * now[2]) * now[4] + x) * now[5] + c)
            v.append(np.clip(value, 0, 255).astype(np.uint8))
    if now:
        yield packed(now, at, v)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            if r["channels"] not in COLOURS:
                raise ValueError(f"a picture has 1 or 3 channels: {r['path']} has {r['channels']}")
            total = 1
            for b in r["sums"]:
                total = joined_adler(total, b["adler"], b["length"])
            head = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", r["width"], r["height"], 8, COLOURS[r["channels"]], 0, 0, 0))
            tail = chunk(b"IDAT", struct.pack(">I", total)) + chunk(b"IEND", b"")
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * 2), pa.array([-1, 2**31 - 1], pa.int32()), pa.array([head, tail], pa.binary())], names=["path", "at", "data"])


def save_pictures(px: DataFrame, folder: str) -> None:
    """Write pixels (``path, y, x, c, v``, v a byte from 0 to 255, as the stretches give) as one PNG for each path, by its
    last part: grey for one channel, RGB for three.

    Sizes are those of the largest place of each image, or the columns ``height, width, channels``; a missing pixel is
    0.  Bands of rows are deflated by tasks of their own, each ending on a byte, so that one after the other they are
    one stream; its checksum comes from the bands' by arithmetic.
    """
    sizes = staged(spanned(px), "png-sizes")
    rows_ = F.greatest(F.floor(BAND / (F.col("width") * F.col("channels"))), F.lit(1)).cast("int")
    shape = sizes.drop("header").withColumn("rows", rows_)
    rows = px.select("path", *[F.col(k).cast("int").alias(k) for k in "yxc"], F.col("v").cast("int").alias("v")).join(shape, "path").withColumn("band", F.floor(F.col("y") / F.col("rows")).cast("int"))
    every = shape.withColumn("band", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / F.col("rows")).cast("int"))))
    rows = rows.unionByName(every.withColumns({k: F.lit(None).cast("int") for k in "yxcv"}))
    rows = rows.repartition("path", "band").sortWithinPartitions("path", "band")
    bands = staged(rows.mapInArrow(_bands, "path string, band int, adler long, length long, data binary"), "png-bands")
    sums = bands.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("band", "adler", "length"))).alias("sums"))  # one entry a band
    ends = sums.join(sizes.drop("header"), "path").mapInArrow(_ends, "path string, at int, data binary")
    write_parts(ends.unionAll(bands.select("path", F.col("band").alias("at"), "data")), folder)
