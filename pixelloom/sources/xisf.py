"""XISF images: an XML header with attached blocks, byte shuffling and zlib, LZ4 or zstd compression, read and written.

Reading takes monolithic files of any store that Spark reads: blocks that are attached, inline or embedded, in one piece
or in sub-blocks, planar or normal storage, either byte order.  Writing deals an image to tasks by stretches of its
pixels; each is shuffled into its byte planes and compressed on its own, and the planes' sub-blocks follow one another.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fits import PIXELS_A_BATCH, SCHEMA
from .parts import spanned, write_parts

SIGNATURE = b"XISF0100"
SUFFIXES = (".xisf",)
#: Sample types by their names, and codecs by theirs.
SAMPLES = {"UInt8": "u1", "UInt16": "u2", "UInt32": "u4", "UInt64": "u8", "Float32": "f4", "Float64": "f8"}
LZ4 = ("lz4", "lz4hc")
#: Pixels of a stretch, which a task compresses; bytes that the header may grow into.
STRETCH, HEADER_ROUND = 1 << 18, 4096
NAMESPACE = "http://www.pixinsight.com/xisf"


def inflated(codec: str, data: bytes, size: int) -> bytes:
    if codec == "zlib":
        return zlib.decompress(data)
    if codec in LZ4:
        return pa.Codec("lz4_raw").decompress(data, size).to_pybytes()
    if codec == "zstd":
        return pa.Codec("zstd").decompress(data, size).to_pybytes()
    raise ValueError(f"unknown compression: {codec!r}")


def unshuffled(data: bytes, size: int) -> bytes:
    """Items of ``size`` bytes from their byte planes; what is left over at the end stays as it is."""
    n = len(data) // size
    return np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.tobytes() + data[n * size :]


def block_of(element: ElementTree.Element, file: bytes) -> bytes:
    """The bytes of an element's block, decompressed."""
    kind, _, rest = element.get("location", "").partition(":")
    if kind == "attachment":
        at, size = map(int, rest.split(":"))
        data = file[at : at + size]
        if len(data) < size:
            raise ValueError("a block is cut off")
    elif kind in ("inline", "embedded"):
        held = element if kind == "inline" else next((e for e in element if e.tag.rpartition("}")[2] == "Data"), None)
        if held is None:
            raise ValueError("an embedded block without data")
        coding = rest if kind == "inline" else held.get("encoding", "base64")
        text = "".join((held.text or "").split())
        data = base64.b64decode(text) if coding == "base64" else bytes.fromhex(text)
        element = element if kind == "inline" or element.get("compression") else held
    else:
        raise ValueError(f"a block elsewhere is not read: {kind!r}")
    if how := element.get("compression"):
        codec, size, *item = how.split(":")
        codec, _, shuffle = codec.partition("+")
        pieces = [tuple(map(int, p.split(","))) for p in element.get("subblocks", f"{len(data)},{size}").split(":")]
        out, at = [], 0
        for packed, plain in pieces:
            out.append(inflated(codec, data[at : at + packed], plain))
            at += packed
        data = b"".join(out)
        if shuffle == "sh":
            data = unshuffled(data, int(item[0]))
    return data


def read_image(file: bytes) -> tuple[dict[str, str], np.ndarray]:
    """The FITS keywords and the first image, (height, width, channels) as doubles, its samples as they are."""
    if file[:8] != SIGNATURE:
        raise ValueError("not an XISF file")
    length = int.from_bytes(file[8:12], "little")
    root = ElementTree.fromstring(file[16 : 16 + length].rstrip(b"\0").decode("utf-8"))
    image = next((e for e in root.iter() if e.tag.rpartition("}")[2] == "Image"), None)
    if image is None:
        raise ValueError("no image in the file")
    *sides, channels = map(int, image.get("geometry", "").split(":"))
    if len(sides) != 2 or image.get("sampleFormat") not in SAMPLES:
        raise ValueError(f"an image of {image.get('geometry')} {image.get('sampleFormat')} is not read")
    width, height = sides
    kind = np.dtype(("<" if image.get("byteOrder", "little") == "little" else ">") + SAMPLES[image.get("sampleFormat")])
    data = np.frombuffer(block_of(image, file), kind, width * height * channels).astype(float)
    normal = image.get("pixelStorage", "Planar").lower() == "normal"
    out = data.reshape(height, width, channels) if normal else np.moveaxis(data.reshape(channels, height, width), 0, 2)
    words = ((e.get("name", ""), e.get("value", "").strip()) for e in image if e.tag.rpartition("}")[2] == "FITSKeyword")
    return {k: (v[1:-1].replace("''", "'").rstrip() if v[:1] == "'" == v[-1:] else v) for k, v in words if k and k not in ("HISTORY", "COMMENT")}, out


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            header, image = read_image(content.as_py())
            h, w, channels = image.shape
            header |= {"NAXIS1": str(w), "NAXIS2": str(h)}
            flat = image.reshape(-1)
            for lo in range(0, flat.size, PIXELS_A_BATCH):
                at = np.arange(lo, min(lo + PIXELS_A_BATCH, flat.size))
                y, rest = np.divmod(at, w * channels)
                x, c = np.divmod(rest, channels)
                heads = pa.array([list(header.items()) if i == 0 and lo == 0 else None for i in range(len(at))], pa.map_(pa.string(), pa.string()))
                values = pa.array(np.where(np.isfinite(flat[at]), flat[at], np.nan), pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(at)), heads, *[pa.array(a, pa.int32()) for a in (y, x, c)], values], names=["path", "header", "y", "x", "c", "v"])


def read_stored(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """XISF files as ``path, header, y, x, c, v``: the FITS keywords are a map on each image's first pixel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xisf,XISF}").load(path).select("path", "content")
    return files.mapInArrow(_pixels, SCHEMA)


def _stretches(codec: str, most: int, fill: float) -> object:
    """Rows (path, size, stretch, offset, v) sorted, as parts: for each stretch of pixels the four byte planes."""

    def part(path: str, stretch: int, size: int, at: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        values = np.full(min(most, size - stretch * most), fill, "<f4")
        values[at - stretch * most] = v
        planes = values.view(np.uint8).reshape(-1, 4).T
        data = [plane.tobytes() for plane in np.ascontiguousarray(planes)]
        packed = data if codec == "none" else [zlib.compress(d) if codec == "zlib" else pa.Codec("lz4_raw" if codec == "lz4" else codec).compress(d).to_pybytes() for d in data]
        n = [pa.array([path] * 4), pa.array(range(4), pa.int32()), pa.array([stretch] * 4, pa.int64()), pa.array([len(values)] * 4, pa.int64()), pa.array(packed, pa.binary())]
        return pa.RecordBatch.from_arrays(n, names=["path", "plane", "stretch", "plain", "data"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, v = None, [], []
        for batch in batches:
            paths, stretches = batch.column("path").to_pylist(), batch.column("stretch").to_numpy()
            keys = list(zip(paths, stretches.tolist()))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(keys)]):
                own = batch.slice(lo, hi - lo)
                key = (*keys[lo], own.column("size")[0].as_py())
                if key != now:
                    if now:
                        yield part(now[0], now[1], now[2], np.concatenate(at), np.concatenate(v))
                    now, at, v = key, [], []
                there = own.filter(own.column("offset").is_valid())
                at.append(there.column("offset").to_numpy())
                v.append(there.column("v").to_numpy(zero_copy_only=False))
        if now:
            yield part(now[0], now[1], now[2], np.concatenate(at), np.concatenate(v))

    return parts


def header_bytes(height: int, width: int, channels: int, subblocks: list[tuple[int, int]], words: dict[str, str] | None, codec: str) -> bytes:
    """The signature and XML of a file whose one block follows; its length depends on where the block begins, in rounds."""
    size, total = sum(n for n, _ in subblocks), 4 * height * width * channels
    keys = "".join(f"<FITSKeyword name={quoteattr(k)} value={quoteattr(v if _plain(v) else _quoted(v))} comment=\"\"/>" for k, v in (words or {}).items() if k.upper() not in ("NAXIS1", "NAXIS2"))
    how = "" if codec == "none" else f' compression="{codec}+sh:{total}:4" subblocks="{":".join(f"{a},{b}" for a, b in subblocks)}"'
    xml = lambda at: (
        f'<?xml version="1.0" encoding="UTF-8"?><xisf version="1.0" xmlns="{NAMESPACE}"><Image geometry="{width}:{height}:{channels}" sampleFormat="Float32" bounds="0:1" '
        f'colorSpace="{"RGB" if channels == 3 else "Gray"}" pixelStorage="Planar" location="attachment:{at}:{size}"{how}>{keys}</Image></xisf>'
    ).encode()
    at = -(-(16 + len(xml(0)) + 20) // HEADER_ROUND) * HEADER_ROUND
    text = xml(at)
    return (SIGNATURE + len(text).to_bytes(4, "little") + bytes(4) + text).ljust(at, b"\0")


def _plain(v: str) -> bool:
    try:
        float(v)
    except ValueError:
        return v in ("T", "F")
    return True


def _quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def save_images(px: DataFrame, folder: str, codec: str = "lz4", fill: float = float("nan"), stretch: int = STRETCH) -> None:
    """Write pixels (``path, y, x, c, v`` and maybe ``header``, a map of text) as one file for each path, by its last
    part: 32-bit floats, planar, shuffled and compressed by ``codec`` (``lz4``, ``zlib``, ``zstd`` or ``none``).

    Sizes are those of the largest place of each image, or the columns ``height, width, channels``.  A missing pixel is
    ``fill``.  Each task packs a stretch of ``stretch`` pixels of an image; what is put in order for a file are their compressed planes.
    """
    from .stage import staged

    if codec not in ("lz4", "zlib", "zstd", "none"):
        raise ValueError(f"unknown compression: {codec!r}")
    sizes = staged(spanned(px), "xisf-sizes")
    size = F.col("height").cast("long") * F.col("width") * F.col("channels")
    offset = (F.col("c").cast("long") * F.col("height") + F.col("y")) * F.col("width") + F.col("x")
    rows = px.select("path", "y", "x", "c", F.col("v").cast("double").alias("v")).join(sizes.drop("header"), "path").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = rows.select("path", size.alias("size"), offset.alias("offset"), "v")
    # Every stretch has a row, so that one without a pixel is written too.
    every = sizes.select("path", size.alias("size")).withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / stretch))))
    rows = rows.withColumn("stretch", F.floor(F.col("offset") / stretch)).unionByName(every.withColumns({"offset": F.lit(None).cast("long"), "v": F.lit(None).cast("double")}))
    rows = rows.repartition("path", "stretch").sortWithinPartitions("path", "stretch", "offset")
    if codec == "none":  # without compression there are no planes: whole items, in order
        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for four in _stretches("none", stretch, fill)(batches):
                planes = np.stack([np.frombuffer(d.as_py(), np.uint8) for d in four.column("data")])
                yield pa.RecordBatch.from_arrays([*[c.slice(0, 1) for c in four.columns[:4]], pa.array([planes.T.tobytes()], pa.binary())], names=four.schema.names)
    else:
        plain = _stretches(codec, stretch, fill)
    parts = staged(rows.mapInArrow(plain, "path string, plane int, stretch long, plain long, data binary"), "xisf-parts")
    lists = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("plane", "stretch", F.octet_length("data").alias("packed"), "plain"))).alias("blocks"))  # some tens of bytes for a stretch

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                width = 4 if codec == "none" else 1
                blocks = [(b["packed"], b["plain"] * width) for b in r["blocks"]]
                data = header_bytes(r["height"], r["width"], r["channels"], blocks, dict(r["header"] or ()), codec)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([data], pa.binary())], names=["path", "data"])

    first = lists.join(sizes, "path").mapInArrow(heads, "path string, data binary").select("path", F.struct(F.lit(-1).alias("plane"), F.lit(-1).cast("long").alias("stretch")).alias("at"), "data")
    write_parts(first.unionAll(parts.select("path", F.struct("plane", "stretch"), "data")), folder)
