"""FITS images as a Spark data source: ``spark.read.format("fits")`` and ``df.write.format("fits")``.

One input partition a file.  Rows are pixels, with the path as frame name; the header is a map on the pixel (0, 0, 0) of
each image and NULL elsewhere.  Colour images are stored channels first and read as channels.  Files lie in any store
that pyarrow opens by its address.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BLOCK, CARD = 2880, 80
#: Types by BITPIX, big-endian.
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}
SUFFIXES = (".fits", ".fit", ".fts")
SCHEMA = "path string, header map<string,string>, y int, x int, c int, v double"
PIXELS_A_BATCH = 1 << 16


def parse_header(block: bytes) -> dict[str, object]:
    """Cards of one header as numbers, booleans and text, in order; blank keywords are left out."""
    out: dict[str, object] = {}
    for i in range(0, len(block) - CARD + 1, CARD):
        card = block[i : i + CARD].decode("ascii", "replace")
        key, rest = card[:8].strip(), card[10:]
        if key == "END":
            break
        if not key or card[8:10] != "= ":
            continue
        rest = rest.strip()
        if rest.startswith("'"):
            text, at = "", 1
            while at < len(rest):
                if rest[at] == "'":
                    if rest[at + 1 : at + 2] != "'":
                        break
                    at += 1
                text += rest[at]
                at += 1
            out[key] = text.rstrip()
            continue
        word = rest.split("/", 1)[0].strip()
        if word in ("T", "F"):
            out[key] = word == "T"
        else:
            try:
                out[key] = int(word)
            except ValueError:
                try:
                    out[key] = float(word.replace("D", "E"))
                except ValueError:
                    out[key] = word
    return out


def read_header(data: bytes, at: int = 0) -> tuple[dict[str, object], int]:
    """A header and where its data begin."""
    stop = at
    while True:
        block = data[stop : stop + BLOCK]
        if len(block) < BLOCK:
            raise ValueError("not a FITS file, or cut off in its header")
        stop += BLOCK
        if any(block[i : i + 8] == b"END     " for i in range(0, BLOCK, CARD)):
            return parse_header(data[at:stop]), stop


def read_image(data: bytes) -> tuple[dict[str, object], np.ndarray]:
    """Header and (height, width, channels) of the first unit with data, as doubles; BLANK is NaN."""
    at = 0
    while at < len(data):
        header, at = read_header(data, at)
        sides = [int(header[f"NAXIS{i}"]) for i in range(1, int(header.get("NAXIS", 0)) + 1)]
        kind = np.dtype(TYPES[int(header["BITPIX"])])
        count = int(np.prod(sides)) if sides else 0
        if not count:
            continue
        raw = np.frombuffer(data, kind, count, at).reshape(sides[::-1])
        out = raw.astype(float)
        if "BLANK" in header and kind.kind in "iu":
            out[raw == header["BLANK"]] = np.nan
        out = out * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0))
        if out.ndim == 2:
            return header, out[:, :, None]
        return header, np.moveaxis(out, 0, 2) if out.shape[0] in (3, 4) else out
    raise ValueError("no image in the file")


def _card(key: str, value: object) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, int):
        text = f"{value:>20}"
    elif isinstance(value, float):
        text = f"{value!r:>20}".upper()
    else:
        escaped = str(value).replace("'", "''")
        text = f"'{escaped:<8}'"
    return f"{key:<8}= {text}".encode("ascii", "replace")[:CARD].ljust(CARD)


def image_header(height: int, width: int, channels: int, extra: dict[str, object] | None = None) -> bytes:
    """The header block of a 32-bit float image, channels first."""
    sides = [width, height] + ([channels] if channels > 1 else [])
    cards = [_card("SIMPLE", True), _card("BITPIX", -32), _card("NAXIS", len(sides))]
    cards += [_card(f"NAXIS{i + 1}", int(n)) for i, n in enumerate(sides)]
    if channels > 1:
        cards.append(_card("COLORTYP", "RGB"))
    fixed = {"SIMPLE", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "NAXIS3", "BSCALE", "BZERO", "BLANK", "END"} | ({"COLORTYP"} if channels > 1 else set())
    cards += [_card(k[:8].upper(), v) for k, v in (extra or {}).items() if k and k.upper() not in fixed]
    head = b"".join(cards) + b"END".ljust(CARD)
    return head.ljust(-(-len(head) // BLOCK) * BLOCK)


def write_image(image: np.ndarray, extra: dict[str, object] | None = None) -> bytes:
    """A 32-bit float file of (height, width) or (height, width, channels), channels first."""
    data = image[:, :, None] if image.ndim == 2 else image
    body = np.ascontiguousarray(np.moveaxis(data, 2, 0), ">f4").tobytes()
    return image_header(*data.shape, extra) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def typed(value: str) -> object:
    """A header value from its text."""
    if value in ("T", "True"):
        return True
    if value in ("F", "False"):
        return False
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def _batches(path: str, data: bytes) -> Iterator[pa.RecordBatch]:
    """The pixels of one file, row by row of the image, in batches of bounded size."""
    header, image = read_image(data)
    h, w, channels = image.shape
    flat = image.reshape(-1)
    words = [(k, str(v)) for k, v in header.items()]
    for lo in range(0, flat.size, PIXELS_A_BATCH):
        at = np.arange(lo, min(lo + PIXELS_A_BATCH, flat.size))
        y, rest = np.divmod(at, w * channels)
        x, c = np.divmod(rest, channels)
        n = len(at)
        heads = pa.array([words if i == 0 and lo == 0 else None for i in range(n)], pa.map_(pa.string(), pa.string()))
        values = pa.array(np.where(np.isfinite(flat[at]), flat[at], np.nan), pa.float64(), from_pandas=True)
        yield pa.RecordBatch.from_arrays([pa.array([path] * n), heads, *[pa.array(a, pa.int32()) for a in (y, x, c)], values], names=["path", "header", "y", "x", "c", "v"])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def partitions(self) -> list[_File]:
        store, top = _store(self.root)
        info = store.get_file_info(top)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(top))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.lower().endswith(SUFFIXES)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with _store(self.root)[0].open_input_stream(partition.path) as f:
            data = f.read()
        yield from _batches(partition.path, data)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # (where it was written, where it belongs)


class _Writer(DataSourceArrowWriter):
    """Images as ``save_images`` deals them: each whole in one partition, in the order of the file, with its size.

    Pixels go to a file of the task as they come; the driver moves the files to their names when all tasks are done,
    so that a lost or repeated task leaves nothing, and refuses two files of one name.
    """

    def __init__(self, options: dict[str, str]):
        self.root, self.job, self.fill = options["path"].rstrip("/"), uuid.uuid4().hex, float(options.get("fill", "nan"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.root)
        out, now, done, file = _Written(), None, 0, None

        def close() -> None:
            if file is not None:
                fill(total)
                file.write(b"\0" * (-4 * total % BLOCK))
                file.close()

        def fill(to: int) -> None:
            """Missing pixels up to a place."""
            nonlocal done
            while done < to:
                n = min(to - done, PIXELS_A_BATCH)
                file.write(np.full(n, self.fill, ">f4").tobytes())
                done += n

        for batch in batches:
            paths = np.array(batch.column("path").to_pylist(), object)
            starts = [0, *(np.flatnonzero(paths[1:] != paths[:-1]) + 1)] if len(paths) else []
            for lo, hi in zip(starts, [*starts[1:], len(paths)]):
                part = batch.slice(lo, hi - lo)
                if paths[lo] != now:
                    close()
                    now, done = paths[lo], 0
                    height, width, channels = (part.column(k)[0].as_py() for k in ("height", "width", "channels"))
                    total = height * width * channels
                    name = now.rstrip("/").rsplit("/", 1)[-1]
                    if name in [target.rsplit("/", 1)[-1] for _, target in out.files]:
                        raise ValueError(f"rows of {now} come apart, or two paths end in {name}: write with save_images")
                    out.files.append((f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}", f"{root}/{name}"))
                    store.create_dir(f"{root}/_temporary/{self.job}")
                    file = store.open_output_stream(out.files[-1][0])
                    file.write(image_header(height, width, channels, {k: typed(v) for k, v in part.column("header")[0].as_py() or ()}))
                y, x, c = (part.column(k).to_numpy() for k in "yxc")
                at = (c.astype(np.int64) * height + y) * width + x
                if at[0] < done or (np.diff(at) <= 0).any() or at[-1] >= total:
                    raise ValueError(f"pixels of {now} are out of order or repeat: write with save_images")
                for b in range(0, len(at), PIXELS_A_BATCH):
                    own = at[b : b + PIXELS_A_BATCH]
                    values = part.column("v").slice(b, len(own)).to_numpy(zero_copy_only=False)
                    gaps = np.flatnonzero(np.diff(own, prepend=done - 1) > 1)
                    for i, j in zip([0, *gaps], [*gaps, len(own)]):  # stretches without a missing pixel
                        if i < j:
                            fill(int(own[i]))
                            file.write(values[i:j].astype(">f4").tobytes())
                            done += j - i
        close()
        return out

    def _clear(self) -> None:
        store, root = _store(self.root)
        if store.get_file_info(f"{root}/_temporary/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_temporary/{self.job}")

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = _store(self.root)
        files = [f for m in messages if m for f in m.files]
        targets = [target for _, target in files]
        if len(set(targets)) < len(targets):
            self._clear()
            raise ValueError("an image was written by two tasks: write with save_images")
        store.create_dir(root)
        for place, target in files:
            if store.get_file_info(target).is_file:
                store.delete_file(target)
            store.move(place, target)
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsSource)


def save_images(px: DataFrame, folder: str, fill: float = float("nan")) -> None:
    """Write pixels (``path, y, x, c, v`` and maybe ``header``, a map of text) as one file for each path, by its last part.

    Sizes are those of the largest place of each image, or the columns ``height, width, channels`` where there are any.  Images are dealt to tasks whole and sorted there by Spark,
    which may spill, and streamed to their file, so that no image lies in the memory of a task; a missing pixel is ``fill``.
    """
    register(px.sparkSession)
    sizes = px.groupBy("path").agg(*[(F.max(n) if n in px.columns else F.max(k) + 1).alias(n) for k, n in (("y", "height"), ("x", "width"), ("c", "channels"))], (F.first("header", True) if "header" in px.columns else F.lit(None).cast("map<string,string>")).alias("header"))
    rows = px.select("path", "y", "x", "c", F.col("v").cast("double").alias("v")).join(sizes, "path")
    rows = rows.repartition("path").sortWithinPartitions("path", "c", "y", "x")
    rows.select("path", "header", "height", "width", "channels", "y", "x", "c", "v").write.format("fits").option("fill", fill).mode("append").save(folder)


def read_stored(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FITS files in any store that Spark reads (``binaryFile``): ``path, header, y, x, c, v``."""

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _batches(name, content.as_py())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{fits,fit,fts,FITS,FIT,FTS}").load(path).select("path", "content")
    return files.mapInArrow(pixels, SCHEMA)


def header_text(header: Column) -> Column:
    """A map of ``struct<number, text>`` as the map of text that files take."""
    return F.transform_values(header, lambda _, v: F.coalesce(v["text"], v["number"].cast("string")))
