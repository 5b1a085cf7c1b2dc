"""FITS headers as a data source: read with their comments, and patched card by card, whatever follows them untouched.

``spark.read.format("fits_headers").load(folder)`` gives ``path, header, text`` from the first blocks of each file alone.
Writing ``path, extra`` puts keywords into the primary header of the files named: pixels keep their bytes and type, cards
that are not named keep theirs (comments, HISTORY and further units too), and a card that is keeps its comment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .fits import BLOCK, CARD, SUFFIXES, parse_header, typed
from .parts import Commit, Written, store_of

#: Keywords that say how the data lie: they are the file's own and not patched.
STRUCTURE = frozenset("SIMPLE XTENSION BITPIX NAXIS EXTEND PCOUNT GCOUNT GROUPS BSCALE BZERO BLANK END".split())
COPY = 1 << 22


def _text_end(card: str) -> int:
    """Where the quoted text that begins at place 10 or later of a card ends."""
    at = card.index("'", 10) + 1
    while at < len(card):
        if card[at] == "'":
            if card[at + 1 : at + 2] != "'":
                return at + 1
            at += 1
        at += 1
    return len(card)


def parts_of(card: str) -> tuple[str, object, str]:
    """Keyword, value and comment of a card; commentary cards have their text as value."""
    key = card[:8].strip()
    if card.startswith("HIERARCH ") and "=" in card:
        name, _, rest = card[9:].partition("=")
        card = f"{'HIERARCH':<8}= {rest.strip()}"
        key = name.strip()
    elif card[8:10] != "= ":
        return key, card[8:].rstrip(), ""
    end = _text_end(card) if card[10:].lstrip()[:1] == "'" else 10
    comment = card[end:].partition("/")[2].strip()
    value = parse_header(f"{'X':<8}{card[8:]}".encode("latin-1").ljust(CARD)[:CARD]).get("X")
    return key, value if value != "" or "'" in card[:end] else None, comment


def cards_of(header: bytes) -> list[str]:
    """The cards of a header up to its END."""
    out = []
    for i in range(0, len(header), CARD):
        card = header[i : i + CARD].decode("latin-1")
        if card[:8] == "END     ":
            break
        out.append(card)
    return out


def dump(header: bytes) -> str:
    """A header as text, a line for each card with a keyword: value, and comment where there is one."""
    lines = []
    for card in cards_of(header):
        key, value, comment = parts_of(card)
        if key:
            lines.append(f"{key:8s} = {value!r:>30s}  / {comment}" if comment else f"{key:8s} = {value!r}")
    return "\n".join(lines) if lines else "(empty header)"


def new_cards(key: str, value: object, comment: str = "") -> list[str]:
    """The cards of a keyword: long ones by HIERARCH, long texts by CONTINUE; the comment as far as it fits."""
    start = f"{key:<8}= " if len(key) <= 8 else f"HIERARCH {key} = "
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, int):
        text = f"{value:>20}"
    elif isinstance(value, float):
        text = f"{value!r:>20}".upper()
    else:
        inner = str(value).replace("'", "''")
        room = CARD - len(start) - 2
        if len(inner) > room:
            pieces, lead = [], start
            while inner or not pieces:
                cut = CARD - len(lead) - 3
                while cut > 1 and inner[:cut].endswith("'") and len(inner[:cut]) - len(inner[:cut].rstrip("'")) & 1:
                    cut -= 1  # a doubled quote stays on one card
                piece, inner = inner[:cut], inner[cut:]
                pieces.append(f"{lead}'{piece}{'&' if inner else ''}'")
                lead = "CONTINUE  "
            return [p.ljust(CARD) for p in pieces]
        text = f"'{inner:<8}'"
    card = start + text
    if comment and len(card) + 4 < CARD:
        card += f" / {comment}"
    return [card[:CARD].ljust(CARD)]


def patched(header: bytes, extra: dict[str, object]) -> bytes:
    """A header block with keywords put in: in place of a card of that keyword, with its comment, else at the end."""
    wanted = {k.strip().upper(): v for k, v in extra.items() if k.strip()}
    wanted = {k: v for k, v in wanted.items() if k not in STRUCTURE and not (k[:5] == "NAXIS" and k[5:].isdigit())}
    out, dropping = [], False
    cards = cards_of(header)
    while cards and not cards[-1].strip():
        cards.pop()
    for card in cards:
        if dropping and card.startswith("CONTINUE"):
            continue
        key, _, comment = parts_of(card)
        dropping = key in wanted and key not in ("HISTORY", "COMMENT", "")
        if dropping:
            out += new_cards(key, wanted.pop(key), comment)
        else:
            out.append(card)
    for key, value in wanted.items():
        out += new_cards(key, value)
    text = "".join(out).encode("latin-1", "replace") + b"END".ljust(CARD)
    return text.ljust(-(-len(text) // BLOCK) * BLOCK)


def read_blocks(file: pa.NativeFile) -> bytes:
    """The primary header of an open file, by blocks."""
    out = b""
    while True:
        block = file.read(BLOCK)
        out += block
        if len(block) < BLOCK:
            raise ValueError("not a FITS file, or cut off in its header")
        if any(block[i : i + 8] == b"END     " for i in range(0, BLOCK, CARD)):
            return out


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.root = path

    def partitions(self) -> list[_File]:
        store, top = store_of(self.root)
        info = store.get_file_info(top)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(top))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.lower().endswith(SUFFIXES)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        try:
            with store_of(self.root)[0].open_input_stream(partition.path) as f:
                header = read_blocks(f)
            words, text = [(k, str(v)) for k, v in parse_header(header).items()], dump(header)
        except (ValueError, OSError) as e:
            words, text = None, f"Error reading FITS header: {e}"
        yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([words], pa.map_(pa.string(), pa.string())), pa.array([text])], names=["path", "header", "text"])


class _Writer(Commit, DataSourceArrowWriter):
    """Each file is written anew beside the old one, its bytes after the header copied as they are, and moved at the end."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = store_of(self.root)
        out = Written()
        for batch in batches:
            for path, extra in zip(batch.column("path").to_pylist(), batch.column("extra").to_pylist()):
                target = f"{root}/{path.rstrip('/').rsplit('/', 1)[-1]}"
                place = self.place()
                with store.open_input_stream(target) as old, store.open_output_stream(place) as new:
                    new.write(patched(read_blocks(old), {k: typed(v) if v is not None else "" for k, v in extra or ()}))
                    while piece := old.read(COPY):
                        new.write(piece)
                out.files.append((place, target))
        return out


class HeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits_headers"

    def schema(self) -> str:
        return "path string, header map<string,string>, text string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``path, header, text`` of the FITS files of a folder, one level deep: keywords as a map, and the whole as text."""
    spark.dataSource.register(HeaderSource)
    return spark.read.format("fits_headers").load(path)


def patch_headers(headers: DataFrame, folder: str) -> None:
    """Put keywords (``path, extra``: last part of a path and a map of text) into the primary headers of the files they
    name.  Keywords that say how the data lie are left aside; a file that is named twice is an error."""
    headers.sparkSession.dataSource.register(HeaderSource)
    headers.select("path", "extra").repartition("path").write.format("fits_headers").mode("append").save(folder)
