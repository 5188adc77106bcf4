"""The container format of tiled images: a Python data source that reads and writes it.

A file is a chain of segments (id, allocated size, used size), which a header, a tile directory and an attachment
directory point into. The reader plans one partition for each file or run of tiles, so that payloads are fetched by
range and in parallel; the directory alone is read without touching a payload. Entries differ in length, so planning
walks a directory once, in pieces, to say where each run begins; a task then reads its own run alone, and parses it
column by column. A plane and a region may be given, so that no payload outside them is fetched. Files are opened through
pyarrow's filesystems, so any store that those know will do.

    opened(spark, "file:///data/*.tiles", "tiles", {"c": 0}, Rect(0, 0, 512, 512))
    rows.repartition("doc").sortWithinPartitions("doc").write.format("tile_container").mode("append").save("file:///data")

Rows to write have doc (the file's name), the columns of the directory and data; sb_metadata, sb_attachment and xml (the
document's, from its first row) if there are any. A task writes a document tile by tile through scratch files, its
directory too, and holds no more than a batch; what it has written counts only once the job commits.
"""

from __future__ import annotations

import glob
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessel.functions.parsing import coordinate
from tessel.schema import ATTACHMENTS, DIM_COLUMNS, DIMS, SUBBLOCKS, Rect
from tessel.session import ship

# Segment ids, sizes and layouts of the format.
FILE, DIRECTORY, TILE, METADATA, ATTACHMENT_DIRECTORY, ATTACHMENT, DELETED = (s.encode().ljust(16, b"\0") for s in ("ZISRAWFILE", "ZISRAWDIRECTORY", "ZISRAWSUBBLOCK", "ZISRAWMETADATA", "ZISRAWATTDIR", "ZISRAWATTACH", "DELETED"))
ALIGN = 32
SEGMENT = struct.Struct("<16sqq")
HEADER = struct.Struct("<iiii16s16siqqiq")
HEADER_DATA, DIRECTORY_DATA, METADATA_DATA, ATTACHMENT_DATA, ATTACHMENT_DIRECTORY_DATA, TILE_DATA = 512, 128, 256, 256, 256, 256
ENTRY = struct.Struct("<2siqiiB5xi")
DIMENSION = struct.Struct("<4siifi")
ATTACHMENT_ENTRY = struct.Struct("<2s10xqi16s8s80s")
MOST_DIMENSIONS = 40
#: Bytes of a directory read at once; rows and bytes of tiles in a batch.
PIECE, BATCH_ROWS, BATCH_BYTES = 4 << 20, 2000, 16 << 20
#: The least bytes fetched of a tile whose payload is wanted: a small tile comes in one request.
AHEAD = 2048


class FormatError(ValueError):
    """The file is not as the format says."""


@dataclass
class Header:
    major: int
    minor: int
    primary_guid: str
    file_guid: str
    directory: int
    metadata: int
    attachments: int


@dataclass
class Tile:
    """A tile to write: a directory row without index and position, and its payload."""

    row: dict
    data: bytes = b""
    metadata: str = ""
    attachment: bytes = b""


@dataclass
class Document:
    tiles: list[Tile] = field(default_factory=list)
    attachments: list[tuple[str, str, str, bytes]] = field(default_factory=list)
    xml: str | None = None
    guid: str | None = None


def _segment(kind: bytes, data: bytes) -> bytes:
    size = -(-len(data) // ALIGN) * ALIGN
    return SEGMENT.pack(kind, size, len(data)) + data.ljust(size, b"\0")


#: Optional dimensions of an entry by their columns, and the layout of an entry by how many it has in all.
_NAMED = [*((d.upper().encode(), c) for d, c in zip(DIMS, DIM_COLUMNS, strict=True)), (b"M", "m_index")]
_LAYOUTS = [struct.Struct(f"{ENTRY.format}{DIMENSION.format[1:] * n}") for n in range(len(_NAMED) + 3)]


def _entry(row: dict, position: int) -> bytes:
    x, y, get = row["x"], row["y"], row.get
    dims = [b"X", x, row["w"], x, row["stored_w"], b"Y", y, row["h"], y, row["stored_h"]]
    for name, c in _NAMED:
        if (v := get(c)) is not None:
            dims += (name, v, 1, v, 1)
    n = len(dims) // 5
    return _LAYOUTS[n].pack(b"DV", row["pixel_type"], position, 0, row["compression_raw"], get("pyramid_type") or 0, n, *dims)


def write_document(document: Document, uri: str) -> None:
    """One document from the driver, with its attachments."""
    new = Appender(document.xml, document.guid)
    for t in document.tiles:
        new.add(t)
    new.finish(document.attachments)
    fs, path = pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)
    fs.create_dir(path.rpartition("/")[0])
    with new.f, fs.open_output_stream(path) as f:
        new.f.seek(0)
        shutil.copyfileobj(new.f, f, 8 << 20)


class File:
    """Reads one file by ranges."""

    def __init__(self, uri: str) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)
        self.f = fs.open_input_file(path)
        self.size = self.f.size()

    def at(self, offset: int, size: int) -> bytes:
        """Up to size bytes: fewer at the end of the file."""
        return self.f.read_at(size, offset)

    def segment(self, offset: int, kind: bytes | None = None) -> tuple[bytes, int, int]:
        """(id, allocated, used) of the segment there; a used size of 0 means all that is allocated."""
        head = self.at(offset, SEGMENT.size)
        if len(head) < SEGMENT.size:
            raise FormatError(f"no segment at {offset}")
        found, allocated, used = SEGMENT.unpack(head)
        if kind and found != kind:
            raise FormatError(f"segment {found!r} at {offset}, not {kind!r}")
        return found, allocated, used or allocated

    def walk(self) -> Iterator[tuple[int, str, int, int]]:
        """(offset, id, allocated, used) of every segment, deleted ones too."""
        at = 0
        while at < self.size:
            kind, allocated, used = self.segment(at)
            yield at, kind.rstrip(b"\0").decode("ascii", "replace"), allocated, used
            at += SEGMENT.size + allocated

    def header(self) -> Header:
        self.segment(0, FILE)
        major, minor, _, _, primary, own, _, directory, metadata, _, attachments = HEADER.unpack(self.at(SEGMENT.size, HEADER.size))
        return Header(major, minor, str(uuid.UUID(bytes_le=primary)), str(uuid.UUID(bytes_le=own)), directory, metadata, attachments)

    def _place(self) -> tuple[int, int, int]:
        """(how many entries the directory has, where the first begins, where the directory ends)."""
        at = self.header().directory
        _, _, used = self.segment(at, DIRECTORY)
        return struct.unpack("<i", self.at(at + SEGMENT.size, 4))[0], at + SEGMENT.size + DIRECTORY_DATA, at + SEGMENT.size + used

    def entries(self) -> int:
        """How many entries the directory has."""
        return self._place()[0]

    def pieces(self, first: int = 0, last: int | None = None, at: int | None = None) -> Iterator[tuple[int, int, bytes, list[int]]]:
        """(number of its first entry, its offset, its bytes, where in them each entry begins) of pieces of the directory, from entry first, which begins at offset at, to before last."""
        n, start, end = self._place()
        at, last = start if at is None else at, n if last is None else min(last, n)
        while first < last:
            size = min(PIECE, (last - first) * (ENTRY.size + DIMENSION.size * MOST_DIMENSIONS), end - at)
            data, starts, here = self.at(at, max(size, 0)), [], 0
            room = len(data) - ENTRY.size
            for _ in range(last - first):
                if here > room:
                    break
                after = here + ENTRY.size + DIMENSION.size * data[here + ENTRY.size - 4]
                if after > len(data):
                    break
                starts.append(here)
                here = after
            if not starts:
                raise FormatError("the directory is cut short")
            yield first, at, data, starts
            first, at = first + len(starts), at + here

    def runs(self, run: int) -> list[tuple[int, int, int]]:
        """(first entry, the one after the last, offset of the first) of each run of entries."""
        n, start, _ = self._place()
        if n <= run:
            return [(0, n, start)] if n > 0 else []
        return [(first + k, min(first + k + run, n), at + starts[k]) for first, at, _, starts in self.pieces() for k in range(-first % run, len(starts), run)]

    def directory(self, strict: bool = False) -> Iterator[dict]:
        """Directory rows in order. strict: sizes must be as the format wants them; else only starts count."""
        for first, _, data, starts in self.pieces():
            yield from ({"sb_index": first + k, **entry_of(data, at, strict)[0]} for k, at in enumerate(starts))

    def tile(self, position: int, ahead: int = 0) -> tuple[bytes, int, int, int, int]:
        """(the first bytes of a tile's segment, its entry among them; where its parts begin; sizes of metadata, data and attachment)."""
        data = self.at(position, SEGMENT.size + max(TILE_DATA, ahead))
        if len(data) < SEGMENT.size + 16 + ENTRY.size or data[:16] != TILE:
            self.segment(position, TILE)
            raise FormatError(f"the tile at {position} is cut short")
        _, allocated, used = SEGMENT.unpack_from(data)
        n_xml, n_attachment, n_data = struct.unpack_from("<iiq", data, SEGMENT.size)
        size = ENTRY.size + DIMENSION.size * data[SEGMENT.size + 16 + ENTRY.size - 4]
        if len(data) < SEGMENT.size + 16 + size:
            data = self.at(position, SEGMENT.size + 16 + size)
        at = max(TILE_DATA, 16 + size)
        if min(used or allocated, self.size - position - SEGMENT.size) < at + n_xml + n_data + n_attachment:
            raise FormatError(f"the tile at {position} is cut short")
        return data, SEGMENT.size + at, n_xml, n_data, n_attachment

    def parts(self, position: int) -> tuple[bytes, bytes, bytes, bytes]:
        """(the first bytes of a tile's segment, data, metadata, attachment)."""
        head, at, n_xml, n_data, n_attachment = self.tile(position, AHEAD)
        whole = n_xml + n_data + n_attachment
        body = head[at : at + whole] if len(head) >= at + whole else self.at(position + at, whole)
        return head, body[n_xml : n_xml + n_data], body[:n_xml], body[n_xml + n_data :]

    def payload(self, position: int) -> tuple[dict, bytes, str, bytes]:
        """(the tile's own header, data, metadata, attachment)."""
        head, data, xml, attachment = self.parts(position)
        return entry_of(head, SEGMENT.size + 16)[0], data, xml.decode("utf-8", "replace"), attachment

    def attachments(self) -> Iterator[dict]:
        if not (at := self.header().attachments):
            return
        _, _, used = self.segment(at, ATTACHMENT_DIRECTORY)
        data = self.at(at + SEGMENT.size, used)
        for i in range(struct.unpack_from("<i", data)[0]):
            schema, position, _, guid, kind, name = ATTACHMENT_ENTRY.unpack_from(data, ATTACHMENT_DIRECTORY_DATA + 128 * i)
            if schema == b"A1":
                text = lambda b: b.split(b"\0")[0].decode("utf-8", "replace")
                yield {"idx": i, "content_guid": str(uuid.UUID(bytes_le=guid)), "content_file_type": text(kind), "name": text(name[:79]), "file_position": position}

    def attachment(self, position: int) -> bytes:
        self.segment(position, ATTACHMENT)
        (size,) = struct.unpack("<q", self.at(position + SEGMENT.size, 8))
        return self.at(position + SEGMENT.size + ATTACHMENT_DATA, size)

    def xml(self) -> str | None:
        """None if the file has no metadata."""
        if not (at := self.header().metadata):
            return None
        self.segment(at, METADATA)
        (size,) = struct.unpack("<i", self.at(at + SEGMENT.size, 4))
        return self.at(at + SEGMENT.size + METADATA_DATA, size).decode("utf-8", "replace")


def entry_of(data: bytes, at: int, strict: bool = False) -> tuple[dict, int]:
    """(row, size) of a directory entry."""
    if data[at : at + 2] != b"DV":
        raise FormatError(f"entries of schema {data[at:at + 2]!r} are not read")
    _, pixel_type, position, _, compression, pyramid, n = ENTRY.unpack_from(data, at)
    if not 0 <= n <= MOST_DIMENSIONS:
        raise FormatError(f"{n} dimensions")
    row: dict = {c: None for c in (*DIM_COLUMNS, "m_index")}
    row |= {"x": None, "y": None, "w": None, "h": None, "stored_w": None, "stored_h": None}
    found = {}
    for k in range(n):
        name, start, size, _, stored = DIMENSION.unpack_from(data, at + ENTRY.size + k * DIMENSION.size)
        found[name.rstrip(b"\0 ").decode("ascii", "replace").upper()] = (start, size, stored)
    layer0 = all(d in found and found[d][1] == found[d][2] for d in "XY")
    for name, (start, size, stored) in found.items():
        if name in "XY":
            row |= {name.lower(): start, "w" if name == "X" else "h": size, f"stored_{'w' if name == 'X' else 'h'}": stored}
            continue
        if name.lower() not in DIMS and name != "M":
            if strict:
                raise FormatError(f"unknown dimension {name}")
            continue
        if strict and size != 1 and (name != "M" or layer0):
            raise FormatError(f"size {size} of dimension {name}")
        row["m_index" if name == "M" else f"dim_{name.lower()}"] = start
    if strict and not {"X", "Y"} <= set(found):
        raise FormatError("no X or Y")
    row |= {"pixel_type": pixel_type, "compression_raw": compression, "pyramid_type": pyramid, "file_position": position}
    return row, ENTRY.size + n * DIMENSION.size


_HEAD = np.dtype([("schema", "S2"), ("pixel_type", "<i4"), ("file_position", "<i8"), ("part", "<i4"), ("compression_raw", "<i4"), ("pyramid_type", "u1"), ("rest", "V5"), ("n", "<i4")])
_DIMENSION = np.dtype([("name", "<u4"), ("start", "<i4"), ("size", "<i4"), ("first", "<f4"), ("stored", "<i4")])
_STARTS = {"X": "x", "Y": "y", "M": "m_index"} | {d.upper(): c for d, c in zip(DIMS, DIM_COLUMNS, strict=True)}


def columns_of(data: bytes, starts: list[int], strict: bool = False) -> dict[str, np.ma.MaskedArray]:
    """The columns of many entries, as entry_of() has their values; what is unusual in an entry is left to it."""
    raw, at = np.frombuffer(data, np.uint8), np.asarray(starts, np.int64)
    head = raw[at[:, None] + np.arange(ENTRY.size)].view(_HEAD)[:, 0]
    out = {c: np.ma.masked_all(len(at), np.int32) for c in (*DIM_COLUMNS, "m_index", "x", "y", "w", "h", "stored_w", "stored_h")}
    out |= {c: np.ma.array(head[c], mask=np.zeros(len(at), bool)) for c in ("pixel_type", "compression_raw", "pyramid_type", "file_position")}
    odd = (head["schema"] != b"DV") | (head["n"] < 0) | (head["n"] > MOST_DIMENSIONS)
    for k in range(int(head["n"][~odd].max(initial=0))):
        rows = np.flatnonzero(~odd & (head["n"] > k))
        dims = raw[at[rows, None] + np.arange(DIMENSION.size) + (ENTRY.size + DIMENSION.size * k)].view(_DIMENSION)[:, 0]
        letter = np.where(dims["name"] >> 8 & ~np.uint32(0x202020), 0, dims["name"] & 0xFF)
        letter = np.where((letter >= 97) & (letter <= 122), letter - 32, letter)
        for code in np.unique(letter):
            these, name = letter == code, chr(code)
            if name not in _STARTS:
                odd[rows[these]] = True
                continue
            out[_STARTS[name]][rows[these]] = dims["start"][these]
            if name in "XY":
                ext = "w" if name == "X" else "h"
                out[ext][rows[these]], out[f"stored_{ext}"][rows[these]] = dims["size"][these], dims["stored"][these]
            elif strict:
                odd[rows[these]] |= dims["size"][these] != 1
    if strict:
        odd |= np.ma.getmaskarray(out["x"]) | np.ma.getmaskarray(out["y"])
    for k in np.flatnonzero(odd):
        row, _ = entry_of(data, starts[k], strict)
        for c, v in out.items():
            v[k] = np.ma.masked if row[c] is None else row[c]
    return out


_TABLES = {
    "subblocks": "doc string, " + SUBBLOCKS,
    "tiles": "doc string, " + SUBBLOCKS + ", data binary, sb_metadata string, sb_attachment binary",
    "payloads": "doc string, sb_index long, data binary, sb_metadata string, sb_attachment binary",
    "headers": "doc string, " + SUBBLOCKS.replace(", file_position long", ""),
    "attachments": "doc string, " + ATTACHMENTS + ", data binary",
    "metadata": "doc string, xml string",
    "files": "doc string, file_guid string, major int, minor int",
    "segments": "doc string, offset long, id string, allocated long, used long",
}


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_SCHEMAS = {t: pa.schema([(n, _ARROW[k]) for n, k in (c.strip().split(" ") for c in columns.split(","))]) for t, columns in _TABLES.items()}
#: Tables whose rows are those of the directory, and the tiles of a partition unless the option says so.
_RUNS = {"subblocks": 65536, "tiles": 256, "payloads": 256, "headers": 256}
#: About how many partitions a table has at most: with more, runs are longer, since a task costs far more than an entry and holds one batch anyway.
_MOST_RUNS = 1024


@dataclass
class _Part(InputPartition):
    uri: str
    first: int = 0
    last: int = -1
    at: int = 0


def _listed(path: str) -> list[str]:
    """The files of a path; * may stand in its last part."""
    if "://" not in path:
        return sorted(glob.glob(path)) or [path]
    head, _, name = path.rpartition("/")
    if "*" not in name:
        return [path]
    fs, folder = pyarrow.fs.FileSystem.from_uri(head)
    before, _, after = name.partition("*")
    names = [x.base_name for x in fs.get_file_info(pyarrow.fs.FileSelector(folder)) if x.is_file]
    return [f"{head}/{n}" for n in sorted(names) if n.startswith(before) and n.endswith(after) and len(n) >= len(before) + len(after)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.table, self.strict, self.run = options.get("table", "subblocks"), options.get("strict", "false") == "true", int(options.get("tiles_per_partition", "0"))
        self.uris = _listed(options["path"])
        # A plane and a region, which directory rows are held against before a payload is fetched.
        self.plane = {f"dim_{d}": v for d, v in coordinate(options.get("plane", "")).items()}
        self.roi = [int(v) for v in options["roi"].split(",")] if "roi" in options else None

    def _wanted(self, rows: dict[str, np.ma.MaskedArray]) -> np.ndarray:
        """Which entries the plane and the region want."""
        good = np.ma.ones(len(rows["x"]), bool)
        for c, v in self.plane.items():
            good &= rows[c] == v
        if self.roi is not None:
            x, y, w, h = self.roi
            left, top, right, bottom = (rows[c].astype(np.int64) for c in ("x", "y", "w", "h"))
            right, bottom = left + right, top + bottom
            good &= (np.ma.minimum(right, x + w) > np.ma.maximum(left, x)) & (np.ma.minimum(bottom, y + h) > np.ma.maximum(top, y))
        return good.filled(False)

    def partitions(self) -> list[InputPartition]:
        if self.table not in _RUNS:
            return [_Part(u) for u in self.uris]
        run = max(self.run or _RUNS[self.table], -(-sum(File(u).entries() for u in self.uris) // _MOST_RUNS))
        return [_Part(u, *r) for u in self.uris for r in File(u).runs(run)] or [_Part(self.uris[0])]

    def _batch(self, u: str, columns: dict) -> pa.RecordBatch:
        schema = _SCHEMAS[self.table]
        n = len(columns["offset" if self.table == "segments" else "sb_index"])
        plain = lambda v, t: pa.array(v.data, mask=np.ma.getmaskarray(v)).cast(t) if isinstance(v, np.ma.MaskedArray) else pa.array(v, t)
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(u), n) if f.name == "doc" else plain(columns[f.name], f.type) for f in schema], schema=schema)

    def _tiles(self, f: File, part: _Part) -> Iterator[pa.RecordBatch]:
        for first, _, data, starts in f.pieces(part.first, part.last, part.at):
            rows = columns_of(data, starts, self.strict)
            chosen = np.flatnonzero(self._wanted(rows))
            cut = lambda these: {"sb_index": these + first, **{c: v[these] for c, v in rows.items()}}
            if self.table == "subblocks":
                yield from (self._batch(part.uri, cut(chosen[k : k + 10000])) for k in range(0, len(chosen), 10000))
                continue
            held, size, k = [], 0, 0
            for j, position in enumerate(rows["file_position"].data[chosen].tolist()):
                if self.table == "headers":
                    held.append(f.tile(position)[0][SEGMENT.size + 16 :])
                else:
                    head, *found = f.parts(position)
                    if head[SEGMENT.size + 16 : SEGMENT.size + 18] != b"DV" or not 0 <= int.from_bytes(head[SEGMENT.size + 44 : SEGMENT.size + 48], "little", signed=True) <= MOST_DIMENSIONS:
                        entry_of(head, SEGMENT.size + 16)
                    held.append(found)
                    size += sum(map(len, found))
                if len(held) == BATCH_ROWS or size >= BATCH_BYTES or j == len(chosen) - 1:
                    yield self._with_parts(part.uri, cut(chosen[k : j + 1]), held)
                    held, size, k = [], 0, j + 1

    def _with_parts(self, u: str, rows: dict, held: list) -> pa.RecordBatch:
        if self.table == "headers":
            starts = np.cumsum([0, *map(len, held)])[:-1].tolist()
            return self._batch(u, columns_of(b"".join(held), starts) | {"sb_index": rows["sb_index"]})
        data, xml, attachment = zip(*held, strict=True)
        return self._batch(u, rows | {"data": data, "sb_metadata": [x.decode("utf-8", "replace") for x in xml], "sb_attachment": attachment})

    def read(self, part: _Part) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        f, u = File(part.uri), part.uri
        columns = [c.strip().split(" ")[0] for c in _TABLES[self.table].split(",")][1:]
        if self.table in _RUNS:
            yield from self._tiles(f, part)
        elif self.table == "attachments":
            yield from ((u, *[r[c] for c in columns[:-1]], f.attachment(r["file_position"])) for r in f.attachments())
        elif self.table == "metadata":
            if (xml := f.xml()) is not None:
                yield u, xml
        elif self.table == "files":
            h = f.header()
            yield u, h.file_guid, h.major, h.minor
        else:
            for some in batched(f.walk(), 10000):
                yield self._batch(u, dict(zip(columns, zip(*some, strict=True), strict=True)))


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows without columns that are null in all, and with the document's xml in its first row only."""
    used = [n for n in batch.schema.names if n != "xml" and batch.column(n).null_count < batch.num_rows]
    last = None
    for k, values in enumerate(zip(*(batch.column(n).to_pylist() for n in used), strict=True)):
        row = dict(zip(used, values, strict=True))
        if "xml" in batch.schema.names and row.get("doc") != last:
            row["xml"], last = batch.column("xml")[k].as_py(), row.get("doc")
        yield row


class _Writer(DataSourceArrowWriter):
    """Documents of a task, each streamed into a scratch file and from there under a temporary name to the folder."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"].rstrip("/")

    def _fs(self):
        return pyarrow.fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (pyarrow.fs.LocalFileSystem(), self.folder)

    def write(self, rows: Iterator[pa.RecordBatch]) -> _Written:
        fs, folder = self._fs()
        fs.create_dir(folder)
        out, name, new = [], None, None

        def end() -> None:
            new.finish()
            temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as f:
                new.f.seek(0)
                shutil.copyfileobj(new.f, f, 8 << 20)
            new.f.close()
            out.append((temporary, f"{folder}/{name}.tiles"))

        for row in (r for batch in rows for r in _rows(batch)):
            if name != row["doc"]:
                if new:
                    end()
                name, new = row["doc"], Appender(row.get("xml"))
            new.add(Tile(row, row.get("data") or b"", row.get("sb_metadata") or "", row.get("sb_attachment") or b""))
        if new:
            end()
        return _Written(out)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, _ = self._fs()
        files = [x for m in messages if m for x in m.files]
        if len({final for _, final in files}) < len(files):
            self.abort(messages)
            raise ValueError("a document came from several tasks, or in several runs; repartition and sort by doc")
        for temporary, final in files:
            fs.move(temporary, final)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, _ = self._fs()
        for m in messages:
            for temporary, _ in m.files if m else ():
                fs.delete_file(temporary)


class Appender:
    """A document under construction in a seekable scratch file, its directory in another."""

    def __init__(self, xml: str | None = None, guid: str | None = None) -> None:
        self.f, self.listed, self.n, self.xml, self.guid = tempfile.TemporaryFile(), tempfile.TemporaryFile(), 0, xml, guid
        self.f.write(_segment(FILE, bytes(HEADER_DATA)))

    def add(self, tile: Tile) -> None:
        entry, xml = _entry(tile.row, self.f.tell()), tile.metadata.encode()
        head = (struct.pack("<iiq", len(xml), len(tile.attachment), len(tile.data)) + entry).ljust(TILE_DATA, b"\0")
        self.f.write(_segment(TILE, head + xml + tile.data + tile.attachment))
        self.listed.write(entry)
        self.n += 1

    def finish(self, attachments: list[tuple[str, str, str, bytes]] = ()) -> None:
        """Metadata, attachments and directories; the header last."""
        metadata = held = 0
        if self.xml is not None:
            metadata, xml = self.f.tell(), self.xml.encode()
            self.f.write(_segment(METADATA, struct.pack("<ii", len(xml), 0).ljust(METADATA_DATA, b"\0") + xml))
        rows = []
        for guid, kind, name, data in attachments:
            entry = ATTACHMENT_ENTRY.pack(b"A1", self.f.tell(), 0, uuid.UUID(guid).bytes_le, kind.encode()[:8], name.encode()[:79])
            self.f.write(_segment(ATTACHMENT, (struct.pack("<q8x", len(data)) + entry).ljust(ATTACHMENT_DATA, b"\0") + data))
            rows.append(entry)
        directory = self.f.tell()
        used = DIRECTORY_DATA + self.listed.tell()
        self.f.write(SEGMENT.pack(DIRECTORY, -(-used // ALIGN) * ALIGN, used) + struct.pack("<i", self.n).ljust(DIRECTORY_DATA, b"\0"))
        with self.listed:
            self.listed.seek(0)
            shutil.copyfileobj(self.listed, self.f, 8 << 20)
        self.f.write(bytes(-used % ALIGN))
        if rows:
            held = self.f.tell()
            self.f.write(_segment(ATTACHMENT_DIRECTORY, struct.pack("<i", len(rows)).ljust(ATTACHMENT_DIRECTORY_DATA, b"\0") + b"".join(rows)))
        guid = uuid.UUID(self.guid) if self.guid else uuid.uuid4()
        self.f.seek(SEGMENT.size)
        self.f.write(HEADER.pack(1, 0, 0, 0, guid.bytes_le, guid.bytes_le, 0, directory, metadata, 0, held))


class ContainerSource(DataSource):
    """Options: path (a URI or a local path, * in its last part), table (subblocks, tiles, payloads, headers, attachments, metadata, files or segments), strict, tiles_per_partition (of tables of tiles; more where a table would have over a thousand partitions); plane (C0T3) and roi (x,y,w,h) of the tiles wanted."""

    @classmethod
    def name(cls) -> str:
        return "tile_container"

    def schema(self) -> str:
        table = self.options.get("table", "subblocks")
        if table not in _TABLES:
            raise ValueError(f"no table {table!r}")
        return _TABLES[table]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the format."""
    spark.dataSource.register(ContainerSource)
    return ship(spark)


def opened(spark: SparkSession, path: str, table: str = "subblocks", plane: dict[str, int] | None = None, roi: Rect | None = None, **options: str) -> DataFrame:
    """A table of the files at a path; of tables of tiles, those on the plane that overlap the region."""
    if plane:
        options["plane"] = "".join(f"{d.upper()}{v}" for d, v in plane.items())
    if roi:
        options["roi"] = ",".join(map(str, roi))
    return registered(spark).read.format("tile_container").option("table", table).options(**options).load(path)
