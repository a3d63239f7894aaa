"""Matrix Market coordinate files as a Spark data source, read by byte ranges and written in two phases.

``spark.read.format("matrixmarket").load(path)`` gives (i, j, v) from 0, and
``df.write.format("matrixmarket").option("rows", m).option("cols", n)`` writes it,
once ``register(spark)`` has been called. Paths are local or of any store that
``pyarrow.fs`` knows; a path is one file or a folder with the banner in one of its files.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "matrixmarket"
BANNER = "%%matrixmarket"
#: Bytes of a read partition, and of one read within it.
SPLIT_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: What a folder's name for parts that are not committed begins with; readers skip such names.
STAGED = "_staged-"
HEAD = "0-head.mtx"


@dataclass
class Head:
    """What the banner and the size line say, and where the cells begin in their file."""

    path: str
    kind: str
    symmetric: bool
    rows: int
    cols: int
    cells: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def files_of(store: fs.FileSystem, path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, or of the folder's files but for hidden and staged ones."""
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    inside = store.get_file_info(fs.FileSelector(path))
    return sorted((f.path, f.size) for f in inside if f.type == fs.FileType.File and f.base_name[0] not in "._")


def head_of(store: fs.FileSystem, path: str) -> Head:
    """The head of a file, or of the first file of a folder that has a banner; a ValueError without or with a wrong one."""
    for name, _ in files_of(store, path):
        with store.open_input_file(name) as f:
            line = f.read(1024).split(b"\n")[0]
            words = line.decode("utf-8", "replace").lower().split()
            if words[:1] != [BANNER]:
                continue
            if len(words) != 5:
                break
            if words[1:3] != ["matrix", "coordinate"] or words[3] not in ("real", "integer", "pattern"):
                raise ValueError(f"unsupported: {' '.join(words[1:4])}")
            if words[4] not in ("general", "symmetric"):
                raise ValueError(f"unsupported symmetry: {words[4]}")
            f.seek(0)
            end, held = 0, b""
            while block := f.read(1 << 16) or (held and b"\n"):
                *lines, held = (held + block).split(b"\n")
                for line in lines:
                    end += len(line) + 1
                    text = line.strip()
                    if text and not text.startswith(b"%"):
                        sizes = text.split()
                        if len(sizes) != 3:
                            raise ValueError("no size line")
                        return Head(name, words[3], words[4] == "symmetric", *map(int, sizes), end)
            raise ValueError("no size line")
    raise ValueError("no Matrix Market banner")


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in [start, end)."""

    path: str
    start: int
    end: int


def lines_between(f: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in [start, end), in blocks of whole lines.

    A line begins at 0 and behind each newline, so a range looks at the byte
    before it first and reads its last line to that line's end.
    """
    base = max(0, start - 1)
    f.seek(base)
    held, inside = b"", start == 0
    while block := f.read(READ_BYTES):
        held += block
        if not inside:
            cut = held.find(b"\n") + 1
            base, held, inside = base + (cut or len(held)), held[cut:] if cut else b"", cut > 0
        if base >= end:
            return
        last = held.find(b"\n", max(0, end - 1 - base))
        if last >= 0:
            yield held[:last]
            return
        whole = held.rfind(b"\n") + 1
        if whole:
            yield held[:whole]
            base, held = base + whole, held[whole:]
    if inside and held and base < end:
        yield held


class MarketReader(DataSourceReader):
    """One partition for each so many bytes; coordinates are moved to 0 and mirrored where they are read."""

    def __init__(self, path: str, options: dict[str, str]):
        self.path, self.base = path, int(options.get("base", "1"))
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.bounded = options.get("bounds", "true") == "true"
        self.head = head_of(*opened(path))

    def partitions(self) -> list[Range]:
        store, path = opened(self.path)
        out = []
        for name, size in files_of(store, path):
            start = self.head.end if name == self.head.path else 0
            out += [Range(name, at, min(at + self.split, size)) for at in range(start, size, self.split)]
        return out or [Range(self.head.path, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        head, value = self.head, "int64" if self.head.kind == "integer" else "float64"
        names = ["i", "j"] if head.kind == "pattern" else ["i", "j", "v"]
        if part.end <= part.start:
            return
        with store.open_input_file(part.path) as f:
            for lines in lines_between(f, part.start, part.end):
                try:
                    cells = pd.read_csv(io.BytesIO(lines), sep=r"\s+", header=None, names=names, comment="%", dtype={"i": "int64", "j": "int64", "v": value}, index_col=False, float_precision="round_trip")
                except pd.errors.EmptyDataError:
                    continue
                if head.kind == "pattern":
                    cells["v"] = 1.0
                cells[["i", "j"]] -= self.base
                if self.bounded and len(cells) and not (cells.i.between(0, head.rows - 1) & cells.j.between(0, head.cols - 1)).all():
                    raise ValueError("coordinates out of bounds")
                if head.symmetric:
                    off = cells[cells.i != cells.j]
                    cells = pd.concat([cells, off.rename(columns={"i": "j", "j": "i"})[["i", "j", "v"]]])
                yield pa.RecordBatch.from_pandas(cells[["i", "j", "v"]], preserve_index=False)


@dataclass
class Part(WriterCommitMessage):
    """A staged file and the cells in it."""

    name: str
    cells: int


class MarketWriter(DataSourceArrowWriter):
    """Tasks stage their cells; the commit moves them in and writes the head with the count of all, and an abort leaves nothing.

    Appending adds the cells of the new parts to the count in the head. Until
    a first commit there is no head, so a reader takes the folder for empty.
    """

    def __init__(self, path: str, options: dict[str, str], overwrite: bool):
        if "rows" not in options or "cols" not in options:
            raise ValueError("the options rows and cols give the matrix its shape")
        self.path, self.overwrite = path, overwrite
        self.rows, self.cols = int(options["rows"]), int(options["cols"])
        self.staged = f"{path.rstrip('/')}/{STAGED}{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        store, staged = opened(self.staged)
        store.create_dir(staged, recursive=True)
        name, cells = f"part-{uuid.uuid4().hex}.mtx", 0
        with store.open_output_stream(f"{staged}/{name}") as out:
            for batch in batches:
                i, j = (pc.cast(pc.add(batch.column(c), 1), pa.string()) for c in ("i", "j"))
                lines = pc.binary_join_element_wise(i, j, pc.cast(pc.cast(batch.column("v"), pa.float64()), pa.string()), " ")
                if len(lines):
                    out.write(("\n".join(lines.to_pylist()) + "\n").encode())
                cells += len(lines)
        return Part(name, cells)

    def commit(self, messages: list[Part | None]) -> None:
        (store, top), (_, staged) = opened(self.path), opened(self.staged)
        done = [m for m in messages if m is not None]
        count, old = sum(m.cells for m in done), []
        store.create_dir(staged, recursive=True)
        if self.overwrite:
            old = [name for name, _ in files_of(store, top)]
        elif files_of(store, top):
            head = head_of(store, top)
            if (head.rows, head.cols, head.symmetric, head.path.rpartition("/")[2]) != (self.rows, self.cols, False, HEAD):
                raise ValueError("cells can be appended to a matrix of the same shape that was written here")
            count += head.cells
        for name in old:
            store.delete_file(name)
        for m in done:
            store.move(f"{staged}/{m.name}", f"{top}/{m.name}")
        with store.open_output_stream(f"{staged}/{HEAD}") as out:
            out.write(f"%%MatrixMarket matrix coordinate real general\n{self.rows} {self.cols} {count}\n".encode())
        store.move(f"{staged}/{HEAD}", f"{top}/{HEAD}")
        store.delete_dir(staged)

    def abort(self, messages: list[Part | None]) -> None:
        store, staged = opened(self.staged)
        if store.get_file_info(staged).type == fs.FileType.Directory:
            store.delete_dir(staged)


class MarketSource(DataSource):
    """Matrix Market coordinate matrices: real, integer or pattern, general or symmetric.

    Options for reading: ``base`` (the first index, 1), ``splitbytes`` and
    ``bounds`` (false: cells outside the announced shape are not errors). For
    writing: ``rows`` and ``cols``.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        kind = head_of(*opened(self.options["path"])).kind
        return f"i bigint, j bigint, v {'bigint' if kind == 'integer' else 'double'}"

    def reader(self, schema: StructType) -> MarketReader:
        return MarketReader(self.options["path"], dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> MarketWriter:
        return MarketWriter(self.options["path"], dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(MarketSource)
