"""Text files read by byte ranges: a file of any size, of one line too, is many tasks.

Spark's text reader cuts at line ends, so a file that is one line is one row. This data
source cuts a file every ``size`` letters and gives each block ``margin`` letters of its
neighbours, which is what a search needs; no task reads more than its range.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.grams import BLOCK, Texts

#: Bytes that a task reads, and bytes read at once.
TASK_BYTES, READ_BYTES = 64 << 20, 1 << 20


def _uri(path: str) -> str:
    """Plain paths, and what Hadoop writes as file:/path, with the scheme in full."""
    if "://" in path:
        return path
    return "file://" + os.path.abspath(path.removeprefix("file:"))


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder, at any depth."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(_uri(path))
    about = system.get_file_info(inner)
    if about.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no text file at {path}")
    found = [about] if about.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def _opened(path: str, inner: str):
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(_uri(path))
    return system.open_input_file(inner)


class _Range(InputPartition):
    def __init__(self, file: str, letters: int, first: int, last: int):
        self.file, self.letters, self.first, self.last = file, letters, first, last


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size, self.margin = options["path"], int(options["size"]), int(options["margin"])
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))

    def partitions(self):
        out, step = [], max(1, self.task_bytes // self.size)
        for file, size in _files(self.path):
            if size:
                with _opened(self.path, file) as f:  # a line end at the end is no letter
                    f.seek(max(0, size - 2))
                    end = f.read(2)
                size -= 2 if end == b"\r\n" else 1 if end.endswith(b"\n") else 0
            blocks = -(-size // self.size)
            out += [_Range(file, size, i, min(i + step, blocks)) for i in range(0, blocks, step)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, part):
        if part.first == part.last:
            return
        per_read = max(1, READ_BYTES // self.size)
        with _opened(self.path, part.file) as f:
            for first in range(part.first, part.last, per_read):
                begin = max(0, first * self.size - self.margin)
                end = min(part.letters, min(first + per_read, part.last) * self.size + self.margin)
                f.seek(begin)
                letters = f.read(end - begin)
                if not letters.isascii():
                    at = begin + next(i for i, c in enumerate(letters) if c > 127)
                    raise ValueError(f"byte {at} of {part.file} is no ASCII letter")
                letters = letters.decode("ascii")
                for block in range(first, min(first + per_read, part.last)):
                    at = block * self.size
                    core, lead = min(self.size, part.letters - at), min(self.margin, at)
                    yield part.file, block, core, lead, letters[at - lead - begin: at + core + self.margin - begin]


class LetterBlocks(DataSource):
    """Format ``letter_blocks``; options path, size, margin and task_bytes."""

    @classmethod
    def name(cls):
        return "letter_blocks"

    def schema(self):
        return "doc_id string, block int, core int, lead int, text string"

    def reader(self, schema):
        return _Reader(self.options)


class TextFiles(Texts):
    """A text file, or the files of a folder, to be searched: a file is a text, its path the
    doc_id. Letters are ASCII; other bytes raise an error that names their place. A line end
    at the end of a file is no letter; line ends within it are. Empty files give nothing, a
    missing path raises. ``path`` is anything that pyarrow's file systems can open on all
    executors."""

    def __init__(self, spark: SparkSession, path: str, task_bytes: int = TASK_BYTES):
        _files(path)
        spark.dataSource.register(LetterBlocks)
        self._spark, self.path, self.task_bytes = spark, path, task_bytes

    @property
    def spark(self) -> SparkSession:
        return self._spark

    @property
    def id_type(self) -> str:
        return "string"

    @property
    def texts(self):
        return None  # never whole

    def blocks(self, margin: int):
        size = max(BLOCK, 1 << (margin - 1).bit_length())
        rows = (self._spark.read.format("letter_blocks").option("size", size).option("margin", margin)
                .option("task_bytes", self.task_bytes).load(self.path))
        return size, rows.where(F.length("text") > 0)
