"""CSV members of zip archives, one archive per task at a time.

An archive cannot be split, so parallelism is the number of archives.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from loomstat.sources.delimited import text_schema

BATCH = 10_000
# characters of a batch of long fields; whichever limit comes first ends it
BATCH_CHARS = 4 << 20
# read at once from a file system; a reader jumps to the directory at an archive's end, then reads on from the member
READ_BYTES = 1 << 20
# schemes that a worker opens by itself with the paths that Spark lists
OPENED = ("", "file", "hdfs", "viewfs")


def _rows(member, sep: str, encoding: str, width: int, header: bool) -> Iterator[list[str]]:
    lines = csv.reader(io.TextIOWrapper(member, encoding=encoding, newline=""), delimiter=sep)
    first = True
    for number, fields in enumerate(lines):
        if not fields:
            continue
        if len(fields) != width:
            raise ValueError(f"expected {width} fields, got {len(fields)} in line {number + 1}")
        # the header is the first line that is not empty
        if header and first:
            first = False
            continue
        yield [f.strip() for f in fields]


def _batches(file: BinaryIO, names: list[str], sep: str, encoding: str, header: bool) -> Iterator[pa.RecordBatch]:
    """Rows of an archive's one CSV member, inflated while they are read."""
    with zipfile.ZipFile(file) as archive:
        members = [n for n in archive.namelist() if n.endswith(".csv")]
        if len(members) != 1:
            raise ValueError(f"expected one csv member, got {members}")
        with archive.open(members[0]) as member:
            pending: list[list[str]] = []
            chars = 0
            for row in _rows(member, sep, encoding, len(names), header):
                pending.append(row)
                chars += sum(map(len, row))
                if len(pending) == BATCH or chars >= BATCH_CHARS:
                    yield _batch(pending, names)
                    pending, chars = [], 0
            if pending:
                yield _batch(pending, names)


def _batch(rows: list[list[str]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)


def open_listed(path: str) -> BinaryIO:
    """A file under the path that Spark lists it by, read in blocks from where it lies."""
    # what follows the authority is a plain path, with blanks and percent signs as they are
    scheme, authority, inside = re.fullmatch(r"(?:([^:/]+):)?(?://([^/]*))?(/.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        system = fs.LocalFileSystem()
    else:
        system, _ = fs.FileSystem.from_uri(f"{scheme}://{authority or ''}/")
    return io.BufferedReader(system.open_input_file(inside), READ_BYTES)


def unzip_rows(
    archives: DataFrame,
    columns: Sequence[str],
    sep: str = ",",
    encoding: str = "UTF-8",
    header: bool = True,
    content: str = "content",
) -> DataFrame:
    """Rows of the one CSV member of every archive in a binary column.

    Members are read line by line; an archive itself is one value, so Spark's limit of 2 GB holds.
    """
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                yield from _batches(io.BytesIO(blob.as_py()), names, sep, encoding, header)

    return archives.select(content).mapInArrow(run, text_schema(columns))


def unzip_files(
    files: DataFrame,
    columns: Sequence[str],
    sep: str = ",",
    encoding: str = "UTF-8",
    header: bool = True,
    path: str = "path",
    open_file: Callable[[str], BinaryIO] = open_listed,
) -> DataFrame:
    """Rows of the one CSV member of every archive whose path is in a text column.

    A task opens an archive with ``open_file``, which gives a file that can seek, and holds a block of
    it and a batch of rows, whatever the sizes of archive and member. NULL paths have no rows.
    """
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).drop_null():
                with open_file(name.as_py()) as file:
                    yield from _batches(file, names, sep, encoding, header)

    return files.select(path).mapInArrow(run, text_schema(columns))


def read_zipped_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    sep: str = ",",
    encoding: str = "UTF-8",
    header: bool = True,
    open_file: Callable[[str], BinaryIO] | None = None,
) -> DataFrame:
    """Text columns of the CSV inside each archive that the path or glob matches.

    Spark lists the archives. Those on a local or Hadoop file system, or anywhere when ``open_file`` opens a
    listed path, are streamed and may have any size. On other systems Spark reads an archive
    as one value, of 2 GB at most.
    """
    files = spark.read.format("binaryFile").load(path)
    if open_file is None:
        found = files.select("path").first()
        if found is not None and urlsplit(found["path"]).scheme not in OPENED:
            return unzip_rows(files, columns, sep, encoding, header)
    # Spark packs the list by the archives' lengths, so a large one has a task of its own
    return unzip_files(files.select("path"), columns, sep, encoding, header, open_file=open_file or open_listed)
