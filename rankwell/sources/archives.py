"""Reviews inside zip and tar archives.

An archive is opened where it lies through its file system (local, HDFS or object store), never
loaded whole.  Zip files carry an index, and so do plain tar files once their headers are walked:
their members are spread over the cluster and every task reads only its own.  Compressed tar files
can only be read front to back, so each is one streaming task.
"""

from __future__ import annotations

import codecs
import io
import json
import tarfile
import zipfile
import zlib
from collections import deque
from collections.abc import Generator, Iterator
from itertools import chain
from typing import IO

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.sources.json_stream import Cutter
from rankwell.sources.reviews import RAW_SCHEMA, is_bad_object, parse_review_lines

_SUFFIXES = (".json", ".jsonl", ".txt")

_MEMBERS = "archive string, member string, start long, size long"
_PIECES = "archive string, member string, kind string, piece string"


def _open(path: str) -> IO[bytes]:
    uri = path.replace("file:///", "/").replace("file:/", "/")
    system, inner = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return system.open_input_file(inner)


def _elements(text: Iterator[str]) -> Generator[str, None, str]:
    """The elements of a JSON array as text, one at a time, whatever the size of the array; the value is what follows it."""
    decoder, held, at, begun = json.JSONDecoder(), "", 0, False
    while True:
        while at < len(held) and (held[at].isspace() or (begun and held[at] == ",") or (not begun and held[at] == "[")):
            begun = begun or held[at] == "["
            at += 1
        if at < len(held) and held[at] == "]":
            return held[at + 1:]
        try:
            _, end = decoder.raw_decode(held, at)
        except json.JSONDecodeError:
            end = None
        # A number or literal at the end of what is held may go on.
        if end is None or end == len(held):
            more = next(text, None)
            if more is None:
                raise ValueError("the array ends inside an element")
            held, at = held[at:] + more, 0
            continue
        yield held[at:end]
        at = end


def _decoded(stream: IO[bytes], size: int = 1 << 20) -> Iterator[str]:
    """Text in parts; a bad byte becomes a replacement character."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    while part := stream.read(size):
        yield decoder.decode(part)
    yield decoder.decode(b"", True)


def _pieces(archive: str, member: str, stream: IO[bytes]) -> Iterator[tuple]:
    """What a member holds, as (archive, member, kind, text): kind `object` or, for what is none, `fault`.

    The first character that is no blank decides, not the name or the size: a bracket starts an array, anything
    else lines or objects over several lines, in any mixture.
    """
    head = b""
    while len(head) < 4 or not head.strip(b"\xef\xbb\xbf \t\r\n"):
        block = stream.read(1 << 16)
        if not block:
            break
        head = head.lstrip() + block if head else block
    rest = io.BufferedReader(_Joined(head, stream))
    if head.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"["):
        found = _array_and_rest(_decoded(rest))
    else:
        found = _records(_line_parts(rest))
    for kind, text in found:
        yield archive, member, kind, text


def _array_and_rest(text: Iterator[str]) -> Iterator[tuple[str, str]]:
    """The elements of an array, and the records of what follows it."""

    elements, after = _elements(text), None
    while after is None:
        try:
            element = next(elements)
            yield "object" if element.startswith("{") else "fault", element
        except StopIteration as end:
            after = end.value
    yield from _records(line for part in chain([after], text) for line in _each_line(part))


def _line_parts(stream: IO[bytes], longest: int = 1 << 20) -> Iterator[str]:
    """Lines with their ends; one that is longer than `longest` bytes in several parts, the last with the end."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    while raw := stream.readline(longest):
        if text := decoder.decode(raw, raw.endswith(b"\n")):
            yield text
    if text := decoder.decode(b"", True):
        yield text


def _each_line(text: str) -> Iterator[str]:
    return iter(io.StringIO(text, newline="\n"))


def _is_object(line: str) -> bool:
    if not line.startswith("{") or not line.rstrip().endswith("}"):
        return False
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def _records(parts: Iterator[str], longest: int = 1 << 27) -> Iterator[tuple[str, str]]:
    """Objects and faults of lines, whether an object takes one line or several.

    An object may follow only a bracket, a comma or a colon inside another one.  Where a line starts one elsewhere
    while another is open, or where the text ends, the open one is broken: its first line is a fault, and
    reading goes on with its second line.  So is one that closes without being JSON, and one of more than `longest`
    characters, so that memory is bounded.
    """
    again: deque[str] = deque()
    cutter, size, last, at_start = Cutter(), 0, "", True
    while True:
        part = again.popleft() if again else next(parts, None)
        is_open = cutter.depth > 0 or cutter.in_string
        if part is None and not is_open:
            return
        first = "" if part is None else part.lstrip(" \t\r\ufeff")[:1]
        broken = part is None or size > longest or (at_start and not cutter.in_string and first == "{" and last not in "[,:")
        if is_open and broken:
            line, _, rest = cutter.rest().partition("\n")
            yield "fault", line
            if part is not None:
                again.appendleft(part)
            again.extendleft(reversed(list(_each_line(rest))))
            cutter, size, last, at_start = Cutter(), 0, "", True
            continue
        if not is_open and at_start and _is_object(part.lstrip("\ufeff")):
            yield "object", part.lstrip("\ufeff").rstrip()
            at_start = True
            continue
        for kind, text in cutter.feed(part):
            line, _, rest = text.strip().partition("\n")
            if rest and (kind == "fault" or not _is_object(text)):
                yield "fault", line
                yield from _records(_each_line(rest), longest)
            else:
                yield kind, text.strip()
        size = size + len(part) if is_open else len(part)
        last = part.rstrip()[-1:] or last
        at_start = part.endswith("\n")


class _Joined(io.RawIOBase):
    """Bytes already read, followed by the rest of their stream."""

    def __init__(self, first: bytes, rest: IO[bytes]):
        self._first, self._rest = first, rest

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        if self._first:
            data, self._first = self._first[: len(buffer)], self._first[len(buffer):]
        else:
            data = self._rest.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _frames(rows: Iterator[tuple], columns: list[str], batch_bytes: int = 4_000_000) -> Iterator[pd.DataFrame]:
    batch, held = [], 0
    for row in rows:
        batch.append(row)
        held += len(row[-1]) if isinstance(row[-1], str) else 64
        if held > batch_bytes:
            yield pd.DataFrame(batch, columns=columns)
            batch, held = [], 0
    if batch:
        yield pd.DataFrame(batch, columns=columns)


def _paths(spark: SparkSession, path: str, glob: str) -> DataFrame:
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return listing.option("pathGlobFilter", glob).load(path).select("path", "length")


def _parse(pieces: DataFrame, schema: T.StructType) -> DataFrame:
    """Every piece of kind `object` holds one object."""
    objects = pieces.where("kind = 'object'").select("archive", "member", F.col("piece").alias("object"))
    return parse_review_lines(objects, "object", schema)


def faulty_archive_records(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, text): what the readers leave out of the archives at `path`, shortened to 1,000 characters.

    These are lines that are no object, and objects that are broken or cut off.  Members that cannot be read
    at all are listed by `corrupt_members`.
    """
    pieces = _zip_pieces(spark, path, None, True).unionByName(_tar_pieces(spark, path, None))
    wrong = pieces.where((F.col("kind") == "fault") | is_bad_object(F.col("piece")))
    return wrong.select("archive", "member", F.substring("piece", 1, 1000).alias("text"))


def read_reviews_zip(spark: SparkSession, path: str, max_reviews: int = 0, schema: T.StructType = RAW_SCHEMA,
                     tasks: int | None = None, lenient: bool = False) -> DataFrame:
    """Reviews of all JSON members of the zip files at `path`, with `archive` and `member` columns.

    A member with a bad checksum or a broken array is an error.  `lenient` leaves such members out from
    the fault on; `corrupt_members` lists them.  Records that are no object are left out too, and
    listed by `faulty_archive_records`.  `max_reviews` stops early (0 = all).
    """
    return _limited(_parse(_zip_pieces(spark, path, tasks, lenient), schema), max_reviews)


def _zip_pieces(spark: SparkSession, path: str, tasks: int | None, lenient: bool) -> DataFrame:
    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["path"]:
                with _open(archive) as handle, zipfile.ZipFile(handle) as zipped:
                    rows = [(archive, m.filename, 0, m.file_size) for m in zipped.infolist()
                            if not m.is_dir() and m.filename.lower().endswith(_SUFFIXES)]
                yield pd.DataFrame(rows, columns=["archive", "member", "start", "size"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for frame in frames:
                for archive, group in frame.groupby("archive", sort=False):
                    with _open(archive) as handle, zipfile.ZipFile(handle) as zipped:
                        for member in group["member"]:
                            try:
                                with zipped.open(member) as stream:
                                    yield from _pieces(archive, member, stream)
                            except (zipfile.BadZipFile, zlib.error, ValueError):
                                if not lenient:
                                    raise
        yield from _frames(rows(), ["archive", "member", "kind", "piece"])

    return _member_pieces(_paths(spark, path, "*.zip"), members, read, tasks)


def corrupt_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, fault) for every member of the zip files at `path` that cannot be read to its end."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["path"]:
                found = []
                with _open(archive) as handle, zipfile.ZipFile(handle) as zipped:
                    for m in zipped.infolist():
                        if not m.is_dir() and m.filename.lower().endswith(_SUFFIXES):
                            try:
                                with zipped.open(m) as stream:
                                    for _ in _pieces(archive, m.filename, stream):
                                        pass
                            except (zipfile.BadZipFile, zlib.error, ValueError) as fault:
                                found.append((archive, m.filename, str(fault)))
                yield pd.DataFrame(found, columns=["archive", "member", "fault"])

    return _one_task_each(_paths(spark, path, "*.zip")).mapInPandas(look, "archive string, member string, fault string")


def read_reviews_tar(spark: SparkSession, path: str, max_reviews: int = 0, schema: T.StructType = RAW_SCHEMA,
                     tasks: int | None = None) -> DataFrame:
    """Reviews of all JSON members of the tar, tgz and tar.bz2 files at `path`; see `faulty_archive_records`."""
    return _limited(_parse(_tar_pieces(spark, path, tasks), schema), max_reviews)


def _tar_pieces(spark: SparkSession, path: str, tasks: int | None) -> DataFrame:
    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["path"]:
                with _open(archive) as handle, tarfile.open(fileobj=handle, mode="r:") as packed:
                    for m in packed:
                        if m.isfile() and m.name.lower().endswith(_SUFFIXES):
                            yield pd.DataFrame([(archive, m.name, m.offset_data, m.size)],
                                               columns=["archive", "member", "start", "size"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for frame in frames:
                for m in frame.itertuples():
                    with _open(m.archive) as handle:
                        handle.seek(m.start)
                        part = io.BufferedReader(_Window(handle, int(m.size)))
                        yield from _pieces(m.archive, m.member, part)
        yield from _frames(rows(), ["archive", "member", "kind", "piece"])

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for frame in frames:
                for archive in frame["path"]:
                    with _open(archive) as handle, tarfile.open(fileobj=handle, mode="r|*") as packed:
                        for m in packed:
                            if m.isfile() and m.name.lower().endswith(_SUFFIXES):
                                yield from _pieces(archive, m.name, packed.extractfile(m))
        yield from _frames(rows(), ["archive", "member", "kind", "piece"])

    plain = _member_pieces(_paths(spark, path, "*.tar"), members, read, tasks)
    packed = _paths(spark, path, "*.{tgz,tar.gz,tar.bz2}")
    return plain.unionByName(_one_task_each(packed).mapInPandas(stream, _PIECES))


class _Window(io.RawIOBase):
    """The next `size` bytes of a file, as a file."""

    def __init__(self, handle: IO[bytes], size: int):
        self._handle, self._left = handle, size

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self._handle.read(min(len(buffer), self._left))
        buffer[: len(data)] = data
        self._left -= len(data)
        return len(data)


def _one_task_each(paths: DataFrame) -> DataFrame:
    slots = max(2, paths.sparkSession.sparkContext.defaultParallelism * 4)
    return paths.repartition(slots, "path")


def _member_pieces(paths: DataFrame, members, read, tasks: int | None) -> DataFrame:
    listed = _one_task_each(paths).mapInPandas(members, _MEMBERS)
    spread = tasks or max(2, paths.sparkSession.sparkContext.defaultParallelism * 4)
    return listed.repartition(spread, "archive", "member").mapInPandas(read, _PIECES)


def _limited(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n) if n > 0 else df
