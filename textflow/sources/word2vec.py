"""The binary word-vector format as a Spark data source that splits.

A file is a head line ``count width``, then records: a word, a space, ``width``
little-endian 32-bit floats, and by some writers a newline. Records have no marks,
so a task that starts at a byte offset looks for the first place from which
``CHAIN`` records in a row can be read, and takes the end of the first of them as its start: a word may
have been cut there, but its vector's end is certain. Where a task ends is found in the same way as
where the next one starts, and a task must arrive there exactly, record by record. The first task
starts behind the head line, so by that every start is right, or the read fails; it never gives other words.

``spark.read.format("word2vec").load(path)`` gives ``(word string, vector array<float>)`` of a file
or of all files of a folder, and a frame of that kind can be written. Paths are local or what
``pyarrow.fs`` knows by its scheme; they must be in a place that all tasks reach.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Bytes that a task reads; words longer than this many bytes aren't looked for.
PARTITION_BYTES, MAX_WORD = 64 << 20, 512
# Records in a row by which a start is told from other bytes; values beyond these aren't taken for components there.
CHAIN, LARGEST, SMALLEST = 8, 1e6, 1e-30
# Records of a batch, and bytes of a written file.
BATCH, FILE_BYTES = 4096, 64 << 20
SCHEMA = "word string, vector array<float>"


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return arrow_fs.LocalFileSystem(), path


def _files(path: str) -> tuple[arrow_fs.FileSystem, list]:
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(arrow_fs.FileSelector(at))
    return system, sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


def _head(handle) -> tuple[int, int, int]:
    """Count, width, and where the records begin."""
    line = handle.read_at(64, 0).split(b"\n", 1)[0]
    parts = line.split()
    if len(parts) != 2:
        raise ValueError("not a word2vec file: the first line must be its count and width")
    return int(parts[0]), int(parts[1]), len(line) + 1


def _record(data: bytes, at: int, width: int, last: bool, strict: bool) -> int:
    """Where the record that begins at ``at`` ends: -1 if there is none, -2 if ``data`` ends in it."""
    space = data.find(b" ", at, at + MAX_WORD if strict else len(data))
    end = space + 1 + 4 * width
    if space < 0 or end > len(data):
        return -1 if (strict and len(data) - at > MAX_WORD + 4 * width) or (last and space < 0) else -2
    if strict:
        word = data[at:space]
        try:
            text = word.decode()
        except UnicodeDecodeError as e:
            if e.start > 3 or not word[4:]:
                return -1
            # the word may have been cut within a character
            text = word[4:].decode("utf-8", "replace")
        values = np.abs(np.frombuffer(data, "<f4", width, space + 1))
        good = (values < LARGEST) & ((values > SMALLEST) | (values == 0))
        if not word or any(c < " " for c in text) or not good.all():
            return -1
    return end + (data[end:end + 1] == b"\n")


def boundary(handle, offset: int, begin: int, size: int, width: int) -> int:
    """The end of the first record that begins, or whose word goes on, at ``offset`` or behind it."""
    if offset <= begin:
        return begin
    if offset >= size:
        return size
    window = (CHAIN + 2) * (MAX_WORD + 4 * width + 1)
    data = handle.read_at(window, offset)
    last = offset + len(data) >= size
    for at in range(min(len(data), MAX_WORD + 4 * width + 1)):
        ends, here = [], at
        for _ in range(CHAIN):
            here = _record(data, here, width, last, True)
            if here < 0:
                break
            ends.append(here)
            if last and here == len(data):
                break
        if ends and (len(ends) == CHAIN or last and ends[-1] == len(data)):
            return offset + ends[0]
    if last:
        return size  # nothing but a rest of the last record
    raise ValueError(f"no record found behind byte {offset}")


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.bytes = options["path"], int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self):
        _, files = _files(self.path)
        return [_Range(f.path, a, min(a + self.bytes, f.size)) for f in files for a in range(0, f.size, self.bytes)] or [_Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as handle:
            size = handle.size()
            count, width, begin = _head(handle)
            at, end = (boundary(handle, o, begin, size, width) for o in (partition.start, partition.end))
            if partition.start == 0:
                at = begin
            data, here, words, vectors = b"", 0, [], []
            while at + here < end:
                stop = _record(data, here, width, False, False)
                if stop < 0:
                    at += here
                    data, here, had = handle.read_at(max(1 << 20, 2 * (len(data) - here), 8 * width), at), 0, len(data) - here
                    if len(data) <= had:
                        raise ValueError(f"{partition.path} ends within a record")
                    continue
                # the newline of a record at the very end of the data is read again with more of it
                if stop == len(data) and at + stop < size and had_more(handle, at + stop):
                    stop += 1
                space = data.index(b" ", here)
                words.append(data[here:space].decode("utf-8", "replace"))
                vectors.append(data[space + 1:space + 1 + 4 * width])
                here = stop
                if len(words) == BATCH:
                    yield _batch(words, vectors, width)
                    words, vectors = [], []
            if at + here != end:
                raise ValueError(f"records of {partition.path} don't meet byte {end}")
            if words:
                yield _batch(words, vectors, width)


def had_more(handle, at: int) -> bool:
    """Whether a newline follows."""
    return handle.read_at(1, at) == b"\n"


def _batch(words: list[str], vectors: list[bytes], width: int) -> pa.RecordBatch:
    flat = np.frombuffer(b"".join(vectors), "<f4").astype(np.float32)
    offsets = np.arange(0, len(words) * width + 1, width or 1, dtype=np.int32)[:len(words) + 1] if width else np.zeros(len(words) + 1, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["word", "vector"])


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceWriter):
    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator):
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        files, held, size, width = [], [], 0, None

        def flush():
            name = f"{folder.rstrip('/')}/.part-{uuid.uuid4().hex}.bin"
            with system.open_output_stream(name) as out:
                out.write(f"{len(held)} {width}\n".encode())
                out.write(b"".join(held))
            files.append(name)

        for row in iterator:
            word, vector = row[0], row[1]
            if not word or " " in word or "\n" in word or vector is None or len(vector) != (len(vector) if width is None else width):
                raise ValueError(f"a word needs letters without spaces, and a vector as wide as the others: {word!r}")
            width = len(vector)
            held.append(word.encode() + b" " + np.array(vector, "<f4").tobytes() + b"\n")
            size += len(held[-1])
            if size > FILE_BYTES:
                flush()
                held, size = [], 0
        if held:
            flush()
        return _Written(files)

    def commit(self, messages):
        """Files count once all tasks are done: until then their names are hidden."""
        system, _ = _open(self.path)
        new = [f for m in messages if m for f in m.files]
        if self.overwrite:
            for f in _files(self.path)[1]:
                system.delete_file(f.path)
        for name in new:
            system.move(name, name.replace("/.part-", "/part-"))

    def abort(self, messages):
        system, _ = _open(self.path)
        for m in messages:
            for name in m.files if m else []:
                system.delete_file(name)


class Word2VecSource(DataSource):
    @classmethod
    def name(cls):
        return "word2vec"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Word2VecSource)
