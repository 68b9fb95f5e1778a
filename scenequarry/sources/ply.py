"""PLY clouds as a splittable source: rows have a fixed stride, so any range of them can be read on its own.

``spark.dataSource.register(PlyDataSource)``, then ``spark.read.format("ply").option("path", glob).load()``.
"""

from __future__ import annotations

import os
import re
import uuid
from fnmatch import fnmatch
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: PLY's names of types, little-endian.
TYPES = {"float": "<f4", "float32": "<f4", "double": "<f8", "uchar": "u1", "uint8": "u1", "char": "i1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4"}
ROWS_PER_TASK = 1_000_000
HEADER_LIMIT = 1 << 16


@dataclass(frozen=True)
class Header:
    count: int
    fields: tuple[tuple[str, str], ...]
    offset: int


def parse_header(head: bytes) -> Header:
    """Vertex count, properties and where rows begin. Needs x, y and z and the little-endian binary format."""
    found = re.search(rb"end_header\r?\n", head)
    if not head.startswith(b"ply") or not found:
        raise ValueError("not a PLY file")
    lines = head[: found.start()].decode("ascii").splitlines()
    if "format binary_little_endian 1.0" not in [x.strip() for x in lines]:
        raise ValueError("only binary little-endian PLY is read")
    count, fields, inside = 0, [], False
    for line in lines:
        part = line.split()
        if part[:1] == ["element"]:
            inside = part[1] == "vertex"
            count = int(part[2]) if inside else count
        elif part[:1] == ["property"] and inside:
            if part[1] not in TYPES:
                raise ValueError(f"property type {part[1]}")
            fields.append((part[2], TYPES[part[1]]))
    if not {"x", "y", "z"} <= {n for n, _ in fields}:
        raise ValueError("x, y and z are needed")
    return Header(count, tuple(fields), found.end())


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (local paths, hdfs, s3, …): files are opened on the shared storage itself, at any offset."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _listed(pattern: str) -> tuple[pafs.FileSystem, list[str]]:
    """Files that a glob names."""
    system, path = _located(pattern)
    fixed = re.split(r"[*?\[]", path, maxsplit=1)[0]
    if fixed == path:
        return system, [path]
    found = system.get_file_info(pafs.FileSelector(fixed.rsplit("/", 1)[0] or "/", allow_not_found=True, recursive=True))
    names = [f.path for f in found if f.type == pafs.FileType.File]
    # As a shell's glob: a star does not cross folders.
    return system, sorted(n for n in names if n.count("/") == path.count("/") and all(map(fnmatch, n.split("/"), path.split("/"))))


class Rows(InputPartition):
    def __init__(self, path: str, start: int, count: int):
        self.path, self.start, self.count = path, start, count


class PlyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.pattern = options["path"]
        self.rows = int(options.get("rowsPerTask", ROWS_PER_TASK))

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        system, paths = _listed(self.pattern)
        for path in paths:
            with system.open_input_file(path) as f:
                count = parse_header(f.read(HEADER_LIMIT)).count
            out += [Rows(path, i, min(self.rows, count - i)) for i in range(0, count, self.rows)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, _ = _located(self.pattern)
        with system.open_input_file(partition.path) as f:
            head = parse_header(f.read(HEADER_LIMIT))
            kind = np.dtype([(n, t) for n, t in head.fields])
            step, here = 65_536, partition.start
            scene = os.path.basename(os.path.dirname(partition.path)).removeprefix("scene_id=")
            while here < partition.start + partition.count:
                n = min(step, partition.start + partition.count - here)
                f.seek(head.offset + here * kind.itemsize)
                rows = np.frombuffer(f.read(n * kind.itemsize), kind)
                column = {"scene_id": lambda: pa.array([scene] * n, pa.string()), "point_idx": lambda here=here: pa.array(np.arange(here, here + n, dtype=np.int64))}
                made = [column[c]() if c in column else pa.array(np.ascontiguousarray(rows[c]).astype(np.float64)) if c in kind.names else pa.nulls(n, pa.float64()) for c in self.names]
                yield pa.RecordBatch.from_arrays(made, self.names)
                here += n


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class PlyWriter(DataSourceArrowWriter):
    """A file for each scene and task, or several of up to ``rowsPerFile`` rows: ``path/scene_id=…/part-….ply``, all numbers as doubles.

    Files are written beside their place and named when the job has succeeded; a task that is run again writes files of its own.
    """

    def __init__(self, schema: StructType, options: dict):
        self.names = [n for n in schema.fieldNames() if n != "scene_id"]
        self.path, self.rows = options["path"].rstrip("/"), int(options.get("rowsPerFile", ROWS_PER_TASK))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _located(self.path)
        held: dict[str, list[np.ndarray]] = {}
        done: list[tuple[str, str]] = []

        def flush(scene: str) -> None:
            rows = np.concatenate(held.pop(scene))
            head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(rows)}\n" + "".join(f"property double {n}\n" for n in self.names) + "end_header\n"
            name = f"part-{uuid.uuid4().hex}.ply"
            system.create_dir(f"{root}/scene_id={scene}", recursive=True)
            system.create_dir(f"{root}/_unfinished", recursive=True)
            with system.open_output_stream(f"{root}/_unfinished/{name}") as f:
                f.write(head.encode("ascii"))
                f.write(rows.astype("<f8").tobytes())
            done.append((f"{root}/_unfinished/{name}", f"{root}/scene_id={scene}/{name}"))

        for batch in iterator:
            scenes = batch.column("scene_id").to_numpy(zero_copy_only=False).astype(str)
            table = np.stack([batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in self.names], axis=1)
            for scene in np.unique(scenes):
                held.setdefault(scene, []).append(table[scenes == scene])
                if sum(map(len, held[scene])) >= self.rows:
                    flush(scene)
            while sum(len(x) for rows in held.values() for x in rows) >= 2 * self.rows:
                flush(max(held, key=lambda k: sum(map(len, held[k]))))
        for scene in list(held):
            flush(scene)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _located(self.path)
        for message in messages:
            for start, end in message.files if message else ():
                system.move(start, end)
        self._clean(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*_located(self.path))

    @staticmethod
    def _clean(system: pafs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_unfinished").type == pafs.FileType.Directory:
            system.delete_dir(f"{root}/_unfinished")


class PlyDataSource(DataSource):
    """Points of all files that a glob names; scene_id is the folder (``scene_id=…`` or the id alone), point_idx the ordinal in the file. Missing columns are null."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return "scene_id string, point_idx long, x double, y double, z double, opacity double, confidence double, red double, green double, blue double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlyReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PlyWriter(schema, self.options)


def write_ply(points: DataFrame, path: str, rows_per_file: int = ROWS_PER_TASK) -> None:
    """Add ``points(scene_id, x, y, z, …)``, numbers beside the scene, to the clouds under ``path``; tasks write their own files."""
    points.sparkSession.dataSource.register(PlyDataSource)
    points.write.format("ply").mode("append").option("path", path).option("rowsPerFile", rows_per_file).save()


def read_ply(spark: SparkSession, path_glob: str, columns: str | None = None) -> DataFrame:
    """Clouds as a DataFrame; ``columns`` is a schema of what to decode (17-column splats have more than the default)."""
    spark.dataSource.register(PlyDataSource)
    reader = spark.read.format("ply").option("path", path_glob)
    return (reader.schema(columns) if columns else reader).load()
