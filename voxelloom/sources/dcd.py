"""Binary trajectories of fixed-size frames (the DCD layout) as a Spark data source.

All frames of a file are equally long, so a frame's place follows from its number: the driver reads headers
only, cuts the frames that are asked for into ranges, and a task seeks to its own.  Filters on ``frame`` (ranges,
equality, lists) and the option ``step`` leave out frames before anything is read; filters on ``atom_id`` leave out atoms before rows are
made.  Frames are counted through the files of a folder in the order of their names.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)

from voxelloom.sources import paths

SCHEMA = ("frame int, atom_id bigint, x double, y double, z double, lx double, ly double, lz double")
ENDING = ".dcd"
_CONTROL, _CELL = 84, 48
_FIELDS = pa.schema([("frame", pa.int32()), ("atom_id", pa.int64()), *((c, pa.float64()) for c in ("x", "y", "z", "lx", "ly", "lz"))])


@dataclass
class Layout:
    """Where the frames of a file are."""

    path: str
    start: int
    n_atoms: int
    has_cell: bool
    n_frames: int

    @property
    def frame_bytes(self) -> int:
        return (_CELL + 8 if self.has_cell else 0) + 3 * (4 * self.n_atoms + 8)


def layout(fs, path: str) -> Layout:
    """Read a header; a file of another layout or cut inside a frame is an error."""
    def block(source):
        n = struct.unpack("<i", source.read(4))[0]
        body = source.read(n)
        if len(body) != n or struct.unpack("<i", source.read(4))[0] != n:
            raise ValueError(f"{path}: a record's length marks differ")
        return body

    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as source:
        control = block(source)
        if len(control) != _CONTROL or control[:4] != b"CORD":
            raise ValueError(f"{path}: not a coordinate trajectory")
        numbers = struct.unpack("<20i", control[4:])
        if numbers[8]:
            raise ValueError(f"{path}: files with fixed atoms are not read")
        block(source)
        n_atoms = struct.unpack("<i", block(source))[0]
        out = Layout(path, source.tell(), n_atoms, bool(numbers[10]), 0)
    whole, rest = divmod(size - out.start, out.frame_bytes)
    if rest:
        raise ValueError(f"{path}: {rest} bytes beyond the last whole frame")
    out.n_frames = whole
    return out


@dataclass
class Frames(InputPartition):
    """Every *step*-th frame of one file from *first* on, *count* of them, numbered from *base*."""

    file: Layout
    base: int
    first: int
    count: int
    step: int
    atoms: list | None


class DcdSource(DataSource):
    """Options: ``path``, ``step`` (every n-th frame, by number) and ``framespertask``."""

    @classmethod
    def name(cls) -> str:
        return "dcd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DcdReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return DcdWriter(self.options, [f.name for f in schema], overwrite)


class DcdReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.step, self.per_task = max(1, int(options.get("step", 1))), max(1, int(options.get("framespertask", 64)))
        self.low, self.high, self.listed, self.atoms = 0, None, None, None

    def pushFilters(self, filters):
        """Narrow frames and atoms; every filter goes back, as Spark's own look at the rows that are left costs little."""
        for f in filters:
            name, value = tuple(getattr(f, "attribute", ())), getattr(f, "value", None)
            if name == ("frame",) and value is not None:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, int(value) + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    top = int(value) + isinstance(f, LessThanOrEqual)
                    self.high = top if self.high is None else min(self.high, top)
                elif isinstance(f, (EqualTo, In)):
                    self.listed = self._both(self.listed, f)
            elif name == ("atom_id",) and isinstance(f, (EqualTo, In)):
                self.atoms = self._both(self.atoms, f)
            yield f

    @staticmethod
    def _both(known, f):
        new = {int(v) for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None}
        return new if known is None else known & new

    def partitions(self):
        fs, _ = paths.at(self.path)
        atoms, out, base = None if self.atoms is None else sorted(self.atoms), [], 0
        for path in paths.listing(self.path, ENDING):
            file = layout(fs, path)
            lo = max(self.low - base, 0)
            hi = file.n_frames if self.high is None else min(file.n_frames, self.high - base)
            lo += -(base + lo) % self.step                             # by number over all files
            if self.listed is not None:
                runs = [(n - base, 1) for n in sorted(self.listed) if lo <= n - base < hi and n % self.step == 0]
            else:
                n = max(0, -(-(hi - lo) // self.step))
                runs = [(lo + k * self.step, min(self.per_task, n - k)) for k in range(0, n, self.per_task)]
            out += [Frames(file, base, first, count, self.step, atoms) for first, count in runs]
            base += file.n_frames
        return out or [Frames(Layout("", 0, 0, False, 0), 0, 0, 0, 1, None)]

    def read(self, part):
        if not part.count:
            return
        fs, _ = paths.at(self.path)
        file, n = part.file, part.file.n_atoms
        keep = np.arange(n) if part.atoms is None else np.array([a for a in part.atoms if 0 <= a < n], dtype=np.int64)
        with fs.open_input_file(file.path) as source:
            for k in range(part.count):
                number = part.first + k * part.step
                source.seek(file.start + number * file.frame_bytes)
                raw = source.read(file.frame_bytes)
                at, edges = 0, [None] * 3
                if file.has_cell:
                    cell = struct.unpack_from("<6d", raw, 4)
                    edges, at = [cell[0], cell[2], cell[5]], _CELL + 8
                axes = []
                for _ in range(3):
                    if struct.unpack_from("<i", raw, at)[0] != 4 * n:
                        raise ValueError(f"{file.path}: frame {number} has another number of atoms")
                    axes.append(np.frombuffer(raw, "<f4", n, at + 4)[keep].astype(np.float64))
                    at += 4 * n + 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keep), part.base + number, dtype=np.int32)), pa.array(keep), *map(pa.array, axes),
                     *(pa.array([e] * len(keep), pa.float64()) for e in edges)], schema=_FIELDS)


@dataclass
class Written(WriterCommitMessage):
    made: str | None
    final: str | None
    n_atoms: int


class DcdWriter(DataSourceArrowWriter):
    """One file a task.  Rows come sorted by frame and atom, and all frames have the same atoms, numbered from 0."""

    def __init__(self, options, columns, overwrite: bool):
        if columns != [f.name for f in _FIELDS]:
            raise ValueError(f"columns must be {[f.name for f in _FIELDS]}, got {columns}")
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator) -> Written:
        fs, root = paths.at(self.path)
        out, made, final, n_atoms, last, held = None, None, None, None, None, []

        def put(number, rows):
            nonlocal out, made, final, n_atoms, last
            atoms = np.concatenate([r[0] for r in rows])
            if n_atoms is None:
                n_atoms = len(atoms)
                made, final = f"{root}/_temporary/{uuid.uuid4().hex}", f"{root}/part-{number:012d}{ENDING}"
                fs.create_dir(f"{root}/_temporary", recursive=True)
                out = fs.open_output_stream(made)
                out.write(_header(number, n_atoms, rows[0][2] is not None))
            if (atoms != np.arange(n_atoms)).any() or (last is not None and number != last + 1):
                raise ValueError(f"frame {number}: frames must follow each other and hold the atoms 0 to {n_atoms - 1}")
            last = number
            if rows[0][2] is not None:
                a, b, c = rows[0][2]
                out.write(struct.pack("<i6di", _CELL, a, 90.0, b, 90.0, 90.0, c, _CELL))
            for axis in range(3):
                values = np.concatenate([r[1][axis] for r in rows]).astype("<f4")
                out.write(struct.pack("<i", 4 * n_atoms) + values.tobytes() + struct.pack("<i", 4 * n_atoms))

        now = None
        for batch in iterator:
            frame, atom = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            xyz = [batch.column(2 + n).to_numpy() for n in range(3)]
            edge = [batch.column(5 + n) for n in range(3)]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(frame)) + 1, [len(frame)]]) if len(frame) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and frame[lo] != now:
                    put(now, held)
                    held = []
                now = int(frame[lo])
                cell = [e[int(lo)].as_py() for e in edge]
                held.append((atom[lo:hi], [v[lo:hi] for v in xyz], None if None in cell else cell))
        if held:
            put(now, held)
        if out is not None:
            out.close()
        return Written(made, final, n_atoms or 0)

    def commit(self, messages) -> None:
        fs, root = paths.at(self.path)
        done = [m for m in messages if m is not None and m.made]
        if len({m.n_atoms for m in done}) > 1:
            self._clear(fs, root)
            raise ValueError(f"frames differ in their number of atoms: {sorted({m.n_atoms for m in done})}")
        if self.overwrite and fs.get_file_info(root).type.name == "Directory":
            for old in paths.listing(self.path, ENDING):
                fs.delete_file(old)
        for m in done:
            fs.move(m.made, m.final)
        self._clear(fs, root)

    def abort(self, messages) -> None:
        self._clear(*paths.at(self.path))

    @staticmethod
    def _clear(fs, root) -> None:
        if fs.get_file_info(f"{root}/_temporary").type.name == "Directory":
            fs.delete_dir(f"{root}/_temporary")


def _header(first: int, n_atoms: int, has_cell: bool) -> bytes:
    """The three leading records; the number of frames is left 0, as it follows from the size of the file."""
    numbers = [0] * 20
    numbers[1], numbers[2], numbers[10], numbers[19] = first, 1, int(has_cell), 24
    title = b"positions".ljust(80)
    return (struct.pack("<i", _CONTROL) + b"CORD" + struct.pack("<20i", *numbers) + struct.pack("<i", _CONTROL)
            + struct.pack("<ii", 84, 1) + title + struct.pack("<i", 84) + struct.pack("<iii", 4, n_atoms, 4))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DcdSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, step: int = 1) -> DataFrame:
    """``frame, atom_id, x, y, z, lx, ly, lz`` of every *step*-th frame of a file or a folder of files."""
    register(spark)
    return spark.read.format("dcd").option("step", step).load(path)


def write(positions: DataFrame, path: str) -> None:
    """Write ``frame, atom_id, x, y, z`` (and ``lx, ly, lz``) with atoms 0..n-1 in each frame, a file per range of frames."""
    register(positions.sparkSession)
    kinds = {f.name: {"int32": "int", "int64": "bigint"}.get(str(f.type), "double") for f in _FIELDS}
    rows = positions.select(*[(F.col(c) if c in positions.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    (rows.repartitionByRange("frame").sortWithinPartitions("frame", "atom_id").write.format("dcd").mode("overwrite").save(path))
