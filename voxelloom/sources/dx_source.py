"""OpenDX maps as a Spark data source: ``spark.read.format("dx")`` and ``df.write.format("dx")``.

Many maps are written in one job.  Rows ``(map, i, j, k, value)`` come sorted by map and raster order, so a task writes
its maps from the first voxel to the last without holding one: what lies between stored voxels is the background.  A map is one
readable file, written under a task's own name and renamed when the job commits.  Reading makes a partition of each file;
a filter on ``map`` is answered by the names alone.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
                                    StringStartsWith, WriterCommitMessage)

from voxelloom.lattice import IJK
from voxelloom.sources import paths
from voxelloom.sources.dx import PER_LINE, frame_lines

SCHEMA = "map string, i int, j int, k int, value double"
ENDING = ".dx"
_CHUNK = 1 << 20
_FIELDS = pa.schema([("map", pa.string()), *((a, pa.int32()) for a in IJK), ("value", pa.float64())])


class DxSource(DataSource):
    """Options: ``path``; for writing also ``gridsize``, ``window`` (json, ``{"i": [lo, hi], ..}``) and ``background``;
    for reading ``keepzero``."""

    @classmethod
    def name(cls) -> str:
        return "dx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DxReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return DxWriter(self.options, [f.name for f in schema], overwrite)


@dataclass
class OneMap(InputPartition):
    name: str
    path: str


class DxReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.keep = options["path"], str(options.get("keepzero", "false")).lower() == "true"
        self.wanted: list = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and tuple(f.attribute) == ("map",):
                self.wanted.append(f)
            yield f                                       # files are left out here; Spark still looks at each row

    def _reads(self, name: str) -> bool:
        return all(name == f.value if isinstance(f, EqualTo) else name in f.value if isinstance(f, In) else name.startswith(f.value)
                   for f in self.wanted)

    def partitions(self):
        _, root = paths.at(self.path)
        files = paths.listing(self.path, ENDING)
        named = [(f[len(root):].lstrip("/") or f.rsplit("/", 1)[-1], f) for f in files]
        return [OneMap(n[:-len(ENDING)], f) for n, f in named if self._reads(n[:-len(ENDING)])]

    def read(self, partition):
        fs, _ = paths.at(self.path)
        with fs.open_input_stream(partition.path) as source:
            yield from _voxels(partition.name, source, self.keep)


def _voxels(name: str, source, keep_zero: bool):
    """The stored voxels of a map, a batch per stretch of text."""
    text = b""
    while (found := re.search(rb"data follows[^\n]*\n", text)) is None:
        more = source.read(_CHUNK)
        if not more:
            raise ValueError(f"{name}: no header")
        text += more
    head, text = text[:found.end()].decode(), text[found.end():]
    size = [int(v) for v in re.search(r"gridpositions counts\s+(\S+)\s+(\S+)\s+(\S+)", head).groups()]
    origin = [float(v) for v in re.search(r"origin\s+(\S+)\s+(\S+)\s+(\S+)", head).groups()]
    delta = float(re.search(r"delta\s+(\S+)", head).group(1))
    low = [round(o / delta - 0.5) for o in origin]
    total, done = size[0] * size[1] * size[2], 0
    while True:
        more = source.read(_CHUNK)
        end = max(text.rfind(b"\n"), text.rfind(b" ")) + 1 if more else len(text)
        part, text = text[:end], text[end:] + more
        stop = re.search(rb"[a-zA-Z]{4,}", part)             # the closing lines; "nan" and "inf" are values
        values = np.array((part[:stop.start()] if stop else part).split(), dtype=np.float64)
        at = np.arange(done, done + len(values))
        done += len(values)
        if not keep_zero:
            at, values = at[values != 0], values[values != 0]
        i, rest = np.divmod(at, size[1] * size[2])
        j, k = np.divmod(rest, size[2])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), *(pa.array((x + o).astype(np.int32)) for x, o in zip((i, j, k), low)),
                                              pa.array(values)], schema=_FIELDS)
        if stop or not more:
            break
    if done != total:
        raise ValueError(f"{name}: {done} values where the header says {total}")


@dataclass
class Written(WriterCommitMessage):
    files: list


class DxWriter(DataSourceArrowWriter):
    def __init__(self, options, columns, overwrite: bool):
        if columns != [f.name for f in _FIELDS]:
            raise ValueError(f"columns must be {[f.name for f in _FIELDS]}, got {columns}")
        self.path, self.overwrite = options["path"], overwrite
        self.gridsize, self.background = float(options["gridsize"]), float(options.get("background", 0.0))
        window = json.loads(options["window"])
        self.window = {a: tuple(int(v) for v in window[a]) for a in IJK}

    def write(self, iterator) -> Written:
        size = [self.window[a][1] - self.window[a][0] for a in IJK]
        total = size[0] * size[1] * size[2]
        head, foot = frame_lines(self.window, self.gridsize)
        fs, root = paths.at(self.path)
        files, out, done, name = [], None, 0, None

        def emit(values):
            """Values of a stretch as text; the line breaks follow from where it starts."""
            nonlocal done
            words = [repr(v) for v in values.tolist()]
            out.write("".join(f"{w}\n" if (done + n + 1) % PER_LINE == 0 or done + n + 1 == total else f"{w} "
                              for n, w in enumerate(words)).encode())
            done += len(words)

        def fill(upto):
            while done < upto:
                emit(np.full(min(upto - done, _CHUNK), own))

        def finish():
            fill(total)
            out.write(("\n".join(foot) + "\n").encode())
            out.close()

        own = self.background
        for batch in iterator:
            maps = batch.column(0).to_pylist()
            placed = np.asarray(batch.column(1).is_valid())
            at = sum((batch.column(1 + n).to_numpy(zero_copy_only=False).astype(np.float64) - self.window[a][0]) * m
                     for n, (a, m) in enumerate(zip(IJK, (size[1] * size[2], size[2], 1))))
            inside = np.ones(len(maps), dtype=bool)
            for n, a in enumerate(IJK):
                x = batch.column(1 + n).to_numpy(zero_copy_only=False).astype(np.float64)
                inside &= (x >= self.window[a][0]) & (x < self.window[a][1])
            values = batch.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
            nulls = ~np.asarray(batch.column(4).is_valid())
            cuts = [0, *(n for n in range(1, len(maps)) if maps[n] != maps[n - 1]), len(maps)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if maps[lo] != name:
                    if out is not None:
                        finish()
                    name, done = maps[lo], 0
                    made = f"{root}/_temporary/{uuid.uuid4().hex}"
                    fs.create_dir(made.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(made)
                    files.append((made, f"{root}/{name}{ENDING}"))
                    out.write(("\n".join(head) + "\n").encode())
                    # a row without a place comes first and carries the map's own background
                    own = self.background if placed[lo] or nulls[lo] else float(values[lo])
                keep = inside[lo:hi] & ~nulls[lo:hi] & placed[lo:hi]
                place, held = at[lo:hi][keep].astype(np.int64), values[lo:hi][keep]
                if len(place) and (place[0] < done or (np.diff(place) <= 0).any()):
                    raise ValueError(f"{name}: rows must come once each and in raster order, see dx_source.ordered")
                start = 0
                while start < len(place):                    # stretches without a gap, or a gap's worth of background
                    fill(int(place[start]))
                    stop = start + int(np.argmax(np.append(np.diff(place[start:]) != 1, True))) + 1
                    emit(held[start:stop])
                    start = stop
        if out is not None:
            finish()
        return Written(files)

    def commit(self, messages) -> None:
        fs, root = paths.at(self.path)
        if self.overwrite:
            for old in paths.listing(self.path, ENDING) if fs.get_file_info(root).type.name == "Directory" else []:
                fs.delete_file(old)
        for made, final in (pair for m in messages if m is not None for pair in m.files):
            fs.create_dir(final.rsplit("/", 1)[0], recursive=True)
            fs.move(made, final)
        self._clear(fs, root)

    def abort(self, messages) -> None:
        fs, root = paths.at(self.path)
        self._clear(fs, root)

    @staticmethod
    def _clear(fs, root) -> None:
        if fs.get_file_info(f"{root}/_temporary").type.name == "Directory":
            fs.delete_dir(f"{root}/_temporary")


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach its reader."""
    spark.dataSource.register(DxSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def ordered(voxels: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Rows as the writer takes them: a map whole in one task, in raster order.

    *extra* names maps that may have no voxel and still get a file; its column ``background``, if there, is what a map's voxels
    that are not stored read.  The sort spills; a task holds no map.
    """
    rows = voxels.select("map", *[F.col(a).cast("int").alias(a) for a in IJK], F.col("value").cast("double").alias("value"))
    if extra is not None:
        value = F.col("background") if "background" in extra.columns else F.lit(None)
        rows = rows.unionByName(extra.select("map", *[F.lit(None).cast("int").alias(a) for a in IJK], value.cast("double").alias("value")))
    return rows.repartition("map").sortWithinPartitions("map", *IJK)


def write(voxels: DataFrame, path: str, window: dict, gridsize: float, background: float = 0.0,
          maps: DataFrame | None = None) -> None:
    """Write all maps of ``(map, i, j, k, value)`` as ``<path>/<map>.dx`` in one job."""
    register(voxels.sparkSession)
    (ordered(voxels, maps).write.format("dx").mode("overwrite").option("gridsize", gridsize).option("background", background)
     .option("window", json.dumps({a: list(map(int, window[a])) for a in IJK})).save(path))


def read(spark: SparkSession, path: str, keep_zero: bool = False) -> DataFrame:
    """``(map, i, j, k, value)`` of all maps below a folder, or of one file; zeros are not stored unless asked for."""
    register(spark)
    return spark.read.format("dx").option("keepzero", str(keep_zero).lower()).load(path)
