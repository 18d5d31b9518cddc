"""A data source for array files: ``spark.read.format("npy")`` and ``spark.readStream.format("npy")`` after ``register``.

Partitions are planned from the listing alone: large grids are cut into bands of rows, each read at its own place in the
file, and small files are put together, so that neither a huge grid nor a million tiny ones make bad tasks. As a
stream, files come in the order of their modification time and name. The path is a folder or a file of any file
system that Arrow opens (local and mounted folders, ``hdfs:``, ``s3:``); for others there is ``files.read_arrays``.

Rows are ``file, y, x, value``; NaN is null; grids have two dimensions; files that hold Python objects are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, y int, x int, value double"
#: Bytes of a band of a large grid, and of small files taken together.
BAND_BYTES, BATCH_BYTES = 32 << 20, 32 << 20
#: Cells of a batch of rows.
CELLS = 1 << 16


@dataclass
class Bands(InputPartition):
    """Parts of files: path, number of the band and of the file's bands."""

    parts: list[tuple[str, int, int]]


def _files(path: str) -> list[tuple[int, str, int]]:
    """Modification time, path and size of the array files of a folder, or of one file, in order."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    info = system.get_file_info(root)
    found = system.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info] if info.type == fs.FileType.File else []
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".npy"))


def _header(f) -> tuple[tuple[int, int], bool, np.dtype, int]:
    """Shape, whether columns come first, type and place of the data."""
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if dtype.hasobject or len(shape) != 2:
        raise ValueError(f"a grid of numbers is wanted, not {dtype} of shape {shape}")
    return shape, fortran, dtype, f.tell()


#: Partitions that a reading has at most, but for as many as its bytes fill.
PARTS = 128


def _plan(files: list[tuple[int, str, int]], band: int, batch: int) -> list[Bands]:
    """Bands by the sizes of the listing: no file is opened here. If there were more than ``PARTS`` of them, neighbours are
    read one after the other, as many as a batch holds.
    """
    bands, small, so_far = [], [], 0
    for _, path, size in files:
        n = -(-size // band)
        if n > 1:
            bands += [(path, k, n) for k in range(n)]
            continue
        small.append((path, 0, 1))
        so_far += size
        if so_far >= batch:
            bands.append(small)
            small, so_far = [], 0
    if small:
        bands.append(small)
    each = max(1, min(-(-len(bands) // PARTS), batch // max(1, band)))
    return [Bands([p for x in bands[i : i + each] for p in (x if isinstance(x, list) else [x])]) for i in range(0, len(bands), each)]


def _read(uri: str, partition: Bands) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system = fs.FileSystem.from_uri(uri)[0]
    runs: list[list] = []
    for path, k, n in partition.parts:  # bands of a file in a row are read at once
        if runs and runs[-1][0] == path and runs[-1][2] == k:
            runs[-1][2] = k + 1
        else:
            runs.append([path, k, k + 1, n])
    for path, k, stop, bands in runs:
        with system.open_input_file(path) as f:
            (rows, columns), fortran, dtype, at = _header(f)
            if fortran:  # rows lie all over the file: the first band reads them all
                first, n = 0, rows if k == 0 else 0
            else:
                first = rows * k // bands
                n = rows * stop // bands - first
            if not n:
                continue
            if fortran:
                grid = np.frombuffer(f.read(), dtype).reshape((rows, columns), order="F")[first : first + n]
            else:
                f.seek(at + first * columns * dtype.itemsize)
                grid = np.frombuffer(f.read(n * columns * dtype.itemsize), dtype).reshape(n, columns)
        step = max(1, CELLS // max(1, columns))
        for k in range(0, n, step):
            part = grid[k : k + step].astype(float)
            y, x = np.indices(part.shape, dtype=np.int32)
            name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(part.size, np.int32)), pa.array([path])).dictionary_decode()
            yield pa.RecordBatch.from_arrays([name, pa.array((y + np.int32(first + k)).ravel()), pa.array(x.ravel()), pa.array(part.ravel(), from_pandas=True)], names=["file", "y", "x", "value"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.band, self.batch = options["path"], int(options.get("band_bytes", BAND_BYTES)), int(options.get("batch_bytes", BATCH_BYTES))

    def partitions(self) -> list[Bands]:
        return _plan(_files(self.path), self.band, self.batch) or [Bands([])]

    def read(self, partition: Bands) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.band, self.batch = options["path"], int(options.get("band_bytes", BAND_BYTES)), int(options.get("batch_bytes", BATCH_BYTES))

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        files = _files(self.path)
        return {"time": files[-1][0], "file": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Bands]:
        lo, hi = (start["time"], start["file"]), (end["time"], end["file"])
        return _plan([f for f in _files(self.path) if lo < f[:2] <= hi], self.band, self.batch)

    def read(self, partition: Bands) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayFiles)
