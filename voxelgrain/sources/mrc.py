"""MRC volumes as a Spark data source: ``spark.read.format("mrc").load(path)``.

Rows are (path, z, y, x, value); one partition reads a run of slices of a file.
The header's cell sizes are in angstrom and become nanometres; y is flipped so
that rows follow the display.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MODES = {0: "i1", 1: "<i2", 2: "<f4", 6: "<u2"}
HEADER = 1024


def header(raw: bytes) -> dict:
    """Shape (z, y, x), type, voxel size in nm and start of the data."""
    nx, ny, nz, mode = struct.unpack("<4i", raw[:16])
    mx, my, mz = struct.unpack("<3i", raw[28:40])
    cell = struct.unpack("<3f", raw[40:52])
    size = [c / m / 10 if m else 0.0 for c, m in zip(cell, (mx, my, mz), strict=True)]
    if mode not in MODES:
        raise ValueError(f"MRC mode {mode} is not supported")
    return {"shape": (nz, ny, nx), "dtype": MODES[mode], "voxel_size": {"z": size[2] if nz > 1 else 0.0, "y": size[1], "x": size[0]}, "start": HEADER + struct.unpack("<i", raw[92:96])[0]}


def encode(volume: np.ndarray, voxel_size: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> bytes:
    """An MRC file of a z, y, x array and a voxel size in nm."""
    kinds = {np.dtype(v): k for k, v in MODES.items()}
    v = np.atleast_3d(volume) if volume.ndim == 3 else volume[None]
    nz, ny, nx = v.shape
    head = bytearray(HEADER)
    struct.pack_into("<4i", head, 0, nx, ny, nz, kinds[np.dtype(v.dtype.newbyteorder("<")) if v.dtype.itemsize > 1 else v.dtype])
    struct.pack_into("<3i", head, 28, nx, ny, nz)
    struct.pack_into("<3f", head, 40, *[n * s * 10 for n, s in zip((nx, ny, nz), voxel_size[::-1], strict=True)])
    head[208:212] = b"MAP "
    return bytes(head) + np.ascontiguousarray(v[:, ::-1]).tobytes()


class Slab(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class Reader(DataSourceReader):
    def __init__(self, path: str, slices: int):
        self.paths = [path] if os.path.isfile(path) else sorted(p for e in ("mrc", "rec") for p in glob.glob(f"{path}/**/*.{e}", recursive=True))
        self.slices = slices

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in self.paths:
            with open(p, "rb") as f:
                depth = header(f.read(HEADER))["shape"][0]
            out += [Slab(p, z, min(depth, z + self.slices)) for z in range(0, depth, self.slices)]
        return out

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            h = header(f.read(HEADER))
            _, ny, nx = h["shape"]
            kind = np.dtype(h["dtype"])
            for z in range(partition.first, partition.last):
                f.seek(h["start"] + z * ny * nx * kind.itemsize)
                a = np.frombuffer(f.read(ny * nx * kind.itemsize), kind).reshape(ny, nx)[::-1]
                y, x = np.indices((ny, nx), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * (ny * nx)), pa.array(np.full(ny * nx, z, np.int32)), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(a.ravel().astype(np.float64))], names=["path", "z", "y", "x", "value"])


class MrcSource(DataSource):
    """Options: path (a file or a folder searched for .mrc and .rec), slices."""

    @classmethod
    def name(cls) -> str:
        return "mrc"

    def schema(self) -> str:
        return "path string, z int, y int, x int, value double"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("slices", "8")))


def read(spark: SparkSession, path: str, slices: int = 8) -> DataFrame:
    spark.dataSource.register(MrcSource)
    return spark.read.format("mrc").option("slices", slices).load(path)


def headers(spark: SparkSession, folder: str, pattern: str = "*.mrc") -> DataFrame:
    """(path, shape, voxel_size in nm) of all files, null where unreadable."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shapes, sizes = [], []
            for raw in b.column(1):
                try:
                    h = header(raw.as_py()[:HEADER])
                    shapes.append(list(h["shape"]))
                    sizes.append([h["voxel_size"][c] for c in "zyx"])
                except (ValueError, struct.error):
                    shapes.append(None)
                    sizes.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shapes, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.float64()))], names=["path", "shape", "voxel_size"])

    return files.mapInArrow(work, "path string, shape array<int>, voxel_size array<double>")
