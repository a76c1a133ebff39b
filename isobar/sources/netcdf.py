"""NetCDF files, classic (versions 1, 2 and 5) and NetCDF-4, as a Python data source.

``spark.read.format("netcdf").option("variable", v).load(path)`` gives a row a
cell: the variable's dimensions (by their coordinate variables where there are
any) and ``value``, null where it is the fill value, NaN or was never written.

Filters on dimensions are pushed down: they become ranges of each axis, and only what
lies in them is read, contiguous runs of a classic file and whole chunks of a
NetCDF-4 file.  Partitions are runs of the first dimension, or of chunks, of about
``CELLS`` cells; the driver reads the header, the axes and the index of chunks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, StructField, StructType

from .hdf5 import SIGNATURE, Chunk, Hdf5

#: External types of the format, and their default fill values.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
FILL = {3: -32767, 4: -2147483647, 5: 9.969209968386869e36, 6: 9.969209968386869e36}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
#: Cells of a partition, about.
CELLS = 4_000_000


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    kind: int
    size: int
    begin: int


class Header:
    """Dimensions, attributes and variables of a file."""

    def __init__(self, f):
        self.f = f
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.wide, self.offsets = magic[3] == 5, ">i4" if magic[3] == 1 else ">i8"
        self.records = self._n()
        self.dims = [(self._name(), self._n()) for _ in self._list(DIMENSION)]
        self.attributes = self._attributes()
        self.variables = {v.name: v for v in (self._variable() for _ in self._list(VARIABLE))}
        record = [v for v in self.variables.values() if v.dims and not self.dims[v.dims[0]][1]]
        self.record_size = sum(v.size for v in record) if len(record) != 1 else self._row(record[0])

    def _n(self) -> int:
        return struct.unpack(">q" if self.wide else ">i", self.f.read(8 if self.wide else 4))[0]

    def _name(self) -> str:
        n = self._n()
        return self.f.read(n + -n % 4)[:n].decode()

    def _list(self, tag: int) -> range:
        found, n = struct.unpack(">i", self.f.read(4))[0], self._n()
        if n and found != tag:
            raise ValueError("the header is broken")
        return range(n)

    def _attributes(self) -> dict:
        out = {}
        for _ in self._list(ATTRIBUTE):
            name, kind, n = self._name(), struct.unpack(">i", self.f.read(4))[0], self._n()
            size = n * np.dtype(TYPES[kind]).itemsize
            raw = self.f.read(size + -size % 4)[:size]
            out[name] = raw.decode() if kind == 2 else np.frombuffer(raw, TYPES[kind])
        return out

    def _variable(self) -> Variable:
        name, dims = self._name(), [self._n() for _ in range(self._n())]
        attributes, kind, size = self._attributes(), struct.unpack(">i", self.f.read(4))[0], self._n()
        return Variable(name, dims, attributes, kind, size, int(np.frombuffer(self.f.read(np.dtype(self.offsets).itemsize), self.offsets)[0]))

    def length(self, dim: int) -> int:
        return self.dims[dim][1] or self.records

    def _row(self, v: Variable) -> int:
        """Bytes of one step of a variable's first dimension."""
        return int(np.prod([self.length(d) for d in v.dims[1:]], dtype=np.int64)) * np.dtype(TYPES[v.kind]).itemsize

    def dimensions(self, name: str) -> list[tuple[str, int]]:
        return [(self.dims[d][0], self.length(d)) for d in self.variables[name].dims]

    def describe(self, name: str) -> dict:
        return self.variables[name].attributes

    def boxes(self, name: str, ranges: list[tuple[int, int]]) -> list[Box]:
        """Runs of the first dimension within the ranges."""
        (lo, hi), *rest = ranges
        step = max(1, CELLS // max(1, int(np.prod([b - a for a, b in rest], dtype=np.int64))))
        return [Box((k, *(a for a, _ in rest)), (min(k + step, hi), *(b for _, b in rest))) for k in range(lo, hi, step)]

    def read(self, name: str, box: Box) -> np.ndarray:
        """The box's values; bytes are read in runs as long as the file has them."""
        v = self.variables[name]
        shape, item = [self.length(d) for d in v.dims], np.dtype(TYPES[v.kind]).itemsize
        sizes = [b - a for a, b in zip(box.start, box.stop, strict=True)]
        record = not self.dims[v.dims[0]][1]
        # Dimensions behind ``whole`` are read all, so that a run has them and a stretch of it.
        whole = len(shape) - 1
        while whole > record and sizes[whole] == shape[whole]:
            whole -= 1
        strides = [item * int(np.prod(shape[k + 1 :], dtype=np.int64)) for k in range(len(shape))]
        if record:
            strides[0] = self.record_size
        run = sizes[whole] * (strides[whole] if whole or not record else self._row(v))
        if record and not whole:  # a step at a time
            whole, run = 1, self._row(v)
        places = np.array([v.begin])
        for k in range(whole):
            places = (places[:, None] + np.arange(box.start[k], box.stop[k]) * strides[k]).ravel()
        if whole < len(shape):
            places = places + box.start[whole] * strides[whole]
        parts = []
        for at in places.tolist():
            self.f.seek(at)
            parts.append(self.f.read(run))
        return np.frombuffer(b"".join(parts), TYPES[v.kind]).reshape(sizes)

    def fill(self, name: str) -> float | None:
        return FILL.get(self.variables[name].kind)


@dataclass
class Box:
    """A part of a variable, by the first and the last index (exclusive) of each
    dimension; of a NetCDF-4 file, the chunk that holds it."""

    start: tuple[int, ...]
    stop: tuple[int, ...]
    chunk: Chunk | None = None

    @property
    def cells(self) -> int:
        return int(np.prod(np.subtract(self.stop, self.start), dtype=np.int64))


class NetCdf4:
    """The same of an HDF5 file: boxes are its chunks."""

    def __init__(self, f):
        self.file = Hdf5(f)
        self.variables = self.file.links

    def dimensions(self, name: str) -> list[tuple[str, int]]:
        return list(zip(self.file.dimensions(name), self.file.dataset(name).shape, strict=True))

    def describe(self, name: str) -> dict:
        return self.file.dataset(name).attributes

    def boxes(self, name: str, ranges: list[tuple[int, int]]) -> list[Box]:
        d = self.file.dataset(name)
        out = []
        for chunk in self.file.chunks(d):
            stop = tuple(min(a + c, n) for a, c, n in zip(chunk.at, d.chunk_shape, d.shape, strict=True))
            if all(a < hi and b > lo for a, b, (lo, hi) in zip(chunk.at, stop, ranges, strict=True)):
                out.append(Box(chunk.at, stop, chunk))
        return out

    def read(self, name: str, box: Box) -> np.ndarray:
        d = self.file.dataset(name)
        if box.chunk is not None:
            found = self.file.read(d, box.chunk)
            return np.full(np.subtract(box.stop, box.start), np.nan) if found is None else found
        out = np.full(np.subtract(box.stop, box.start), np.nan)
        for part in self.boxes(name, list(zip(box.start, box.stop, strict=True))):
            lo, hi = np.maximum(part.start, box.start), np.minimum(part.stop, box.stop)
            inner, outer = (tuple(map(slice, lo - np.array(b.start), hi - np.array(b.start))) for b in (part, box))
            out[outer] = self.read(name, part)[inner]
        return out

    def fill(self, name: str) -> None:
        return None


def opened(f) -> Header | NetCdf4:
    """By the file's first bytes."""
    first = f.read(4)
    f.seek(0)
    return NetCdf4(f) if first == SIGNATURE[:4] else Header(f)


def cleaned(x: np.ndarray, attributes: dict, fill: float | None) -> np.ndarray:
    """Numbers with NaN where they are missing, unpacked."""
    one = lambda a: float(np.ravel(a)[0])
    x = x.astype(float)
    for missing in (attributes.get("_FillValue"), attributes.get("missing_value"), fill):
        if missing is not None and np.size(missing):
            x = np.where(x == one(missing), np.nan, x)
    scale, add = one(attributes.get("scale_factor", 1)), one(attributes.get("add_offset", 0))
    return x * scale + add if (scale, add) != (1.0, 0.0) else x


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


@dataclass
class Boxes(InputPartition):
    boxes: list[Box]


#: Comparisons that are pushed down.
HOLDS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


class Reader(DataSourceReader):
    def __init__(self, path: str, variable: str):
        self.path, self.variable = path, variable
        self.conditions: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Comparisons of a dimension with a number, or with a list of them; the others
        are left to Spark."""
        number = lambda x: isinstance(x, int | float) and x == x
        with _open(self.path) as f:
            dims = {d for d, _ in self._file(f).dimensions(self.variable)}
        for found in filters:
            name = found.attribute[0] if len(getattr(found, "attribute", ())) == 1 else None
            if name in dims and type(found) in HOLDS and number(found.value):
                self.conditions.append((name, type(found), float(found.value)))
            elif name in dims and isinstance(found, In) and all(map(number, found.value)):
                self.conditions.append((name, In, [float(x) for x in found.value]))
            elif not (name in dims and isinstance(found, IsNotNull)):
                yield found

    def _file(self, f) -> Header | NetCdf4:
        file = opened(f)
        if self.variable not in file.variables:
            raise ValueError(f"no variable {self.variable}")
        return file

    def _axis(self, file: Header | NetCdf4, name: str, start: int, stop: int) -> np.ndarray:
        """Coordinates of a stretch of a dimension; its indices where it has no variable."""
        if name in file.variables and [d for d, _ in file.dimensions(name)] == [name]:
            return cleaned(file.read(name, Box((start,), (stop,))), file.describe(name), file.fill(name))
        return np.arange(start, stop, dtype=float)

    def _kept(self, name: str, axis: np.ndarray) -> np.ndarray:
        keep = np.ones(len(axis), bool)
        for of, kind, value in self.conditions:
            if of == name:
                keep &= np.isin(axis, value) if kind is In else HOLDS[kind](axis, value)
        return keep

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as f:
            file, ranges = self._file(f), []
            asked = {name for name, *_ in self.conditions}
            for name, n in file.dimensions(self.variable):
                at = np.flatnonzero(self._kept(name, self._axis(file, name, 0, n))) if name in asked else None
                ranges.append((0, n) if at is None else (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0))
            boxes = file.boxes(self.variable, ranges) if all(a < b for a, b in ranges) else []
        out, size = [Boxes([])], 0
        for box in boxes:
            if size and size + box.cells > CELLS:
                out, size = [*out, Boxes([])], 0
            out[-1].boxes.append(box)
            size += box.cells
        return out

    def read(self, partition: Boxes) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as f:
            file = self._file(f)
            names = [d for d, _ in file.dimensions(self.variable)]
            for box in partition.boxes:
                axes = [self._axis(file, name, a, b) for name, a, b in zip(names, box.start, box.stop, strict=True)]
                keep = [self._kept(name, axis) for name, axis in zip(names, axes, strict=True)]
                if not all(k.any() for k in keep):
                    continue
                x = cleaned(file.read(self.variable, box)[np.ix_(*keep)], file.describe(self.variable), file.fill(self.variable)).ravel()
                grid = np.meshgrid(*(axis[k] for axis, k in zip(axes, keep, strict=True)), indexing="ij")
                yield pa.RecordBatch.from_arrays([*(pa.array(g.ravel()) for g in grid), pa.array(x, mask=np.isnan(x))], names=[*names, "value"])


class NetCdf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as f:
            dims = opened(f).dimensions(self.options["variable"])
        return StructType([StructField(name, DoubleType()) for name, _ in dims] + [StructField("value", DoubleType())])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options["variable"])


def describe(path: str, variable: str) -> dict:
    """A variable's attributes."""
    with _open(path) as f:
        return opened(f).describe(variable)


def read_netcdf(spark: SparkSession, path: str, variable: str) -> DataFrame:
    if not path.endswith((".nc", ".nc4", ".netcdf")):
        raise NotImplementedError(f"not a NetCDF name: {path}")
    spark.dataSource.register(NetCdf)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("netcdf").option("variable", variable).load(path)
