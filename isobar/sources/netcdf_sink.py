"""NetCDF files written by all tasks at once.

A file (version 5: 64-bit sizes) has a header, the axes and then each variable's cells
in order.  The driver lays it out beside its final name: header and axes, which are
bounded, and the room for the rest.  Tasks hold whole blocks of cells, ranges of one
variable, and write each where it belongs, cells without a row as the fill value; a
task that runs again writes the same bytes.  Only the commit, when every block is
there, gives the file its name; a failed job leaves nothing.

The place has to be a file system that all machines share and that can write inside
a file; object stores can't, and are refused.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import DateType, StructType, TimestampNTZType, TimestampType

from .netcdf import ATTRIBUTE, DIMENSION, FILL, VARIABLE

DOUBLE, TEXT = 6, 2
#: Cells of a block, and values of an axis at most (they are held by the driver).
BLOCK, AXIS = 1 << 17, 2_000_000
DAYS = "days since 1970-01-01 00:00:00"


@dataclass
class Table:
    """Rows of a variable: its dimensions' columns and ``value``."""

    rows: DataFrame
    dims: tuple[str, ...]
    attributes: dict[str, str | float] = field(default_factory=dict)


@dataclass
class Done(WriterCommitMessage):
    blocks: int


def _name(s: str) -> bytes:
    raw = s.encode()
    return struct.pack(">q", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _attributes(found: dict[str, str | float]) -> bytes:
    out = struct.pack(">iq", ATTRIBUTE if found else 0, len(found))
    for name, value in found.items():
        raw = value.encode() if isinstance(value, str) else struct.pack(">d", value)
        out += _name(name) + struct.pack(">iq", TEXT if isinstance(value, str) else DOUBLE, len(raw) if isinstance(value, str) else 1) + raw + b"\0" * (-len(raw) % 4)
    return out


def header(dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], dict]], attributes: dict) -> tuple[bytes, dict[str, int]]:
    """The header, and where each variable begins."""
    place = list(dims)
    cells = {v: int(np.prod([dims[d] for d in own], dtype=np.int64)) for v, (own, _) in variables.items()}

    def made(begins: dict[str, int]) -> bytes:
        out = b"CDF\5" + struct.pack(">q", 0) + struct.pack(">iq", DIMENSION if dims else 0, len(dims)) + b"".join(_name(d) + struct.pack(">q", n) for d, n in dims.items())
        out += _attributes(attributes) + struct.pack(">iq", VARIABLE, len(variables))
        for v, (own, described) in variables.items():
            out += _name(v) + struct.pack(f">q{len(own)}q", len(own), *map(place.index, own)) + _attributes(described)
            out += struct.pack(">iqq", DOUBLE, cells[v] * 8, begins.get(v, 0))
        return out

    at, begins = len(made({})), {}
    for v in variables:
        begins[v] = at
        at += cells[v] * 8
    return made(begins), begins


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.part, self.path = options["part"], options["path"]
        self.begins, self.cells, self.blocks = json.loads(options["begins"]), json.loads(options["cells"]), int(options["blocks"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        """Rows (v, at, value, real) in order, whole blocks of them."""
        out = os.open(self.part, os.O_WRONLY)
        block, held, blocks, last = None, np.zeros(0), 0, None

        def put() -> None:
            if block is not None:
                raw = held.astype(">f8").tobytes()
                if os.pwrite(out, raw, self.begins[block[0]] + block[1] * BLOCK * 8) != len(raw):
                    raise OSError("a block wasn't written")

        try:
            for batch in iterator:
                v, at, real = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
                value = batch.column(2).fill_null(FILL[DOUBLE]).to_numpy()
                value = np.where(np.isnan(value), FILL[DOUBLE], value)
                cell = v.astype(np.int64) << 48 | at
                twice = cell[real]
                if len(twice) and (last == twice[0] or (np.diff(twice) == 0).any()):
                    raise ValueError("two rows have one cell")
                last = twice[-1] if len(twice) else last
                keys = cell // BLOCK
                cuts = np.flatnonzero(np.diff(keys)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                    if a == b:
                        continue
                    key = int(v[a]), int(at[a]) // BLOCK
                    if key != block:
                        put()
                        block, blocks = key, blocks + 1
                        held = np.full(min(BLOCK, self.cells[key[0]] - key[1] * BLOCK), FILL[DOUBLE])
                    own = real[a:b]
                    held[at[a:b][own] - key[1] * BLOCK] = value[a:b][own]
            put()
            os.fsync(out)
        finally:
            os.close(out)
        return Done(blocks)

    def commit(self, messages: list[Done | None]) -> None:
        there = sum(m.blocks for m in messages if m is not None)
        if there != self.blocks:
            self.abort(messages)
            raise OSError(f"{there} of {self.blocks} blocks were written")
        os.replace(self.part, self.path)

    def abort(self, messages: list[Done | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class NetCdfSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf_sink"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def _local(path: str) -> str:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise NotImplementedError(f"no writes inside files there: {path}")
    return os.path.abspath(path)


def write_netcdf(tables: dict[str, Table], path: str, attributes: dict[str, str | float] | None = None, overwrite: bool = False) -> None:
    """Variables over shared dimensions in one file.  An axis has all values that any
    table has for it, in order; dates and times become days since 1970.  Cells without
    a row, nulls and NaN are missing; two rows of one cell are an error."""
    spark, final = next(iter(tables.values())).rows.sparkSession, _local(path)
    if os.path.exists(final) and not overwrite:
        raise FileExistsError(final)
    timed: set[str] = set()
    plain = {}
    for name, t in tables.items():
        rows = t.rows
        for d in t.dims:
            kind = rows.schema[d].dataType
            if isinstance(kind, DateType | TimestampType | TimestampNTZType):
                timed.add(d)
                rows = rows.withColumn(d, F.unix_micros(F.col(d).cast("timestamp")) / 86_400_000_000)
        plain[name] = rows.select(*[F.col(d).cast("double").alias(d) for d in t.dims], F.col("value").cast("double").alias("value"))
    axes: dict[str, list[float]] = {}
    for d in dict.fromkeys(d for t in tables.values() for d in t.dims):
        every = reduce(DataFrame.union, [plain[n].select(d) for n, t in tables.items() if d in t.dims]).where(F.col(d).isNotNull()).distinct()
        found = [r[0] for r in every.orderBy(d).limit(AXIS + 1).collect()]
        if len(found) > AXIS:
            raise ValueError(f"{d} has more than {AXIS} values")
        axes[d] = found

    sizes = {d: len(a) for d, a in axes.items()}
    described = {d: ((d,), {"units": DAYS, "calendar": "standard"} if d in timed else {}) for d in axes}
    described |= {n: (t.dims, {**t.attributes, "_FillValue": FILL[DOUBLE]}) for n, t in tables.items()}
    head, begins = header(sizes, described, attributes or {})
    cells = [int(np.prod([sizes[d] for d in t.dims], dtype=np.int64)) for t in tables.values()]
    blocks = [-(-n // BLOCK) for n in cells]

    placed = None
    for v, (name, t) in enumerate(tables.items()):
        rows, at, stride = plain[name], F.lit(0).cast("long"), cells[v]
        for d in t.dims:
            index = spark.createDataFrame([(x, k) for k, x in enumerate(axes[d])], f"`{d}` double, `{d}#` long")
            rows, stride = rows.join(F.broadcast(index), d), stride // max(sizes[d], 1)
            at = at + F.col(f"`{d}#`") * stride
        filler = spark.range(blocks[v]).select(F.lit(v).alias("v"), (F.col("id") * BLOCK).alias("at"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("real"))
        own = rows.select(F.lit(v).alias("v"), at.alias("at"), "value", F.lit(True).alias("real")).union(filler)
        placed = own if placed is None else placed.union(own)

    part = f"{final}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(head)
        for d, a in axes.items():
            f.seek(begins[d])
            f.write(np.array(a, ">f8").tobytes())
        f.truncate(begins[next(reversed(tables))] + cells[-1] * 8)
    spark.dataSource.register(NetCdfSink)
    options = {"part": part, "begins": json.dumps([begins[n] for n in tables]), "cells": json.dumps(cells), "blocks": str(sum(blocks))}
    try:
        dealt = placed.repartitionByRange("v", F.expr(f"at div {BLOCK}")).sortWithinPartitions("v", "at", "real")
        dealt.write.format("netcdf_sink").options(**options).mode("append").save(final)
    finally:
        if os.path.exists(part):
            os.remove(part)
