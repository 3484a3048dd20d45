"""NetCDF classic files (CDF-1 and CDF-2) read as long tables and written one field a file, without a library."""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: tags of lists and numbers of types.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


@dataclass
class Variable:
    """A variable of a file: its dimensions' names, shape, attributes, type, and where its data lie."""

    dims: list[str]
    shape: tuple[int, ...]
    attributes: dict
    kind: str
    size: int
    begin: int
    record: bool


@dataclass
class Classic:
    """An open file: dimensions, attributes and variables are parsed, data are read when asked for."""

    content: bytes
    dims: dict[str, int] = field(default_factory=dict)
    attributes: dict = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    records: int = 0

    def __post_init__(self):
        if self.content[:3] != b"CDF" or self.content[3] not in (1, 2):
            raise ValueError("not a classic NetCDF file")
        self._at, wide = 4, self.content[3] == 2
        self.records = self._number()
        unlimited = None
        for _ in range(self._list(DIMENSION)):
            name, n = self._name(), self._number()
            self.dims[name] = n
            unlimited = name if n == 0 else unlimited
        self.attributes = self._attributes()
        names = list(self.dims)
        for _ in range(self._list(VARIABLE)):
            name = self._name()
            own = [names[self._number()] for _ in range(self._number())]
            attributes, kind, size = self._attributes(), TYPES[self._number()], self._number()
            begin = struct.unpack_from(">q" if wide else ">i", self.content, self._at)[0]
            self._at += 8 if wide else 4
            record = bool(own) and own[0] == unlimited
            self.variables[name] = Variable(own, tuple(self.records if d == unlimited else self.dims[d] for d in own), attributes, kind, size, begin, record)
        if unlimited:
            self.dims[unlimited] = self.records

    def _number(self) -> int:
        self._at += 4
        return struct.unpack_from(">I", self.content, self._at - 4)[0]

    def _name(self) -> str:
        n = self._number()
        text = self.content[self._at : self._at + n].decode("utf-8", "replace")
        self._at += n + -n % 4
        return text

    def _list(self, tag: int) -> int:
        found, n = self._number(), self._number()
        if found not in (tag, 0):
            raise ValueError(f"tag {found} where {tag} is due")
        return n

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list(ATTRIBUTE)):
            name, kind, n = self._name(), TYPES[self._number()], self._number()
            raw = self.content[self._at : self._at + n * np.dtype(kind).itemsize]
            self._at += len(raw) + -len(raw) % 4
            if kind == "S1":
                out[name] = raw.decode("utf-8", "replace").rstrip("\0")
            else:
                values = np.frombuffer(raw, kind)
                out[name] = values[0].item() if n == 1 else values.tolist()
        return out

    def values(self, name: str, scaled: bool = True) -> np.ndarray:
        """A variable's values; scaled: fill values as NaN, then scale_factor and add_offset."""
        v = self.variables[name]
        kind = np.dtype(v.kind)
        if v.record:
            each = int(np.prod(v.shape[1:], dtype=np.int64)) * kind.itemsize
            step = sum(x.size for x in self.variables.values() if x.record) if sum(x.record for x in self.variables.values()) > 1 else each
            raw = b"".join(self.content[v.begin + i * step : v.begin + i * step + each] for i in range(self.records))
        else:
            raw = self.content[v.begin : v.begin + int(np.prod(v.shape, dtype=np.int64)) * kind.itemsize]
        out = np.frombuffer(raw, kind).reshape(v.shape)
        if not scaled or v.kind == "S1":
            return out
        missing = [v.attributes[a] for a in ("_FillValue", "missing_value") if isinstance(v.attributes.get(a), (int, float))]
        absent = np.isin(out, np.array(missing, kind)) if missing else np.zeros(out.shape, bool)
        return np.where(absent, np.nan, out * float(v.attributes.get("scale_factor", 1)) + float(v.attributes.get("add_offset", 0)))


def encoded(dims: dict[str, np.ndarray], name: str, values: np.ndarray, attributes: dict | None = None, kind: str = "f4", version: int = 2) -> bytes:
    """A file with a coordinate variable (double) for each dimension and one variable over all of them; NaN is the fill value."""
    pad = lambda raw: raw + b"\0" * (-len(raw) % 4)
    text = lambda s: struct.pack(">I", len(s.encode())) + pad(s.encode())
    number = {v: k for k, v in TYPES.items()}

    def listed(tag, items):
        return struct.pack(">II", tag, len(items)) + b"".join(items) if items else b"\0" * 8

    def attribute(key, value):
        if isinstance(value, str):
            return text(key) + struct.pack(">II", 2, len(value.encode())) + pad(value.encode())
        one = np.array([value], value.dtype.newbyteorder(">") if isinstance(value, np.generic) else ">f8")
        return text(key) + struct.pack(">II", number[one.dtype.str], 1) + pad(one.tobytes())

    fill = np.float32(9.96921e36) if kind == "f4" else np.float64(9.969209968386869e36)
    order = list(dims)
    data = [(d, [i], {}, np.asarray(dims[d], ">f8")) for i, d in enumerate(order)]
    data.append((name, list(range(len(order))), {**(attributes or {}), "_FillValue": fill}, np.where(np.isnan(values), fill, values).astype(f">{kind}")))
    width = 8 if version == 2 else 4

    def head(begins):
        variables = []
        for (var, own, attrs, array), begin in zip(data, begins, strict=True):
            body = text(var) + struct.pack(">I", len(own)) + b"".join(struct.pack(">I", i) for i in own) + listed(ATTRIBUTE, [attribute(k, v) for k, v in attrs.items()])
            variables.append(body + struct.pack(">II", number[array.dtype.str], array.nbytes + -array.nbytes % 4) + begin.to_bytes(width, "big"))
        lengths = [text(d) + struct.pack(">I", len(dims[d])) for d in order]
        return b"CDF" + bytes([version]) + struct.pack(">I", 0) + listed(DIMENSION, lengths) + listed(ATTRIBUTE, []) + listed(VARIABLE, variables)

    at, begins = len(head([0] * len(data))), []
    for _, _, _, array in data:
        begins.append(at)
        at += array.nbytes + -array.nbytes % 4
    return head(begins) + b"".join(pad(array.tobytes()) for _, _, _, array in data)


def read(spark: SparkSession, path: str, variable: str, dims: list[str], names: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """file, a column for each of dims (the coordinate's value, else the place) and value (null where missing) of files.

    names gives other names under which a file may hold a dimension or the variable, tried in turn, as lon, longitude, x.
    Dimensions of a file that are not asked for must have length 1, or the first of each is read.
    """
    names = names or {}

    def cells(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nc = Classic(content)
                wanted = next((n for n in (variable, *names.get(variable, ())) if n in nc.variables), None)
                if wanted is None:
                    raise ValueError(f"{name} has no variable {variable}")
                own = nc.variables[wanted].dims
                axes = {d: next((n for n in (d, *names.get(d, ())) if n in own), None) for d in dims}
                kept = [n for n in axes.values() if n]
                values = nc.values(wanted).astype(float)[tuple(slice(None) if n in kept else 0 for n in own)]
                left = [n for n in own if n in kept]
                spots = np.indices(values.shape).reshape(len(left), -1)
                columns = [pa.array([name] * values.size)]
                for d in dims:
                    n = axes[d]
                    if n is None:
                        columns.append(pa.array(np.zeros(values.size)))
                    else:
                        place = spots[left.index(n)]
                        columns.append(pa.array(nc.values(n).astype(float)[place] if n in nc.variables else place.astype(float)))
                columns.append(pa.array(values.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays(columns, names=["file", *dims, "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(cells, "file string, " + ", ".join(f"`{d}` double" for d in dims) + ", value double")


def write(table: DataFrame, folder: str, by: list[str], dims: list[str], name: str = "data0", pattern: str | None = None, attributes: dict | None = None, overwrite: bool = True) -> DataFrame:
    """One file for each value of by, over the dims of its rows (value null or absent: missing); returns (file, cells, written).

    A field is a group, as the format asks. Files are named by pattern (format string of by) in a mounted folder, written
    aside and moved into place; without overwrite those that are there stay as they are. The table returned is lazy:
    files are written when it is read.
    """
    pattern = pattern or "_".join(f"{{{b}}}" for b in by) + ".nc"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        path = os.path.join(folder, pattern.format(**dict(zip(by, key, strict=True))))
        done = overwrite or not os.path.exists(path)
        if done:
            axes = {d: np.unique(rows[d].to_numpy(float)) for d in dims}
            values = np.full([len(a) for a in axes.values()], np.nan)
            values[tuple(np.searchsorted(axes[d], rows[d].to_numpy(float)) for d in dims)] = rows["value"].to_numpy(float)
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            partial = f"{path}.{os.getpid()}"
            with open(partial, "wb") as f:
                f.write(encoded(axes, name, values, attributes))
            os.replace(partial, path)
        return pd.DataFrame({"file": [path], "cells": [len(rows)], "written": [done]})

    return table.select(*by, *dims, "value").groupBy(*by).applyInPandas(run, "file string, cells long, written boolean")
