"""Array files as tables: Python data sources for NPZ archives and classic NetCDF files.

`npz`: an archive's arrays of one shape are columns; arrays of several dimensions come in long form with their indices d0, d1, ... A table
is written as an archive for each task, an array for each column.

`netcdf`: a variable over dimensions comes in long form: the index of each dimension as <dimension>_idx, its coordinate where a variable has the
dimension's name, and the value. A table is written as dense blocks, a file for each task, over the distinct values of its dimensions' columns;
cells that no row has are NaN.

Both read a file or a folder of files, by blocks of the first dimension, on a file system that every executor reaches (a path or a URI that
pyarrow knows). A range of the first dimension, its coordinate or else its index, is an option of the reader: blocks outside aren't planned,
rows outside aren't read. It isn't left to pushed filters, as Spark 4.1 keeps those of one query for others on the same DataFrame.
"""

from __future__ import annotations

import contextlib
import struct
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Cells of a partition, as far as one index of the first dimension allows.
BLOCK = 1 << 20
#: NetCDF's tags of lists, its types by number, and their big-endian formats.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
NUMBERS = {np.dtype(v).str: k for k, v in TYPES.items()}
SPARK = {"b": "boolean", "i": "long", "u": "long", "f": "double", "S": "string", "U": "string"}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


def files_of(path: str, suffix: str) -> list[str]:
    """The path itself, or the files of a folder by name, with the scheme they were asked for."""
    fs, inner = file_system(path)
    if fs.get_file_info(inner).type != pafs.FileType.Directory:
        return [path]
    names = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(inner)) if i.path.endswith(suffix))
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return [head + n for n in names]


@contextlib.contextmanager
def opened(path: str, write: bool = False) -> Iterator:
    fs, inner = file_system(path)
    if write:
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(inner) if write else fs.open_input_file(inner) as f:
        yield f


@dataclass
class Block(InputPartition):
    path: str
    low: int
    high: int


def blocks(path: str, keep: np.ndarray, each: int, options: Mapping[str, str]) -> list[Block]:
    """Runs of the first dimension of some `block` cells that hold an index to keep."""
    step = max(1, int(options.get("block", BLOCK)) // max(1, each))
    return [Block(path, k, min(len(keep), k + step)) for k in range(0, len(keep), step) if keep[k : k + step].any()]


def within(values: np.ndarray, options: Mapping[str, str]) -> np.ndarray:
    """Which values lie in the range of the options from and to, both included."""
    low, high = (float(options.get(k, d)) for k, d in (("from", "-inf"), ("to", "inf")))
    return (values >= low) & (values <= high)


def long_rows(index: np.ndarray, shape: tuple[int, ...]) -> list[np.ndarray]:
    """Indices of each dimension for all cells of some indices of the first one."""
    n = int(np.prod(shape[1:], dtype=np.int64))
    rest = np.unravel_index(np.arange(n), shape[1:]) if len(shape) > 1 else ()
    return [np.repeat(index, n), *(np.tile(r, len(index)) for r in rest)]


# NPZ


def npz_header(path: str) -> dict[str, tuple[tuple[int, ...], np.dtype, bool]]:
    """name -> (shape, type, Fortran order) of an archive's arrays, from their headers."""
    out = {}
    with opened(path) as f, zipfile.ZipFile(f) as z:
        for name in z.namelist():
            with z.open(name) as a:
                version = np.lib.format.read_magic(a)
                shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(a)
                out[name.removesuffix(".npy")] = (shape, kind, fortran)
    return out


class NpzReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], names: list[str], schema: StructType):
        self.options, self.names, self.schema = dict(options), names, schema

    def partitions(self) -> list[Block]:
        out = []
        for path in files_of(self.options["path"], ".npz"):
            shape = npz_header(path)[self.names[0]][0] or (1,)
            out += blocks(path, within(np.arange(shape[0]), self.options), int(np.prod(shape[1:], dtype=np.int64)), self.options)
        return out or [Block("", 0, 0)]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if not block.path:
            return
        shape, arrays = (), []
        with opened(block.path) as f, zipfile.ZipFile(f) as z:
            for name in self.names:
                with z.open(f"{name}.npy") as a:
                    version = np.lib.format.read_magic(a)
                    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(a)
                    shape = shape or (1,)
                    if fortran and len(shape) > 1:  # its blocks don't lie together
                        arrays.append(np.frombuffer(a.read(), kind).reshape(shape, order="F")[block.low : block.high])
                        continue
                    each = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
                    a.seek(a.tell() + block.low * each)
                    arrays.append(np.frombuffer(a.read((block.high - block.low) * each), kind).reshape(-1, *shape[1:]))
        index = np.arange(block.low, block.high)
        keep = within(index, self.options)
        columns = [*(long_rows(index[keep], shape) if len(shape) > 1 or "d0" in self.schema.names else []), *(a[keep].ravel() for a in arrays)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(_numpy_of(t.dataType.simpleString()))) for c, t in zip(columns, self.schema, strict=True)], self.schema.names)


def _numpy_of(kind: str) -> object:
    return {"long": np.int64, "bigint": np.int64, "int": np.int32, "double": np.float64, "boolean": bool, "string": str}[kind]


@dataclass
class Written(WriterCommitMessage):
    path: str


class NpzWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path.rstrip("/"), schema

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        held = list(batches)
        path = f"{self.path}/part-{TaskContext.get().partitionId():05d}.npz"
        if sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held)
            with opened(path, write=True) as f:
                texts = {c for c in self.schema.names if pa.types.is_string(table.column(c).type)}
                np.savez(_Seekless(f), **{c: np.array(table.column(c).to_pylist(), str) if c in texts else table.column(c).to_numpy() for c in self.schema.names})
        return Written(path)


class _Seekless:
    """A stream that zipfile only appends to."""

    def __init__(self, f):
        self.f = f

    def write(self, data: bytes) -> int:
        self.f.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        self.f.flush()

    def read(self, *_: int) -> bytes:
        raise OSError("for writing only")


class NpzSource(DataSource):
    """Options: path; arrays, names parted by commas (all of the first one's shape if left out); from and to, of the first index."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def names(self) -> list[str]:
        if "arrays" in self.options:
            return [n.strip() for n in self.options["arrays"].split(",")]
        header = npz_header(files_of(self.options["path"], ".npz")[0])
        first = next(iter(header.values()))[0]
        return [n for n, (shape, kind, _) in header.items() if shape == first and kind.kind in SPARK]

    def schema(self) -> str:
        header, names = npz_header(files_of(self.options["path"], ".npz")[0]), self.names()
        shapes = {header[n][0] for n in names}
        if len(shapes) > 1:
            raise ValueError(f"arrays of several shapes: {shapes}")
        (shape,) = shapes
        index = [f"d{k} long" for k in range(len(shape))] if len(shape) > 1 else []
        return ", ".join([*index, *(f"`{n}` {SPARK[header[n][1].kind]}" for n in names)])

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(self.options, self.names(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options["path"], schema)


# NetCDF


@dataclass
class Variable:
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: str
    begin: int
    step: int  # bytes from one index of the first dimension to the next
    attributes: dict


def netcdf_header(path: str) -> dict[str, Variable]:
    """The variables of a classic NetCDF file (32- or 64-bit offsets)."""
    with opened(path) as f:
        def number(wide: bool = False) -> int:
            return struct.unpack(">q" if wide else ">i", f.read(8 if wide else 4))[0]

        def text() -> str:
            n = number()
            out = f.read(n)
            f.read(-n % 4)
            return out.decode()

        def attributes() -> dict:
            tag, n = number(), number()
            if tag not in (0, ATTRIBUTE):
                raise ValueError(f"{path}: no list of attributes where one is due")
            out = {}
            for _ in range(n):
                name, kind, many = text(), number(), number()
                size = many * np.dtype(TYPES[kind]).itemsize
                raw = f.read(size)
                f.read(-size % 4)
                out[name] = raw.decode() if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
            return out

        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError(f"{path} isn't a classic NetCDF file")
        records, _, many = number(), number(), number()
        dims = [(text(), number()) for _ in range(many)]
        attributes()
        _, many = number(), number()
        found = []
        for _ in range(many):
            name, rank = text(), number()
            ids = [number() for _ in range(rank)]
            of, kind, size, begin = attributes(), number(), number(), number(wide=magic[3] == 2)
            found.append((name, ids, of, kind, size, begin))
        open_ended = [v for v in found if v[1] and dims[v[1][0]][1] == 0]
        record = sum(v[4] for v in open_ended) if len(open_ended) != 1 else int(np.prod([dims[k][1] for k in open_ended[0][1][1:]], dtype=np.int64)) * np.dtype(TYPES[open_ended[0][3]]).itemsize
        out = {}
        for name, ids, of, kind, _, begin in found:
            shape = tuple(records if dims[k][1] == 0 else dims[k][1] for k in ids)
            each = int(np.prod(shape[1:], dtype=np.int64)) * np.dtype(TYPES[kind]).itemsize
            out[name] = Variable(tuple(dims[k][0] for k in ids), shape, TYPES[kind], begin, record if ids and dims[ids[0]][1] == 0 else each, of)
        return out


def netcdf_values(path: str, v: Variable, low: int = 0, high: int | None = None) -> np.ndarray:
    """Values of some indices of a variable's first dimension."""
    if not v.shape:
        with opened(path) as f:
            f.seek(v.begin)
            return np.frombuffer(f.read(np.dtype(v.kind).itemsize), v.kind)
    high = v.shape[0] if high is None else high
    each = int(np.prod(v.shape[1:], dtype=np.int64)) * np.dtype(v.kind).itemsize
    with opened(path) as f:
        if v.step == each:
            f.seek(v.begin + low * each)
            raw = f.read((high - low) * each)
        else:  # records of several variables lie in turn
            parts = []
            for k in range(low, high):
                f.seek(v.begin + k * v.step)
                parts.append(f.read(each))
            raw = b"".join(parts)
    out = np.frombuffer(raw, v.kind).reshape(high - low, *v.shape[1:])
    if out.dtype.kind == "f" and "_FillValue" in v.attributes:
        out = np.where(out == np.array(v.attributes["_FillValue"][0], out.dtype), np.nan, out)
    return out


class NetcdfReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: StructType):
        self.options, self.variable, self.schema = dict(options), options["variable"], schema

    def _kept(self, path: str, header: dict[str, Variable]) -> np.ndarray:
        v = header[self.variable]
        first = v.dims[0]
        return within(netcdf_values(path, header[first]) if first in header else np.arange(v.shape[0]), self.options)

    def partitions(self) -> list[Block]:
        out = []
        for path in files_of(self.options["path"], ".nc"):
            header = netcdf_header(path)
            out += blocks(path, self._kept(path, header), int(np.prod(header[self.variable].shape[1:], dtype=np.int64)), self.options)
        return out or [Block("", 0, 0)]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if not block.path:
            return
        header = netcdf_header(block.path)
        v = header[self.variable]
        index = np.arange(block.low, block.high)
        keep = self._kept(block.path, header)[block.low : block.high]
        rows = long_rows(index[keep], v.shape)
        found = {self.variable: netcdf_values(block.path, v, block.low, block.high)[keep].ravel()}
        for name, at in zip(v.dims, rows, strict=True):
            found[f"{name}_idx"] = at
            if name in header and name != self.variable:
                found[name] = netcdf_values(block.path, header[name])[at]
        yield pa.RecordBatch.from_arrays([pa.array(found[t.name].astype(_numpy_of(t.dataType.simpleString()))) for t in self.schema], self.schema.names)


def netcdf_bytes(dims: dict[str, np.ndarray], values: dict[str, np.ndarray], attributes: dict[str, dict[str, str]] | None = None) -> bytes:
    """A classic NetCDF file (64-bit offsets) of coordinates by dimension and of variables over all dimensions in order."""
    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">i", len(raw)) + raw + bytes(-len(raw) % 4)

    def of(name: str) -> bytes:
        found = (attributes or {}).get(name, {})
        return struct.pack(">ii", ATTRIBUTE if found else 0, len(found)) + b"".join(text(k) + struct.pack(">i", 2) + text(v) for k, v in found.items())

    def stored(a: np.ndarray) -> tuple[int, bytes]:
        kind = ">f4" if a.dtype == np.float32 else ">f8" if a.dtype.kind == "f" else ">i4"
        if kind == ">i4" and a.size and (a.min() < -(2**31) or a.max() >= 2**31):
            raise ValueError("whole numbers beyond 32 bits have no type in a classic file")
        raw = np.ascontiguousarray(a.astype(kind)).tobytes()
        return NUMBERS[kind], raw + bytes(-len(raw) % 4)

    names = list(dims)
    parts = [(n, [k], *stored(a)) for k, (n, a) in enumerate(dims.items())] + [(n, list(range(len(names))), *stored(a)) for n, a in values.items()]
    head = b"CDF\x02" + struct.pack(">iii", 0, DIMENSION, len(names)) + b"".join(text(n) + struct.pack(">i", len(a)) for n, a in dims.items()) + of("")
    lists = [text(n) + struct.pack(f">i{len(ids)}i", len(ids), *ids) + of(n) + struct.pack(">ii", kind, min(len(raw), 2**31 - 1)) for n, ids, kind, raw in parts]
    begin = len(head) + 8 + sum(len(x) + 8 for x in lists)
    body = struct.pack(">ii", VARIABLE, len(parts))
    for x, (_, _, _, raw) in zip(lists, parts, strict=True):
        body += x + struct.pack(">q", begin)
        begin += len(raw)
    return head + body + b"".join(raw for *_, raw in parts)


class NetcdfWriter(DataSourceArrowWriter):
    def __init__(self, path: str, dims: list[str], schema: StructType):
        self.path, self.dims, self.schema = path.rstrip("/"), dims, schema

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        held = list(batches)
        path = f"{self.path}/part-{TaskContext.get().partitionId():05d}.nc"
        if sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held)
            axes, at = zip(*(np.unique(table.column(d).to_numpy(), return_inverse=True) for d in self.dims), strict=True)
            values = {}
            for f in self.schema:
                if f.name not in self.dims:
                    column = table.column(f.name).to_numpy()
                    cells = np.full([len(a) for a in axes], np.nan, np.float32 if f.dataType.simpleString() == "float" else np.float64)
                    cells[tuple(at)] = column
                    values[f.name] = cells
            attributes = {f.name: {k: str(v) for k, v in f.metadata.items()} for f in self.schema if f.metadata}
            with opened(path, write=True) as out:
                out.write(netcdf_bytes(dict(zip(self.dims, axes, strict=True)), values, attributes))
        return Written(path)


class NetcdfSource(DataSource):
    """Options: path; variable, from and to for reading; dims, columns parted by commas, for writing."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        header = netcdf_header(files_of(self.options["path"], ".nc")[0])
        v = header[self.options["variable"]]
        columns = []
        for d in v.dims:
            columns.append(f"`{d}_idx` long")
            if d in header and d != self.options["variable"]:
                columns.append(f"`{d}` {SPARK[np.dtype(header[d].kind).kind]}")
        return ", ".join([*columns, f"`{self.options['variable']}` {SPARK[np.dtype(v.kind).kind]}"])

    def reader(self, schema: StructType) -> NetcdfReader:
        return NetcdfReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> NetcdfWriter:
        return NetcdfWriter(self.options["path"], [d.strip() for d in self.options["dims"].split(",")], schema)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session."""
    for source in (NpzSource, NetcdfSource):
        spark.dataSource.register(source)


def _read(spark: SparkSession, form: str, low: float | None, high: float | None, block: int, **options: str) -> DataFrame:
    register(spark)
    options["block"] = str(block)
    ends = {k: str(v) for k, v in (("from", low), ("to", high)) if v is not None}
    return spark.read.format(form).options(**options, **ends).load()


def read_npz(spark: SparkSession, path: str, arrays: Sequence[str] = (), low: int | None = None, high: int | None = None, block: int = BLOCK) -> DataFrame:
    return _read(spark, "npz", low, high, block, path=path, **({"arrays": ",".join(arrays)} if arrays else {}))


def write_npz(df: DataFrame, path: str) -> None:
    """One archive for each partition that has rows; columns are numbers, booleans or texts without nulls. A task holds its partition's rows."""
    register(df.sparkSession)
    df.write.format("npz").mode("append").option("path", path).save()


def read_netcdf(spark: SparkSession, path: str, variable: str, low: float | None = None, high: float | None = None, block: int = BLOCK) -> DataFrame:
    return _read(spark, "netcdf", low, high, block, path=path, variable=variable)


def write_netcdf(df: DataFrame, path: str, dims: Sequence[str]) -> None:
    """A dense block for each value of the first dimension's column that its partition has; a task holds its block. Other columns are values of all
    dimensions; their metadata become attributes."""
    register(df.sparkSession)
    df.repartition(dims[0]).write.format("netcdf").mode("append").option("path", path).option("dims", ",".join(dims)).save()
