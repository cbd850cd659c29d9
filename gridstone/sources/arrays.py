"""Chunked arrays as tables: Zarr (versions 2 and 3), NPY and NPZ, one task a chunk.

Planning reads metadata only. The indices that are wanted of an axis choose chunks, so that
a chunk without any is never opened, and then cells, before anything leaves the task. Each
cell is a row of its indices i0, i1, ... and its value as a double.

Decoders: none, zlib, gzip, bz2, lzma and zstd. Others (blosc) are an error at planning.
Defined cases: an absent chunk holds the fill value (null where that is null); edge chunks
are cut to the shape; an empty axis gives no rows; NaN stays NaN; a member of an NPZ that
is deflated can't be entered in the middle and is one task, a stored one is cut like NPY.
"""

from __future__ import annotations

import bz2
import gzip
import itertools
import json
import lzma
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .rowgroups import opened

CELLS = 1 << 16
ROW_BYTES = 8 << 20  # of an NPY stretch


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


DECODERS = {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress, "zstd": _zstd}


@dataclass
class Layout:
    """kind, shape, chunks, dtype, order, codec, fill, key (how a chunk's file is named), offset of the first cell."""

    kind: str
    shape: tuple
    chunks: tuple
    dtype: str
    order: str = "C"
    codec: str | None = None
    fill: float | None = 0.0
    key: str = "."
    offset: int = 0
    member: str | None = None


def zarr_layout(fs, at: str) -> Layout:
    """From .zarray (version 2) or zarr.json (version 3)."""
    if fs.get_file_info(f"{at}/.zarray").type == pa.fs.FileType.File:
        m = json.loads(fs.open_input_file(f"{at}/.zarray").read())
        if m.get("filters"):
            raise ValueError(f"filters {m['filters']} aren't decoded")
        codec = m["compressor"]["id"] if m.get("compressor") else None
        out = Layout("zarr", tuple(m["shape"]), tuple(m["chunks"]), m["dtype"], m.get("order", "C"), codec, m.get("fill_value"), m.get("dimension_separator", "."))
    else:
        m = json.loads(fs.open_input_file(f"{at}/zarr.json").read())
        order, codec, swap = "C", None, "<"
        for c in m["codecs"]:
            if c["name"] == "bytes":
                swap = ">" if c.get("configuration", {}).get("endian") == "big" else "<"
            elif c["name"] == "transpose":
                order = "F" if list(c["configuration"]["order"]) == list(range(len(m["shape"])))[::-1] else "?"
            else:
                codec = c["name"]
        sep = m.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
        out = Layout("zarr", tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), np.dtype(m["data_type"]).newbyteorder(swap).str, order, codec, m.get("fill_value"), f"c{sep}")
    if out.codec not in DECODERS or out.order not in "CF":
        raise ValueError(f"codec {out.codec} or order {out.order} isn't decoded")
    out.fill = None if out.fill is None else float(out.fill)  # "NaN" and "Infinity" as well
    return out


def _npy(f, member: str | None, base: int) -> Layout:
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if dtype.hasobject:
        raise ValueError("arrays of objects aren't read")
    row = int(dtype.itemsize * np.prod(shape[1:], dtype=np.int64)) or 1
    step = shape[0] if fortran or not shape or member and base < 0 else max(1, ROW_BYTES // row)
    return Layout("npy", shape, (max(step, 1), *(max(s, 1) for s in shape[1:])), dtype.str, "F" if fortran else "C", offset=base + f.tell() if base >= 0 else -1, member=member)


def npy_layout(fs, at: str, member: str | None) -> Layout:
    """From an NPY file, or a member of an NPZ."""
    with fs.open_input_file(at) as f:
        if member is None:
            return _npy(f, None, 0)
        with zipfile.ZipFile(f) as z:
            info = z.getinfo(member if member.endswith(".npy") else f"{member}.npy")
            if info.compress_type == zipfile.ZIP_STORED:
                f.seek(info.header_offset)
                head = f.read(30)
                begin = info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
                with z.open(info) as own:
                    return _npy(own, info.filename, begin)
            with z.open(info) as own:
                return _npy(own, info.filename, -1)


def layout(path: str, member: str | None = None) -> Layout:
    fs, at = opened(path)
    return zarr_layout(fs, at) if fs.get_file_info(at).type == pa.fs.FileType.Directory else npy_layout(fs, at, member)


@dataclass
class Chunk(InputPartition):
    at: tuple


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, found: Layout, select: dict[int, list | dict]):
        """select: axis -> the wanted indices, or {"range": [first, past]}."""
        self.path, self.layout, self.select = path, found, select

    def wanted(self, axis: int, chunk: int) -> np.ndarray:
        """The indices of an axis that a chunk has and the filters keep."""
        step = self.layout.chunks[axis]
        i = np.arange(chunk * step, min((chunk + 1) * step, self.layout.shape[axis]), dtype=np.int64)
        want = self.select.get(axis)
        if want is None:
            return i
        return i[(i >= want["range"][0]) & (i < want["range"][1])] if isinstance(want, dict) else i[np.isin(i, want)]

    def partitions(self):
        m = self.layout
        axes = [[c for c in range(-(-s // step)) if len(self.wanted(a, c))] for a, (s, step) in enumerate(zip(m.shape, m.chunks))]
        return [Chunk(at) for at in itertools.product(*axes)] or [Chunk(())] if m.shape else [Chunk(())]

    def block(self, at: tuple) -> np.ndarray | None:
        """The chunk's cells, cut to the shape; None where it is absent."""
        m = self.layout
        fs, base = opened(self.path)
        size = [min(step, s - c * step) for c, step, s in zip(at, m.chunks, m.shape)]
        if m.kind == "zarr":
            name = m.key + m.key[-1].join(map(str, at)) if m.key.startswith("c") else m.key.join(map(str, at))
            if fs.get_file_info(f"{base}/{name}").type != pa.fs.FileType.File:
                return None
            raw = DECODERS[m.codec](fs.open_input_file(f"{base}/{name}").read())
            cells = np.frombuffer(raw, m.dtype).reshape(m.chunks, order=m.order)
            return cells[tuple(slice(0, n) for n in size)]
        count = int(np.prod(size, dtype=np.int64))
        with fs.open_input_file(base) as f:
            if m.offset < 0:
                with zipfile.ZipFile(f) as z, z.open(m.member) as own:
                    return np.lib.format.read_array(own)
            f.seek(m.offset + at[0] * m.chunks[0] * int(np.prod(m.shape[1:], dtype=np.int64)) * np.dtype(m.dtype).itemsize)
            return np.frombuffer(f.read(count * np.dtype(m.dtype).itemsize), m.dtype).reshape(size, order=m.order)

    def read(self, partition):
        if len(partition.at) != len(self.layout.shape) or not partition.at:
            return
        own = [self.wanted(a, c) for a, c in enumerate(partition.at)]
        cells = self.block(partition.at)
        if cells is not None:
            cells = cells[np.ix_(*(i - c * step for i, c, step in zip(own, partition.at, self.layout.chunks)))].astype(float).ravel()
        total = int(np.prod([len(i) for i in own], dtype=np.int64))
        for begin in range(0, total, CELLS):
            place = np.unravel_index(np.arange(begin, min(begin + CELLS, total)), [len(i) for i in own])
            if cells is not None:
                value = pa.array(cells[begin : begin + CELLS])
            else:
                value = pa.array([self.layout.fill] * len(place[0]), pa.float64())
            yield pa.RecordBatch.from_arrays([*(pa.array(i[p]) for i, p in zip(own, place)), value], [*(f"i{a}" for a in range(len(own))), "value"])


class Arrays(DataSource):
    @classmethod
    def name(cls):
        return "chunked_array"

    def schema(self):
        n = len(layout(self.options["path"], self.options.get("member")).shape)
        return T.StructType([T.StructField(f"i{a}", T.LongType()) for a in range(n)] + [T.StructField("value", T.DoubleType())])

    def reader(self, schema):
        chosen = {int(k): v for k, v in json.loads(self.options.get("select", "{}")).items()}
        return ArrayReader(self.options["path"], layout(self.options["path"], self.options.get("member")), chosen)


def chunked_array(spark: SparkSession, path: str, member: str | None = None, select: dict[int, list[int] | range] | None = None) -> DataFrame:
    """i0, i1, ..., value of a Zarr array's folder, an NPY file or a member of an NPZ; of an axis in select only the listed indices, or those of a range of step 1."""
    spark.dataSource.register(Arrays)
    chosen = {k: {"range": [v.start, v.stop]} if isinstance(v, range) else sorted(set(v)) for k, v in (select or {}).items()}
    if any(isinstance(v, range) and v.step != 1 for v in (select or {}).values()):
        raise ValueError("ranges are of step 1")
    reader = spark.read.format("chunked_array").option("select", json.dumps(chosen))
    return (reader.option("member", member) if member else reader).load(path)


def save_zarr(df: DataFrame, path: str, shape: tuple, chunks: tuple, codec: str | None = "zlib", dtype: str = "<f8") -> None:
    """df(i0, i1, ..., value) as a Zarr array of version 2: a task a chunk; cells without a row are NaN; an error where a cell comes twice or lies outside.

    A chunk is written beside its place and renamed, so that a task that is run again leaves the same file. The folder must be one that driver and executors share.
    """
    fs, at = opened(path)
    fs.create_dir(at, recursive=True)
    meta = {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "compressor": {"id": codec, "level": 1} if codec else None, "fill_value": "NaN", "order": "C", "filters": None}
    encode = {None: bytes, "zlib": lambda b: zlib.compress(b, 1), "gzip": lambda b: gzip.compress(b, 1, mtime=0)}[codec]
    names = [f"i{a}" for a in range(len(shape))]

    def run(key, pdf):
        cells = np.full(chunks, np.nan, dtype)
        place = tuple(pdf[n].to_numpy() - c * step for n, c, step in zip(names, key, chunks))
        if any((pdf[n] < 0).any() or (pdf[n] >= s).any() for n, s in zip(names, shape)) or len(set(zip(*place))) < len(pdf):
            raise ValueError(f"chunk {key} has a cell twice or outside the shape")
        cells[place] = pdf.value.to_numpy()
        own, base = opened(path)
        name = f"{base}/{'.'.join(map(str, key))}"
        with own.open_output_stream(f"{name}.part") as f:
            f.write(encode(cells.tobytes()))
        own.move(f"{name}.part", name)
        return pdf.iloc[:1][["i0"]].assign(n=len(pdf))[["n"]]

    where = [F.floor(F.col(n) / step).cast("bigint").alias(f"c{a}") for a, (n, step) in enumerate(zip(names, chunks))]
    df.select(*names, F.col("value").cast("double"), *where).groupBy(*(f"c{a}" for a in range(len(shape)))).applyInPandas(run, "n bigint").agg(F.sum("n")).collect()
    with fs.open_output_stream(f"{at}/.zarray") as f:
        f.write(json.dumps(meta).encode())
