"""Array files as tables: .npy, .npz, raw images and volumes. Files are read where their rows are made."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LONG = "path string, name string, dims array<int>, index array<int>, value double"


def _rows(path: str, name: str, a: np.ndarray) -> pd.DataFrame:
    index = np.stack(np.unravel_index(np.arange(a.size), a.shape), 1).astype(np.int32) if a.ndim else np.zeros((a.size, 0), np.int32)
    return pd.DataFrame({"path": path, "name": name, "dims": [list(map(int, a.shape))] * a.size, "index": list(index), "value": a.ravel().astype(float)})


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, dims, index, value``: one row per element of each .npy file."""

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                yield _rows(p, "", np.load(io.BytesIO(content), allow_pickle=False))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _LONG)


def read_npz(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """As ``read_npy`` for the members of .npz files: one by name, or all."""

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for n in z.files if member is None else [member]:
                        yield _rows(p, n, z[n])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _LONG)


def read_raw_images(spark: SparkSession, path: str, width: int, height: int, dtype: str = "uint16") -> DataFrame:
    """``path, row, col, value`` of headerless single-channel images; a file of another size is an error."""

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.frombuffer(content, np.dtype(dtype).newbyteorder("<"))
                if a.size != width * height:
                    raise ValueError(f"{p}: {a.size} pixels, {width * height} wanted")
                r, c = np.divmod(np.arange(a.size), width)
                yield pd.DataFrame({"path": p, "row": r.astype(np.int32), "col": c.astype(np.int32), "value": a.astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, col int, value double")


#: Data type codes of Analyze headers.
ANALYZE = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8"}


def _analyze(header: bytes, image: bytes) -> np.ndarray:
    """The volume of a header and its image, indexed z, y, x; both byte orders are read."""
    order = "<" if int.from_bytes(header[:4], "little") == 348 else ">"
    dims = np.frombuffer(header, f"{order}i2", 8, 40)
    code = int(np.frombuffer(header, f"{order}i2", 1, 70)[0])
    if code not in ANALYZE:
        raise ValueError(f"unknown data type {code}")
    x, y, z = (max(1, int(d)) if k < dims[0] else 1 for k, d in enumerate(dims[1:4]))
    return np.frombuffer(image, f"{order}{ANALYZE[code]}", x * y * z).reshape(z, y, x)


def read_analyze(spark: SparkSession, path: str) -> DataFrame:
    """``path, ix, iy, iz, value`` of the Analyze volumes in a folder: pairs of .hdr and .img; a lone file gives no rows."""

    def run(batches):
        for pdf in batches:
            for p, header, image in zip(pdf["stem"], pdf["header"], pdf["image"], strict=True):
                v = _analyze(header, image)
                z, y, x = np.unravel_index(np.arange(v.size), v.shape)
                yield pd.DataFrame({"path": p, "ix": x.astype(np.int32), "iy": y.astype(np.int32), "iz": z.astype(np.int32), "value": v.ravel().astype(float)})

    files = spark.read.format("binaryFile").load(path)
    part = lambda end, name: files.where(F.col("path").endswith(end)).select(F.regexp_replace("path", r"\.(hdr|img)$", "").alias("stem"), F.col("content").alias(name))
    return part(".hdr", "header").join(part(".img", "image"), "stem").mapInPandas(run, "path string, ix int, iy int, iz int, value double")


def analyze_files(voxels: DataFrame, key: str = "name") -> DataFrame:
    """``name, header, image``: each volume (rows of key, ix, iy, iz, value) as the two files of an Analyze volume of floats."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [pdf[c].to_numpy(int) for c in ("iz", "iy", "ix")]
        v = np.zeros([int(a.max()) + 1 for a in at], "<f4")
        v[tuple(at)] = pdf["value"].to_numpy()
        header = bytearray(348)
        header[0:4] = (348).to_bytes(4, "little")
        header[40:56] = np.array([4, *v.shape[::-1], 1, 0, 0, 0], "<i2").tobytes()
        header[70:74] = np.array([16, 32], "<i2").tobytes()
        return pd.DataFrame({"name": [pdf[key].iloc[0]], "header": [bytes(header)], "image": [v.tobytes()]})

    return voxels.groupBy(key).applyInPandas(run, "name string, header binary, image binary")


def npz_files(cells: DataFrame, key: str = "archive") -> DataFrame:
    """``name, content``: each group of (key, name, dims, index, value) rows as a compressed .npz file, an array per name."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = {}
        for name, part in pdf.groupby("name"):
            a = np.zeros([int(x) for x in part["dims"].iloc[0]])
            a[tuple(np.stack(part["index"].to_list()).T)] = part["value"].to_numpy()
            arrays[str(name)] = a
        out = io.BytesIO()
        np.savez_compressed(out, **arrays)
        return pd.DataFrame({"name": [pdf[key].iloc[0]], "content": [out.getvalue()]})

    return cells.groupBy(key).applyInPandas(run, "name string, content binary")


def npy_files(cells: DataFrame, keys: str = "name") -> DataFrame:
    """``name, content``: each group of (name, dims, index, value) rows as the bytes of a .npy file.

    One array is one group, as an array file is one object; arrays are bounded by their readers' memory.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros([int(x) for x in pdf["dims"].iloc[0]])
        a[tuple(np.stack(pdf["index"].to_list()).T)] = pdf["value"].to_numpy()
        out = io.BytesIO()
        np.save(out, a)
        return pd.DataFrame({"name": [pdf[keys].iloc[0]], "content": [out.getvalue()]})

    return cells.groupBy(keys).applyInPandas(run, "name string, content binary")


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def volume(cells: DataFrame, size: tuple[int, int, int], valid: str = "valid") -> DataFrame:
    """Voxel table ``ix, iy, iz, value, node_id, valid`` from rows with a linear index ``i`` (x fastest)."""
    x, y, _ = size
    i = F.col("i")
    return cells.select(F.pmod(i, F.lit(x)).cast("int").alias("ix"), F.pmod(F.floor(i / x), F.lit(y)).cast("int").alias("iy"), F.floor(i / (x * y)).cast("int").alias("iz"), "value", "node_id", valid)
