"""Score arrays that other tools have written: structured score matrices and npy arrays, read in ranges by many tasks."""

from __future__ import annotations

import ast
import json
import os
import shutil
import zipfile

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are read at once.
RANGE = 8 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def write_bytes(path: str, data: bytes) -> None:
    files, at = _open(path)
    files.create_dir(os.path.dirname(at), recursive=True)
    with files.open_output_stream(at) as f:
        f.write(data)


def _read(path: str, start: int = 0, size: int | None = None) -> bytes:
    files, at = _open(path)
    with files.open_input_file(at) as f:
        f.seek(start)
        return f.read(size) if size is not None else f.read()


def _ranges(spark: SparkSession, path: str, start: int, dtype: np.dtype, n: int, rows, schema: str) -> DataFrame:
    """rows(first index, records) -> frame, over n records of dtype that begin at byte `start`."""
    per = max(1, RANGE // dtype.itemsize)
    blocks = -(-n // per)

    def run(batches):
        for pdf in batches:
            for b in pdf["id"]:
                lo = int(b) * per
                data = _read(path, start + lo * dtype.itemsize, min(per, n - lo) * dtype.itemsize)
                yield rows(lo, np.frombuffer(data, dtype=dtype))

    return spark.range(0, blocks, numPartitions=max(1, min(blocks, 4096))).mapInPandas(run, schema)


def _score_info(folder: str) -> tuple[np.dtype, int, list[str]]:
    # The file names and fields of a score folder.
    info = json.loads(_read(f"{folder}/info.json"))
    d = info["dtype"]
    dtype = np.dtype({"names": d["names"], "formats": d["formats"], "offsets": d["offsets"], "itemsize": d["itemsize"]})
    return dtype, int(info["num_items"]), [c for c in d["names"] if c.startswith("score_")]


def score_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (train_idx, pair_idx, score_good, score_bad) of scores.bin as info.json describes it: a
    record for each training row, whose fields score_2j and score_2j+1 are the good and the bad text of pair j."""
    dtype, n, names = _score_info(folder)
    pairs = len(names) // 2

    def rows(lo: int, records: np.ndarray) -> pd.DataFrame:
        sides = [np.stack([records[f"score_{2 * j + s}"] for j in range(pairs)], axis=1).astype(np.float64).ravel() if pairs else np.zeros(0) for s in (0, 1)]
        at = np.arange(lo, lo + len(records))
        return pd.DataFrame({"train_idx": np.repeat(at, pairs), "pair_idx": np.tile(np.arange(pairs), len(at)), "score_good": sides[0], "score_bad": sides[1]})

    return _ranges(spark, f"{folder}/scores.bin", 0, dtype, n, rows, "train_idx long, pair_idx long, score_good double, score_bad double")


def single_score(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (train_idx, score) of a score folder with exactly one score field."""
    dtype, n, names = _score_info(folder)
    if len(names) != 1:
        raise ValueError(f"one score field is needed, not {names}")
    return _ranges(
        spark, f"{folder}/scores.bin", 0, dtype, n,
        lambda lo, r: pd.DataFrame({"train_idx": np.arange(lo, lo + len(r)), "score": r[names[0]].astype(np.float64)}), "train_idx long, score double",
    )


def unpack(path: str, folder: str) -> None:
    """Write the arrays of an npz file as npy files under folder, unless they are there."""
    files, at = _open(path)
    with files.open_input_file(at) as packed, zipfile.ZipFile(packed) as z:
        for name in z.namelist():
            there, to = _open(f"{folder}/{name}")
            if there.get_file_info(to).type == pafs.FileType.NotFound:
                there.create_dir(os.path.dirname(to), recursive=True)
                with z.open(name) as source, there.open_output_stream(to + ".part") as out:
                    shutil.copyfileobj(source, out, RANGE)
                there.move(to + ".part", to)


def array_values(spark: SparkSession, path: str, column: str = "value") -> DataFrame:
    """Rows (idx, column) of a one-dimensional npy file."""
    head = _read(path, 0, 12)
    wide = head[6] > 1
    size = int.from_bytes(head[8 : 12 if wide else 10], "little")
    start = (12 if wide else 10) + size
    found = ast.literal_eval(_read(path, start - size, size).decode("latin-1"))
    dtype, shape = np.dtype(found["descr"]), found["shape"]
    if len(shape) != 1:
        raise ValueError(f"one dimension is needed, not {shape}")
    return _ranges(spark, path, start, dtype, shape[0], lambda lo, v: pd.DataFrame({"idx": np.arange(lo, lo + len(v)), column: v.astype(np.float64)}), f"idx long, `{column}` double")


def contrasts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (part, pair_idx, row, delta_i) of unpacked contrast statistics: dx and base hold a stretch for each pair."""
    pairs = int(np.frombuffer(_read(f"{folder}/n_pairs.npy")[-8:], dtype=np.int64)[0])
    out = None
    for part in ("dx", "base"):
        rows = array_values(spark, f"{folder}/{part}.npy", "delta_i")
        n = _length(f"{folder}/{part}.npy") // max(pairs, 1)
        rows = rows.select(F.lit(part).alias("part"), F.floor(F.col("idx") / max(n, 1)).alias("pair_idx"), F.pmod("idx", F.lit(max(n, 1))).alias("row"), "delta_i")
        out = rows if out is None else out.unionByName(rows)
    return out


def _length(path: str) -> int:
    head = _read(path, 0, 4096)
    size = int.from_bytes(head[8 : 12 if head[6] > 1 else 10], "little")
    at = 12 if head[6] > 1 else 10
    return ast.literal_eval(head[at : at + size].decode("latin-1"))["shape"][0]
