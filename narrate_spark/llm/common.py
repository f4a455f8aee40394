"""Helpers the operators share: tables, stored results, files and words.

Words are cut and hashed with numpy over the bytes of a text.  A word's hash is
a polynomial over its bytes modulo 2**64, taken from running sums, and mixed
afterwards, so a text costs a few array operations and no Python object per word.
"""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# Bytes that end a word: ASCII white space, or everything ASCII but letters and digits.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
# Texts are hashed in blocks of about so many bytes, cut between words.
BLOCK = 1 << 18
# Folders of stored results, and those of the scratch block at hand.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_MADE: contextvars.ContextVar[set[str] | None] = contextvars.ContextVar("made", default=None)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE)
_INV = _powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(kind: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values other than ``gap``."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], edges))
    ends = np.concatenate((edges, [len(kind)]))
    keep = kind[starts] != gap
    return starts[keep], ends[keep]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs [start, end); a run of any length is hashed whole."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        if ends[j - 1] - base > BLOCK:  # one word longer than a block
            value = np.uint64(0)
            for at in range(int(base), int(ends[i]), BLOCK):
                part = data[at : min(at + BLOCK, int(ends[i]))].astype(np.uint64) + np.uint64(1)
                value = value * _POW[BLOCK] + (part * _POW[: len(part)]).sum(dtype=np.uint64)
            out[i] = value
        else:
            part = data[base : ends[j - 1]].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * _POW[: len(part)], out=sums[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (sums[e] - sums[s]) * _INV[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: str | None, gaps: np.ndarray) -> np.ndarray:
    """Hashes of the words of a whole text, A-Z in lower case, in order."""
    with np.errstate(over="ignore"):
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
        starts, ends = runs((~gaps[data]).view(np.uint8))
        return hash_runs(data, starts, ends)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all ``size``-word shingles.

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    if not len(words):
        return words
    size_ = min(size, len(words))
    n = len(words) - size_ + 1
    with np.errstate(over="ignore"):
        out = np.full(n, size_, np.uint64)
        for i in range(size_):
            out = mix(out * np.uint64(_BASE) + words[i : i + n])
    return np.unique(out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors reach.

    It lies in ``spark.checkpoint.dir``.  Only a local master may do without
    that setting; there is one machine then, and a temporary folder is shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write a result into the shared folder and read it again.

    This cuts the lineage: a lost executor costs its running tasks only, and a
    result that is used twice is computed once.  Inside of ``scratch`` the folder
    goes at its end, or with ``drop``, unless it is to be kept.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    made = _MADE.get()
    if made is not None and not keep:
        made.add(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    _FOLDERS[out] = folder
    return out


def scratch_folder(spark: SparkSession) -> str:
    """A new shared folder for files of tasks; inside of ``scratch`` it goes at its end."""
    folder = shared_folder(spark)
    made = _MADE.get()
    if made is not None:
        made.add(folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*results: DataFrame) -> None:
    """Delete the folders of stored results that nothing reads any more."""
    for df in results:
        folder = _FOLDERS.pop(df, None)
        if folder is not None:
            _delete(df.sparkSession, folder)
            if _MADE.get() is not None:
                _MADE.get().discard(folder)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Results stored inside go at the end; what is returned has been stored to be kept."""
    token = _MADE.set(set())
    try:
        yield
    finally:
        for folder in _MADE.get():
            _delete(spark, folder)
        _MADE.reset(token)


def file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder named by path or URI, for use inside tasks."""
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(folder)


def put_file(folder: str, name: str, parts: Iterator[bytes] | list[bytes]) -> str:
    """Write a file under a name of its own and return its full name.

    Each attempt of a task writes another file; readers take only those that a
    finished task has listed.
    """
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(path) as out:
        for part in parts:
            out.write(part)
    return f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"


def get_file(name: str) -> bytes:
    """A whole file of bounded size."""
    folder, _, last = name.rpartition("/")
    fs, root = file_system(folder)
    with fs.open_input_stream(f"{root}/{last}") as f:
        return f.read()


def batch(columns: dict[str, list | np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of the given columns."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
