"""Vectorised work on Arrow batches of whole texts: byte views, words and their hashes.

A batch is cut into slices of about :data:`SLICE_BYTES` so that the arrays of a task stay
small whatever the batch holds; a text is never cut here.  Null texts count as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def _worker_kept() -> dict[str, object]:
    return sys.modules.setdefault("pairlens_worker_kept", types.ModuleType("pairlens_worker_kept")).__dict__.setdefault("kept", {})


class WorkerKept(dict):
    """One and the same for all tasks of a Python worker.

    Functions reach the workers by value, each task's with globals of its own; only a module outlives the task.
    """

    def __reduce__(self):
        return _worker_kept, ()


#: What the operator that ran last in this Python worker keeps for its further tasks.
worker_kept: dict[str, object] = WorkerKept()


def release(kept: bool = True) -> None:
    """Give unused memory back to the system, with ``kept`` also what an operator keeps for its tasks.

    Spark's Python workers outlive tasks and stages.  What the allocators hold back from one operator
    would stand beside the memory of all later ones, also of those that run no Python.
    """
    _powers.clear()
    if kept:
        worker_kept.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit words that depend only on ``seed``."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD + mix(np.array([seed], np.uint64) * _GOLD + _GOLD))


_BYTE_CODES = stream(17, 256)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_word_table() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = False
    return table


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is not None and len(have) >= n:
        return have[:n], _powers["down"][:n]
    size = max(n, SLICE_BYTES + 1)
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for step in (_BASE, inverse):
        a = np.full(size, step, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    if size <= 4 * SLICE_BYTES:
        _powers["up"], _powers["down"] = out
    return out[0][:n], out[1][:n]


class Texts:
    """UTF-8 bytes of consecutive texts with their offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


class Words:
    """Lower-cased words of a slice: byte ranges, 64-bit hashes and each text's range of words."""

    def __init__(self, texts: Texts, is_word: np.ndarray | None = None):
        table = space_word_table() if is_word is None else is_word
        data, offsets = lower_table()[texts.data], texts.offsets
        n = len(data)
        inside = table[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = False
        after[edges - 1] = False
        self.data = data
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * up[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + _GOLD)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(column: pa.Array) -> Texts:
    """The bytes of a string column without a copy per text; null as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offset_buffer, data_buffer = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offset_buffer, np.int64, n + 1, column.offset * 8) if offset_buffer and offset_buffer.size else np.zeros(n + 1, np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer and data_buffer.size else np.empty(0, np.uint8)
    return Texts(data[offsets[0]:offsets[-1]], offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut a batch between rows so that a slice holds at most ``limit`` bytes, or one row."""
    texts = text_bytes(batch.column(column))
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(texts.offsets, texts.offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), len(texts))
        lo, hi = texts.offsets[start], texts.offsets[end]
        yield batch.slice(start, end - start), Texts(texts.data[lo:hi], texts.offsets[start:end + 1] - lo)
        start = end


def over_texts(df: DataFrame, column: str, fields: list[tuple[str, str]], fn: Callable[[Texts], list], passing: list[str] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """Add columns computed from whole texts: ``fn`` maps a slice to one array per field.

    Only ``passing`` (all columns when not given) goes along; a column of the same name as
    a new field is replaced by it.
    """
    keep = [c for c in (df.columns if passing is None else passing) if c not in {n for n, _ in fields}]
    sent = df.select(*keep, F.col(quoted(column)).alias("__text")) if column not in keep else df.select(*map(quoted, keep))
    source = column if column in keep else "__text"
    by_name = {f.name: f for f in sent.schema.fields}
    schema = T.StructType([by_name[c] for c in keep] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # of another operator's
        batch = part = texts = made = None
        for batch in batches:
            for part, texts in slices(batch, source, limit):
                made = [a if isinstance(a, pa.Array) else pa.array(a) for a in fn(texts)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, names=keep + [n for n, _ in fields])
        del batch, part, texts, made
        release()

    return sent.mapInArrow(run, schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fold(column, modulus: int):
    """crc32 of the value's text modulo ``modulus``; 0 for null."""
    return F.pmod(F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)), F.lit(modulus))


def crc_fold(value, modulus: int) -> int:
    return zlib.crc32(str(value).encode()) % modulus
