"""What the training-data operators share: Arrow batches in and out, words, word hashes."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.session import ship

#: White space that separates words, as a character class: a word is a run of anything else.
SPACE = "\x20\x09-\x0d"
WORD = re.compile(f"[^{SPACE}]+")
#: Rows worked on at a time inside an Arrow batch, so that very long texts don't pile up.
ROWS = 512

Columns = dict[str, list]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, m: int):
    """crc32 of the column as text, mod m; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


def release() -> None:
    """Give memory that a worker no longer uses back to the machine; it may stand idle for the rest of a job."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_columns(df: DataFrame, fn: Callable[[Columns], Columns], schema: str | T.StructType, rows: int = ROWS, once: Callable[[], None] | None = None) -> DataFrame:
    """df's batches as dicts of Python lists through fn; no shuffle, memory bounded by one slice of rows."""
    ship(df.sparkSession)
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if once:
            once()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type, from_pandas=False) for f in arrow], schema=arrow)
                del part, got
            del batch
        release()

    return df.mapInArrow(run, out)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: bytes.split() splits at just the six characters of SPACE."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15
#: Spans of more bytes than this are hashed one at a time, by a cryptographic hash.
LONG_SPAN = 64
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a UTF-8 text."""
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[b]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def eight_bytes(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros stand behind the end."""
    return np.ndarray(len(b) + 1, "<u8", np.concatenate([b, np.zeros(8, np.uint8)]), strides=(1,))


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; a hash depends on the span's bytes alone. Eight bytes at a time are mixed in, which is not linear."""
    size, u = end - start, eight_bytes(b)
    h = mix(size.astype(np.uint64) + np.uint64(_P))
    long = np.flatnonzero(size > LONG_SPAN)
    live, at = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(live):
        part = u[start[live] + at] & _LOW[np.minimum(size[live] - at, 8)]
        with np.errstate(over="ignore"):
            h[live] = mix((h[live] ^ part) * np.uint64(_P))
        at += 8
        live = live[size[live] > at]
    for k in long.tolist():
        h[k] = int.from_bytes(hashlib.blake2b(b[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def distinct_spans(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of byte spans: a first of each, and for each span which it is. Bytes are compared, hashes decide nothing."""
    size, u = end - start, eight_bytes(b)
    one = u[start] & _LOW[np.clip(size, 0, 8)]
    two = np.where(size > 8, u[np.minimum(start + 8, len(b))] & _LOW[np.clip(size - 8, 0, 8)], np.uint64(0))
    with np.errstate(over="ignore"):
        h = mix((one ^ mix(two + size.astype(np.uint64) * np.uint64(_P))) * np.uint64(_P)) >> np.uint64(1)
    if len(long := np.flatnonzero(size > 16)):  # numbered by their bytes, beside all hashes
        seen: dict[bytes, int] = {}
        data = b.tobytes()
        h[long] = np.array([seen.setdefault(data[x:y], len(seen)) for x, y in zip(start[long].tolist(), end[long].tolist(), strict=True)], np.uint64) | np.uint64(1 << 63)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    rep = first[inverse]
    if ((one != one[rep]) | (two != two[rep]) | (size != size[rep])).any():  # two short spans share a hash: never seen
        key = np.column_stack([h, one, two, size.astype(np.uint64)])
        _, first, inverse = np.unique(key, axis=0, return_index=True, return_inverse=True)
    return first, inverse.reshape(-1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and 64-bit hashes of the words of a UTF-8 text."""
    b = np.frombuffer(data, np.uint8)
    start, end = word_bounds(b)
    return start, end, span_hashes(b, start, end)


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def unit_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As word_bounds(), but a full stop or comma that ends a word after a letter or digit stands by itself."""
    start, end = word_bounds(b)
    last, two, three = b[end - 1], b[np.maximum(end - 2, 0)], b[np.maximum(end - 3, 0)]
    letter = _ALNUM[two] | ((three == 0xC3) & (two >= 0x80) & (two != 0x97) & (two != 0xB7) & (end - start > 2))
    cut = np.flatnonzero(((last == 46) | (last == 44)) & letter & (end - start > 1))
    at = end[cut] - 1
    return np.insert(start, cut + 1, at), np.insert(np.where(np.isin(np.arange(len(end)), cut), end - 1, end), cut + 1, end[cut])


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word windows; a text of fewer words has one window of all its words, an empty one none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        h = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            h = h * np.uint64(_P) + words[i : n - k + 1 + i]
    return mix(h ^ np.uint64(k))
