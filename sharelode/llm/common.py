"""What several operators share: scratch tables, batches of texts, hashes of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sharelode.session import remove, shared_dir

# Text that a Python worker holds as words at once.
SLICE_BYTES = 4 << 20
# Words a worker remembers; beyond that it starts anew.
MEMO_WORDS = 1 << 19

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_SECOND = 0xD6E8FEB86659FD93 | 1


# Folders made within `passing`.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the folder all executors share."""
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Scratch folders that are made in the block are removed at its end, also of a block that fails.

    For steps whose outcome is stored; what the block stores itself goes too, so that has to be
    done by `stored` with a `path` from outside.
    """
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        for path in made:
            remove(spark, path)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write `df` to the shared folder, or to `path`, and go on from the stored rows.

    Lineage ends there, so what follows survives the loss of executors without
    computing it anew, and joins deal both sides out themselves.
    """
    path = path or scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(*tables: DataFrame) -> None:
    """Delete tables of `stored` that nothing reads any more."""
    for table in tables:
        for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            remove(table.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Remove all scratch tables of this application; results made from them end too."""
    remove(spark, f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}")


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """The named columns alone, so that no other column of the input can clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name)
                       for name, c in columns.items()])


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `limit` bytes of `column`; no row is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype=np.int64) // limit
        starts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def word_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after the other, and the number of words of each text."""
    if len(_hashes) > MEMO_WORDS:
        _hashes.clear()
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    return flat, counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(multiplier: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    tables = _powers.get(multiplier)
    if tables is None or len(tables[0]) < size:
        size = 1 << max(16, (size - 1).bit_length())
        inverse = pow(multiplier, -1, 1 << 64)
        made = []
        for m in (multiplier, inverse):
            factors = np.full(size, m, np.uint64)
            factors[0] = 1
            made.append(np.multiply.accumulate(factors))
        tables = _powers[multiplier] = (made[0], made[1])
    return tables


def window_hashes(flat: np.ndarray, length: int, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each `length` consecutive words, by their start in `flat`."""
    n = len(flat) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    multiplier = _SECOND if second else _MULTIPLIER
    power, inverse = _power_tables(multiplier, len(flat))
    words = mix(flat + np.uint64(multiplier)) if second else flat
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[: len(flat)], dtype=np.uint64)])
    return mix((sums[length:] - sums[:-length]) * inverse[:n])


def left_in_text(counts: np.ndarray) -> np.ndarray:
    """For each word of all texts, the words from it to the end of its text."""
    ends = np.cumsum(counts)
    return np.repeat(ends, counts) - np.arange(int(ends[-1]) if len(ends) else 0)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (np.minimum or np.maximum) over each `width` consecutive values."""
    if len(values) < width:
        return values[:0]
    done, result = 1, values
    while done * 2 <= width:
        result = pick(result[:-done], result[done:])
        done *= 2
    if done < width:
        rest = width - done
        result = pick(result[:-rest], result[rest:])
    return result


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values in a row as lists of the given lengths."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
