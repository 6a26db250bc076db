"""What the operators of this subpackage share: registration, table access, word splitting, ragged arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.session import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Named columns of a table; other columns it may have are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once, compressed, to the shared folder and scan it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_in_buckets(df: DataFrame, name: str, column: str, n: int) -> DataFrame:
    """As ``keep``, in ``n`` buckets by ``column``: joins and groups on it leave these rows where they are."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    entry = f"spark_catalog.default.tabweave_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, column).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")  # the name only: the files are the scan's
    return out


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores in front that no column of ``df`` has them, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    lead = "_"
    while any(f"{lead}{n}".lower() in taken for n in names):
        lead += "_"
    return [f"{lead}{n}" for n in names]


def text_key(col: str = "text") -> Column:
    """64-bit key of a text's bytes; null texts share one key."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("\0null")))


def rows_of(n_total: int, per_group: int, least: int = 1) -> int:
    """Number of groups of about ``per_group`` rows."""
    return max(least, -(-n_total // per_group))


# ---- numpy and Arrow inside tasks


def trim() -> None:
    """Give freed memory back to the system; a worker's allocators would keep it for the worker's life."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(fn):
    """A task over batches that gives back its memory when it ends."""

    def run(batches):
        yield from fn(batches)
        trim()

    return run


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: offsets per text and all words in a row.

    Null texts have no words.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    filled = pc.greater(pc.binary_length(words), 0)
    if not pc.all(filled).as_py():  # leading or trailing space gives empty strings
        mask = filled.to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(mask)])[offsets]
        words = words.filter(filled)
    return offsets, words


def hash_strings(values: np.ndarray) -> np.ndarray:
    """64-bit hashes of an object array of strings, the same in every process."""
    from pandas.util import hash_array

    return hash_array(values, categorize=False) if len(values) else np.zeros(0, np.uint64)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets per text, word codes, and the 64-bit hash of each code's word."""
    offsets, words = words_of(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return offsets, codes, hash_strings(coded.dictionary.to_numpy(zero_copy_only=False))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes, by doubling; len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, have, power, span, rest = None, 0, h, 1, k
    while rest:
        if rest & 1:
            n = len(h) - k + 1
            part = power[have : have + n]
            out = part if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
            have += span
        rest >>= 1
        if rest:
            power = mix(power[:-span] * np.uint64(0xD6E8FEB86659FD93) + power[span:])
            span *= 2
    return out


def pieces(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + length[i] - 1 for all i in a row."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - length), length)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def batches_by_bytes(batches, column: str, limit: int = 8 << 20):
    """Join or cut incoming Arrow batches into tables of about ``limit`` bytes of ``column`` (never inside a row)."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        widths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff((size + np.cumsum(widths.astype(np.int64))) // limit)) + 1
        at = 0
        for end in [*cut.tolist(), batch.num_rows]:
            held.append(batch.slice(at, end - at))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            at = end
        size = sum(int(pc.sum(pc.fill_null(pc.binary_length(b.column(column)), 0)).as_py() or 0) for b in held)
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column_of(data: pa.Table, name: str) -> pa.Array:
    """A column as one array that begins at the start of its buffers (string kernels misread slices)."""
    chunks = data.column(name)
    whole = chunks.combine_chunks() if isinstance(chunks, pa.ChunkedArray) else chunks
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], chunks.type)
    return whole.take(pa.array(np.arange(len(whole)))) if whole.offset else whole
