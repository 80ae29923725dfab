"""Helpers shared by the training-data operators: shared tables, Arrow chunks and rolling hashes."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.sources.scratch import materialize, shared_dir  # noqa: F401 (for the other modules here)

#: Bytes that end a word: space and \t \n \v \f \r.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Java and DuckDB pattern of one word.
WORD = r"[^\x20\x09-\x0D]+"


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32) if len(column) else np.zeros(1, np.int64)
    offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2] if len(column) else None
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, column: str = "text", most: int = 1 << 18):
    """Slices of record batches whose text holds about `most` bytes; a longer text stands alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = bytes_of(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _trim() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


#: Rows that Spark hands to Python at once: texts are long, and both sides hold a batch and its copy.
BATCH_ROWS = 1000


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), after which the Python worker, which is kept for later tasks, holds no freed memory.

    Where the session has Spark's own 10,000 rows a batch, it gets BATCH_ROWS.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, str(BATCH_ROWS))

    def held(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return df.mapInArrow(held, schema)


def pick(batch, *names):
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


class Roll:
    """Polynomial hashes modulo 2**64 of any byte span, from one running sum.

    Byte b at place i adds table[b] * m**i; the span's sum is divided by m**start. `lower` folds A-Z.
    """

    def __init__(self, seed: int, lower: bool = False, size: int = 256):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            self.table[65:91] = self.table[97:123]
        self.m = int(rng.integers(2**60, 2**62)) * 8 + 5
        self.inverse = pow(self.m, -1, 2**64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers), 1 << 16)
            for name, base in (("powers", self.m), ("inverses", self.inverse)):
                steps = np.full(n, np.uint64(base % 2**64))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.inverses[start])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each document (n + 1 numbers)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.ones(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    inside[0] = inside[-1] = False
    body = inside[1:-1]
    begins = body & ~inside[:-2]
    ends = body & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = body[cut]
    ends[cut - 1] = body[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)



class HashCache:
    """Values by 64-bit key in sorted arrays; cleared when it holds `most` keys, so memory is bounded."""

    def __init__(self, width: int, dtype, most: int = 1_000_000):
        self.width, self.dtype, self.most = width, dtype, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, self.width), self.dtype)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and whether each key is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: sorted, not yet there."""
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values, axis=0)


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit table as bytes, that has every id of the column; other ids may hit by chance.

    It has 16 bits an id, 128 KB at least and 16 MB at most, whatever the input. Full tables let all rows through, which
    costs shuffle but changes no result.
    """
    table = bit_table(ids, column, least=32).toArrow()
    rows = table.column("rows")[0].as_py() if table.num_rows else 32
    out = np.zeros((rows, ROW_OF_BITS // 8), np.uint8)
    for at, bits in zip(table.column("bucket").to_pylist(), table.column("bits")):
        out[at] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.ravel()


def _filtered(docs: DataFrame, hits: np.ndarray) -> tuple[DataFrame, object]:
    shared = docs.sparkSession.sparkContext.broadcast(hits)
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(8 * len(hits))).alias("h")), shared


def _hit(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (table[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1


def without(docs: DataFrame, hits: np.ndarray) -> DataFrame:
    """doc_id, text of the rows that the filter does not hit."""
    rows, shared = _filtered(docs, hits)

    def run(batches):
        for batch in batches:
            out = batch.filter(pa.array(~_hit(shared.value, batch.column(2).to_numpy())))
            yield out.select(["doc_id", "text"])

    return map_batches(rows, run, "doc_id long, text string")


def packed(docs: DataFrame, hits: np.ndarray) -> DataFrame:
    """doc_id, size, z: the rows that the filter hits, their UTF-8 text compressed one by one, so that shuffles are small."""
    rows, shared = _filtered(docs, hits)

    def run(batches):
        codec = pa.Codec("zstd", 1)
        for batch in chunks(batches):
            batch = batch.filter(pa.array(_hit(shared.value, batch.column(2).to_numpy())))
            data, offsets = bytes_of(batch.column(1))
            blobs = [codec.compress(data[a:b].tobytes(), asbytes=True) if b > a else b"" for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(blobs, pa.binary())], ["doc_id", "size", "z"])

    return map_batches(rows, run, "doc_id long, size long, z binary")


def unpacked(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


#: Bits of one row of a bit table, and its most rows (16 MB in all).
ROW_OF_BITS, MOST_ROWS = 1 << 15, 4096


def bit_table(ids: DataFrame, column: str, least: int = 1) -> DataFrame:
    """(bucket, bits, rows): a bit for the hash of each id, 16 bits an id, never above 16 MB whatever the input; other ids may hit by chance."""
    n = ids.agg(F.approx_count_distinct(column)).first()[0]
    rows = max(least, min(MOST_ROWS, 1 << (16 * n // ROW_OF_BITS).bit_length()))
    h = F.pmod(F.xxhash64(column), F.lit(rows * ROW_OF_BITS))
    at = ids.select(F.shiftright(h, 15).alias("bucket"), (h % ROW_OF_BITS).alias("bit"))
    return materialize(at.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))).withColumn("rows", F.lit(rows))


def with_hits(df: DataFrame, table: DataFrame, column: str, name: str = "hit__") -> DataFrame:
    """df with whether the bit table hits the column: a broadcast of at most 16 MB, no shuffle and no Python."""
    rows = table.select("rows").limit(1).collect()
    h = F.pmod(F.xxhash64(column), F.lit((rows[0][0] if rows else 1) * ROW_OF_BITS))
    keyed = df.withColumns({"bucket__": F.shiftright(h, 15), "bit__": h % ROW_OF_BITS})
    bits = F.broadcast(table.select(F.col("bucket").alias("bucket__"), F.col("bits").alias("bits__")))
    byte = F.conv(F.hex(F.substring("bits__", (F.shiftright("bit__", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("bit__") % 8).cast("int")) == 1, F.lit(False))
    return keyed.join(bits, "bucket__", "left").withColumn(name, hit).drop("bucket__", "bit__", "bits__")


#: Keys with this share of all rows or more are heavy: there are at most as many as its inverse.
HEAVY = 1000


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], count: str) -> DataFrame:
    """rows with the columns of table (one row a key, `count`: how many of rows have it); rows without a key there go.

    Keys that hold a thousandth of the rows or more, at most 1000 of them, are broadcast, so that no task gets all rows
    of a very common key; the others are joined by key. Both tables should be written ones, as they are read twice.
    """
    least = rows.count() / HEAVY
    heavy, light = table.where(F.col(count) >= least), table.where(F.col(count) < least)
    keys = F.broadcast(heavy.select(*on))
    return rows.join(F.broadcast(heavy), on).unionByName(rows.join(keys, on, "left_anti").join(light, on))
