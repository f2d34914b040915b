"""Words, word hashes and document keys shared by the corpus operators.

A *word* is a maximal run of bytes other than space and ``\\t``..``\\r``
(``[^\\x20\\x09-\\x0D]+``).  All of these separators are single bytes in UTF-8,
so words can be found on the raw bytes of an Arrow string column, and numpy can
hash every word of a block of documents without a Python loop over words.

Inside ``mapInArrow`` tasks the helpers below work on blocks of rows whose text
is about ``BLOCK_BYTES`` long, so a task's memory does not follow the size of
its partition.  Null texts count as empty texts everywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Letters and digits as plain ranges: classes of Unicode categories cost a lookup for each character.
LETTERS = r"0-9A-Za-z\x{C0}-\x{1FFF}\x{2C00}-\x{D7FF}\x{F900}-\x{FFFD}\x{10000}-\x{10FFFF}"

BLOCK_BYTES = 4 << 20
#: Bytes of rows to a file, where a table's size is known before it is written.
FILE_BYTES = 8 << 20
#: Bytes whose words are hashed at once; running sums and powers take 8 bytes for each.
HASH_STEP = 1 << 19

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1B54A32D192ED03 | 1
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or one below the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints").rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: losing an executor later costs a read, not a rerun.
    Tables that the returned plan reads stay until the folder's owner clears it;
    an operator drops those of its inner rounds by ``drop_tables``.
    """
    path = f"{shared_folder(df.sparkSession)}/slotweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_for(spark: SparkSession, most: int) -> int:
    """Files that ``most`` bytes of rows ask for; one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-most // FILE_BYTES))


def in_few(df: DataFrame, most: int) -> DataFrame:
    """``df``, of which about ``most`` bytes of rows or less will come, in no more partitions than these ask for.

    Else a table is written by one task for each shuffle partition, however few its rows.
    In a local folder Hadoop launches three processes (``chmod``) for every file, and until
    such a process has begun it counts as a second executor where memory is watched.
    """
    return df.coalesce(files_for(df.sparkSession, most))


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that ``checkpoint`` has written and that no plan needs any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if folder.rpartition("/")[2].startswith("slotweave-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spaced(text: Column) -> Column:
    """Text with a space for each separator (null: empty); much cheaper than a pattern over the whole text."""
    out = F.coalesce(text, F.lit(""))
    for separator in "\n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(separator), F.lit(" "))
    return out


def broadcast_below(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``most`` rows (it is counted), else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole value."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = [base % 2**64, pow(base, -1, 2**64)]
        self.tables = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        for k in (0, 1):
            while len(self.tables[k]) < n:
                t = self.tables[k]
                step = U64(pow(self.base[k], len(t), 2**64))
                self.tables[k] = np.concatenate([t, t * step])
        return self.tables[0], self.tables[1]


_BYTE_POWERS = _Powers(_BASE)
_WORD_POWERS = _Powers(_WORD_BASE)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets start at 0; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", max_rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about BLOCK_BYTES of text (one row at least).

    Behind the last one Arrow gives back what it holds for more: a worker outlives its task.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = string_buffers(column)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1
            to = min(max(to, at + 1), at + max_rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    batch = column = _ = None
    pa.default_memory_pool().release_unused()


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, and each row's bounds among them."""
    if lower:
        data = _LOWER[data]
    inside = ~_IS_SEP[data]
    n = len(data)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    out = np.empty(len(starts), dtype=U64)
    at = 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + HASH_STEP, side="right")), at + 1)
        low, high = starts[at], ends[to - 1]
        up, down = _BYTE_POWERS.upto(int(high - low) + 1)
        sums = np.zeros(int(high - low) + 1, dtype=U64)
        np.cumsum((data[low:high].astype(U64) + U64(1)) * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xA0761D6478BD642F))
        at = to
    return out, np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``size`` consecutive words.

    The hash is a polynomial in the word hashes modulo 2**64, taken from prefix
    sums, so each window costs the same whatever its length.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.empty(n, dtype=U64)
    step = 1 << 19
    for at in range(0, n, step):
        to = min(n, at + step)
        part = words[at : to + size - 1]
        up, down = _WORD_POWERS.upto(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[at:to] = mix((sums[size:] - sums[:-size]) * down[: to - at] + U64(size))
    return out


def starts_of_windows(bounds: np.ndarray, size: int, total: int) -> np.ndarray:
    """Mask of the word positions at which a window of ``size`` words of one row starts."""
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(total)
    return room[: max(0, total - size + 1)] >= size


def int_array(column: pa.Array, null: int) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def shuffle_buckets(spark: SparkSession, factor: int = 4) -> int:
    """Number of hash buckets for a packed exchange: follows the session's shuffle width."""
    return factor * int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buckets(docs: DataFrame, factor: int = 4, most: int = 32 << 20) -> int:
    """The same for buckets that are held in memory one at a time: as many more as leave about ``most`` bytes of text to each."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_buckets(docs.sparkSession, factor), total // most)
