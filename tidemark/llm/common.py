"""What several operators of this folder share: shared-folder tables, sizes, and Arrow text helpers."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words everywhere in this folder: space and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1
#: Whether Spark deletes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables that saved() has written in the innermost scope() of this thread.
OWN: ContextVar[list[DataFrame] | None] = ContextVar("own", default=None)
#: How many tables are being written at once, and what the setting was before; of each session.
WRITING: dict[int, list] = {}
LOCK = threading.Lock()
#: Longs of marks that among() broadcasts; so many are some 100 million rows and less than 100 MB.
MARKED = 1_600_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, as in tests, may go without one and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: the lineage ends here, and a lost executor costs no more than its own tasks. Shuffle files go once the table is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"
    with cleaned_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    if (own := OWN.get()) is not None:
        own.append(out)
    return out


@contextmanager
def cleaned_up(spark: SparkSession):
    """CLEANUP holds inside; the session's own value comes back when the last of several threads has left."""
    with LOCK:
        state = WRITING.setdefault(id(spark), [0, None])
        if not state[0]:
            state[1] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        state[0] += 1
    try:
        yield
    finally:
        with LOCK:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(CLEANUP, state[1])
                del WRITING[id(spark)]


def discard(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote, once all that was made of them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope():
    """Gives a function keep(*tables): on leaving, the tables saved inside, by this thread, are deleted but for those kept. What other threads or the code around have saved is never touched; kept tables belong to the scope around, if there is one. Where the code inside fails, its tables stay."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    token = OWN.set(own)
    try:
        yield lambda *tables: kept.extend(tables)
    except BaseException:
        OWN.reset(token)
        raise
    OWN.reset(token)
    discard(*[df for df in own if all(df is not k for k in kept)])
    if (around := OWN.get()) is not None:
        around.extend(kept)


def numbered(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """docs (or some of its columns) with a number for each row, `__row`, written so that every reading has the same numbers."""
    chosen = [F.col(f"`{c}`") for c in columns or docs.columns]
    return saved(docs.select(*chosen, F.monotonically_increasing_id().alias("__row")), "numbered")


def among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose number in `column`, as numbered() gives it, is among ids (one column of that name), without moving them: a bit for each row goes to every task, 64 in a long. Beyond MARKED longs the rows are joined by a shuffle."""
    block = lambda: F.shiftright(column, 6).alias("__block")
    place = F.col(column).bitwiseAND(F.lit(63)).cast("int")
    marks = ids.select(column).where(F.col(column).isNotNull()).groupBy(block()).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("__marks"))
    marks = saved(marks, "marks")
    if marks.count() > MARKED:
        return rows.join(ids.select(column).distinct(), column, "left_semi")
    told = rows.withColumn("__block", block()).join(F.broadcast(marks), "__block")
    return told.where(F.call_function("shiftright", "__marks", place).bitwiseAND(F.lit(1)) == 1).select(*[F.col(f"`{c}`") for c in rows.columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Gives memory that a worker has freed back to the system, for the JVM beside it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """One contiguous array with nulls as empty texts. It is a fresh copy: some string kernels misread arrays whose offsets don't begin at zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.large_string())
    return pc.fill_null(column.take(pa.array(np.arange(len(column)))).cast(pa.large_string()), "")


def by_bytes(batch: pa.RecordBatch | pa.Table, column: str, most: int):
    """Slices of a batch with at most `most` bytes of text each, or one row where a row alone has more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def words_of(texts: pa.LargeStringArray, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, vocabulary, offsets): the words of text i are vocabulary[codes[offsets[i]:offsets[i + 1]]]. Only A-Z are lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = pc.dictionary_encode(values)
    codes = np.asarray(coded.indices).astype(np.int64)
    empty = np.flatnonzero(np.asarray(pc.binary_length(coded.dictionary)) == 0)
    if len(empty):  # at the edges of a text
        keep = codes != empty[0]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, coded.dictionary, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashes_of(vocabulary: pa.Array, seed: int) -> np.ndarray:
    """XXH64 of each word's UTF-8 bytes."""
    from xxhash import xxh64_intdigest

    vocabulary = vocabulary.cast(pa.large_binary())
    _, offsets, data = vocabulary.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[vocabulary.offset : vocabulary.offset + len(vocabulary) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    return np.fromiter((xxh64_intdigest(view[a:b], seed) for a, b in zip(ends, ends[1:])), dtype=np.uint64, count=len(vocabulary))


def spans_of(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ..., n - 1 for each n, one after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - lengths, lengths)
