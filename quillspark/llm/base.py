"""Shared pieces of the corpus operators: scratch tables, sized broadcasts and byte-level word splitting.

Intermediate tables are written as Parquet below the folder that the cluster names in ``spark.checkpoint.dir`` and read
back. That cuts lineage, keeps a lost executor from costing more than its running tasks, and gives Spark a true size for
its join choices. A local session without that setting (tests) gets a folder of its own; on a cluster its lack is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: space and the control characters 9 to 13. ``bytes.split()`` splits on the same set.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A key table with at most this many rows (16 bytes each) may be broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 500_000

_UPPER = bytes(range(65, 91))
LOWER_ASCII = bytes.maketrans(_UPPER, _UPPER.lower())

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def release() -> None:
    """Delete every scratch table of this process; frames that still read one must be used up before."""
    while _made:
        with contextlib.suppress(Exception):  # the session may have ended, and its folder with it
            _delete(*_made.pop())


def drop_scratch(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            spark = df.sparkSession
            with contextlib.suppress(ValueError):
                _made.remove((spark, path))
            _delete(spark, path)


def made_tables() -> list[tuple[SparkSession, str]]:
    """The scratch tables that now exist, in the order in which they were written."""
    return list(_made)


def drop_tables(tables: list[tuple[SparkSession, str]]) -> None:
    """Delete these scratch tables, as far as they still exist."""
    for table in tables:
        if table in _made:
            _made.remove(table)
            _delete(*table)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written: it does so once the driver's JVM has
    collected their plans, which otherwise may be long after, while the files of all steps add up on the disks."""
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def scratch_scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end every scratch table written inside it, but for those handed to the function it yields."""
    before, kept = set(p for _, p in _made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._scratch)
        return df

    yield keep
    drop_tables([t for t in made_tables() if t[1] not in before and t[1] not in kept])


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, mbytes: int = 16):
    """Arrow batches small enough that very long texts fit a worker's memory."""
    keys = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(mbytes << 20),
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def restrict(df: DataFrame, keys: DataFrame, on: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``on`` is among the distinct ``keys`` (a scratch table).

    The keys are counted first and broadcast only if they are few; beyond that the rows are joined by shuffling.
    """
    keys = keys.select(on)
    if keys.limit(rows + 1).count() <= rows:
        keys = F.broadcast(keys)
    return df.join(keys, on, "left_semi")


#: Words of 64 bits in the bitmap of :func:`parted`: at most so many rows of two longs are broadcast, whatever comes.
BITMAP_WORDS = 1 << 19


def parted(df: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``on`` may be in ``keys`` (a scratch table), and those whose is not, by a bitmap of fixed size.

    It spares rows the shuffle of the join that follows, whatever the sizes are. With very many keys the bitmap fills up
    and takes all rows for possible ones, which costs time and changes nothing.
    """
    place = F.pmod(F.xxhash64(on), F.lit(BITMAP_WORDS * 64))
    bits = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("__bits"))
    marked = df.withColumns({"__word": F.shiftright(place, 6), "__bit": place.bitwiseAND(F.lit(63)).cast("int")})
    marked = marked.join(F.broadcast(materialize(bits, "bitmap")), "__word", "left")
    maybe = F.coalesce(F.getbit("__bits", F.col("__bit")) == 1, F.lit(False))
    return tuple(marked.filter(c).drop("__word", "__bit", "__bits") for c in (maybe, ~maybe))


def among(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is among the distinct ``keys`` (a scratch table): a shuffle join of those that may be."""
    return parted(df, keys, on)[0].join(keys.select(on), on, "left_semi")


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def only(df: DataFrame, **cols: str) -> DataFrame:
    """A projection under the operator's own names, so that further columns of the input can't clash with them."""
    return df.select(*[F.col(f"`{have}`").alias(name) for name, have in cols.items()])


class WordCodes(dict):
    """Numbers distinct words (bytes) in the order in which they come; ``new`` holds those not yet worked on."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of a batch of texts: a code for each word in order, the number of words of each text, the distinct words.

    Splitting and coding run in Arrow, so Python only sees each distinct word of a batch once. Null counts as empty.
    """
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    distinct, codes = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64)
    counts = np.diff(ends - ends[0])
    blank = distinct.index(b"") if b"" in distinct else -1
    if blank >= 0:  # white space at either end of a text leaves empty parts
        full = codes != blank
        owner = np.repeat(np.arange(len(counts)), counts)
        codes, counts = codes[full], np.bincount(owner[full], minlength=len(counts))
    return codes, counts.astype(np.int64), distinct
