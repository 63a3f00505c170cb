"""What the training-data operators share: reading tables, cutting lineage, bounded text batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points of the ASCII white space that separates words.
SPACES = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; one of our own only for a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    return _own.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='tessera-shared-')}")


_own: dict[str, str] = {}


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither recompute it nor depend on an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in {name.rsplit("/", 1)[0] for name in df.inputFiles() if "/settled-" in name}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a sieve, at most (32 MB), and bits for each key as long as they suffice.
SIEVE_BITS, SIEVE_PER_KEY, SIEVE_WORD = 2**28, 16, 32_768


def sieve(rows: DataFrame, keys: DataFrame, hashed: str, out: str) -> DataFrame:
    """``rows`` with ``out``: whether their long ``hashed`` may be among ``keys``' (true for each that is, and for some six in a hundred others).

    A bitmap of hashed keys, of a size that follows their number up to ``SIEVE_BITS``, is broadcast and looked up before anything is
    shuffled; an equal join is to follow.  With so many keys that the bitmap would let nearly all rows pass, all rows do.
    """
    n = keys.count()
    if n > 2 * SIEVE_BITS:
        return rows.withColumn(out, F.lit(True))
    bits = SIEVE_WORD
    while bits < min(SIEVE_BITS, SIEVE_PER_KEY * n):
        bits *= 2
    slot = F.pmod(F.col(hashed), F.lit(bits))
    words = keys.select((slot / SIEVE_WORD).cast("int").alias("_word"), (slot % SIEVE_WORD).alias("_bit")).groupBy("_word").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    at = slot % SIEVE_WORD
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn("_word", (slot / SIEVE_WORD).cast("int")).join(F.broadcast(words), "_word", "left").withColumn(out, hit).drop("_word", "_bits")


def sieved(rows: DataFrame, keys: DataFrame, hashed: str = "hashed") -> DataFrame:
    """The rows that may be among ``keys``."""
    return sieve(rows, keys, hashed, "_maybe").where("_maybe").drop("_maybe")


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def text_key(text: str = "text") -> Column:
    """16 bytes that stand for a whole text; a null text counts as empty."""
    return F.unhex(F.md5(whole_text(text).cast("binary")))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text falls into fold 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def in_pieces(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``max_bytes`` of text each, or one row."""
    import numpy as np

    for batch in batches:
        sizes = np.array([0 if s is None else s for s in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def text_bytes(column: pa.Array):
    """The UTF-8 bytes of all rows in one array, and the rows' bounds in it; nulls are empty."""
    import numpy as np

    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def give_back() -> None:
    """Memory that a task of a Python worker has freed goes back to the system: workers live on, for other tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def frugal(run: Callable) -> Callable:
    """``run`` of a task's batches, giving memory back at its end."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def by_text(df: DataFrame, work: Callable, schema: str, max_bytes: int = 2_000_000, column: str = "text") -> DataFrame:
    """``work(piece) -> dict of columns`` over bounded pieces of Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for piece in in_pieces(batches, column, max_bytes):
            made = work(piece)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) if not isinstance(made[f.name], pa.Array) else made[f.name].cast(f.type) for f in out], names=out.names)

    return df.mapInArrow(frugal(run), schema)


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most 1,000 rows and 8 MB at a time.

    Queries and stages that own their session call this; operators leave the session as it is and work with batches of any size.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
