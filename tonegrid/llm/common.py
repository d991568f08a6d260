"""What the corpus operators share: shared-folder tables, joins with a checked broadcast, text in Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows up to which a side of a few narrow columns is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Texts are worked on in slices of about so many bytes, so that a task's memory doesn't follow the batch size.
SLICE_BYTES = 1 << 20

#: What separates words everywhere here: space and the ASCII controls 9 to 13, as ``bytes.split()`` does.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables written by ``cut``: all, and those of the scope that is open.
_WRITTEN: set[str] = set()
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A local session without one gets a temporary folder of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="tonegrid-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, so a lost executor
    costs a re-read at most, and branches that follow share the work."""
    path = f"{shared_dir(df.sparkSession)}/tonegrid/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN.add(path)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    made.cut_path = path
    return made


def forget(*made: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote, once nothing reads them any more."""
    _delete(made[0].sparkSession, [t.cut_path for t in made])


def forget_all(spark: SparkSession) -> None:
    """Deletes all tables that ``cut`` wrote in this process and that are left. Results of operators read such tables
    when they are computed, so this is for the time after their last use."""
    _delete(spark, list(_WRITTEN))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that ``cut`` writes inside are deleted at the end, but for those put into the list it gives."""
    kept, own = [], []
    token = _SCOPE.set(own)
    try:
        yield kept
    finally:
        _SCOPE.reset(token)
    left = {t.cut_path for t in kept}
    if (outer := _SCOPE.get()) is not None:
        outer.extend(left)
    _delete(spark, [p for p in own if p not in left])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
        _WRITTEN.discard(p)


def quoted(name: str) -> str:
    """A column's name as an expression reads it, dots and all."""
    return f"`{name.replace('`', '``')}`"


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names with as many underscores before them as it takes to be none of ``columns``, in any case."""
    taken, lead = {c.lower() for c in columns}, "__"
    while any(lead + n in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def checked_broadcast(small: DataFrame, rows: int | None = None) -> DataFrame:
    """small with a broadcast hint if it has at most BROADCAST_ROWS rows (counted here unless given)."""
    n = small.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(small) if n <= BROADCAST_ROWS else small


def drop_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return _filtered(df, keys, on, "left_anti")


def keep_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return _filtered(df, keys, on, "left_semi")


def _filtered(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    own = unused(df.columns, *[f"k{i}" for i in range(len(on))])
    small = keys.toDF(*own)
    same = [F.col(quoted(c)).eqNullSafe(F.col(k)) for c, k in zip(on, own)]
    return df.join(checked_broadcast(small), same, how)


#: Slices that the rows of one key are dealt into where a join could bring very many of them together.
SLICES = 8
#: Bits a key has in a bit filter, and the most bits of one (32 MB as a broadcast).
KEY_BITS, MOST_BITS = 16, 1 << 28


def likely_in(df: DataFrame, on: list[Column], keys: DataFrame, key: list[Column], name: str = "likely") -> DataFrame:
    """df with a flag of that name: true where its key is among those of ``keys``, and for one in 16 or fewer of the others.

    Each key sets one bit of a bit map, which is broadcast in pieces of 4 KB. The map has a fixed bound; past 16
    million keys more and more others are taken for likely, which costs work but no row.
    """
    bits = min(MOST_BITS, max(1 << 15, 1 << (KEY_BITS * keys.count()).bit_length()))
    place = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(bits)) + 1
    piece, bit, held_bits, at = unused(df.columns, "piece", "bit", "held", "at")
    built = keys.select(place(key).alias(at)).groupBy(F.bitmap_bucket_number(at).alias(piece)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(held_bits))
    placed = df.withColumn(at, place(on)).withColumn(piece, F.bitmap_bucket_number(at)).withColumn(bit, F.bitmap_bit_position(at))
    byte = F.conv(F.hex(F.substring(held_bits, (F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.col(bit).cast("int") % 8) == 1, F.lit(False))
    return placed.join(F.broadcast(built), piece, "left").withColumn(name, hit).drop(piece, bit, held_bits, at)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of at most ``most`` bytes together, or of one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


#: Things that a Python worker holds at a time, each with a bound of its own.
MOST_HELD = 1
_HELD: dict = {}


def held(key: object, build: Callable) -> object:
    """What ``build()`` made in this Python worker for the key. A worker serves many tasks, of several operators one
    after another, and holds the last MOST_HELD such things, so what one operator remembers doesn't add up with others."""
    if key not in _HELD:
        while len(_HELD) >= MOST_HELD:
            del _HELD[next(iter(_HELD))]
        _HELD[key] = build()
    return _HELD[key]


def map_text(df: DataFrame, text: str, keep: list[str], fields: str, make: Callable[[], Callable], also: list[str] = ()) -> DataFrame:
    """The columns ``keep``, and those of ``fields`` (DDL) computed from whole texts.

    ``make()`` is called once in each task and returns a function of a list of texts (UTF-8 bytes, None for
    null), and of a list of values for each column in ``also``, that returns a column for each field. A text that is
    itself kept goes to Python once.
    """
    new = StructType.fromDDL(fields).fields
    own = [] if text in keep else [F.col(quoted(text)).cast("string")]
    given = [*[F.col(quoted(c)) for c in keep], *own, *[F.col(quoted(c)) for c in also]]
    given = df.select([c.alias(f"c{i}") for i, c in enumerate(given)])  # names that any column may have had don't matter inside
    whole = given.schema.fields[: len(keep)] + [StructField(f"n{i}", f.dataType) for i, f in enumerate(new)]
    place, first = keep.index(text) if text in keep else len(keep), len(keep) + len(own)
    types, names = [f.dataType for f in new], [f.name for f in whole]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(t) for t in types]
        work = make()
        for batch in batches:
            raw = batch.column(place)
            raw = raw.cast(pa.large_binary() if pa.types.is_large_string(raw.type) else pa.binary())
            sizes = [x or 0 for x in pc.binary_length(raw).to_pylist()] if len(raw) else []
            for a, b in slices(sizes, SLICE_BYTES):
                others = [batch.column(first + i).slice(a, b - a).to_pylist() for i in range(len(also))]
                made = work(raw.slice(a, b - a).to_pylist(), *others)
                cols = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for t, c in zip(arrow, made, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(keep))] + cols, names=names)
        pa.default_memory_pool().release_unused()  # the worker lives on; what Arrow freed goes back

    return given.mapInArrow(run, StructType(whole)).toDF(*keep, *[f.name for f in new])
