"""What the operators share: reading tables, writing intermediate tables, Arrow batch iteration, bounded samples."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bounds of one Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str, *more: str) -> str:
    """A column name like name that neither df nor more has; names are compared as Spark does, without case."""
    taken = {c.lower() for c in (*df.columns, *more)}
    while name.lower() in taken:
        name += "_"
    return name


# --- Intermediate tables ---------------------------------------------------------------------------------------------

_LOCAL: dict[str, str] = {}
_SCOPES = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A run on one machine may do without; it gets a folder until it ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="fieldmark-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        found = f"file://{_LOCAL[app]}"
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/fieldmark-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    path = f"{_own_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._fieldmark_path = path
    if scopes := getattr(_SCOPES, "open", None):
        scopes[-1].append(back)
    return back


def release(*frames: DataFrame | None) -> None:
    """Delete tables made by materialize() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_fieldmark_path", None):
            _delete(df.sparkSession, path)
            df._fieldmark_path = None


def clear(spark: SparkSession) -> None:
    """Delete what this application has materialised and not released: lazy results read such tables until they are written."""
    _delete(spark, _own_dir(spark))


@contextlib.contextmanager
def scratch(*, keep: Callable[[], DataFrame | None] = lambda: None) -> Iterator[None]:
    """Tables that the block materialises go at its end, but for the one that keep() gives."""
    scopes = _SCOPES.open = getattr(_SCOPES, "open", [])
    scopes.append([])
    try:
        yield
    finally:
        own = scopes.pop()
        kept = keep()
        with contextlib.suppress(Exception):  # what can't be deleted costs room alone
            release(*(x for x in own if x is not kept))
        if kept is not None and scopes:
            scopes[-1].append(kept)


def settle(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """materialize(make()); then the tables that make() has materialised go, as only the result has read them."""
    done: list[DataFrame | None] = [None]
    with scratch(keep=lambda: done[0]):
        done[0] = materialize(make(), tag)
    return done[0]


def give_back() -> None:
    """What the driver's Python has freed goes back to the machine; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# --- Python over Arrow batches ---------------------------------------------------------------------------------------


def bound_batches(spark: SparkSession) -> None:
    """Python workers get batches of bounded rows and bytes, whatever the length of texts.

    Spark reads these settings when a query is planned, so they stay set; a session that has smaller ones keeps them.
    """
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= bound:
            spark.conf.set(key, str(bound))


def map_columns(df: DataFrame, keep: list[str], read: list[str], make: Callable[..., dict], schema: str) -> DataFrame:
    """Columns keep as they are, then what make(*lists of the read columns) returns: a dict of lists, one value a row.

    schema declares the new columns; a column of keep that has the name of one is left out. It is a narrow operation:
    a batch in, a batch out. Between, columns go by their place, so no name of df can clash.
    """
    bound_batches(df.sparkSession)
    added = StructType.fromDDL(schema)
    new = {n.lower() for n in added.names}
    keep = [c for c in keep if c.lower() not in new]
    kept = df.select(*keep).schema
    within = StructType()
    for i, field in enumerate([*kept, *added]):
        within.add(f"c{i}", field.dataType, True)
    arrow, n, names = to_arrow_schema(within), len(keep), added.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(*(batch.column(i + n).to_pylist() for i in range(batch.num_columns - n)))
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(n)]
            columns += [pa.array(made[name], type=arrow.field(n + i).type) for i, name in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    picked = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *[F.col(c).alias(f"r{i}") for i, c in enumerate(read)])
    return picked.mapInArrow(run, within).toDF(*keep, *names)


# --- Folds, samples --------------------------------------------------------------------------------------------------


def id_mod(column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; the folds of the queries."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def bounded_sample(df: DataFrame, by: str, bound: int, key: str, text: str | None = None) -> DataFrame:
    """At most bound different rows of each value of by: those whose hash of (key, text) is least.

    Rows that are equal in by, key and text count once, so an id that repeats, or is null, is neither all of a sample nor
    none of it. All rows are counted, any number of classes, by sketches that are combined before the shuffle; only
    rows under a threshold that leaves about twice the bound are then ranked. The result is the same in every run.
    """
    mark, cls, share, place = (fresh(df, n) for n in ("mark__", "class__", "share__", "place__"))
    rows = df.withColumn(mark, F.xxhash64(F.lit("sample"), F.col(key), *([F.col(text)] if text else [])))
    counts = rows.groupBy(F.col(by).alias(cls)).agg(F.approx_count_distinct(mark, 0.05).alias("n")).where(F.col("n") > bound)
    # Written, so that its size is known and Spark's own check may broadcast it; classes under the bound have no row.
    counts = materialize(counts.select(cls, (F.lit(2.0 * bound) / F.col("n")).alias(share)), "classes")
    unit = F.pmod(F.col(mark), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = rows.join(counts, rows[by].eqNullSafe(counts[cls]), "left").where(unit < F.coalesce(share, F.lit(1.0))).drop(cls, share)
    near = near.dropDuplicates([by, mark])
    order = Window.partitionBy(by).orderBy(F.pmod(F.col(mark), F.lit(1 << 40)), mark)  # some 2 * bound rows
    return near.withColumn(place, F.row_number().over(order)).where(F.col(place) <= bound).drop(mark, place)


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, bound: int) -> tuple[dict[int, int], DataFrame]:
    """Counts of the labels 0 and 1, and label, text, key of at most bound different documents of each.

    The labelled keys are counted and sampled before texts are looked at, so what is joined is bounded: 2 * bound keys, in
    a table whose size Spark knows. Of several labels of one key the greatest counts; a null key has none. A key
    that many documents have is bounded once more, by key and text.
    """
    given = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    given = materialize(given, "labels")
    counts = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = materialize(bounded_sample(given, "label", bound, "key"), "picked")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(picked, "key")
    return counts, bounded_sample(materialize(texts, "labelled"), "label", bound, "key", "text")


def word_count(text: str) -> Column:
    """Number of [^ space, tab..carriage return]+ in the column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
