"""What the operators share: scratch tables in the shared folder and Arrow maps over texts."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch at most; very long texts make batches of more rows too large.
BATCH_ROWS = 512
#: Rows of batches that are put together, at most.
TOGETHER_ROWS = 1 << 14

_local_root: str | None = None
_released: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master, as in tests, may do without that setting; it gets a
    temporary folder. On a cluster a missing setting is an error, as a folder of
    one machine would not be seen by the others. What an application leaves there goes
    when it ends; :func:`release` deletes it before.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        own = f"{root.rstrip('/')}/colloquy-{spark.sparkContext.applicationId}"
        if own not in _released:
            _released.add(own)
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        return own
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="colloquy-")
        atexit.register(shutil.rmtree, _local_root, True)
    return f"file://{_local_root}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below :func:`shared_root`."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage, and lost executors only repeat the reading of it.
    The shuffle files behind it go as soon as it is written.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffle_cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of the queries run inside once they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Units(dict):
    """A bounded memo of ``compute`` by short strings: two generations of ``limit`` entries each."""

    def __init__(self, compute: Callable, limit: int = 100_000, longest: int = 32):
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def dropped(table: DataFrame) -> None:
    """Delete a table of :func:`written`; all its readers must be done."""
    _delete(table.sparkSession, table.shared_path)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; their readers must be done."""
    _delete(spark, shared_root(spark))


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_kept: dict[str, object] = {}


def kept(key: str, build: Callable) -> object:
    """What a Python worker keeps from task to task: one object, which gives way to another key's."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def forget() -> None:
    """Free what is kept; operators that keep nothing call it, as workers serve all of them in turn."""
    _kept.clear()


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """Names for columns on the way that no column has."""
    taken = {c.lower() for c in columns}
    return [next(f"_{'_' * k}{name}" for k in range(len(taken) + 1) if f"_{'_' * k}{name}" not in taken) for name in names]


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to :data:`BATCH_ROWS` rows, so that long texts fit in memory.

    Spark reads the setting when a query runs, not when it is built, so the session keeps
    it; a smaller one of the user's own stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most that many bytes and :data:`TOGETHER_ROWS` rows; larger batches stay as they are."""
    held, n_bytes, n_rows = [], 0, 0
    for batch in batches:
        if held and (n_bytes + batch.nbytes > size or n_rows + batch.num_rows > TOGETHER_ROWS):
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, n_bytes, n_rows = [], 0, 0
        held.append(batch)
        n_bytes += batch.nbytes
        n_rows += batch.num_rows
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def arrow_map(
    df: DataFrame,
    inputs: Sequence[str],
    outputs: T.StructType,
    make: Callable[[], Callable[..., Sequence]],
    keep: Sequence[str] = (),
    together: int = 0,
) -> DataFrame:
    """Add columns computed in Python from whole batches; one result row per input row.

    ``make()`` is called once per task and gives a function from the input
    columns (Python lists, nulls as None) to one list or Arrow array per output.
    ``keep`` names the columns carried along; one that has the name of an output
    gives way to the output. Batches are put together up to ``together`` bytes.
    """
    small_batches(df.sparkSession)
    kept = [c for c in keep if c not in outputs.names]
    schema = T.StructType([df.schema[c] for c in kept] + list(outputs.fields))
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    n_kept, n_in = len(kept), len(inputs)
    out_types = [target.field(n_kept + i).type for i in range(len(outputs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in joined(batches, together):
            got = function(*(batch.column(n_kept + i).to_pylist() for i in range(n_in)))
            new = [
                x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, kind)
                for x, kind in zip(got, out_types, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_kept)] + new, names=schema.names)

    # Names of their own for all columns on the way, so that no name clashes or needs quoting.
    source = df.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([*kept, *inputs])])
    return source.mapInArrow(run, schema)
