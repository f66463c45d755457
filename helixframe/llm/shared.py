"""Spark helpers shared by the corpus operators: written tables, ranks, and column names."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from helixframe.llm import kernels

#: Folders in the shared one that are still to be deleted, with their sessions.
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share.

    Where the session names none, a local master (tests on one machine) gets one of its own; a cluster must name one.
    """
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if (set_before := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return set_before.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = tempfile.mkdtemp(prefix="helixframe-")
    spark.sparkContext.setCheckpointDir(where)
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by `drop`, or when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: nothing is left to ask
            return


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stashed_at = path
    return back


#: Short rows that are worth a task.
ROWS_A_TASK = 200_000


def packed(df: DataFrame, rows: int | None) -> DataFrame:
    """df, of at most `rows` short rows, in no more tasks than they are worth (twice the cores at least), without a shuffle."""
    if rows is None:
        return df
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))


def drop(*stashed: DataFrame) -> None:
    """Delete tables that `stash` wrote, once nothing reads them any more.

    Spark deletes the files of finished shuffles when the driver has collected their plans as garbage, so that is done too.
    """
    for df in stashed:
        if spark := _written.pop(df.stashed_at, None):
            _delete(spark, df.stashed_at)
    gc.collect()
    stashed[0].sparkSession._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def trim() -> None:
    """Give back what a worker process holds but does not use: it serves other tasks and operators next."""
    pa.default_memory_pool().release_unused()
    if libc := ctypes.util.find_library("c"):
        getattr(ctypes.CDLL(libc), "malloc_trim", lambda _: 0)(0)


def _let_go(but: str | None) -> None:
    for name in [x for x in kept if x != but]:
        del kept[name]
        trim()


#: What a worker process keeps from task to task, by name.
kept: dict[str, object] = {}


def per_text(docs: DataFrame, make, fields: T.StructType, *, text: str = "text", keep: list[str] | None = None, also: list[str] = (), uses: str | None = None) -> DataFrame:
    """Rows of docs with the columns `keep` and those that `make` computes from each step of texts.

    make() is called once a task and returns a function from (texts, other columns by name) to a
    list of Arrow arrays in the order of `fields`.  Nothing is shuffled; a task holds one batch, whose bytes
    spark.sql.execution.arrow.maxBytesPerBatch bounds, and works on one step of it (kernels.STEP_BYTES of text) at a time.  A result whose name is taken in `keep` gets
    leading underscores.  Of what the worker keeps (`kept`) all but `uses` is let go first.
    """
    keep = ["doc_id"] if keep is None else list(keep)
    took = [docs.schema[c] for c in keep]
    names = []
    for f in fields:
        name = f.name
        while name.lower() in {c.lower() for c in [*keep, *names]}:
            name = f"_{name}"
        names.append(name)
    schema = T.StructType([*took, *(T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True))])
    arrow = to_arrow_schema(schema)
    n, m = len(keep), len(also)

    def run(batches):
        _let_go(uses)
        work = make()
        for batch in batches:
            texts = batch.column(n + m)
            for lo, hi in kernels.steps(texts):
                part = batch.slice(lo, hi - lo)
                made = work(part.column(n + m), {c: part.column(n + i) for i, c in enumerate(also)})
                cols = [part.column(i).cast(arrow.field(i).type) for i in range(n)]
                cols += [a.cast(arrow.field(n + i).type) for i, a in enumerate(made)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        trim()

    picked = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([*keep, *also, text])]
    return docs.select(*picked).mapInArrow(run, schema)
