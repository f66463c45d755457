"""The first lines of each of many text files: told apart by their place, not by what they hold."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def body_lines(spark: SparkSession, path: str, *, skip: int = 0, comment: str | None = None) -> DataFrame:
    """value: the lines of all files of path without each file's first `skip` lines, and then without lines that start with `comment`, up to the first that does not.

    What is left out must lie within a file's first split (spark.sql.files.maxPartitionBytes); a file where it does not is an error.
    """
    meta = "_metadata.{}".format
    lines = spark.read.text(path).select("value", F.col(meta("file_path")).alias("path"), F.col(meta("file_block_start")).alias("at"), (F.col(meta("file_block_length")) < F.col(meta("file_size"))).alias("more"))
    if not skip and not comment:
        return lines.select("value")

    def run(batches):
        path, left, leading, more = None, 0, False, False

        def check():
            if path is not None and more and (left or leading):
                raise ValueError(f"the leading lines of {path} go on past its first split: raise spark.sql.files.maxPartitionBytes")

        for batch in batches:
            values, paths, at, more_ = (batch.column(i) for i in range(4))
            runs = pc.run_end_encode(paths)
            begin = 0
            for own, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if own != path:
                    check()
                    path, left, leading, more = own, skip, comment is not None, more_[begin].as_py()
                    if at[begin].as_py():
                        left, leading = 0, False
                gone = min(left, end - begin)
                left, begin = left - gone, begin + gone
                if leading and not left:
                    kept = pc.fill_null(pc.invert(pc.starts_with(values.slice(begin, end - begin), comment)), True)
                    first = pc.index(kept, True).as_py()
                    leading = first < 0
                    begin = end if leading else begin + first
                if begin < end:
                    yield pa.RecordBatch.from_arrays([values.slice(begin, end - begin)], ["value"])
                begin = end
        check()

    return lines.mapInArrow(run, "value string")


def leading_lines(spark: SparkSession, path: str, comment: str) -> list[str] | None:
    """The lines of one file before the first that does not start with `comment`; None if there are no lines at all.

    Each task stops at its first other line, so no more than those lines come to the driver.
    """

    def run(batches):
        for batch in batches:
            kept = pc.starts_with(batch.column(0), comment)
            first = pc.index(kept, False).as_py()
            yield batch.slice(0, batch.num_rows if first < 0 else first + 1)
            if first >= 0:
                return

    found = None
    for row in spark.read.text(path).mapInArrow(run, "value string").toLocalIterator():
        found = found or []
        if not row.value.startswith(comment):
            break
        found.append(row.value)
    return found
