"""Bucketed tables with a heavy bucket.

A rollup on a bucketed table groups straight off the scan, one task a bucket.  A
key with a large share of the rows makes its bucket that much larger, and since
there is no exchange, adaptive execution has nothing to split.  The sizes of the
buckets are known from the file listing (no job, no scan); where one is heavy,
the same files are read without their bucketing: a large file is then split over
tasks, every task combines its rows first, and an exchange, which AQE may split,
brings the partial results together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import median
from urllib.parse import unquote

from pyspark.sql import DataFrame

#: A bucket is heavy if it has so many times the median's bytes, and is larger than one task should read.
UNEVEN = 3
HEAVY_BYTES = 256 * 1024 * 1024
#: Stored bytes whose rows one task sorts or groups; as in the layout of the buckets.
TASK_BYTES, MOST_TASKS = 8 * 1024 * 1024, 65536

_BUCKET_FILE = re.compile(r"_(\d{5})(?:\.c\d+)?[^/]*$")


def _bucketed_table(df: DataFrame):
    """The file relation of ``df`` if it is a bucketed table as it stands, else None."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() == "SubqueryAlias":
        plan = plan.child()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return None
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or not relation.bucketSpec().isDefined():
        return None
    return relation


def bucket_sizes(df: DataFrame) -> list[int]:
    """Bytes of each bucket that has files, by the listing; empty if ``df`` is no bucketed table."""
    if _bucketed_table(df) is None:
        return []
    sizes: dict[str, int] = {}
    for _, name, length in _listed(df, df.inputFiles()):
        found = _BUCKET_FILE.search(name)
        if found:
            sizes[found[1]] = sizes.get(found[1], 0) + length
    return sorted(sizes.values())


def _listed(df: DataFrame, files: list[str]) -> Iterator[tuple[str, str, int]]:
    """Folder, name and bytes of every file in the folders of ``files``: one listing a folder."""
    session = df.sparkSession
    for folder in sorted({unquote(f).rsplit("/", 1)[0] for f in files}):  # they are URIs
        path = session._jvm.org.apache.hadoop.fs.Path(folder)
        for status in path.getFileSystem(session._jsc.hadoopConfiguration()).listStatus(path):
            yield folder, status.getPath().getName(), status.getLen()


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, by their listing; 0 if it reads none."""
    files = df.inputFiles()
    read = {unquote(f) for f in files}
    return sum(length for folder, name, length in _listed(df, files) if f"{folder}/{name}" in read)


def tasks_for(n_bytes: int) -> int:
    """So many tasks that each gets about ``TASK_BYTES`` of stored rows."""
    return min(max(1, -(-n_bytes // TASK_BYTES)), MOST_TASKS)


def evened(df: DataFrame, heavy_bytes: int = HEAVY_BYTES) -> DataFrame:
    """``df``, read without its bucketing if a bucket of it is heavy."""
    sizes = bucket_sizes(df)
    if not sizes or sizes[-1] < max(heavy_bytes, UNEVEN * median(sizes)):
        return df
    folders = sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    return df.sparkSession.read.schema(df.schema).parquet(*folders)
