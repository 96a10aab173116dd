"""Files of a tree: listed by tasks, judged by path, and only then read.

Listing and judging see paths and sizes alone. The paths that are kept are dealt
into lists of about ``LIST_BYTES`` of contents, one Parquet file each, and a
data source reads every list in a partition of its own. So contents pass from
the store into the row that holds them, and through no exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from loomgraph.functions.paths import base_name
from loomgraph.plans.iterate import expand
from loomgraph.plans.ranking import running_total
from loomgraph.session import cut, scratch_path, ship

LIST_BYTES = 128 << 20
_BATCH_BYTES = 16 << 20
CONTENTS = "project string, path string, content binary"
ENTRIES = "project string, root string, path string, is_directory boolean, bytes bigint"
_ENTRIES = pa.schema([("project", pa.string()), ("root", pa.string()), ("path", pa.string()), ("is_directory", pa.bool_()), ("bytes", pa.int64())])


def _store(root: str):
    """The store a root lies in, and the root's place there; a root without a scheme is a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of each directory, with whether they are directories, and their sizes."""
    from pyarrow import fs

    for batch in batches:
        found = []
        for entry in batch.to_pylist():
            store, base = _store(entry["root"])
            inside = f"{base}/{entry['path']}".rstrip("/")
            for info in store.get_file_info(fs.FileSelector(inside)):
                path = info.path.removeprefix(base).lstrip("/")
                found.append((entry["project"], entry["root"], path, info.type == fs.FileType.Directory, info.size or 0))
        columns = zip(*found, strict=True) if found else [[]] * len(_ENTRIES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ENTRIES.types, strict=True)], schema=_ENTRIES)


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each root as an entry: a directory as it is, a file as the only one of the directory that holds it."""
    from pyarrow import fs

    for batch in batches:
        found = []
        for row in batch.to_pylist():
            root = row["root"].rstrip("/") or "/"
            store, base = _store(root)
            info = store.get_file_info(base)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(root)
            if info.type == fs.FileType.Directory:
                found.append((row["project"], root, "", True, 0))
            else:
                folder, _, name = root.rpartition("/")
                found.append((row["project"], folder, name, False, info.size))
        columns = zip(*found, strict=True) if found else [[]] * len(_ENTRIES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ENTRIES.types, strict=True)], schema=_ENTRIES)


def listing(roots: DataFrame, skipped: list[str]) -> DataFrame:
    """``project, root, path, bytes`` of every file under the roots ``(project, root)``.

    Spark's own file listing leaves out empty files and names that start with a
    dot or an underscore, which here are ``.gitignore`` and ``__init__.py``. So
    tasks list directories, one level per round; hidden ones and those called
    as in ``skipped`` are not entered. A root that is a file lists itself.
    """
    spark = roots.sparkSession
    ship(spark)
    wide = spark.sparkContext.defaultParallelism
    entered = ~F.col("is_directory") | (~base_name(F.col("path")).startswith(".") & ~base_name(F.col("path")).isin(*skipped))

    def step(frontier: DataFrame, number: int) -> DataFrame:
        return frontier.where("is_directory").repartition(wide).mapInArrow(_children, ENTRIES).where(entered)

    start = roots.select("project", "root").distinct().mapInArrow(_start, ENTRIES)
    return expand(start, step, ["project", "root", "path"]).where(~F.col("is_directory")).select("project", "root", "path", "bytes")


class ListedFiles(DataSource):
    """Contents of listed files. The option ``listing`` names a folder whose Parquet files are the lists."""

    @classmethod
    def name(cls) -> str:
        return "listed_files"

    def schema(self) -> str:
        return CONTENTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ListedFilesReader(self.options["listing"])


class ListedFilesReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = _store(self.folder)
        names = sorted(i.path for i in store.get_file_info(fs.FileSelector(base)) if i.path.endswith(".parquet"))
        return [InputPartition(name) for name in names]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if partition is None:
            return
        kinds = [pa.string(), pa.string(), pa.binary()]
        store, _ = _store(self.folder)
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["project", "path", "content"])

        with store.open_input_file(partition.value) as file:
            for listed in pq.ParquetFile(file).iter_batches(batch_size=1000, columns=["project", "root", "path"]):
                for entry in listed.to_pylist():
                    place, base = _store(entry["root"])
                    with place.open_input_stream(f"{base.rstrip('/')}/{entry['path']}") as stream:
                        held.append((entry["project"], entry["path"], stream.readall()))
                    size += len(held[-1][2])
                    if size >= _BATCH_BYTES:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()


def read_listed(files: DataFrame, list_bytes: int = LIST_BYTES) -> DataFrame:
    """``project, path, content`` of listed files, a partition per list of about ``list_bytes``."""
    spark = files.sparkSession
    ship(spark)
    spark.dataSource.register(ListedFiles)
    order = [F.col(c) for c in ("project", "root", "path")]
    # An empty file costs its opening.
    weighed = running_total(files.withColumn("_cost", F.col("bytes") + 4096), order, "_cost", "_until")
    dealt = cut(weighed.withColumn("_list", F.floor((F.col("_until") - F.col("_cost")) / list_bytes).cast("int")).drop("_until", "_cost"), "dealt")
    lists = (dealt.agg(F.max("_list")).first()[0] or 0) + 1
    folder = scratch_path(spark, "listing")
    dealt.repartitionById(lists, F.col("_list")).drop("_list").write.parquet(folder)
    return spark.read.format("listed_files").option("listing", folder).load()


def read_tree(roots: DataFrame, skipped: list[str], keep, list_bytes: int = LIST_BYTES) -> DataFrame:
    """Contents of the files that ``keep`` leaves of the listing; it gets the listing and the contents of any part of it."""
    listed = cut(listing(roots, skipped), "listing")
    return read_listed(keep(listed, lambda some: read_listed(some, list_bytes)), list_bytes)


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write ``(project, path, content)`` as files under ``root``, a folder per project; ``(project, root)`` of each.

    A repeated task writes the same files again.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        made = set()
        for batch in batches:
            for project, path, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                whole = f"{base.rstrip('/')}/{project}/{path}"
                folder = whole.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(whole) as stream:
                    stream.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0).unique()], names=["project"])

    written = cut(files.select("project", "path", "content").mapInArrow(run, "project string"), "written")
    return written.distinct().select("project", F.concat(F.lit(f"{root.rstrip('/')}/"), "project").alias("root"))
