"""``spark.read.format("workbook").load(path)``: the cells of workbooks on a folder that all machines mount.

A partition is one sheet of one file and is read as a stream of batches, so a
large sheet is never held whole.  Filters on ``sheet`` and ``path`` leave
partitions out, and one on ``row`` ends a sheet's reading early, where Spark
pushes filters to Python sources (``spark.sql.python.filterPushdown.enabled``);
Spark applies them again in any case.

Readers of such sources open files themselves, so this one is for mounted
folders; ``workbook.cells`` reads from any store that Spark reads.
"""

from __future__ import annotations

import glob
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

from ..errors import IngestFailed
from . import workbook


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str
    part: str
    rows: int | None


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.rows, self.only = path, None, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if isinstance(f, (LessThan, LessThanOrEqual)) and name == "row":
                most = f.value + isinstance(f, LessThanOrEqual)
                self.rows = most if self.rows is None else min(self.rows, most)
            elif isinstance(f, (EqualTo, In)) and name in ("sheet", "path"):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.only[name] = self.only.get(name, wanted) & wanted
            yield f  # Spark filters once more

    def partitions(self) -> list[Sheet]:
        at = self.path.removeprefix("file://").removeprefix("file:")
        files = sorted(glob.glob(os.path.join(at, "*.xls[xm]")) if os.path.isdir(at) else glob.glob(at))
        if not files:
            raise IngestFailed(f"no workbook at {self.path!r}")
        out = []
        for f in files:
            if f in self.only.get("path", {f}) and zipfile.is_zipfile(f):
                with zipfile.ZipFile(f) as z:  # the list of sheets alone is read here
                    out += [Sheet(f, name, part, self.rows) for name, part in workbook.sheets(z) if name in self.only.get("sheet", {name})]
        return out

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        with zipfile.ZipFile(partition.path) as z:
            shared, styles, merged = workbook.shared_strings(z), workbook.style_codes(z), workbook.merges(z, partition.part)
            for piece in workbook.pieces(z, partition.sheet, partition.part, shared, styles, merged, partition.rows):
                yield from workbook.as_batches((partition.path, partition.sheet, *cell) for cell in workbook.cells_of(piece, partition.rows))


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return workbook.SCHEMA

    def reader(self, schema) -> WorkbookReader:
        if not self.options.get("path"):
            raise IngestFailed("a path is needed")
        return WorkbookReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("workbook")`` known to a session."""
    spark.dataSource.register(WorkbookSource)
