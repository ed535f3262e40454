"""Uploads as a Spark data source: spark.read.format("uploads").option("path", ...).

Files are dealt to partitions by size, and each is read, and parsed if a parser is
named, by itself: a task holds one file's bytes at a time, and a file that fails is
a row with its error.  Any file system that pyarrow opens by its URI will do.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from evidentia import schemas
from evidentia.sources.files import SUFFIXES

#: Bytes of the files in a partition, unless told otherwise; a larger file is alone in one.
GROUP_BYTES = 64 << 20
#: Options that are the source's own; all others go to the parser by name.
OWN = ("path", "groupbytes", "parser")
ITEM = StructType([f for f in schemas.ITEM.fields if f.name not in ("document_id", "pos")])


class Group(InputPartition):
    def __init__(self, files: list[tuple[str, int | None]]) -> None:
        super().__init__(files)
        self.files = files


def grouped(files: list[tuple[str, int | None]], most: int) -> list[list[tuple[str, int | None]]]:
    """Files (path, size) in groups of about `most` bytes, large ones first."""
    groups: list[list] = []
    room = 0
    for path, size in sorted(files, key=lambda f: (-(f[1] or 0), f[0])):
        if not groups or (size or 0) > room:
            groups.append([])
            room = most
        groups[-1].append((path, size))
        room -= size or 0
    return groups


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError("the uploads source needs the option path")
        self.schema, self.options = schema, options
        self.most = int(options.get("groupbytes", GROUP_BYTES))

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.options["path"])
        known = lambda x: x.type != fs.FileType.Directory and x.base_name.rpartition(".")[2].lower() in SUFFIXES
        found = [(x.path, x.size) for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if known(x)]
        return [Group(g) for g in grouped(found, self.most)]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        kinds, call = to_arrow_schema(self.schema), None
        if "parser" in self.options:
            module, _, name = self.options["parser"].partition(":")
            call = getattr(importlib.import_module(module), name)
        more = {k: v for k, v in self.options.items() if k not in OWN}
        for path, size in partition.files:
            name = path.rpartition("/")[2]
            row = {"filename": name, "file_type": name.rpartition(".")[2].lower(), "path": path, "size": size, "content": None, "items": None, "error": None}
            try:
                with store.open_input_stream(path) as f:
                    content = f.read()
                row |= {"size": len(content), "items": call(name, content, **more)} if call else {"size": len(content), "content": content}
                made = pa.RecordBatch.from_pylist([row], schema=kinds)
            except Exception as e:  # noqa: BLE001  one file's failure is its own
                made = pa.RecordBatch.from_pylist([row | {"content": None, "items": None, "error": f"{name}: {e}"}], schema=kinds)
            yield made


class Uploads(DataSource):
    """(filename, file_type, path, size, content, items, error) of all files of a known kind under `path`.

    Options: path; groupBytes, the bytes of files in a partition; parser, as
    module:function, called with the name, the bytes and all other options, which
    gives the items (schemas.ITEM rows) of a file.  With a parser the content is
    not passed on.  A file that can't be opened has no size.
    """

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> StructType:
        text = StringType()
        return StructType([*(StructField(c, text) for c in ("filename", "file_type", "path")), StructField("size", LongType()), StructField("content", BinaryType()), StructField("items", ArrayType(ITEM)), StructField("error", text)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(schema, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(Uploads)
