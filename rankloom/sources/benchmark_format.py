"""The benchmark folder as a data source of its own: ``spark.read.format("benchmark_folder")``.

Options: ``table`` is ``corpus`` (the default), ``queries`` or ``qrels``, and
``split`` the name of the judgements file (``test``). Files are cut into ranges
of bytes at line ends and every range is read by a task of its own, as Arrow
batches. A schema passed to the reader names the columns wanted; others are
parsed past and never sent to Spark. Paths are local or of any store that
Arrow's file systems reach (hdfs, s3, gs).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
import pyarrow.json
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "benchmark_folder"
# Bytes of a range, unless the option ``range_bytes`` says otherwise.
RANGE_BYTES = 64 * 1024 * 1024

# Columns of the tables and the fields of the layout that they are read from.
FIELDS = {
    "corpus": {"doc_id": "_id", "title": "title", "text": "text"},
    "queries": {"qid": "_id", "text": "text"},
    "qrels": {"qid": "query-id", "doc_id": "corpus-id", "rel": "score"},
}
SCHEMAS = {"corpus": "doc_id string, title string, text string", "queries": "qid string, text string", "qrels": "qid string, doc_id string, rel int"}


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class BenchmarkFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _table(self) -> str:
        table = self.options.get("table", "corpus")
        if table not in FIELDS:
            raise ValueError(f"table must be one of {sorted(FIELDS)}, not {table!r}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema: StructType) -> DataSourceReader:
        table = self._table()
        unknown = [c for c in schema.names if c not in FIELDS[table]]
        if unknown:
            raise ValueError(f"{table} has no columns {unknown}")
        return BenchmarkReader(self.options["path"], table, self.options.get("split", "test"), schema.names,
                               int(self.options.get("range_bytes", RANGE_BYTES)))


class BenchmarkReader(DataSourceReader):
    def __init__(self, folder: str, table: str, split: str, columns: list[str], range_bytes: int):
        self.folder, self.table, self.columns, self.range_bytes = folder.rstrip("/"), table, columns, range_bytes
        self.file = f"qrels/{split}.tsv" if table == "qrels" else f"{table}.jsonl"

    def partitions(self) -> list[ByteRange]:
        files, path = pyarrow.fs.FileSystem.from_uri(f"{_uri(self.folder)}/{self.file}")
        info = files.get_file_info(path)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(f"{self.folder} has no {self.file}")
        found = [info] if info.is_file else files.get_file_info(pyarrow.fs.FileSelector(path))
        # As Spark does, leave out what writers keep beside the data.
        data = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        return [ByteRange(name, start, min(start + self.range_bytes, size)) for name, size in data for start in range(0, size, self.range_bytes)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        files, _ = pyarrow.fs.FileSystem.from_uri(_uri(self.folder))
        with files.open_input_file(partition.path) as file:
            data = _lines(file, partition.start, partition.end)
        fields = {FIELDS[self.table][c]: pa.int32() if c == "rel" else pa.string() for c in self.columns}
        if self.table == "qrels":
            # The header is the first line of each file.
            data = data.split(b"\n", 1)[1] if partition.start == 0 and b"\n" in data else b"" if partition.start == 0 else data
            names = list(FIELDS["qrels"].values())
            if not data.strip():
                return
            table = pyarrow.csv.read_csv(pa.BufferReader(data), pyarrow.csv.ReadOptions(column_names=names), pyarrow.csv.ParseOptions(delimiter="\t"),
                                         pyarrow.csv.ConvertOptions(include_columns=list(fields), column_types=fields, strings_can_be_null=False))
        else:
            if not data.strip():
                return
            # A line may be longer than the parser's usual block.
            table = pyarrow.json.read_json(pa.BufferReader(data), pyarrow.json.ReadOptions(block_size=max(1 << 20, len(data) + 1)),
                                           pyarrow.json.ParseOptions(pa.schema(list(fields.items())), unexpected_field_behavior="ignore"))
        yield from table.select(list(fields)).rename_columns(self.columns).to_batches(max_chunksize=10_000)


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def _lines(file: pa.NativeFile, start: int, end: int) -> bytes:
    """The lines that begin in a range of bytes: from behind the first line end at ``start`` - 1 or later, to the line end at ``end`` - 1 or later."""
    size = file.size()
    first = max(start - 1, 0)
    file.seek(first)
    data = file.read(end - first)
    while end < size and not data.endswith(b"\n"):
        more = file.read(1 << 16)
        cut = more.find(b"\n")
        data += more if cut < 0 else more[:cut + 1]
        end = size if not more else end + len(more)
        if cut >= 0:
            break
    if start == 0:
        return data
    # What comes before the first line end belongs to the range before.
    cut = data.find(b"\n")
    return data[cut + 1:] if cut >= 0 else b""


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(BenchmarkFolder)
