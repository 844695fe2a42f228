"""A provider's stored answers as a source of its own: batch scans with filters that the provider evaluates, and a pull in chunks.

The provider is anything that lists Parquet files (a folder or a URI that
pyarrow opens).  A batch scan has one partition for each row group that may
hold rows; comparisons reach it in two ways: those that the optimizer pushes,
and groups of conditions that ``source_filters`` has translated.  A pull is a
stream with offsets of its own, the number of rows taken so far in the order of
files and row groups; it admits ``chunk`` rows at a time and keeps its
high-water mark in a file, so that it can be stopped at any time and go on.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as api
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewater.plans import flows, predicates
from tidewater.storage import importable

NAME = "provider_answers"
#: Operators of condition trees that a provider evaluates itself, by its own names.
NATIVE = {"equals": "EQ", "is_any_of": "IN", "contains": "CONTAINS", "starts_with": "STARTS", "gt": "GT", "gte": "GTE", "lt": "LT", "lte": "LTE", "is_not_empty": "HAS"}
_COMPARED = {api.EqualTo: "equal", api.GreaterThan: "greater", api.GreaterThanOrEqual: "greater_equal", api.LessThan: "less", api.LessThanOrEqual: "less_equal"}
_WITHIN = {api.StringStartsWith: pc.starts_with, api.StringEndsWith: pc.ends_with, api.StringContains: pc.match_substring}


class Provider:
    """The files behind a scan or a pull: their row groups in a fixed order, and columns under our names."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.provider, self.id = options["path"], options["provider"], options["id"]
        self.columns: dict[str, str] = json.loads(options.get("columns", "{}"))
        self.wanted = to_arrow_schema(schema)
        self.data = pds.dataset(self.path, format="parquet")

    def theirs(self, name: str) -> str | None:
        return self.id if name == "record_id" else self.columns.get(name)

    def groups(self, condition: pc.Expression | None = None) -> list[tuple[str, int, int]]:
        """(file, row group, rows) of all row groups, by file name; those whose statistics rule a condition out are left out (not of columns with nulls)."""
        found = []
        for piece in sorted(self.data.get_fragments(), key=lambda f: f.path):
            held = piece.subset(filter=condition, schema=self.data.schema) if condition is not None else piece
            found += [(piece.path, g.id, g.num_rows) for g in held.row_groups]
        return found

    def batches(self, file: str, group: int, condition: pc.Expression | None = None, begin: int = 0, end: int | None = None) -> Iterator[pa.RecordBatch]:
        """Rows of a row group under our names and types; only the columns that are mapped are read."""
        piece = next(f for f in self.data.get_fragments() if f.path == file).subset(row_group_ids=[group])
        named = {f.name: self.theirs(f.name) for f in self.wanted}
        at = 0
        for batch in piece.to_batches(schema=self.data.schema, columns=sorted({c for c in named.values() if c}), filter=condition):
            lo, hi = max(begin - at, 0), batch.num_rows if end is None else min(end - at, batch.num_rows)
            at += batch.num_rows
            if hi > lo:
                part = batch.slice(lo, hi - lo)
                made = [part.column(named[f.name]).cast(f.type) if named[f.name] else pa.array([self.provider if f.name == "provider" else None] * part.num_rows, f.type) for f in self.wanted]
                yield pa.RecordBatch.from_arrays(made, schema=self.wanted)

    def pushed(self, filter: api.Filter) -> pc.Expression | None:
        """The filter as the provider evaluates it, with the same result as Spark's; None if it cannot."""
        name = filter.attribute[0] if hasattr(filter, "attribute") and len(filter.attribute) == 1 else None
        kind = self.wanted.field(name).type if name in self.wanted.names else None
        if name is None or kind is None or self.theirs(name) is None:
            return None
        column = pc.field(self.theirs(name))
        if self.data.schema.field(self.theirs(name)).type != kind:
            column = column.cast(kind)
        if isinstance(filter, (api.IsNull, api.IsNotNull)):
            return column.is_null() if isinstance(filter, api.IsNull) else column.is_valid()
        if pa.types.is_floating(kind) or pa.types.is_timestamp(kind):  # not-a-number and zones compare differently
            return None
        if isinstance(filter, api.In):
            return column.isin([v for v in filter.value if v is not None])
        if type(filter) in _WITHIN:
            return _WITHIN[type(filter)](column, filter.value)
        return pc.Expression._call(_COMPARED[type(filter)], [column, pc.scalar(filter.value)]) if type(filter) in _COMPARED else None

    def native(self, groups: list[list[list[Any]]]) -> pc.Expression | None:
        """An OR of ANDs of (field, operator, value) as a condition that keeps at least the rows that fit; None: all rows."""
        alternatives = []
        for group in groups:
            held = [e for e in (self._native(*c) for c in group) if e is not None]
            if not held:
                return None
            alternatives.append(_joined("and_kleene", held))
        return _joined("or_kleene", alternatives) if alternatives else None

    def _native(self, name: str, operator: str, value: Any) -> pc.Expression | None:
        theirs = self.theirs(name)
        kind = self.data.schema.field(theirs).type if theirs else None
        if kind is None or value in (None, "", []) and operator != "HAS":
            return None
        column = pc.field(theirs)
        if operator == "HAS":
            return column.is_valid()
        if pa.types.is_string(kind) or pa.types.is_large_string(kind):
            low, text = pc.utf8_lower(column), str(value).lower()
            return {"EQ": lambda: low == text, "IN": lambda: low.isin([str(v).lower() for v in ([value] if isinstance(value, str) else value)]), "CONTAINS": lambda: pc.match_substring(low, text), "STARTS": lambda: pc.starts_with(low, text)}.get(operator, lambda: None)()
        if pa.types.is_integer(kind) and isinstance(value, (int, float)) and operator in ("EQ", "GT", "GTE", "LT", "LTE"):
            return {"EQ": column == value, "GT": column > value, "GTE": column >= value, "LT": column < value, "LTE": column <= value}[operator]
        return None


def _joined(how: str, conditions: list[pc.Expression]) -> pc.Expression:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c if how == "and_kleene" else out | c
    return out


class Scan(api.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema = dict(options), schema
        provider = Provider(self.options, schema)
        self.condition = provider.native(json.loads(self.options.get("filters", "[]")))

    def pushFilters(self, filters: list[api.Filter]) -> Iterable[api.Filter]:
        provider = Provider(self.options, self.schema)
        for filter in filters:
            pushed = provider.pushed(filter)
            if pushed is None:
                yield filter
            else:
                self.condition = pushed if self.condition is None else self.condition & pushed

    def partitions(self) -> list[api.InputPartition]:
        found = Provider(self.options, self.schema).groups(self.condition)
        return [api.InputPartition((file, group)) for file, group, _ in found] or [api.InputPartition(None)]

    def read(self, partition: api.InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is not None:
            yield from Provider(self.options, self.schema).batches(*partition.value, self.condition)


class Pull(api.DataSourceStreamReader):
    """Rows from one offset to another; ``chunk`` of them are admitted at once."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema = dict(options), schema
        self.provider = Provider(self.options, schema)
        self.chunk, self.mark = int(options.get("chunk", "10000")), options.get("mark")
        self.kept = {"done": 0, "planned": 0, **(self._load() or {})}

    def _file(self) -> tuple[Any, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.mark) if "://" in self.mark or self.mark.startswith("file:") else (fs.LocalFileSystem(), self.mark)

    def _load(self) -> dict[str, int] | None:
        from pyarrow import fs

        if not self.mark:
            return None
        system, path = self._file()
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(path) as f:
            return json.loads(f.read())

    def _keep(self, **known: int) -> None:
        """Marks only grow; the file is replaced by a finished one."""
        self.kept = {k: max(v, known.get(k, 0)) for k, v in self.kept.items()}
        if self.mark:
            system, path = self._file()
            system.create_dir(posixpath.dirname(path), recursive=True)
            with system.open_output_stream(path + ".new") as f:
                f.write(json.dumps(self.kept).encode())
            system.move(path + ".new", path)

    def initialOffset(self) -> dict:
        return {"rows": self.kept["done"]}

    def latestOffset(self) -> dict:
        """At most a chunk behind what has been planned.  A batch that was logged but not planned before a stop is planned again first, so offsets never go back."""
        total = sum(n for _, _, n in Provider(self.options, self.schema).groups())
        return {"rows": max(self.kept["planned"], min(total, max(self.kept["planned"], self.kept["done"]) + self.chunk))}

    def partitions(self, start: dict, end: dict) -> list[api.InputPartition]:
        self._keep(planned=end["rows"])
        found, at = [], 0
        for file, group, n in self.provider.groups():
            lo, hi = max(start["rows"] - at, 0), min(end["rows"] - at, n)
            if hi > lo:
                found.append(api.InputPartition((file, group, lo, hi)))
            at += n
        return found

    def read(self, partition: api.InputPartition) -> Iterator[pa.RecordBatch]:
        file, group, lo, hi = partition.value
        yield from Provider(self.options, self.schema).batches(file, group, None, lo, hi)

    def commit(self, end: dict) -> None:
        self._keep(done=end["rows"])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "provider"}


class Answers(api.DataSource):
    """Options: path, provider, id, columns (our names to theirs, as JSON), filters (JSON), chunk and mark for pulls."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "record_id string, provider string, " + ", ".join(f"`{c}` string" for c in json.loads(self.options.get("columns", "{}")))

    def reader(self, schema: StructType) -> Scan:
        return Scan(self.options, schema)

    def streamReader(self, schema: StructType) -> Pull:
        return Pull(self.options, schema)


def register(spark: SparkSession) -> None:
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Answers)


def answers(spark: SparkSession, path: str, provider: str, id: str, columns: dict[str, str], schema: str | None = None, tree: dict[str, Any] | None = None) -> DataFrame:
    """A scan of a provider's answers: record_id, provider and its columns under our names.

    What the provider can evaluate of a condition tree goes to it; the tree is applied again to what it returns.
    Filters on the result reach the provider too where it gives the same answer as Spark.
    """
    register(spark)
    reader = spark.read.format(NAME).option("path", path).option("provider", provider).option("id", id).option("columns", json.dumps(columns))
    if tree is not None:
        reader = reader.option("filters", json.dumps(flows.source_filters(tree, NATIVE)[0]))
    rows = (reader.schema(schema) if schema else reader).load()
    return rows if tree is None else rows.filter(predicates.compile_tree(tree))


def pulled(spark: SparkSession, path: str, provider: str, id: str, columns: dict[str, str], mark: str, chunk: int = 10_000, schema: str | None = None) -> DataFrame:
    """The same answers as a stream that takes ``chunk`` rows at a time behind the mark."""
    register(spark)
    reader = spark.readStream.format(NAME).option("path", path).option("provider", provider).option("id", id).option("columns", json.dumps(columns)).option("chunk", str(chunk)).option("mark", mark)
    return (reader.schema(schema) if schema else reader).load()


def pull(spark: SparkSession, path: str, provider: str, id: str, columns: dict[str, str], folder: str, mode: str = "incremental", chunk: int = 10_000, schema: str | None = None, most: int | None = None) -> DataFrame:
    """All that has been pulled into ``folder`` after this run, each row once.

    incremental goes on behind the mark, full starts a new generation beside the old ones, from the first row.  With
    ``most`` the run is stopped once so many chunks are stored, as if somebody paused it; the next one goes on.  New
    files of a provider must come behind the old ones by name.
    """
    known = _generations(spark, folder)
    number = max(known, default=0) + (mode == "full" or not known)
    root = f"{folder.rstrip('/')}/generation={number}"
    stream = pulled(spark, path, provider, id, columns, f"{root}/mark.json", chunk, schema)
    run_chunks(stream, f"{root}/rows", f"{root}/checkpoint", most)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{root}/rows")


def run_chunks(stream: DataFrame, path: str, checkpoint: str, most: int | None = None) -> None:
    """Store each chunk of a stream as a table of its own, which a repeated one replaces, until nothing is left or ``most`` chunks are done."""
    stored = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        stored.append(number)

    query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).start()
    try:
        while most is not None and len(stored) < most and query.isActive and not query.exception():
            query.awaitTermination(0.1)
        if most is None:
            query.processAllAvailable()
    finally:
        query.stop()
    if query.exception():
        raise query.exception()


def _generations(spark: SparkSession, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return [int(s.getPath().getName().split("=")[1]) for s in system.listStatus(path) if s.getPath().getName().startswith("generation=")]
