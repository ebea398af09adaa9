"""Python data sources: gold cases of YAML files, and evaluation reports that appear whole or not at all.

`register(spark)` names them; then `spark.read.format("gold").load(folder)`,
`spark.read.format("reports").load(folder)` and `df.write.format("reports").save(folder)`.
Folders are reached as pyarrow reaches them, by a path or a URI.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from claimwright.sources.files import yaml_items


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(path: str, endings: tuple[str, ...]) -> list[str]:
    """The files under a folder, or the file itself, in order of name."""
    where, root = _opened(path)
    info = where.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(endings) and not f.base_name.startswith(("_", ".")))


def _text(path: str, file: str) -> str:
    with _opened(path)[0].open_input_stream(file) as stream:
        return stream.read().decode("utf-8", "replace")


#: Files that one task reads.
FILES_PER_TASK = 32


@dataclass
class _Files(InputPartition):
    paths: list[str]


def _dealt(path: str, endings: tuple[str, ...]) -> list[InputPartition]:
    found = _listed(path, endings)
    return [_Files(found[k : k + FILES_PER_TASK]) for k in range(0, max(len(found), 1), FILES_PER_TASK)]


class GoldSource(DataSource):
    """Cases of version-1 YAML files: file, position, id and the case as JSON.

    Options: needed, the fields a case must have, with commas between them (id); key, the
    list's name (items).  A malformed file, or one of another version, has no cases.
    """

    @classmethod
    def name(cls) -> str:
        return "gold"

    def schema(self) -> str:
        return "file string, position int, id string, item string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _GoldReader(self.options)


class _GoldReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.key = options["path"], options.get("key", "items")
        self.needed = tuple(x.strip() for x in options.get("needed", "id").split(",") if x.strip())

    def partitions(self) -> list[InputPartition]:
        return _dealt(self.path, (".yaml", ".yml"))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            for k, item in enumerate(yaml_items(_text(self.path, path), self.needed, self.key)):
                yield path, k, str(item.get("id")), json.dumps(item, ensure_ascii=False, default=str)


#: What a report states: its file, run, aggregate and cases, and why it can't be read.
REPORT = "file string, stage string, timestamp_utc string, model string, tag string, git_rev string, aggregate map<string, double>, cases int, failed boolean, error string"


class ReportSource(DataSource):
    """Evaluation reports, one JSON file each: meta, result.aggregate, result.per_case.

    Writing takes rows (name, report), report being the JSON; each task writes aside and
    the files get their names when all tasks are done, so a failed write leaves none.
    """

    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return REPORT

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ReportReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _ReportWriter(self.options, overwrite)


class _ReportReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return _dealt(self.path, (".json",))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            yield self._row(path)

    def _row(self, path: str) -> tuple:
        name = path.rpartition("/")[2]
        try:
            data = json.loads(_text(self.path, path))
            meta, result = data.get("meta") or {}, data.get("result") or {}
            stage, cases = meta.get("stage") or "unknown", result.get("per_case") or []
            numbers = {k: float(v) for k, v in (result.get("aggregate") or {}).items() if isinstance(v, int | float)}
            return name, stage, *(meta.get(k) for k in ("timestamp_utc", "model", "tag", "git_rev")), numbers, len(cases), _failed(stage, cases), None
        except (ValueError, AttributeError, TypeError) as error:
            return name, *[None] * 8, str(error)


def _failed(stage: str, cases: list[dict]) -> bool:
    """Whether a question went wrong; other stages list nothing but what failed."""
    if stage != "query":
        return bool(cases)
    return any(c.get("error") is not None or c.get("sql_ok") is False or c.get("missed_contains") or c.get("missed_slugs") for c in cases)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _ReportWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    @property
    def _aside(self) -> str:
        return f"{_opened(self.path)[1]}/_temporary/{self.job}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        where, root = _opened(self.path)
        made = []
        for row in rows:
            if "/" in row["name"] or not row["name"]:
                raise ValueError(f"no name of a report: {row['name']!r}")
            json.loads(row["report"])
            where.create_dir(self._aside)
            aside = f"{self._aside}/{uuid.uuid4().hex}"
            with where.open_output_stream(aside) as stream:
                stream.write(row["report"].encode())
            made.append((aside, f"{root}/{row['name']}.json"))
        return _Written(made)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = _opened(self.path)
        if self.overwrite and where.get_file_info(root).type == fs.FileType.Directory:
            for old in _listed(self.path, (".json",)):
                where.delete_file(old)
        where.create_dir(root)
        for message in messages:
            for aside, name in message.files if message else ():
                where.move(aside, name)
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        where, root = _opened(self.path)
        if where.get_file_info(self._aside).type == fs.FileType.Directory:
            where.delete_dir(self._aside)
        parent = f"{root}/_temporary"
        if where.get_file_info(parent).type == fs.FileType.Directory and not where.get_file_info(fs.FileSelector(parent)):
            where.delete_dir(parent)


def register(spark: SparkSession) -> None:
    """The formats gold and reports, for this session."""
    for source in (GoldSource, ReportSource):
        spark.dataSource.register(source)
