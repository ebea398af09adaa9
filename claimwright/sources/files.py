"""Raw files, tables and append-only logs."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.functions.text import slug, title

#: Which reader takes which extension; office formats need a converter given as a hook.
TEXT, TABLE, OFFICE = (".txt", ".md"), (".csv",), (".pdf", ".docx", ".pptx", ".xlsx")


def csv_markdown(data: bytes) -> str:
    """A CSV file as a markdown table: UTF-8 (with or without mark), else code page 932."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("cp932", "replace")
    rows = list(csv.reader(io.StringIO(text)))
    if not rows:
        return ""
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * len(rows[0]), *map(line, rows[1:])])


def extract_files(spark: SparkSession, folder: str, done: DataFrame | None = None, converters: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, slug, title, body, problem) of every file under a folder by its extension.

    Files whose slug is in `done` are passed over; an extension without a reader, or a
    file that fails, gives a row with problem and no body, and the others go on.
    """
    hooks = converters or {}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("slug", slug("name"))
    if done is not None:
        files = files.join(done.select("slug").distinct(), "slug", "left_anti")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies, problems = [], []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                kind = PurePosixPath(path).suffix.lower()
                try:
                    if kind in TEXT:
                        body = bytes(data).decode("utf-8", "replace")
                    elif kind in TABLE:
                        body = csv_markdown(bytes(data))
                    elif kind in hooks:
                        body = hooks[kind](bytes(data))
                    else:
                        raise ValueError(f"no reader for {kind or 'a file without extension'}")
                    bodies.append(f"<!-- source: {PurePosixPath(path).name} -->\n\n{body}")
                    problems.append(None)
                except Exception as error:
                    bodies.append(None)
                    problems.append(str(error))
            yield pd.DataFrame({"path": batch["path"], "slug": batch["slug"], "body": bodies, "problem": problems})

    out = files.select("path", "slug", "content").mapInPandas(work, "path string, slug string, body string, problem string")
    return out.select("path", "slug", title("slug").alias("title"), "body", "problem")


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, slug, title, body) of text files read whole; bytes that are no UTF-8 are replaced."""
    files = spark.read.text(paths, wholetext=True).withColumn("path", F.input_file_name())
    named = files.withColumn("slug", slug(F.element_at(F.split("path", "/"), -1)))
    return named.select("path", "slug", title("slug").alias("title"), F.make_valid_utf8("value").alias("body"))


def register_tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Each Parquet table of a folder as a temporary view."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log; nothing that is there changes."""
    df.write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A table written aside and swapped in by name; the new rows are complete before the old go.

    Between the two renames there is no table of that name: a writer that is lost there
    leaves the old one aside, and the next write puts it back first.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(f"{path}.__new"), jvm.org.apache.hadoop.fs.Path(f"{path}.__old")
    here = jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(conf)
    if not fs.exists(here) and fs.exists(old):
        fs.rename(old, here)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}.__new")
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(new, here)
    fs.delete(old, True)


def yaml_items(text: str, needed: tuple[str, ...], key: str = "items") -> list[dict]:
    """The complete items of a version-1 YAML file; a malformed file or another version has none."""
    try:
        import yaml

        data = yaml.safe_load(text)
    except ImportError:
        data = _plain_yaml(text)
    except Exception:
        return []
    if not isinstance(data, dict) or data.get("version", data.get("schema_version")) not in (1, 2):
        return []
    return [x for x in data.get(key) or [] if isinstance(x, dict) and all(x.get(k) for k in needed)]


def _plain_yaml(text: str) -> dict:
    """Flat lists of quoted fields, where no YAML library is there."""
    out: dict = {"items": []}
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip() if not line.strip().startswith("#") else ""
        name, sep, value = bare.strip().removeprefix("- ").partition(":")
        if not sep:
            continue
        value = value.strip()
        value = json.loads(value) if value.startswith('"') else int(value) if value.isdigit() else value
        if not bare.startswith((" ", "-")):
            out[name] = value if value != "" else out.get(name, [])
        else:
            if bare.strip().startswith("- "):
                out["items"].append({})
            if out["items"]:
                out["items"][-1][name] = value
    return out


def write_report(df: DataFrame, folder: str, timestamp: str, model: str, tag: str, stage: str) -> str:
    """One evaluation report as JSON, in a folder named by time, model, tag and stage."""
    path = f"{folder}/{timestamp}__{model.replace('/', '-').replace(':', '-')}__{tag}__{stage}"
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """All reports of a folder, newest first; an unreadable one gives a row with _corrupt_record."""
    rows = spark.read.option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").json(folder)
    return rows.withColumn("report", F.input_file_name()).orderBy(F.desc("report"))


def report_markdown(title_: str, metrics: dict[str, float | None], failures: list[dict], top: int = 20) -> str:
    lines = [f"# {title_}", "", "| metric | value |", "| --- | --- |", *(f"| {k} | {'-' if v is None else v} |" for k, v in metrics.items())]
    return "\n".join([*lines, "", "## failures", "", *(f"- {json.dumps(f, ensure_ascii=False)}" for f in failures[:top])])


def guarded_path(path: str, allowed: tuple[str, ...], refused: tuple[str, ...] = ()) -> str:
    """The path, if it lies under an allowed root and under no refused one; raises otherwise."""
    clean = str(PurePosixPath(path))
    if ".." in PurePosixPath(clean).parts or any(clean == r or clean.startswith(f"{r}/") for r in refused):
        raise PermissionError(clean)
    if not any(clean == a or clean.startswith(f"{a}/") for a in allowed):
        raise PermissionError(clean)
    return clean


def cached_embeddings(texts: DataFrame, cache: DataFrame, model: str, embed: Callable[[str], list[float] | None]) -> tuple[DataFrame, DataFrame]:
    """(texts with vectors, new cache rows): hits by sha1 of model and text, misses embedded once; failures stay null.

    texts: text; cache: key, vec.
    """
    keyed = texts.withColumn("key", F.sha1(F.concat(F.lit(f"{model}|"), "text")))
    missing = keyed.join(cache, "key", "left_anti").select("key", "text").dropDuplicates(["key"])

    @F.pandas_udf("array<float>")
    def compute(s: pd.Series) -> pd.Series:
        def one(text: str) -> list[float] | None:
            try:
                return embed(text)
            except Exception:
                return None

        return s.map(one)

    fresh = missing.select("key", compute("text").alias("vec")).filter("vec IS NOT NULL")
    return keyed.join(cache.unionByName(fresh), "key", "left"), fresh
