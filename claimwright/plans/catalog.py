"""Catalog text, schema proposals, their validation, dry run, diffs and application.

A schema is a registry value: a dry run applies a proposal to a copy, a diff compares two
registries, applying yields the next version.  No scratch database is needed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.operators.search import top_or_head
from claimwright.plans.registry import CORE_TABLES, EXTRA_TABLES_TOP, Registry

#: Types that a proposed column may have, with Spark's name for each: fixed values.
DDL_TYPES = {"text": "string", "string": "string", "integer": "bigint", "int": "bigint", "bigint": "bigint", "real": "double", "double": "double", "boolean": "boolean", "date": "string", "timestamp": "timestamp"}
#: Words that no proposed DDL may hold as a token: fixed values.
FORBIDDEN = ("drop", "pragma", "attach", "detach", "vacuum", "reindex", "trigger", "view", "select", "insert", "update", "delete", "replace")

_INTERNAL = re.compile(r"^(sqlite_|_|doc_fts|schema_migrations|spark_)")


@dataclass(frozen=True)
class Proposal:
    """kind is new_table, new_column, rename, split or merge; ddl is what was proposed."""

    kind: str
    table: str | None
    ddl: str
    requires_manual_dry_run: bool = False
    status: str = "pending"


@dataclass(frozen=True)
class Outcome:
    ok: bool
    reason: str | None = None
    diff: tuple[dict, ...] = ()
    registry: Registry | None = None


def visible_tables(names: list[str]) -> list[str]:
    """Table names without internal ones, in order."""
    return sorted(n for n in names if not _INTERNAL.match(n))


def declaration(name: str, columns: dict[str, str]) -> str:
    return f"{name}({', '.join(f'{c} {kind.upper()}' for c, kind in columns.items())})"


def declaration_of(name: str, df: DataFrame) -> str:
    return declaration(name, {f.name: f.dataType.simpleString() for f in df.schema.fields})


def schema_block(registry: Registry, extras: list[str]) -> str:
    """Declarations of the core tables in order, then of the chosen others."""
    tables = registry.tables()
    core = [declaration(t, tables[t]) for t in CORE_TABLES if t in tables]
    more = [declaration(t, tables[t]) for t in extras if t in tables and t not in CORE_TABLES]
    return "\n".join(["-- core", *core, *(["-- related", *more] if more else [])])


def extra_tables(roles: DataFrame, question: list[float] | None, available: list[str], top: int = EXTRA_TABLES_TOP) -> list[str]:
    """The `top` available tables whose role text is nearest to the question; the first ones if it has no vector.

    roles: table, position, embedding: configuration, a row per table.
    """
    chosen = top_or_head(question, roles.filter(roles["table"].isin(available)), top, "position")
    return [r["table"] for r in chosen.collect()]


def _tokens(ddl: str) -> set[str]:
    """The bare words of a text outside quotes."""
    return set(re.findall(r"[a-z_]\w*", re.sub(r"'[^']*'|\"[^\"]*\"|`[^`]*`", " ", ddl.lower())))


def _plan(spark: SparkSession, ddl: str) -> list[dict]:
    """The parsed DDL by Spark's parser; type names of other dialects are translated first."""
    text = re.sub(r"\b(text|real)\b(?=\s*(?:,|\)|$|not\b|unique\b|check\b|default\b|primary\b|references\b))", lambda m: DDL_TYPES[m[1].lower()], ddl, flags=re.IGNORECASE)
    text = re.sub(r"\b(primary\s+key|unique|references\s+\w+\s*\([^)]*\)(\s+on\s+delete\s+\w+)?)\b", " ", text, flags=re.IGNORECASE)
    text = re.sub(r"\bcheck\s*\((?:[^()]|\([^()]*\))*\)|\bdefault\s+(?:'[^']*'|\S+)|\bautoincrement\b", " ", text, flags=re.IGNORECASE)
    text = re.sub(r",\s*(?:foreign\s+key\s*\([^)]*\)|\([^)]*\))\s*(?=[,)])", "", text, flags=re.IGNORECASE)
    text = re.sub(r"(alter\s+table\s+\S+\s+)add\s+column\s+(?!\()(.+)$", r"\1ADD COLUMNS (\2)", text.strip(), flags=re.IGNORECASE | re.DOTALL)
    return json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toJSON())


def validate(spark: SparkSession, proposal: Proposal) -> Outcome:
    """Whether the DDL is one statement of the form that its kind allows, on its own table."""
    if proposal.kind in ("split", "merge"):
        return Outcome(False, "split and merge need a manual dry run")
    if not proposal.ddl.strip():
        return Outcome(False, "empty DDL")
    found = sorted(_tokens(proposal.ddl) & set(FORBIDDEN))
    if found:
        return Outcome(False, f"forbidden word: {found[0]}")
    statement, *indexes = _statements(proposal.ddl)
    if re.search(r"\bif\s+not\s+exists\b", proposal.ddl, re.IGNORECASE):
        return Outcome(False, "IF NOT EXISTS is not allowed")
    about = _target(statement)
    for index in indexes:
        m = _INDEX.fullmatch(index)
        if proposal.kind == "rename" or not m:
            return Outcome(False, "only indexes may follow the first statement")
        if m[1].lower() != about:
            return Outcome(False, f"the index is on {m[1].lower()}, not {about}")
    try:
        plan = _plan(spark, statement)
    except Exception as error:
        return Outcome(False, f"parse error: {str(error).splitlines()[0][:120]}")
    kind = plan[0]["class"].rpartition(".")[2]
    allowed = {"new_table": ("CreateTable",), "new_column": ("AddColumns",), "rename": ("RenameColumn",)}.get(proposal.kind)
    if not allowed:
        return Outcome(False, f"unknown kind: {proposal.kind}")
    if kind not in allowed:
        return Outcome(False, f"{proposal.kind} may not be {kind}")
    if proposal.table and about != proposal.table.lower():
        return Outcome(False, f"the DDL is about {about}, not {proposal.table}")
    return Outcome(True)


#: A plain index on columns of one table.
_INDEX = re.compile(r"create\s+(?:unique\s+)?index\s+\w+\s+on\s+[`\"]?(\w+)[`\"]?\s*\(\s*\w+(?:\s+(?:asc|desc))?(?:\s*,\s*\w+(?:\s+(?:asc|desc))?)*\s*\)", re.IGNORECASE)


def _statements(ddl: str) -> list[str]:
    """The statements of a text, cut at semicolons outside quotes."""
    return [s.strip() for s in re.findall(r"(?:'[^']*'|\"[^\"]*\"|[^;'\"])+", ddl) if s.strip()] or [""]


def _target(ddl: str) -> str:
    m = re.match(r"\s*(?:create\s+table|alter\s+table)\s+[`\"]?(\w+)", ddl, re.IGNORECASE)
    return m[1].lower() if m else ""


def _column_list(body: str) -> dict[str, str]:
    out = {}
    for part in re.split(r",(?![^(]*\))", body):
        m = re.match(r"\s*[`\"]?(\w+)[`\"]?\s+(\w+)", part)
        if m and m[1].lower() not in ("foreign", "unique", "primary", "check", "constraint"):
            out[m[1]] = DDL_TYPES.get(m[2].lower(), m[2].lower())
    return out


def dry_run(spark: SparkSession, registry: Registry, proposal: Proposal) -> Outcome:
    """The registry after the proposal and what changed, without touching anything."""
    checked = validate(spark, proposal)
    if not checked.ok:
        return checked
    ddl = _statements(proposal.ddl)[0]
    table = _target(ddl)
    tables = registry.tables()
    if proposal.kind == "new_table":
        if table in tables:
            return Outcome(False, f"{table} exists")
        after = registry.with_table(table, _column_list(ddl[ddl.index("(") + 1 : ddl.rindex(")")]))
    elif table not in tables:
        return Outcome(False, f"{table} doesn't exist")
    elif proposal.kind == "new_column":
        columns = _column_list(re.sub(r"^.*?\badd\s+(?:column\s+)?", "", ddl, flags=re.IGNORECASE | re.DOTALL))
        clash = [c for c in columns if c in tables[table]]
        if clash:
            return Outcome(False, f"{table}.{clash[0]} exists")
        after = registry
        for column, kind in columns.items():
            after = after.with_column(table, column, kind)
    else:
        m = re.search(r"rename\s+column\s+(\w+)\s+to\s+(\w+)", ddl, re.IGNORECASE)
        if not m or m[1] not in tables[table]:
            return Outcome(False, "no such column to rename")
        after = registry.renamed(table, m[1], m[2])
    return Outcome(True, None, tuple(schema_diff(registry, after)), after)


def schema_diff(before: Registry, after: Registry) -> list[dict]:
    """Tables added, removed or modified, by name."""
    a, b = before.tables(), after.tables()
    out = []
    for name in sorted(a.keys() | b.keys()):
        if a.get(name) != b.get(name):
            out.append({"table": name, "change": "added" if name not in a else "removed" if name not in b else "modified", **column_diff(a.get(name, {}), b.get(name, {}))})
    return out


def next_version(applied: DataFrame, version: str = "version") -> DataFrame:
    """(version): the number that the next applied change gets; 1 for an empty log."""
    return applied.agg((F.coalesce(F.max(version), F.lit(0)) + 1).cast("bigint").alias("version"))


def present_types(spark: SparkSession, registry: Registry) -> list[str]:
    """The entity types whose table and claims table are both there, as a store that wasn't migrated may lack some."""
    return [name for name in registry.entities if spark.catalog.tableExists(name) and spark.catalog.tableExists(f"{name}_claims")]


def column_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table, column, change) of two catalogs of rows (table, column, type): added, removed, retyped or kept."""
    sides = before.withColumnRenamed("type", "was").join(after.withColumnRenamed("type", "now"), ["table", "column"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "retyped").otherwise("kept")
    return sides.select("table", "column", change.alias("change"))


def column_diff(before: dict[str, str], after: dict[str, str]) -> dict[str, list[str]]:
    return {
        "added": [c for c in after if c not in before],
        "removed": [c for c in before if c not in after],
        "kept": [c for c in after if c in before],
        "retyped": [c for c in after if c in before and before[c] != after[c]],
    }


def approve(spark: SparkSession, registry: Registry, proposal: Proposal, manually_checked: bool = False) -> Outcome:
    """The next registry version; only a pending proposal, and one that asks for a manual check only after it."""
    if proposal.status != "pending":
        return Outcome(False, f"already {proposal.status}")
    if proposal.requires_manual_dry_run and not manually_checked:
        return Outcome(False, "needs a manual dry run")
    return dry_run(spark, registry, proposal)


def table_ddl(name: str, columns: dict[str, str]) -> str:
    """DDL for a proposed table: id, name, key, the proposed columns and timestamps."""
    every = {"id": "INTEGER", "canonical_name": "TEXT", "norm_key": "TEXT", **columns, "created_at": "TEXT", "updated_at": "TEXT"}
    return f"CREATE TABLE {name} ({', '.join(f'{c} {kind}' for c, kind in every.items())})"


def apply_to_table(df: DataFrame, before: dict[str, str], after: dict[str, str]) -> DataFrame:
    """A table's rows under a later column list: new columns are null, removed ones go."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in after.items()])


def run_migrations(steps: dict[str, Callable[[], None]], applied: set[int], record: Callable[[int, str], None]) -> list[int]:
    """Runs the steps of numbered files not yet applied, ascending; each is recorded once it has run, and a failure stops the rest."""
    done = []
    for number, name in migrations(list(steps), applied):
        steps[name]()
        record(number, name)
        done.append(number)
    return done


def migrations(files: list[str], applied: set[int]) -> list[tuple[int, str]]:
    """Numbered files not yet applied, ascending; names without a number are passed over."""
    numbered = [(int(m[1]), f) for f in files if (m := re.match(r"(\d+)[^/]*$", f.rsplit("/", 1)[-1]))]
    return sorted((n, f) for n, f in numbered if n not in applied)
