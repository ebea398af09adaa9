"""Listing of evaluation reports with their headline numbers, and what a run states of itself."""

from __future__ import annotations

import subprocess
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headline names and the aggregate that each shows, by stage: fixed values.
HEADLINES = {
    "query": {"sql": "sql_success_rate", "row": "row_contains_rate", "doc": "doc_slug_rate"},
    "extract": {"ent_f1": "entities_f1", "rel_f1": "relations_f1", "fact_f1": "facts_f1"},
    "dedup": {"acc": "accuracy", "f1": "f1", "lvl": "level_match_rate"},
    "proposal": {"prop_f1": "proposal_f1", "stage_f1": "staging_f1", "weak_r": "weak_promotion_recall", "stab": "canonical_stability_passed"},
}
_MEAN = "_mean"


def headline(stage: Column | str, aggregate: Column | str) -> Column:
    """map(name, value): what a report of the stage is known by; of other stages every mean, by its name without the ending."""
    s, a = (F.col(c) if isinstance(c, str) else c for c in (stage, aggregate))
    means = F.map_filter(a, lambda k, _: k.endswith(_MEAN))
    shown = F.transform_keys(means, lambda k, _: F.substr(k, F.lit(1), F.length(k) - len(_MEAN)))
    out = F.when(F.lit(False), shown)
    for name, columns in HEADLINES.items():
        out = out.when(s == name, F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[a[F.lit(c + _MEAN)] for c in columns.values()])))
    return out.otherwise(shown)


def listing(reports: DataFrame) -> DataFrame:
    """`reports` (stage, aggregate, timestamp_utc, file and more) with headline and score, the mean of what is there; the newest first.

    Reports that couldn't be read have neither, and come last.
    """
    shown = reports.withColumn("headline", headline("stage", "aggregate"))
    there = F.filter(F.map_values("headline"), lambda v: v.isNotNull())
    score = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda t, v: t + v) / F.size(there))
    return shown.withColumn("score", score).orderBy(F.desc(F.coalesce("timestamp_utc", F.lit(""))), F.desc("file"))


def revision(folder: str) -> str:
    """The git revision of a folder, or `unknown`."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, check=True, text=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def run_meta(stage: str, gold: str, tag: str, runs: int, model: str, folder: str = ".", temperature: float = 0.0, context: int = 0) -> dict:
    """What an evaluation run states of itself."""
    return {
        "timestamp_utc": datetime.now(UTC).strftime("%Y-%m-%dT%H-%M-%SZ"), "model": model, "temperature": float(temperature), "num_ctx": context,
        "git_rev": revision(folder), "tag": tag, "runs": runs, "stage": stage, "gold_path": gold,
    }
