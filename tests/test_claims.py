import random

import pytest
from pyspark.sql import functions as F

from claimwright.operators import claims

SCHEMA = "entity_table string, entity_id long, column_name string, document_id long, value string, confidence double, seq long"


def log(spark, rows, key=("person", 1, "birth_date")):
    return spark.createDataFrame([(*key, d, v, c, k) for k, (d, v, c) in enumerate(rows)], SCHEMA)


#: (arrivals, statuses by document, canonical value) of the incremental machine.
INCREMENTAL = [
    ([(1, "1990", 0.8)], {1: "active"}, "1990"),
    ([(1, "v", 0.8), (2, "v", 0.7)], {1: "active", 2: "active"}, "v"),
    ([(1, "1990", 0.5), (2, "1991", 0.8)], {1: "superseded", 2: "active"}, "1991"),
    ([(1, "1990", 0.7), (2, "1991", 0.75)], {1: "conflicted", 2: "conflicted"}, "1990"),
    ([(1, "1990", 0.9), (2, "1991", 0.4)], {1: "active", 2: "superseded"}, "1990"),
    ([(2, "1990", 0.95), (1, "1991", 1.0)], {1: "conflicted", 2: "conflicted"}, "1990"),
    ([(2, "1990", 0.5), (1, "1991", 1.0)], {2: "superseded", 1: "active"}, "1991"),
    ([(1, "v", 0.5), (1, "v", 0.9)], {1: "active"}, "v"),
    ([(1, "1990", 0.5), (1, "1991", 0.9)], {1: "active"}, "1991"),
    ([(1, "1990", 0.2)], {}, None),
    ([(1, "1990", 0.7), (2, "1991", 0.75), (3, "1992", 0.4)], {1: "conflicted", 2: "conflicted", 3: "active"}, "1992"),
]


@pytest.mark.parametrize("arrivals, statuses, value", INCREMENTAL)
def test_machine(arrivals, statuses, value):
    machine = claims.Machine()
    for d, v, c in arrivals:
        machine.add(d, v, c)
    assert {d: r[2] for d, r in machine.rows.items()} == statuses and machine.value == value


def test_fold_equals_the_machine_whatever_the_partitions(spark):
    rng = random.Random(4)
    rows, machines = [], {}
    for seq in range(600):
        key = ("person", rng.randrange(9), rng.choice(["birth_date", "nationality"]))
        claim = (rng.randrange(6), rng.choice("abc"), rng.choice([0.1, 0.4, 0.45, 0.6, 0.9]))
        rows.append((*key, *claim, seq))
        machines.setdefault(key, claims.Machine()).add(*claim)
    want = {(*k, d, *r[:3], m.value) for k, m in machines.items() for d, r in m.rows.items()}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts, "value")
        got = {(r.entity_table, r.entity_id, r.column_name, r.document_id, r.value, r.confidence, r.status, r.canonical_value) for r in claims.fold(df).collect()}
        assert got == want


def statuses(df):
    return {r.document_id: r.status for r in df.collect()}


def test_resolve(spark):
    assert statuses(claims.resolve(log(spark, [(1, "a", 0.9), (2, "b", 0.85), (3, "c", 0.5), (4, "a", 0.4)]))) == {1: "conflicted", 2: "conflicted", 3: "superseded", 4: "active"}
    assert statuses(claims.resolve(log(spark, [(1, "a", 0.9), (2, "b", 0.85), (3, "c", 0.5)]), strict=True))[3] == "active"
    assert statuses(claims.resolve(log(spark, [(1, "a", 0.9), (2, "b", 0.5), (2, "a", 0.6)]))) == {1: "active", 2: "active"}
    assert statuses(claims.resolve(log(spark, [(1, None, 0.9), (2, None, 0.9), (3, "x", 0.2)]))) == {1: "active", 2: "active", 3: "superseded"}
    assert claims.resolve(log(spark, [])).count() == 0


def test_resolve_agrees_with_fold_without_conflicts(spark):
    df = log(spark, [(1, "a", 0.4), (2, "b", 0.6), (3, "c", 0.9), (4, "c", 0.3)])
    resolved = {r.document_id: (r.status, r.pivot_value) for r in claims.resolve(df).collect()}
    assert resolved == {r.document_id: (r.status, r.canonical_value) for r in claims.fold(df).collect()}


def test_reingesting_changes_nothing(spark):
    df = log(spark, [(1, "a", 0.4), (2, "b", 0.6)])
    again = df.union(df.withColumn("seq", F.col("seq") + 10))
    assert statuses(claims.resolve(df)) == statuses(claims.resolve(again)) and claims.latest(again).count() == 2


def test_existence_and_groups(spark):
    df = spark.createDataFrame([(7, 1, 0.6, 1), (7, 2, 0.7, 2), (7, 3, 0.2, 3)], "edge_id long, document_id long, confidence double, seq long")
    assert statuses(claims.existence_resolve(df)) == {1: "active", 2: "active", 3: "superseded"}
    fought = claims.conflict_groups(claims.resolve(log(spark, [(1, "a", 0.9), (2, "b", 0.85)]))).collect()
    assert {r.kind for r in fought} == {"person_birth_date"} and len({r.conflict_group for r in fought}) == 1 and len(fought) == 2


def test_canonical_table_casts_what_it_can(spark):
    rows = [("organization", 1, "founded_year", 1, "1990", 0.9, 1), ("organization", 1, "headquarters", 1, "Paris", 0.9, 2), ("organization", 2, "founded_year", 1, "long ago", 0.9, 3)]
    got = {r.entity_id: (r.founded_year, r.headquarters) for r in claims.canonical_table(claims.resolve(spark.createDataFrame(rows, SCHEMA)), "organization").collect()}
    assert got == {1: (1990, "Paris"), 2: (None, None)}


def test_violations(spark):
    rows = [("person", 1, "birth_date", 1, "x", 0.5, 1), ("robot", 1, "name", 1, "x", 0.5, 2), ("person", 1, "role", 1, "x", 0.5, 3), ("person", 1, "birth_date", 1, "x", 1.5, 4),
            ("organization", 1, "org_type", 1, "gang", 0.5, 5), ("contract", 1, "sla_uptime_percent", 1, "101", 0.5, 6), ("contract", 1, "rto_hours", 1, "soon", 0.5, 7), ("organization", 1, "org_type", 1, None, 0.5, 8)]
    got = {r.seq: r.violation for r in claims.violations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: None, 2: "unknown_type", 3: "unknown_column", 4: "confidence_range", 5: "enum", 6: "range", 7: "range", 8: None}


def test_measures(spark):
    df = log(spark, [(1, "a", 0.9), (2, "a", 0.5), (3, "b", 0.3)])
    resolved = claims.resolve(df)
    assert {r.status: r.n for r in claims.status_histogram(resolved).collect()} == {"active": 2, "superseded": 1}
    assert [r.support for r in claims.support(resolved).collect()] == [2] and [r.flips for r in claims.flips(df).collect()] == [1]
    assert [r.changed for r in claims.history(df).orderBy("seq").collect()] == [True, False, True]
    verdict = spark.range(1).select(*claims.human_verdict("person", F.lit(1), "birth_date", F.lit("b"), F.lit(99)))
    assert [c in verdict.columns for c in ("document_id", "confidence")] == [True, True] and verdict.first().confidence == 1.0
