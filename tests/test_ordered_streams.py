import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimwright.operators import claims, ordered
from claimwright.streaming import claims as streaming

SCHEMA = "entity_table string, entity_id long, column_name string, document_id long, value string, confidence double, seq long"


@pytest.fixture(scope="module")
def hot(spark):
    """A key with a third of all rows, null keys, nulls among the values."""
    rng = random.Random(6)
    rows = [(None if k % 50 == 0 else "hot" if k % 3 == 0 else f"k{rng.randrange(40)}", k % 2, k, rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2, 5])) for k in range(4000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "a string, b int, seq int, v string, n int").repartition(9)


def test_previous_rows_of_a_hot_key(spark, hot):
    rows, df = hot
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one range
    try:
        got = {r.seq: r.p for r in ordered.with_previous(df, ("a", "b"), "seq", "v", "p").collect()}
        last, want = {}, {}
        for a, b, seq, v, _ in sorted(rows, key=lambda r: r[2]):
            want[seq] = last.get((a, b))
            last[a, b] = v
        assert got == want
        sizes = ordered._ranged(df, ("a", "b"), "seq").groupBy("_range").count().collect()
        assert len(sizes) > 8 and max(r["count"] for r in sizes) < len(rows) / 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_of_a_hot_key(spark, hot):
    rows, df = hot
    got = {r.seq: r.s for r in ordered.with_running(df, ("a", "b"), "seq", "n", "s").collect()}
    total = {}
    for a, b, seq, _, n in sorted(rows, key=lambda r: r[2]):
        if n is not None:
            total[a, b] = total.get((a, b), 0) + n
        assert got[seq] == total.get((a, b)), seq
    assert ordered.with_running(df.limit(0), ("a",), "seq", "n", "s").count() == 0


def log(spark, n=300, seed=2):
    rng = random.Random(seed)
    rows = [("p", k % 3, "c", rng.randrange(9), rng.choice(["a", "b", "c", None]), rng.choice([0.1, 0.4, 0.45, 0.6, 0.9, None]), k) for k in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def plain_machine(rows, delta=0.1, least=0.3):
    """The rule of the store, with every claim walked each time."""
    store, value, groups, out = {}, None, 0, []
    for _, _, _, d, v, c, _ in rows:
        if c is None or c < least:
            out.append("rejected")
            continue
        if d in store:
            out.append("refreshed" if store[d][0] == v else "revalued")
            store[d][0], store[d][1] = v, c
            best = max(store.values(), key=lambda r: r[1])
            rivals = [r for r in store.values() if r[0] != best[0] and best[1] - r[1] <= delta]
            groups += bool(rivals)
            for r in store.values():
                fought = rivals and (r is best or r in rivals and r[0] != best[0])
                r[2:] = ["conflicted", groups] if fought else ["active" if r[0] == best[0] or rivals else "superseded", None]
            value = best[0]
            continue
        active = [r for r in store.values() if r[2] == "active"]
        mine = store[d] = [v, c, "active", None]
        if not active or any(r[0] == v for r in active):
            value = value if active else v
            out.append("inserted_active")
            continue
        gap = c - max(r[1] for r in active)
        if gap > delta:
            for r in active:
                r[2] = "superseded"
            value = v
            out.append("inserted_active")
        elif gap < -delta:
            mine[2] = "superseded"
            out.append("inserted_superseded")
        else:
            groups += 1
            for r in (*active, mine):
                r[2:] = ["conflicted", groups]
            out.append("inserted_conflicted")
    return store, value, out


def test_the_machine_that_keeps_its_active_claims_apart(spark):
    for seed in range(40):
        rows = [r for r in log(spark, 80, seed)[0] if r[1] == 0] if seed == 0 else [("p", 0, "c", *x) for x in [(random.Random(seed * 100 + k).randrange(7), random.Random(seed * 7 + k).choice(["a", "b", None]), random.Random(seed + k * 3).choice([0.2, 0.5, 0.55, 0.7, 0.95]), k) for k in range(60)]]
        machine = claims.Machine()
        store, value, out = plain_machine(rows)
        assert [machine.add(*r[3:6]) for r in rows] == out and machine.value == value
        assert {d: r[:4] for d, r in machine.rows.items()} == store


@pytest.mark.parametrize("parts", [1, 4])
def test_the_stream_s_state_equals_the_fold(spark, tmp_path, parts):
    rows, df = log(spark)
    for piece in streaming.in_arrivals(df, "seq", parts):
        piece.write.mode("append").parquet(str(tmp_path / "in"))
        found = streaming.run(streaming.fold_stream(streaming.landing(spark, str(tmp_path / "in"), SCHEMA)), str(tmp_path / "s"))
    got = {(r.entity_id, r.seq): (r.outcome, r.canonical_value) for r in found.collect()}
    assert len(got) == len(rows)
    for key in range(3):
        mine = [r for r in rows if r[1] == key]
        _, value, out = plain_machine(mine)
        assert [got[key, r[6]][0] for r in mine] == out and got[key, mine[-1][6]][1] == value
    last = {r.entity_id: r.canonical_value for r in claims.fold(df).collect()}
    assert last == {key: plain_machine([r for r in rows if r[1] == key])[1] for key in range(3)}


def test_a_batch_that_is_handed_over_again_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, "c", k % 4, "a", 0.5, k) for k in range(20)], SCHEMA).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    updates = lambda: streaming.once_per_document(streaming.landing(spark, str(tmp_path / "in"), SCHEMA + ", ts timestamp"))
    write = streaming.batch_folders(str(tmp_path / "s" / "sink"))

    def dying(batch, number):
        write(batch, number)
        raise RuntimeError("killed after writing")

    with pytest.raises(Exception, match="killed after writing"):
        streaming.into_table(updates(), str(tmp_path / "s" / "checkpoint"), dying).awaitTermination()
    for _ in range(3):
        assert streaming.run(updates(), str(tmp_path / "s")).count() == 4
    df.withColumn("document_id", F.col("document_id") + 2).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r.document_id for r in streaming.run(updates(), str(tmp_path / "s")).collect()) == [0, 1, 2, 3, 4, 5]


def test_the_stream_asks_for_state_by_key_not_by_claim(spark, tmp_path):
    """Twenty claims of a key are a read and a write of its entry."""
    keys, rng = 200, random.Random(4)
    rows = [("p", k % keys, "c", rng.randrange(9), rng.choice(["a", "b", None]), rng.choice([0.1, 0.4, 0.45, 0.9]), k) for k in range(keys * 20)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    updates = streaming.fold_stream(streaming.landing(spark, str(tmp_path / "in"), SCHEMA))
    query = streaming.into_table(updates, str(tmp_path / "ck"), lambda batch, n: batch.write.parquet(str(tmp_path / "out")))
    query.awaitTermination()
    told = [op.customMetrics for p in query.recentProgress for op in p.stateOperators]
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert sum(m["rocksdbPutCount"] for m in told) <= keys and sum(m["rocksdbGetCount"] for m in told) <= 3 * keys


@pytest.mark.parametrize("page", [1, 4])
def test_keys_that_share_an_entry_and_spread_over_pages(spark, tmp_path, page):
    rows, df = log(spark, 900, seed=11)
    rows = [(t, k, c, d * 5 + s % 5, v, conf, s) for t, k, c, d, v, conf, s in rows]
    for piece in streaming.in_arrivals(spark.createDataFrame(rows, SCHEMA), "seq", 4):
        piece.write.mode("append").parquet(str(tmp_path / "in"))
        found = streaming.run(streaming.fold_stream(streaming.landing(spark, str(tmp_path / "in"), SCHEMA), groups=2, entries=1, page=page), str(tmp_path / "s"))
    got = {(r.entity_id, r.seq): (r.outcome, r.canonical_value) for r in found.collect()}
    assert len(got) == len(rows)
    for key in range(3):
        mine = [r for r in rows if r[1] == key]
        machine = claims.Machine()
        assert [got[key, r[6]] for r in mine] == [(machine.add(*r[3:6]), machine.value) for r in mine]
        assert [got[key, r[6]][0] for r in mine] == plain_machine(mine)[2]


class Kept:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.reads, self.writes = {}, [], []

    def getMapState(self, *_):  # noqa: N802  name of the interface
        return self

    def getValue(self, key):  # noqa: N802
        self.reads.append(key[0])
        return self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.writes.append(key[0])
        self.held[key] = value


def test_a_micro_batch_reads_and_writes_an_entry_once():
    state, fold = Kept(), streaming.ClaimFold(0.1, page=10)
    fold.init(state)

    def told(rows, entries=1):
        state.reads, state.writes = [], []
        frame = pd.DataFrame([(7, k % entries, *r) for k, r in enumerate(rows)], columns=["group", "entry", *SCHEMA.replace(" string", "").replace(" long", "").replace(" double", "").split(", ")])
        return pd.concat(fold.handleInputRows((7,), iter([frame[:500], frame[500:]]), None))

    first = told([("p", k % 1000, "c", k // 1000, "é", 0.5, k) for k in range(4000)], entries=2)
    assert len(first) == 4000 and sorted(state.reads) == sorted(state.writes) == ["0", "1"]
    told([("p", 0, "c", 100, "é", 0.1, 5000)])  # rejected: nothing has changed
    assert state.reads == ["0"] and not state.writes
    told([("p", 2, "d", k, "é", 0.5, 6000 + k) for k in range(95)])
    assert len(state.writes) == 10
    last = told([("p", 2, "d", 94, "x", 0.9, 9000)])  # the last document speaks again, and all others are judged anew
    assert last.outcome.tolist() == ["revalued"] and last.canonical_value.tolist() == ["x"] and len(state.reads) == 10
    assert len(state.writes) == 10
    told([("p", 2, "d", 200, "x", 0.9, 9001)])  # a new document touches the entry and its own page
    assert state.writes == ['["p", 2, "d", 9]', "0"]
