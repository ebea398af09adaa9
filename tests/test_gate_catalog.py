import pytest

from claimwright.plans import ask, catalog, gate
from claimwright.plans.registry import CORE_TABLES, Registry


@pytest.fixture(scope="module")
def views(spark):
    spark.createDataFrame([(1, "7", "active"), (2, "7", "superseded"), (3, "8", "active")], "id long, value string, status string").createOrReplaceTempView("person_claims")
    spark.createDataFrame([(k,) for k in range(80)], "id long").createOrReplaceTempView("person")
    return spark


@pytest.mark.parametrize("sql", [
    "SELECT id FROM person_claims c WHERE c.value > '5' AND c.status = 'active'", "SELECT id FROM person_claims c WHERE c.value BETWEEN 1 AND 2 AND c.status = 'active'",
    "SELECT id FROM person_claims WHERE value LIKE '%x%' AND status = 'active'", "SELECT id FROM person_claims WHERE CAST(value AS INT) = 7 AND status = 'active'",
    "SELECT id FROM person_claims WHERE DATE(value) = '2020-01-01' AND status = 'active'",
    "SELECT id FROM person WHERE id IN (SELECT c.id FROM person_claims c WHERE c.value < '5' AND c.status = 'active')",
    "SELECT v FROM (SELECT value AS v FROM person_claims WHERE status = 'active') WHERE v > 5", "WITH x AS (SELECT value AS v FROM person_claims WHERE status = 'active') SELECT v FROM x WHERE v BETWEEN '1' AND '2'",
    "WITH x AS (SELECT value AS v FROM person_claims), y AS (SELECT v AS w FROM x) SELECT w FROM y JOIN x ON v = w WHERE w > '7'", "SELECT id FROM person_claims WHERE value RLIKE '7'", "SELECT max(value) AS m FROM person_claims",
    "SELECT v FROM (SELECT value AS v FROM person_claims) WHERE CAST(v AS INT) = 7", "SELECT p.id FROM person p JOIN person_claims c ON c.id = p.id AND c.value >= '7'",
])
def test_values_are_only_tested_for_equality(views, sql):
    with pytest.raises(gate.GateError) as error:
        gate.guarded(views, sql)
    assert error.value.rule == "R1"


@pytest.mark.parametrize("sql, rows", [
    ("SELECT id FROM person_claims WHERE value = '7'", 1), ("SELECT id FROM person_claims c WHERE c.value IN ('7', '8')", 2), ("SELECT id FROM person_claims WHERE status = 'superseded'", 1),
    ("SELECT status, count(*) AS n FROM person_claims GROUP BY status", 2), ("SELECT c.id FROM person p LEFT JOIN person_claims c ON c.id = p.id", 50), ("SELECT id FROM person_claims UNION ALL SELECT id FROM person_claims c", 4),
    ("SELECT id FROM person", 50), ("SELECT id FROM person LIMIT 60", 50), ("WITH x AS (SELECT id FROM person_claims) SELECT * FROM x;", 2), ("SELECT id FROM person WHERE id IN (SELECT id FROM person_claims)", 2),
    ("SELECT replace('a;drop table x', 'a', 'update') AS s", 1), ("SELECT id FROM (SELECT id FROM person LIMIT 3)", 3),
    ("SELECT 1 AS a -- note", 1), ("SELECT id FROM person_claims -- FROM person_claims\n", 2), ("SELECT id FROM person_claims /* all of person_claims */ WHERE value = 7", 1), ("SELECT id FROM person LIMIT 7", 7),
    ("WITH x AS (SELECT value AS v, id FROM person_claims), y AS (SELECT id FROM x WHERE v = '7') SELECT * FROM y", 1), ("SELECT x.id FROM (SELECT id, value AS v FROM person_claims) x WHERE x.v IN ('7', '8')", 2),
    ("SELECT value, count(*) AS n FROM person_claims GROUP BY value", 2), ("SELECT id FROM range(5)", 5),
])
def test_queries_pass_repaired(views, sql, rows):
    assert gate.run(views, sql).count() == rows


@pytest.mark.parametrize("sql, aliases", [
    ("SELECT b.value FROM person_claims a JOIN person_claims b ON a.id = b.id WHERE a.status = 'active'", ["b"]),
    ("SELECT a.value FROM person_claims a, person_claims b WHERE a.status = 'active' AND b.status IN ('active', 'superseded')", []),
    ("SELECT value FROM person_claims x WHERE EXISTS (SELECT 1 FROM person_claims y WHERE y.status = 'active' AND y.id = x.id)", ["x"]),
    ("SELECT value FROM person_claims x WHERE EXISTS (SELECT 1 FROM person p WHERE p.id = x.id AND x.status = 'active')", []),
    ("SELECT value FROM person_claims x WHERE EXISTS (SELECT 1 FROM person_claims x WHERE x.status = 'active')", ["x"]),
    ("SELECT t.value FROM (SELECT value, status FROM person_claims) t WHERE t.status = 'superseded'", []), ("SELECT t.value FROM (SELECT value FROM person_claims) t JOIN person_claims c ON c.id = 1 WHERE c.status = 'active'", ["person_claims"]),
    ("WITH w AS (SELECT * FROM person_claims) SELECT * FROM w WHERE w.status <> 'active'", []), ("WITH w AS (SELECT * FROM person_claims) SELECT a.id FROM w a JOIN w b ON a.id = b.id WHERE a.status = 'active'", ["person_claims"]),
    ("SELECT id FROM person_claims UNION ALL SELECT id FROM person_claims c WHERE c.status = 'active'", ["person_claims"]), ("SELECT c.status, count(*) FROM person_claims c GROUP BY c.status", []), ("SELECT count(*) FROM person_claims c GROUP BY c.status", ["c"]),
    ("WITH person_claims AS (SELECT 1 AS id) SELECT id FROM person_claims", []),
])
def test_status_is_asked_of_each_alias(views, sql, aliases):
    assert sorted(v.message.rpartition("(as ")[2].rstrip(")") for v in gate.lint(views, sql) if v.rule == "R2") == aliases


@pytest.mark.parametrize("sql, values", [
    ("SELECT b.value FROM person_claims a JOIN person_claims b ON a.value = b.value WHERE a.status = 'active'", ["7", "8"]),
    ("SELECT value FROM person_claims x WHERE EXISTS (SELECT 1 FROM person_claims y WHERE y.status = 'active')", ["7", "8"]),
    ("SELECT value FROM `person_claims` -- FROM person_claims\n WHERE id > 0", ["7", "8"]), ("SELECT person_claims.value FROM person_claims", ["7", "8"]), ("SELECT value AS `é` FROM person_claims /* é */ c", ["7", "8"]),
    ("SELECT t.value FROM (SELECT value, status FROM person_claims) t WHERE t.status = 'superseded'", ["7"]),
])
def test_each_bare_alias_reads_active_rows(views, sql, values):
    assert sorted(r[0] for r in gate.run(views, sql).collect()) == values


def test_qualified_claims_tables_are_repaired(views, tmp_path):
    views.sql("CREATE DATABASE IF NOT EXISTS kept")
    views.sql(f"CREATE TABLE IF NOT EXISTS kept.user2_claims USING parquet LOCATION '{tmp_path}/u2' AS SELECT * FROM person_claims")
    try:
        assert gate.run(views, "SELECT value FROM kept.user2_claims").count() == 2 and gate.run(views, "SELECT c.value FROM kept.user2_claims c WHERE c.status = 'superseded'").count() == 1
    finally:
        views.sql("DROP DATABASE kept CASCADE")


@pytest.mark.parametrize("sql", ["SELECT array_max(collect_set(value)) AS m FROM person_claims", "SELECT sort_array(collect_list(value)) AS s FROM person_claims", "SELECT max_by(id, value) AS m FROM person_claims", "SELECT value || 'x' > '7' AS b FROM person_claims", "SELECT percentile(value, 0.5) AS p FROM person_claims"])
def test_order_is_refused_under_any_name(views, sql):
    with pytest.raises(gate.GateError) as error:
        gate.guarded(views, sql)
    assert error.value.rule == "R1"


@pytest.mark.parametrize("sql, rows", [
    ("SELECT id % 3 AS k, id FROM person GROUP BY k", 3), ("SELECT p.id % 3 AS k,\n upper(p.id) AS u\nFROM\n person p GROUP BY 1", 3), ("SELECT status, value FROM person_claims GROUP BY status HAVING count(*) > 0", 2),
    ("SELECT status, max(id) AS m, concat(value, ' FROM ') AS s FROM person_claims GROUP BY status", 2), ("SELECT x.k FROM (SELECT status AS k, id FROM person_claims GROUP BY status) x", 2),
])
def test_bare_columns_of_a_grouping(views, sql, rows):
    assert gate.run(views, sql).count() == rows


@pytest.mark.parametrize("sql, rows", [
    ("SELECT id FROM named WHERE n LIKE 'ann%'", 2), ("SELECT id FROM named WHERE n NOT /* LIKE */ like 'ANN%'", 1), ("SELECT id FROM named WHERE n = 'LIKE' OR n LIKE '%B' -- LIKE\n", 1),
    ("SELECT id FROM named WHERE id IN (SELECT id FROM named x WHERE x.n LIKE 'b_b')", 1), ("SELECT id FROM named WHERE strftime('%Y', '2024-05-06') = '2024'", 3),
])
def test_sqlite_s_like_knows_no_case(views, sql, rows):
    views.createDataFrame([(1, "Ann"), (2, "ANNA"), (3, "Bob")], "id int, n string").createOrReplaceTempView("named")
    assert gate.run(views, sql, sqlite=True).count() == rows


@pytest.mark.parametrize("sql", ["DROP TABLE person", "INSERT INTO person SELECT 1", "CREATE TABLE x (a INT)", "CREATE VIEW v AS SELECT 1", "DELETE FROM person", "SELECT 1; SELECT 2", "SELEC 1", "", "SHOW TABLES", "SET x = 1", "USE default", "DESCRIBE person", "EXPLAIN SELECT 1", "TRUNCATE TABLE person", "ALTER TABLE person ADD COLUMNS (b INT)", "CACHE TABLE person",
    "SELECT * FROM text.`/etc/passwd`", "SELECT * FROM csv.`/tmp`", "WITH x AS (SELECT * FROM binaryFile.`/etc/passwd`) SELECT * FROM x", "SELECT id FROM person WHERE id IN (SELECT value FROM text.`/etc/passwd`)",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x", "SELECT java_method('java.lang.System', 'getenv', 'HOME') AS x", "SELECT * FROM nowhere", "SELECT 1) UNION (SELECT 2"])
def test_nothing_but_one_select_passes(views, sql):
    with pytest.raises(gate.GateError):
        gate.guarded(views, sql)


class Stub:
    def __init__(self, *answers):
        self.answers, self.errors = list(answers), []

    def sql(self, question, schema, hints, examples, error):
        self.errors.append(error)
        return self.answers.pop(0)

    def prose(self, question, rows, documents):
        return f"{rows} / {len(documents)}"

    def embed(self, text):
        return None


def test_one_repair(views):
    bad = Stub("SELECT nope FROM person", "SELECT id FROM person LIMIT 1")
    sql, _, rows, error = ask.text_to_sql(views, bad, "q")
    assert rows == [{"id": 0}] and error is None and bad.errors[1] and "LIMIT 1" in sql
    empty = Stub("SELECT id FROM person WHERE id < 0", "DROP TABLE person")
    sql, _, rows, error = ask.text_to_sql(views, empty, "q")
    assert "id < 0" in sql and rows == [] and error is None
    lost = Stub("x", "y")
    assert ask.text_to_sql(views, lost, "q")[0] is None


def test_answer_brings_rows_documents_and_sources(views):
    docs = views.createDataFrame([(1, "about ann here")], "doc_id long, text string")
    known = views.createDataFrame([("person", 1, "Ann")], "entity_table string, entity_id long, canonical_name string")
    backed = views.createDataFrame([("person", 1, 1, "active")], "entity_table string, entity_id long, document_id long, status string")
    slugs = views.createDataFrame([(1, "ann-doc")], "id long, slug string")
    trace = ask.Trace()
    got = ask.answer(views, Stub("SELECT 'Ann' AS name"), "who is ann", docs, known, backed, slugs, trace)
    assert got.rows == [{"name": "Ann"}] and got.documents[0]["snippet"] == "about >>ann<< here" and got.sources[0]["slug"] == "ann-doc" and "Ann" in got.text
    assert [s for s, _ in trace.steps] == ["sql_ran", "documents"]


def proposal(kind, table, ddl):
    return catalog.Proposal(kind, table, ddl)


@pytest.mark.parametrize("p, ok", [
    (proposal("new_table", "startup", catalog.table_ddl("startup", {"stage": "TEXT"})), True), (proposal("new_table", "startup", "CREATE TABLE other (a TEXT)"), False),
    (proposal("new_table", "t", "CREATE TABLE t AS SELECT 1"), False), (proposal("new_column", "product", "ALTER TABLE product ADD COLUMN color TEXT"), True),
    (proposal("new_column", "product", "ALTER TABLE person ADD COLUMN color TEXT"), False), (proposal("new_column", "product", "DROP TABLE product"), False),
    (proposal("rename", "project", "ALTER TABLE project RENAME COLUMN started_at TO began_at"), True), (proposal("rename", "project", "ALTER TABLE project ADD COLUMN b TEXT"), False),
    (proposal("split", "person", "CREATE TABLE a (x TEXT)"), False), (proposal("new_table", "t", ""), False), (proposal("new_table", "t", "CREATE TABLE t (a TEXT); DROP TABLE person"), False),
    (proposal("new_table", "t", "CREATE TABLE IF NOT EXISTS t (a TEXT)"), False), (proposal("new_table", "t", "CREATE TABLE t (a TEXT); CREATE INDEX ix ON t(a);"), True),
    (proposal("new_table", "t", "CREATE TABLE t (a TEXT, b TEXT); CREATE UNIQUE INDEX ix ON t (a, b DESC)"), True), (proposal("new_table", "t", "CREATE TABLE t (a TEXT); CREATE INDEX ix ON person(a)"), False),
    (proposal("new_table", "t", "CREATE INDEX ix ON t(a)"), False), (proposal("new_table", "t", "CREATE TABLE t (a TEXT); CREATE TABLE t (b TEXT)"), False),
    (proposal("new_column", "product", "ALTER TABLE product ADD COLUMN color TEXT; CREATE INDEX ix ON product(color)"), True), (proposal("rename", "project", "ALTER TABLE project RENAME TO venture"), False),
    (proposal("new_table", "t", "nonsense"), False), (proposal("new_table", "t", "CREATE TABLE t (id INTEGER PRIMARY KEY, updated_at TEXT NOT NULL, p INTEGER REFERENCES person(id))"), True),
])
def test_validation(spark, p, ok):
    assert catalog.validate(spark, p).ok is ok


def test_dry_run_leaves_the_registry_and_approval_moves_it_on(spark):
    registry = Registry()
    p = proposal("new_column", "product", "ALTER TABLE product ADD COLUMN color TEXT")
    done = catalog.dry_run(spark, registry, p)
    assert done.ok and [(d["table"], d["added"]) for d in done.diff] == [("product", ["color"])]
    assert "color" not in registry.entities["product"] and "color" in done.registry.entities["product"] and done.registry.version == registry.version + 1
    assert not catalog.dry_run(spark, done.registry, p).ok
    assert not catalog.approve(spark, registry, catalog.Proposal(p.kind, p.table, p.ddl, status="approved")).ok
    manual = catalog.Proposal(p.kind, p.table, p.ddl, requires_manual_dry_run=True)
    made = catalog.dry_run(spark, registry, proposal("new_table", "t", "CREATE TABLE t (id INTEGER, name TEXT); CREATE INDEX ix ON t(name);"))
    assert made.ok and made.registry.tables()["t"] == {"id": "bigint", "name": "string"}
    assert not catalog.approve(spark, registry, manual).ok and catalog.approve(spark, registry, manual, manually_checked=True).ok


def test_schema_text(spark):
    block = catalog.schema_block(Registry(), ["person_claims", "nowhere", "person"])
    lines = block.splitlines()
    assert lines[0] == "-- core" and lines[1].startswith("documents(id BIGINT") and len(lines) == len(CORE_TABLES) + 3 and lines[-1].startswith("person_claims(person_id BIGINT")
    roles = spark.createDataFrame([("a", 0, [0.0, 1.0]), ("b", 1, [1.0, 0.0]), ("c", 2, [0.5, 0.5])], "table string, position int, embedding array<float>")
    assert catalog.extra_tables(roles, [1.0, 0.0], ["a", "b"], 1) == ["b"] and catalog.extra_tables(roles, None, ["c", "a"], 1) == ["a"]
    assert catalog.visible_tables(["person", "doc_fts_data", "_x", "sqlite_master"]) == ["person"]
    assert catalog.migrations(["m/0002_b.sql", "0001_a.sql", "readme.md", "10_c.sql"], {1}) == [(2, "m/0002_b.sql"), (10, "10_c.sql")]
    ran, log = [], []
    steps = {"m/0002_b.sql": lambda: ran.append(2), "0001_a.sql": lambda: ran.append(1), "readme.md": lambda: ran.append(0), "10_c.sql": lambda: ran.append(10), "11_d.sql": lambda: 1 / 0, "12_e.sql": lambda: ran.append(12)}
    with pytest.raises(ZeroDivisionError):
        catalog.run_migrations(steps, {1}, lambda n, name: log.append((n, name)))
    assert ran == [2, 10] and log == [(2, "m/0002_b.sql"), (10, "10_c.sql")] and catalog.run_migrations({}, set(), print) == []
    moved = catalog.apply_to_table(spark.createDataFrame([(1, "x")], "a long, b string"), {}, {"a": "bigint", "c": "string"})
    assert moved.columns == ["a", "c"] and tuple(moved.first()) == (1, None)
