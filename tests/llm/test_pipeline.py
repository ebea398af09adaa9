import corpus_pipeline
from claimwright.llm import secret_scan
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_minhash import brute_classes
from tests.llm.test_mixing import brute as mixed


def test_stages_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(stage(spark, frames[-1], tiny).cache())
        assert frames[-1].columns == docs.columns
    rows = [[(r.doc_id, r.text) for r in f.collect()] for f in frames]
    clean = [r for r in rows[0] if not any(w in r[1].lower() for w in ("idiot", "moron", "scum", "loser", "pathetic", "worthless"))]
    assert {i for i, _ in clean} <= {i for i, _ in rows[1]}
    assert sorted(i for i, _ in rows[2]) == sorted(set(brute_classes(rows[1]).values()))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    judged = contaminated(rows[2], items)
    assert {i for i, _ in rows[3]} == {i for i, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)}
    assert dict(rows[4]) == {i: secret_scan.redacted(t, secret_scan.scan(t)) for i, t in rows[3]}
    source = {r.doc_id: r.source for r in docs.collect()}
    want, _ = mixed([(i, t, source[i]) for i, t in rows[4]])
    last = corpus_pipeline.STAGES[-1][1](spark, frames[-1], tiny).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.taken) for r in last) == [w for w in want if w[3] > 0]


def test_run_writes_and_reads_each_stage(spark, tiny):
    found = corpus_pipeline.run(spark, tiny)
    assert found.count() > 0 and {"doc_id", "taken"} <= set(found.columns)
