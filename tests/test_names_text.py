import pytest
from pyspark.sql import functions as F

from claimwright.functions import confidence, names, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("name, key", [("アクメ株式会社", "アクメ"), ("アクメ（株）", "アクメ"), ("Smart Scan", "smartscan"), ("Coca-Cola Co.", "cala"), ("㈱日立", "日立"), ("", ""), ("Ｇｌｏｂｅｘ　Ｃｏｒｐ．", "globex")])
def test_norm_key(spark, name, key):
    assert one(spark, names.norm_key(F.lit(name)))[0] == key


@pytest.mark.parametrize("a, b, score", [("alice", "alicia", 0.4444), ("東京大学", "東大", 0.1429), ("ibmbobpro", "ibmbobproplus", 0.6), ("", "x", 0.0), ("x", "x", 1.0)])
def test_trigram_similarity(spark, a, b, score):
    got = one(spark, names.similarity(F.lit(a), F.lit(b)), names.similarity(F.lit(b), F.lit(a)))
    assert round(got[0], 4) == score and got[0] == got[1]


def test_cosine(spark):
    vec = lambda *x: F.array(*map(F.lit, x)).cast("array<float>")
    got = one(spark, names.cosine(vec(1.0, 0.0), vec(0.7, 0.7)), names.cosine(vec(0.0, 0.0), vec(1.0, 1.0)), names.cosine(vec(1.0), vec(1.0, 1.0)), names.cosine(F.array().cast("array<float>"), vec(1.0)))
    assert [round(x, 4) for x in got] == [0.7071, 0.0, 0.0, 0.0]


def test_suffix_and_slug(spark):
    got = one(spark, names.suffix_stripped(F.lit("業務契約書")), names.suffix_stripped(F.lit("書")), text.slug(F.lit("my file.v2.pdf")), text.title(F.lit("my-file.v2")), text.slug(F.lit("plain")))
    assert tuple(got) == ("業務", None, "my-file.v2", "my file.v2", "plain")


def test_chunks():
    assert text.chunks("", 5) == [""] and text.chunks(None, 5) == [""] and text.chunks("short", 5) == ["short"]
    assert text.chunks("aa\n\nbb\n\ncc", 6) == ["aa\n\nbb", "cc"]
    assert text.chunks("x" * 12, 5) == ["xxxxx", "xxxxx", "xx"]
    doc = "# top\nintro\n## one\n" + "a" * 30 + "\n## two\n" + "b" * 30
    parts = text.chunks(doc, 40)
    assert len(parts) == 3 and parts[1].startswith("## one") and all(len(p) <= 40 for p in parts)
    assert all(len(p) <= 50 for p in text.chunks("w " * 500 + "\n\n" + "# h\n" * 30, 50))


def test_chunks_cut_deeper_only_where_needed():
    doc = "## a\nshort\n## b\n" + "x" * 20 + "\n### c\n" + "y" * 20 + "\n\n" + "z" * 20 + "\n### d\nend"
    head = "## a\nshort\n\n\n## b\n" + "x" * 20 + "\n"
    assert text.chunks(doc, 60) == [head, "### c\n" + "y" * 20 + "\n\n" + "z" * 20 + "\n\n\n### d\nend"]
    assert text.chunks(doc, 40) == [head, "### c\n" + "y" * 20, "z" * 20 + "\n\n\n### d\nend"]
    assert text.chunks("a\n \n\nb" + " " * 10, 8) == ["a", "b" + " " * 7, " " * 3]


def test_loose_json():
    assert text.loads_loose("a [1] b [2]") == [] and text.loads_loose('x {"a": [1]} y') == [1] and text.loads_loose("```\n{}\n```") == {}
    assert text.loads_loose('```json\n[1, 2]\n```') == [1, 2]
    assert text.loads_loose("say [3] ok") == [3] and text.loads_loose('x {"a": 1} y') == {"a": 1}
    assert text.loads_loose("nothing") == [] and text.loads_loose(None) == [] and text.loads_loose("[broken") == []


def test_payload_items_are_read_one_by_one(spark):
    raw = '{"entities": [{"proposed_type": "person", "canonical_name": "A", "attributes": {"k": "v"}}, {"proposed_type": "x"}, 7], "relations": [{"proposed_junction": "employment", "from": "A", "to": "B", "confidence": 0.5}]}'
    g = one(spark, text.parse_payload(F.lit(raw)).alias("g")).g
    assert [e.canonical_name for e in g.entities] == ["A"] and g.entities[0].attributes == {"k": "v"}
    assert [(r["from"], r["to"]) for r in g.relations] == [("A", "B")] and g.weak_relations == []
    assert one(spark, text.parse_payload(F.lit('[{"proposed_type": "p", "canonical_name": "B"}]')).alias("g")).g.entities[0].canonical_name == "B"
    assert one(spark, text.parse_payload(F.lit("no")).alias("g")).g.entities == []


def test_snippet_marks_hits(spark):
    got = one(spark, text.snippet(F.lit("one two three Four five six seven"), text.terms(F.lit("four")), 3))[0]
    assert got == "…three >>Four<< five…"


def test_token_spans_and_confidence(spark):
    tokens = [{"token": "A", "logprob": -0.5}, {"token": "あ", "logprob": -0.5}, {"token": "B", "logprob": -0.5, "bytes": [66]}]
    assert confidence.byte_spans(tokens) == [(0, 1), (1, 4), (4, 5)]
    assert confidence.content_tokens("あB", tokens) == tokens[1:] and confidence.content_tokens("zz", tokens) == []
    content = '{"entities": [{"canonical_name": "Acme"}, {"canonical_name": "Missing"}]}'
    parts = [{"token": c, "logprob": -0.5} for c in content]
    graph = {"entities": [{"canonical_name": "Acme"}, {"canonical_name": "Absent"}]}
    got = confidence.graph_confidences(content, parts, graph, graph)
    assert round(got["entities"][0], 4) == 0.6065 and got["entities"][1] == 0.1
    assert confidence.value_span('"\\u00e9"'.encode(), "é", 0) == ((1, 7), 8)
    assert confidence.value_span(b'"a" "a"', "a", 3) == ((5, 6), 7) and confidence.value_span(b"x", "", 0) == (None, 0)
    assert round(one(spark, confidence.mean_confidence(F.array(F.lit(-0.5), F.lit(-0.5))))[0], 4) == 0.6065
    assert one(spark, confidence.mean_confidence(F.array().cast("array<double>")))[0] == 0.1
    assert tuple(one(spark, confidence.capped(F.lit(0.99), F.lit(7)), confidence.capped(F.lit(1.0), F.lit(1)))) == (0.95, 1.0)


def test_confidences_over_documents(spark):
    content = '{"relations": [{"from": "A", "to": "B"}], "entities": [{"canonical_name": "A"}]}'
    tokens = [(c, -0.1 if k < 40 else -1.0, None) for k, c in enumerate(content)]
    df = spark.createDataFrame([(1, content, tokens), (2, "broken", [])], "document_id long, content string, tokens array<struct<token: string, logprob: double, bytes: array<int>>>")
    got = {(r.document_id, r.section): round(r.confidence, 3) for r in confidence.apply_confidences(df).collect()}
    assert got == {(1, "relations"): 0.905, (1, "entities"): 0.368}
