from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caseloom.functions.scalar import parsed_location
from caseloom.operators import anomaly, chains, dedup, graph, inference, quality, queues, search, stats, store, timeline, weights
from caseloom.sinks import export

FACT = "id long, fingerprint string, filename string, fact_summary string, source_quote string, category string, severity_score int, confidence double, quality_score double, associated_date string, people array<string>, tags array<string>, is_deleted boolean, identified_crime string, location string, created_at timestamp, source_language string, evidence_hash string, evidence_full string"


def fact(i, **kw):
    base = {"id": i, "fingerprint": "f1", "filename": "a.txt", "fact_summary": f"fact {i}", "is_deleted": False}
    base.update(kw)
    return tuple(base.get(c.split()[0]) for c in FACT.split(", "))


def facts(spark, rows):
    return spark.createDataFrame(rows, FACT)


def test_distributions_and_empty(spark):
    f = facts(spark, [fact(1, category="a", severity_score=2), fact(2, category="a", severity_score=None), fact(3, category=None), fact(4, category="b", is_deleted=True)])
    assert [(r["category"], r["n"], r["mean_severity"]) for r in stats.category_distribution(f).collect()] == [("a", 2, 2.0)]
    empty = facts(spark, [])
    assert stats.category_distribution(empty).count() == 0
    ent = spark.createDataFrame([], "id long, value string")
    r = stats.overall_statistics(empty, ent).first()
    assert r["facts"] == 0 and r["mean_severity"] is None


def test_tags(spark):
    f = facts(spark, [fact(1, tags=[" fraud", ""]), fact(2, tags=["finance"]), fact(3, tags=None), fact(4, tags=["fin", "fraud"])])
    assert [r["id"] for r in queues.search_by_tags(f, ["fin"], False, 10).collect()] == [4]
    assert [r["id"] for r in queues.search_by_tags(f, ["fin"], False, 10, substring=True).collect()] == [2, 4]
    assert [r["id"] for r in queues.search_by_tags(f, ["fin", "fraud"], True, 10).collect()] == [4]
    assert queues.search_by_tags(f, [], True, 10).count() == 0
    assert [r["tag"] for r in queues.all_tags(f).collect()] == ["fin", "finance", "fraud"]


def test_clusters_against_a_fold(spark):
    rng = random.Random(1)
    days = [date(2020, 1, 1) + timedelta(rng.randrange(200)) for _ in range(60)]
    f = facts(spark, [fact(i, associated_date=d.isoformat(), severity_score=i % 9) for i, d in enumerate(days)] + [fact(99, associated_date="next week"), fact(98, associated_date="2020-13-99")])
    got = sorted((r["cluster_start"], r["cluster_end"], r["n"]) for r in timeline.clusters(f, 5).collect())
    want, start = [], None
    for d in sorted(days):
        if start is None or (d - start).days > 5:
            start = d
            want.append([d, d, 0])
        want[-1][1], want[-1][2] = d, want[-1][2] + 1
    assert got == [tuple(x) for x in want]
    assert timeline.anomalies(f, 0, 1.0).count() == 0


def test_anomalies(spark):
    same = facts(spark, [fact(i, severity_score=3) for i in range(5)])
    assert anomaly.fact_anomalies(same, "severity", 1.0).count() == 0  # no deviation
    assert anomaly.fact_anomalies(same, "nothing", 1.0).count() == 0
    f = facts(spark, [fact(i, severity_score=s) for i, s in enumerate([5, 5, 5, 5, 5, 5, 5, 5, 1])])
    assert [r["id"] for r in anomaly.fact_anomalies(f, "severity", 2.0).collect()] == [8]
    assert [r["id"] for r in anomaly.severity_outliers(f).collect()] == [8]


def test_weights(spark):
    f = facts(spark, [fact(1, severity_score=10, confidence=1.0, quality_score=1.0), fact(2, severity_score=1)])
    assert [(r["id"], r["weight"]) for r in weights.weighted(f).collect()] == [(1, 1.4), (2, 0.38)]
    assert weights.weighted(f, cap=True).first()["weight"] == 1.0


def graph_edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "a string, b string, n long")


def test_graph(spark):
    ring = graph_edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "e")])
    assert {r["betweenness"] for r in graph.betweenness(ring).collect()} == {round(1 / 6, 6)}
    assert {r["centrality"] for r in graph.degrees(ring).collect()} == {0.5}
    triangle = graph_edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")])
    assert {r["node"]: r["clustering"] for r in graph.clustering(triangle).collect()} == {"a": 1.0, "b": 1.0, "c": round(1 / 3, 6), "d": 0.0}
    two = graph_edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")])
    c = {r["node"]: r["community"] for r in graph.communities(two).collect()}
    assert len({c["a"], c["b"], c["c"]}) == 1 and len({c["x"], c["y"], c["z"]}) == 1 and c["a"] != c["x"]


def test_relationships_against_all_pairs(spark):
    rng = random.Random(3)
    f = facts(spark, [fact(i, fingerprint=f"f{rng.randrange(6)}", confidence=0.5) for i in range(40)])
    ent = [(i, f"f{rng.randrange(6)}", f"v{i % 7}", "person", 0.9) for i in range(30)]
    e = spark.createDataFrame(ent, "id long, fingerprint string, value string, entity_type string, confidence double")
    co = {r["fingerprint"]: r["co"] for r in graph.file_facts(f).collect()}
    want = sorted((-co[a[1]], a[0], b[0]) for a in ent for b in ent if a[0] < b[0] and a[1] == b[1] and a[1] in co)[:20]
    got = [(-r["cooccurrence"], r["a"], r["b"]) for r in graph.relationships(f, e, limit=20).collect()]
    assert got == want


def test_locations(spark):
    df = spark.createDataFrame([("70.743, 145.276",), ("95.0, 3",), ("x",), (None,), ("-12 33.5",)], "v string").select(parsed_location("v").alias("p"))
    assert [None if r["p"] is None else (r["p"]["lat"], r["p"]["lon"]) for r in df.collect()] == [(70.743, 145.276), None, None, None, (-12.0, 33.5)]
    places = spark.createDataFrame([(1, 50.0, 8.0), (2, 50.1, 8.1), (3, -50.0, 8.0)], "id long, lat double, lon double")
    assert [(r["id_a"], r["id_b"]) for r in graph.nearby(places, 20.0).collect()] == [(1, 2)]


def test_search(spark):
    f = facts(spark, [fact(1, fact_summary="Wire transfer to the bank", category="bank order"), fact(2, fact_summary="an éléphant at the bank"), fact(3, fact_summary="bank of the river; wire fence"), fact(4, fact_summary="nothing")])

    def ids(q):
        return sorted(r["id"] for r in search.facts(f, q).collect())

    assert ids("bank") == [1, 2, 3]
    assert ids("bank order") == [1]
    assert ids("elephant") == [2]
    assert ids('"wire transfer" OR nothing') == [1, 4]
    assert ids("bank NOT wire") == [2]
    assert ids("bank AND NOT wire") == [2]
    assert ids("trans*") == [1]
    assert ids('"bank an"') == []  # not over a column's end
    assert ids("(river OR elephant) AND bank") == [2, 3]
    assert ids("...") == []
    with pytest.raises(ValueError):
        search.parse("NOT x")
    with pytest.raises(ValueError):
        search.parse("(a OR b")


def test_dedup(spark):
    rows = [fact(1, fact_summary="a b c d e f g", associated_date="2020-01-01", category="x"), fact(2, fact_summary="A b c d e f g", associated_date="2020-01-01", category="x"), fact(3, fact_summary="a b c d e f g", associated_date="2020-01-02", category="x"), fact(4, fact_summary="", category="x"), fact(5, fact_summary="", category="x"), fact(6, fact_summary=None)]
    f = facts(spark, rows)
    assert {r["id"]: r["leader"] for r in dedup.groups(f).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    rng = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    many = [(i, " ".join(w for w in words if rng.random() > 0.15)) for i in range(80)]
    got = {r["id"]: r["leader"] for r in dedup.groups(facts(spark, [fact(i, fact_summary=s) for i, s in many]), 0.8).collect()}
    leaders, want = [], {}
    for i, s in many:
        w = set(s.split())
        for j, v in leaders:
            if w and len(w & v) / len(w | v) >= 0.8:
                want[i] = j
                break
        else:
            leaders.append((i, w))
            want[i] = i
    assert got == want


def test_merge_strategies(spark):
    f = facts(spark, [fact(1, severity_score=3, confidence=0.9, fact_summary="x"), fact(2, severity_score=8, confidence=0.2, fact_summary="y", category="c")])
    g = spark.createDataFrame([(1, 1), (2, 1)], "id long, leader long")
    assert dedup.merged(f, g, "most_severe").first()["id"] == 2
    assert dedup.merged(f, g, "highest_confidence").first()["id"] == 1
    m = dedup.merged(f, g, "merge_all").first()
    assert (m["fact_summary"], m["category"]) == ("x; y", "c")


def test_quality(spark):
    t = spark.createDataFrame([(1, "word " * 200), (2, ""), (3, None), (4, "." * 600)], "id long, t string")
    got = {r["id"]: (r["confidence"], r["scanned"]) for r in quality.text_quality(t, "id", "t").collect()}
    assert got[1] == (1.0, False) and got[2][1] and got[3][1] and got[4][1]


def test_chains(spark):
    f = facts(spark, [fact(1, fingerprint="a", severity_score=9), fact(2, fingerprint="b", severity_score=9), fact(3, fingerprint="c", severity_score=9), fact(4, fingerprint="d", severity_score=9)])
    e = spark.createDataFrame([(i, fp, v) for i, (fp, v) in enumerate([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")])], "id long, fingerprint string, value string")
    assert {(r["id"], r["related"]) for r in chains.detect(f, e).collect()} == {(1, 2), (2, 2), (3, 2)}


def test_store(spark):
    t = datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, note string")
    new = spark.createDataFrame([("a", 5, 1), ("c", 7, 2), ("c", 8, 3)], "k string, v int, seq int")
    assert sorted((r["k"], r["v"], r["note"]) for r in store.upsert(old, new, ["k"]).collect()) == [("a", 5, None), ("b", 2, "y"), ("c", 8, None)]
    assert [(r["k"], r["v"]) for r in store.insert_ignore(old, new, ["k"], "seq").collect()] == [("c", 7)]
    log = spark.createDataFrame([(1, "add", "n1", t), (1, "update", "n2", t + timedelta(1)), (2, "add", "z", t), (2, "delete", "z", t + timedelta(1))], "id int, op string, content string, at timestamp")
    assert [(r["id"], r["content"]) for r in store.event_view(log, "id").collect()] == [(1, "n2")]


def test_backup(tmp_path):
    src = tmp_path / "case"
    src.mkdir()
    (src / "a.txt").write_text("x")
    archive = store.backup(str(src), str(tmp_path / "b"))
    store.restore(archive, str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.txt").read_text() == "x"
    import zipfile

    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError):
        store.restore(str(tmp_path / "bad.zip"), str(tmp_path / "out"))


def test_inference(spark):
    assert inference.json_objects('noise [ {"a": "}"} ] and {"b": 1}') == [{"a": "}"}, {"b": 1}]
    assert inference.json_objects('["{\\"a\\": 1}", "x", {"b": 2}]') == [{"a": 1}, {"b": 2}]
    assert inference.json_objects(None) == []
    t = spark.createDataFrame([(1, "n.txt", "x" * 4000), (2, "m.txt", "short"), (3, "e.txt", ""), (4, "z", None)], "id long, name string, text string")
    c = inference.chunks(t, "id", "name", "text").collect()
    assert [(r["id"], r["label"], len(r["chunk"])) for r in c] == [(1, "n.txt", 2000), (1, "n.txt (Part 2/3)", 2000), (1, "n.txt (Part 3/3)", 300), (2, "m.txt", 5)]

    def model(prompt, n):
        return 'Sure: [{"summary": "s", "people": ["A"], "confidence": 0.9}] {"summary": "s"}' if "short" in prompt else "[]"

    out = inference.analyse(t, "id", "name", "text", model).collect()
    assert [(r["id"], r["source"], r["summary"], r["severity"]) for r in out] == [(2, "m.txt", "s", 1)]
    assert inference.run_pipeline(t, "id", "name", "text", inference.PIPELINES["financial_crimes"], model).count() == 2


def test_export(spark, tmp_path):
    f = facts(spark, [fact(1, fact_summary='say "hi"', category="a", severity_score=5, confidence=0.5), fact(2, category="b")])
    assert '"say ""hi"""' in export.fact_lines(f).first()["line"]
    assert [r["id"] for r in export.facts(f, categories=["b"]).collect()] == [2]
    assert export.json_array(export.facts(f).select("id", "category")).startswith("[")
    e = spark.createDataFrame([(1, "f1", "x", "person", 0.5)], "id long, fingerprint string, value string, entity_type string, confidence double")
    assert "# Evidence report" in export.report(f, e)
    export.write(export.facts(f), str(tmp_path / "o"), "csv")
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "o")).filter(F.col("summary") == 'say "hi"').count() == 1
