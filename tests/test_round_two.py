"""Search by index, nearby places, de-duplication by chosen fields, writers, page images, passes, shared folder."""

from __future__ import annotations

import json
import math
import random
from datetime import datetime
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom import session
from caseloom.operators import dedup, graph, inference, search, stats, store, timeline
from caseloom.sinks import export
from caseloom.sources import files

AT = datetime(2024, 5, 1)


def great_circle(a, b):
    (la, lo), (lb, lp) = a, b
    h = math.sin(math.radians(la - lb) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lo - lp) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(math.sqrt(h), 1))


@pytest.mark.parametrize("km", [5.0, 300.0, 1000.0, 30000.0])
def test_nearby_has_neither_poles_nor_a_date_line(spark, km):
    rng = random.Random(3)
    places = [(0.0, 179.99), (0.0, -179.99), (80.0, 10.0), (80.0, 60.0), (80.5, 10.0), (90.0, 0.0), (89.99, 120.0), (-90.0, 5.0)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(places)] + [(1000, None, 3.0)], "id long, lat double, lon double")
    got = sorted((r["id_a"], r["id_b"]) for r in graph.nearby(df, km).collect())
    assert got == [(i, j) for i in range(len(places)) for j in range(i + 1, len(places)) if great_circle(places[i], places[j]) <= km]
    if km == 5.0:
        assert (0, 1) in got


def test_shared_folder_must_be_named_on_a_cluster():
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake)


def test_tables_that_were_cut_can_be_cleared(spark):
    before = session.cut(spark.range(5), "clear-me")
    assert before.count() == 5
    assert session.clear(spark) >= 1 and session.clear(spark) == 0


FACTS = [
    (1, "f1", "a.txt", "second signature crossed out", "the second signature", "legal", None, 3, False), (2, "f1", "a.txt", "signature second", None, "legal", None, 9, False),
    (3, "f2", "b.txt", "a second", "signature crossing the page", "legal", None, None, False), (4, "f2", "b.txt", None, "", None, None, 2, False), (5, "f3", "c.txt", "second signature cross", "x", "legal", None, 2, True),
]
COLUMNS = "id long, fingerprint string, filename string, fact_summary string, source_quote string, category string, associated_date string, severity_score int, is_deleted boolean"


def test_search_reads_postings_only(spark, tmp_path):
    spark.createDataFrame(FACTS, COLUMNS).write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    own = facts.filter("not is_deleted")
    idx = search.index(own, "id", search.FACT_COLUMNS)
    hit = search.ranked(idx, '"second signature" AND cross*')
    assert [r["doc"] for r in hit.collect()] == [1]  # a phrase in one column, in its order
    plan = hit._jdf.queryExecution().toString()
    assert "fact_summary" not in plan.replace("term", "") and "PushedFilters" in plan and str(tmp_path) not in plan
    assert search.index(own, "id", search.FACT_COLUMNS) is idx  # one index for all searches of a table
    got = search.facts(facts, "signature NOT second").collect()
    assert [r["id"] for r in got] == []
    assert [r["id"] for r in search.facts(facts, "second", min_severity=4).collect()] == [2]
    assert search.facts(facts, "  ").count() == 0
    ents = spark.createDataFrame([(7, "f1", "Acme Logistics", None, "ORGANIZATION", 0.9), (8, "zz", "Logistics", None, "ORGANIZATION", 0.9)], "id long, fingerprint string, value string, normalized_value string, entity_type string, confidence double")
    assert [(r["id"], r["filename"]) for r in search.entity_facts(ents, facts, "logistics").collect()] == [(7, "a.txt")]


def greedy(rows, fields, t):
    leaders, out = [], {}
    for r in sorted(rows, key=lambda r: r["id"]):
        w, k = set((r["fact_summary"] or "").lower().split()), tuple(r[f] for f in fields)
        out[r["id"]] = next((i for i, k2, w2 in leaders if w and w2 and k == k2 and len(w & w2) / len(w | w2) >= t), r["id"])
        if out[r["id"]] == r["id"]:
            leaders.append((r["id"], k, w))
    return out


@pytest.mark.parametrize("fields", [("associated_date", "category"), ("fingerprint",), ()])
def test_dedup_by_chosen_fields(spark, fields):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(30)}" for _ in range(8)] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        if rng.random() < 0.5:
            w[rng.randrange(8)] = f"w{rng.randrange(30)}"
        rows.append({"id": i, "fact_summary": " ".join(w) if rng.random() < 0.95 else None, "associated_date": rng.choice(["2020-01-01", None]), "category": rng.choice(["a", "b"]), "fingerprint": rng.choice("xyz")})
    df = spark.createDataFrame(rows, "id long, fact_summary string, associated_date string, category string, fingerprint string")
    assert {r["id"]: r["leader"] for r in dedup.groups(df, 0.75, fields).collect()} == greedy(rows, fields, 0.75)


def test_writers_of_chains_aliases_errors_and_notes(spark):
    chains = spark.createDataFrame([], "id bigint, chain_name string, chain_type string, description string, created_at timestamp, updated_at timestamp")
    chains = store.chain_created(chains, "money", "crime", AT)
    cid = chains.first()["id"]
    with pytest.raises(ValueError, match="exists"):
        store.chain_created(chains, "money", "crime", AT)
    assert store.chain_updated(chains, cid, AT, description="new").first()["description"] == "new"
    links = spark.createDataFrame([(cid, 1, "root", 1.0, AT)], "chain_id bigint, intelligence_id bigint, relationship_type string, relationship_strength double, linked_at timestamp")
    more = store.chain_linked(links, cid, spark.createDataFrame([(1,), (2,), (2,)], "id long"), "supports", 0.5, AT)
    assert sorted((r["intelligence_id"], r["relationship_type"]) for r in more.collect()) == [(1, "root"), (2, "supports")]
    entities = spark.createDataFrame([(4, "Acme")], "id long, value string")
    aliases = spark.createDataFrame([], "canonical_entity_id bigint, alias_value string, alias_type string, confidence double, created_at timestamp")
    aliases = store.alias_added(aliases, entities, 4, " ACME ", "short", 0.9, AT)
    assert store.alias_added(aliases, entities, 4, "ACME", "other", 0.1, AT).count() == 1
    for bad in ((5, "x"), (4, "  ")):
        with pytest.raises(ValueError):
            store.alias_added(aliases, entities, *bad, "short", 0.9, AT)
    events = [store.error_event("e", "add", AT), store.error_event("e", "retry", datetime(2024, 5, 2), 0), store.error_event("g", "add", AT), store.error_event("g", "resolve", datetime(2024, 5, 2), 1, None, "me")]
    states = {r["error_id"]: r for r in store.backoff(store.error_states(spark.createDataFrame(events, store.ERROR_LOG))).collect()}
    assert states["e"]["open"] and states["e"]["next_attempt"] == datetime(2024, 5, 2, 0, 2) and not states["g"]["open"]
    notes = [store.note_event("n", "add", AT, 3, "look"), store.note_event("n", "update", datetime(2024, 5, 2), 3, "again"), store.note_event("m", "add", AT, 3, "x"), store.note_event("m", "delete", datetime(2024, 5, 2))]
    assert [(r["note_id"], r["content"]) for r in store.event_view(spark.createDataFrame(notes, store.NOTE_LOG), "note_id").collect()] == [("n", "again")]
    with pytest.raises(ValueError):
        store.note_event("n", "add", AT, 3, " ")
    log = spark.createDataFrame([("j", "running", 1, AT), ("j", "done", 9, datetime(2024, 5, 2)), ("k", "running", 2, AT)], "job_id string, status string, processed int, at timestamp")
    assert {r["job_id"]: r["status"] for r in store.job_states(log).collect()} == {"j": "done", "k": "running"}


def test_page_images():
    page = np.full((60, 80), 200, np.uint8)
    page[20:24, 10:70] = 90
    bw = files.binarised(page)
    assert set(np.unique(bw)) == {0, 255} and (bw[21, 30], bw[5, 5]) == (0, 255)
    turned = np.full((200, 300), 255, np.uint8)
    for y0 in (50, 100, 150):
        for x in range(300):
            turned[int(round(y0 + x * math.tan(math.radians(2)))) : int(round(y0 + x * math.tan(math.radians(2)))) + 3, x] = 0
    assert abs(files.skew(turned) - 2.0) <= 0.5
    assert files.skew(files.straightened(turned, 2.0)) == 0.0
    assert files.binarised(np.zeros((0, 0), np.uint8)).size == 0 and files.skew(np.full((5, 5), 255, np.uint8)) == 0.0


def test_scanned_files_are_read_by_pages():
    def pages(data, name):
        yield "x" * 300
        yield "y" * 300
        raise AssertionError("enough was read")

    read = files.scanned_or_text(lambda d, n: d.decode(), pages)
    assert read(b"z" * 200, "a.pdf") == "z" * 200
    assert read(b"  few  ", "a.pdf") == "x" * 300 + "\n" + "y" * 300


def test_error_classes(spark):
    df = spark.createDataFrame([("File is encrypted",), ("unexpected EOF in xref",), ("disk full",), (None,)], "e string")
    assert [r[0] for r in df.select(files.error_class(F.col("e"))).collect()] == ["password", "corrupt", "other", None]


def test_passes_with_context_and_samples(spark):
    asked = []

    def model(prompt, n):
        return json.dumps([{"summary": "paid" if "Known: " not in prompt else "saw " + ("paid" if "Known: paid" in prompt else "none"), "category": "x"}])

    texts = spark.createDataFrame([(1, "a.txt", "para one\n\npara two\n\n" * 30)], "id long, name string, text string")
    pipe = inference.Pipeline("p", [inference.Pass("first", "Find.", 50), inference.Pass("second", "Known: {{CONTEXT}}", 50)])
    got = {r["pass_name"]: r["summary"] for r in inference.run_pipeline(texts, "id", "name", "text", pipe, model).collect()}
    assert got == {"first": "paid", "second": "saw paid"} and not asked
    assert len(inference.sampled(texts, "text", 50).first()["text"]) < 600
    assert inference.sampled(texts.withColumn("text", F.lit(None).cast("string")), "text", 50).first()["text"] is None
    registry = spark.createDataFrame([("f1", False), ("f2", None)], "fingerprint string, processed boolean")
    facts = inference.analyse(texts, "id", "name", "text", model)
    stored, counts, done = inference.write_back(facts, texts.withColumn("fingerprint", F.lit("f1")), registry, "id")
    assert stored.first()["fingerprint"] == "f1" and counts.first()["facts"] >= 1 and {r["fingerprint"]: r["processed"] for r in done.collect()} == {"f1": True, "f2": False}
    assert [r[0] for r in spark.createDataFrame([("gemma-2b.gguf",), ("gemma-3-4b.gguf",)], "n string").select(inference.model_family(F.col("n"))).collect()] == ["ChatML", "Gemma3"]


def test_reports_and_raw_sinks(spark, tmp_path):
    facts = spark.createDataFrame([(1, "f", "a.txt", "s", "q", "legal", "2020-01-01", 3, False, 0.5, 0.5, AT)], COLUMNS + ", confidence double, quality_score double, created_at timestamp")
    ents = spark.createDataFrame([(7, "f", "Acme", None, "ORGANIZATION", 0.9)], "id long, fingerprint string, value string, normalized_value string, entity_type string, confidence double")
    report = json.loads(export.report_json(facts, ents))
    assert report["statistics"]["facts"] == 1 and report["timeline"][0]["id"] == 1
    assert json.loads(export.sheets_json(facts, ents))["facts"][0]["id"] == 1
    export.write_document(spark, "é report", str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text() == "é report"
    export.write_text(facts, "fact_summary", str(tmp_path / "lines"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["s"]
    assert [(r["month"], r["top_ids"]) for r in stats.by_month(facts).collect()] == [("2020-01", "1")]
    assert timeline.backdating(facts).count() == 0


def test_modularity_and_communities(spark):
    edges = [(a, b, 1) for group in ("abcd", "wxyz") for i, a in enumerate(group) for b in group[i + 1 :]] + [("d", "w", 1)]
    df = spark.createDataFrame(edges, "a string, b string, n long")
    own = {r["node"]: r["community"] for r in graph.communities(df).collect()}
    assert len({own[x] for x in "abcd"}) == 1 and len({own[x] for x in "wxyz"}) == 1 and own["a"] != own["z"]
    m = len(edges)
    inside = sum(own[a] == own[b] for a, b, _ in edges) / m
    degree: dict = {}
    for a, b, _ in edges:
        for x in (a, b):
            degree[own[x]] = degree.get(own[x], 0) + 1
    want = inside - sum((d / (2 * m)) ** 2 for d in degree.values())
    assert abs(graph.modularity(df, graph.communities(df)).first()["modularity"] - want) < 1e-6
