"""p6_pieces loses no text: those without a limit come out as one piece."""

from __future__ import annotations


def test_texts_without_a_limit(spark, tmp_path):
    from caseloom.llm.queries import REGISTRY

    text = "word " * 30
    tables = {
        "text_cache": ([(1, "a", text), (2, "b", text), (3, "c", text), (4, "unregistered", text), (5, None, text), (6, "b", None)], "id bigint, fingerprint string, extracted_text string"),
        "registry": ([("a", "text"), ("b", "video"), ("c", None)], "fingerprint string, file_type string"),
        "reasoner_config": ([("text", 60, 10)], "file_type string, max_chars_per_chunk int, chunk_overlap int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = {}
    for r in REGISTRY.queries["p6_pieces"](spark, str(tmp_path)).collect():
        found.setdefault(r.text_id, []).append((r.piece_no, r.start_pos, r.end_pos, r.piece))
    assert len(found.pop(1)) > 1
    assert found == {k: [(0, 0, len(text), text)] for k in (2, 3, 4, 5)}
