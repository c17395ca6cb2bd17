from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from caseloom.sources import files
from caseloom.streaming import ingest


def tree(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("Hello, World!")
    (root / "copy.txt").write_text("Hello, World!")
    (root / "b.md").write_bytes("café “x”".encode("cp1252"))
    (root / "sub" / "c.bin").write_bytes(b"\x00\x01")
    with zipfile.ZipFile(root / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:t>one</w:t><w:t>two</w:t></w:document>')
    return root


def test_scan_and_extract(spark, tmp_path):
    root = tree(tmp_path)
    known = spark.createDataFrame([], "fingerprint string")
    new = files.scan(spark, str(root), known)
    assert sorted(r["file_name"] for r in new.collect()) == ["a.txt", "b.md", "c.bin", "d.docx"]
    assert files.scan(spark, str(root), new.select("fingerprint")).count() == 0
    assert files.listing(spark, str(root), max_depth=1).count() == 4
    got = {r["file_name"]: (r["text"], r["status"]) for r in files.extract(files.listing(spark, str(root)), {"image": lambda b, n: "x"}).collect()}
    assert got["a.txt"] == ("Hello, World!", "ok") and got["b.md"] == ("café “x”", "ok") and got["d.docx"] == ("one two", "ok") and got["c.bin"][1] == "error"
    assert len(files.listing(spark, str(root)).select(files.edge_fingerprint(F.col("content"), F.col("length")).alias("f")).first()["f"]) == 64
    assert files.stamped_fingerprint(files.listing(spark, str(root))).first()["stamped"].count("-") == 1


def test_pages():
    assert files.pages_until(["a" * 300, "b" * 300, "c"]) == "a" * 300 + "\n" + "b" * 300


def test_streaming(spark, tmp_path):
    root = tree(tmp_path)
    for _ in range(2):  # the second run finds nothing new
        q = ingest.ingest(spark, str(root), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out" / "text_cache"))
    assert rows.filter("status = 'ok'").count() == 3 and rows.count() == 4
