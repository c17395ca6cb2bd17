"""Exports: JSON, CSV and reports, written by the executors; small reports are one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import centrality
from ..operators.stats import category_distribution, entity_type_distribution, overall_statistics, severity_distribution
from ..operators.timeline import events
from ..operators.weights import weighted

FACT_KEYS = ["id", "fingerprint", "filename", "summary", "category", "severity", "confidence", "quality", "weight", "created_at"]


def facts(table: DataFrame, min_weight: float = 0.0, limit: int = 10_000, categories: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The rows of a fact export, heaviest first; all filters apply."""
    t = table
    if categories:
        t = t.filter(F.col("category").isin(categories))
    if start:
        t = t.filter(F.col("associated_date") >= start)
    if end:
        t = t.filter(F.col("associated_date") <= end)
    w = weighted(t, min_weight, limit)
    return w.select("id", "fingerprint", "filename", F.col("fact_summary").alias("summary"), "category", F.col("severity_score").alias("severity"), "confidence", F.col("quality_score").alias("quality"), "weight", "created_at")


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as a JSON object in a column json."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def json_array(df: DataFrame, pretty: bool = True) -> str:
    """All rows of a limited result as one JSON array."""
    import json

    return json.dumps([json.loads(r["json"]) for r in json_lines(df).toLocalIterator()], indent=2 if pretty else None, ensure_ascii=False)


def fact_lines(table: DataFrame, min_weight: float = 0.0, limit: int = 10_000) -> DataFrame:
    """Facts as lines of CSV: file name and summary in quotes, gaps as 0.0 or empty."""

    def quoted(c: str):
        return F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))

    f = facts(table, min_weight, limit)
    line = F.concat_ws(",", F.col("id").cast("string"), quoted("filename"), quoted("summary"), F.coalesce("category", F.lit("")), F.coalesce(F.col("severity").cast("string"), F.lit("0")), F.format_string("%.3f", F.coalesce("confidence", F.lit(0.0))), F.format_string("%.3f", F.col("weight")))
    return f.select("id", line.alias("line"))


def entity_lines(fact_table: DataFrame, entities: DataFrame) -> DataFrame:
    c = centrality(fact_table, entities)
    return c.select("id", F.concat_ws(",", F.col("id").cast("string"), F.concat(F.lit('"'), F.replace("value", F.lit('"'), F.lit('""')), F.lit('"')), "entity_type", F.col("occurrences").cast("string"), F.format_string("%.3f", "centrality")).alias("line"))


def timeline(table: DataFrame, limit: int = 10_000) -> DataFrame:
    return json_lines(events(table, limit=limit))


def report(fact_table: DataFrame, entities: DataFrame, top_categories: int = 10, top_facts: int = 15) -> str:
    """A report in Markdown: statistics, the commonest categories, the heaviest facts cut at 60 signs."""
    s = overall_statistics(fact_table, entities).first().asDict()
    lines = ["# Evidence report", "", *[f"- {k}: {v}" for k, v in s.items()], "", "## Categories", ""]
    lines += [f"- {r['category']}: {r['n']}" for r in category_distribution(fact_table).limit(top_categories).collect()]
    lines += ["", "## Facts", ""]
    for r in weighted(fact_table, 0.0, top_facts).collect():
        text = r["fact_summary"] or ""
        lines.append(f"- {r['weight']:.3f} {text[:60] + '...' if len(text) > 60 else text}")
    return "\n".join(lines) + "\n"


def sheets(fact_table: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """The tables of a workbook."""
    return {"facts": facts(fact_table, limit=1000), "categories": category_distribution(fact_table), "entities": centrality(fact_table, entities), "timeline": events(fact_table, limit=1000), "statistics": overall_statistics(fact_table, entities)}


def report_json(fact_table: DataFrame, entities: DataFrame, limit: int = 1000) -> str:
    """The whole report as one JSON object: statistics, categories, severities, entity types, heaviest facts, timeline. Each part has at most `limit` rows."""
    import json

    def rows(df: DataFrame) -> list[dict]:
        return [json.loads(r["json"]) for r in json_lines(df.limit(limit)).collect()]

    parts = {
        "statistics": rows(overall_statistics(fact_table, entities))[0], "categories": rows(category_distribution(fact_table)), "severities": rows(severity_distribution(fact_table)), "entity_types": rows(entity_type_distribution(entities)),
        "facts": rows(facts(fact_table, 0.0, limit)), "timeline": rows(events(fact_table, limit=limit)),
    }
    return json.dumps(parts, indent=2, ensure_ascii=False)


def sheets_json(fact_table: DataFrame, entities: DataFrame) -> str:
    """The tables of a workbook as one JSON object of lists of rows."""
    import json

    return json.dumps({name: [json.loads(r["json"]) for r in json_lines(df).collect()] for name, df in sheets(fact_table, entities).items()}, ensure_ascii=False)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """A raw sink: one column of text as lines, written by the executors; nulls are left out."""
    df.select(F.col(column).cast("string").alias("value")).filter("value is not null").write.mode("overwrite").text(path)


def write_document(spark: SparkSession, text: str, path: str) -> None:
    """A raw sink for one finished document (a report): the text as it is, at a path of any file system Spark can write to."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes by the executors: parquet, json, or csv with all values quoted."""
    w = df.write.mode("overwrite")
    if kind == "csv":
        w.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    else:
        w.format(kind).save(path)
