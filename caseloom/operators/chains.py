"""Evidence chains: detection, suggestions, contents and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import alive, r6
from .weights import weighted


def detect(facts: DataFrame, entities: DataFrame, min_weight: float = 0.0, min_related: int = 1, roots: int = 1000) -> DataFrame:
    """Of the `roots` heaviest facts, those related to two or more others: their files share at least min_related entity values, or are one.

    Files of the roots are at most `roots`, so file pairs are bounded; facts are counted per file before they are related.
    """
    top = weighted(facts, min_weight, roots).select("id", "fingerprint", "weight")
    files = top.select("fingerprint").distinct()
    values = entities.filter(F.col("value").isNotNull()).join(F.broadcast(files), "fingerprint", "left_semi").select("fingerprint", "value").distinct()
    a, b = values.alias("a"), values.alias("b")
    shared = a.join(b, (F.col("a.value") == F.col("b.value")) & (F.col("a.fingerprint") != F.col("b.fingerprint"))).groupBy(F.col("a.fingerprint").alias("f"), F.col("b.fingerprint").alias("g")).agg(F.count(F.lit(1)).alias("overlap")).filter(F.col("overlap") >= min_related)
    per = top.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("k"))
    own = values.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("v")).filter(F.col("v") >= min_related)
    across = shared.join(per.withColumnRenamed("fingerprint", "g"), "g").groupBy("f").agg(F.sum("k").alias("n"))
    within = per.join(own, "fingerprint").select(F.col("fingerprint").alias("f"), (F.col("k") - 1).alias("n"))
    related = across.unionByName(within).groupBy("f").agg(F.sum("n").alias("related"))
    return top.join(related, F.col("fingerprint") == F.col("f")).filter("related >= 2").select("id", "fingerprint", "weight", "related").orderBy(F.desc("related"), F.desc("weight"), "id")


def related_facts(facts: DataFrame, entities: DataFrame, root_id: int, min_related: int = 1, limit: int = 100) -> DataFrame:
    """The facts related to one: their files share entity values with its file."""
    root = facts.filter(F.col("id") == root_id).select("fingerprint")
    own = entities.filter(F.col("value").isNotNull()).join(root, "fingerprint", "left_semi").select("value").distinct()
    files = entities.join(own, "value").select("fingerprint", "value").distinct().groupBy("fingerprint").agg(F.count(F.lit(1)).alias("overlap")).filter(F.col("overlap") >= min_related)
    return facts.filter(alive() & (F.col("id") != root_id)).join(files, "fingerprint").select("id", "fingerprint", "overlap").orderBy(F.desc("overlap"), "id").limit(limit)


def by_entities(facts: DataFrame, entities: DataFrame, values: list[str], min_occurrences: int) -> DataFrame:
    """Facts of files that name at least so many of the values, with those."""
    hits = entities.filter(F.col("value").isin(values)).groupBy("fingerprint").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("named"), F.countDistinct("value").alias("n")).filter(F.col("n") >= min_occurrences)
    return facts.filter(alive()).join(hits, "fingerprint").select("id", "fingerprint", "named", "n")


def suggestions(facts: DataFrame, fact_id: int, threshold: float, candidates: int = 20) -> DataFrame:
    """Facts of other files like one: by its first ten words of more than four bytes, category and severity. As a ranked list, the most severe `candidates` with any of the words are compared."""
    root = facts.filter(F.col("id") == fact_id).select("fingerprint", "category", "severity_score", F.slice(F.filter(F.split(F.lower(F.trim("fact_summary")), r"\s+"), lambda w: F.octet_length(w) > 4), 1, 10).alias("words")).limit(1)
    r = root.select(F.col("fingerprint").alias("rf"), F.col("category").alias("rc"), F.col("severity_score").alias("rs"), "words")
    text = F.lower(F.coalesce("fact_summary", F.lit("")))
    both = facts.filter(alive()).crossJoin(F.broadcast(r)).filter(F.col("fingerprint") != F.col("rf"))  # with one row
    hit = both.withColumn("text", text).withColumn("hits", F.size(F.filter("words", lambda w: F.col("text").contains(w)))).filter("hits > 0")
    top = hit.orderBy(F.desc_nulls_last("severity_score"), "id").limit(candidates)
    score = 0.7 * F.try_divide("hits", F.size("words")) + F.when(F.col("category").eqNullSafe(F.col("rc")), 0.2).otherwise(0.0) + F.when(F.abs(F.col("severity_score") - F.col("rs")) <= 1, 0.1).otherwise(0.0)
    return top.withColumn("similarity", r6(score)).filter(F.col("similarity") >= threshold).select("id", "similarity", F.concat(F.col("hits").cast("string"), F.lit(" keyword matches")).alias("reasons")).orderBy(F.desc("similarity"), "id")


def all_chains(chains: DataFrame, links: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    per = links.groupBy("chain_id").agg(F.count(F.lit(1)).alias("items"), r6(F.avg("relationship_strength")).alias("mean_strength"))
    return chains.join(per, F.col("id") == F.col("chain_id"), "left").select("id", "chain_name", "chain_type", F.coalesce("items", F.lit(0)).alias("items"), "mean_strength", "updated_at").orderBy(F.desc_nulls_last("updated_at"), "id").offset(offset).limit(limit)


def items(links: DataFrame, facts: DataFrame, chain_id: int) -> DataFrame:
    own = links.filter(F.col("chain_id") == chain_id).select("intelligence_id", "relationship_type", "relationship_strength", "linked_at")
    return own.join(facts.select("id", "fact_summary", "filename", "category", "severity_score"), F.col("intelligence_id") == F.col("id")).orderBy(F.desc_nulls_last("linked_at"), "id")


def statistics(links: DataFrame, facts: DataFrame, chain_id: int) -> DataFrame:
    return items(links, facts, chain_id).agg(
        F.count(F.lit(1)).alias("items"), r6(F.avg("severity_score")).alias("mean_severity"), F.max("severity_score").alias("top_severity"), F.min("severity_score").alias("least_severity"),
        F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("relationship_type")).alias("relationships"),
    )


def search(links: DataFrame, facts: DataFrame, chain_id: int, text: str) -> DataFrame:
    q = text.lower()
    hit = F.lit(False)
    for col in ("fact_summary", "filename", "category"):
        hit = hit | F.coalesce(F.lower(col).contains(q), F.lit(False))
    return items(links, facts, chain_id).filter(hit)


def without_links(links: DataFrame, chain_id: int, fact_id: int | None = None) -> DataFrame:
    """Links after a fact, or the whole chain, was taken out."""
    gone = F.col("chain_id") == chain_id
    return links.filter(~(gone if fact_id is None else gone & (F.col("intelligence_id") == fact_id)))
