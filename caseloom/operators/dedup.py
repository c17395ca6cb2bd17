"""Removing repeated facts: exact and by word overlap within chosen fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import jaccard, words
from ..session import cut


def exact(elements: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """Elements whose keys no element of smaller id has; null keys are keys too. The ids are aggregated, so hot keys are no problem."""
    first = elements.groupBy(*[F.coalesce(k, F.lit("\x00")).alias(k) for k in keys]).agg(F.min(id_col).alias(id_col))
    return elements.join(first.select(id_col), id_col, "left_semi")


def groups(facts: DataFrame, threshold: float = 0.85, match: tuple[str, ...] = ("associated_date", "category"), text: str = "fact_summary") -> DataFrame:
    """(id, leader): in the order of ids, a fact joins the first earlier leader that has the same `match` fields and is alike by the threshold, else it leads.

    Equal word sets are one set throughout (by two 64-bit hashes together). Pairs come from a prefix join: sets alike by t share one of their first n - ceil(t n) + 1 words
    in any fixed order, here the rarest of the corpus first. Only ids, sizes and keys are shuffled; word sets are compared once for each different pair.
    Leaders are then found in rounds; facts without words lead themselves. Jobs run when this is called.
    """
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in match] or [F.lit("")]
    base = facts.select("id", F.xxhash64(F.lit(1), *fields).alias("b1"), F.xxhash64(F.lit(2), *fields).alias("b2"), F.array_sort(words(text)).alias("w"))
    sets = base.withColumn("same", F.struct(F.xxhash64("b1", "w").alias("x"), F.xxhash64("b2", "w", F.lit(3)).alias("y")))
    reps = cut(sets.groupBy("same").agg(F.min(F.struct("id", "b1", "b2", "w")).alias("r")).select("same", "r.*"), "dedup-sets")
    n = F.size("w")
    spelt = reps.filter(n > 0).select("id", "b1", "b2", n.alias("n"), F.explode("w").alias("word"))
    often = spelt.groupBy("word").agg(F.count(F.lit(1)).alias("f"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("f", "word"))  # the words of one set
    prefix = spelt.join(often, "word").withColumn("place", place).filter(F.col("place") <= F.greatest(F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1, F.lit(1)))
    prefix = prefix.select("id", "n", F.xxhash64("b1", "b2", "word").alias("key"))
    a, b = prefix.alias("a"), prefix.alias("b")
    sized = (F.col("a.n") * threshold <= F.col("b.n")) & (F.col("b.n") * threshold <= F.col("a.n"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & sized).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    wa, wb = (reps.select(F.col("id").alias(c), F.struct("b1", "b2").alias(f"k{c}"), F.col("w").alias(f"w{c}")) for c in "ab")
    near = met.join(wa, "a").join(wb, "b").filter((F.col("ka") == F.col("kb")) & (jaccard(F.col("wa"), F.col("wb")) >= threshold))
    edges = cut(near.select("a", "b"), "dedup-edges")
    open_ = edges
    led = None
    while True:
        # who has no earlier undecided neighbour leads; who has an earlier leader beside it follows the first one
        heads = open_.select(F.col("a").alias("id")).distinct().join(open_.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        follow = open_.join(heads.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
        follow = cut(follow, "dedup-round")
        if not follow.limit(1).count():
            break
        led = follow if led is None else led.unionByName(follow)
        gone = follow.select("id")
        # decided ones drop out; leaders' other edges are used up
        open_ = cut(open_.join(gone.withColumnRenamed("id", "b"), "b", "left_anti").join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(heads.withColumnRenamed("id", "a"), "a", "left_anti"), "dedup-open")
    leaders = reps.select("same", F.col("id").alias("rep"))
    out = sets.select("id", "same", (F.size("w") == 0).alias("empty")).join(leaders, "same")
    if led is not None:
        out = out.join(led.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        out = out.withColumn("leader", F.lit(None).cast("long"))
    return out.select("id", F.when(F.col("empty"), F.col("id")).otherwise(F.coalesce("leader", "rep")).alias("leader"))


def merged(facts: DataFrame, grouped: DataFrame, strategy: str = "highest_confidence") -> DataFrame:
    """One fact per leader: of highest_confidence, most_severe (ties: the first), or merge_all (different summaries joined, gaps filled from the first that has a value).

    merge_all holds the different summaries of one leader in a row: they are alike by the threshold, and copies count once.
    """
    f = facts.join(grouped, "id")
    if strategy == "merge_all":
        def first(c: str):
            return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)

        return f.groupBy("leader").agg(F.array_join(F.array_sort(F.collect_set("fact_summary")), "; ").alias("fact_summary"), first("associated_date"), first("category"), first("identified_crime"), F.max("severity_score").alias("severity_score"), F.max("confidence").alias("confidence"))
    by = {"highest_confidence": "confidence", "most_severe": "severity_score"}[strategy]
    rank = F.struct(F.coalesce(F.col(by).cast("double"), F.lit(-1.0)), -F.col("id"))
    keep = f.groupBy("leader").agg(F.max_by("id", rank).alias("id"))
    return keep.join(facts, "id").select("leader", "id", "fact_summary", "associated_date", "category", "identified_crime", "severity_score", "confidence")
