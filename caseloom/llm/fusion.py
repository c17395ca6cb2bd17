"""Problem 5: one surviving record for each group of duplicates, field by field, by Bayesian fusion with copy detection.

A claim is a usable value of a field in a record of a group. Records come from sources (here the extraction pass that made them).
In rounds, over the whole corpus:

- the accuracy of a source is the mean posterior of the values it claims;
- for each pair of sources, three soft counts say how often they share a value that is accepted, share one that isn't, or differ. Sharing false values is
  unlikely between independent sources, so the likelihood of the counts under copying against independence gives the probability that one depends on the other;
- in the vote for a value, the sources that claim it count in the order of their accuracy, each discounted by the probability that it copied from one before it;
- a value's posterior is the product of its prior (how recent and how trusted its best claim is) and the discounted votes for it.

The value of maximum posterior survives. A claim that is at least as recent and as trusted as every other one supersedes them: its prior outweighs
any number of votes.

Claims are first summed by (group, field, value, source) with partial aggregation, so a group of a third of all rows is spread over
all tasks and no task ever holds a group.

Defined results: null, out-of-range or unreadable values are no claims; a field without a claim has no row; records with null group
keys are in no group; groups of one record are left out; ties are broken by the smallest id; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timestamps import NORMAL, normal_form_column, with_source
from ..session import cut

#: The prior of a value whose best claim is superseded, as a log-odds penalty that votes (at most VOTE_CAP in sum) can't outweigh.
SUPERSEDED, VOTE_CAP = -50.0, 20.0
FALSE_VALUES = 20.0  # how many false values a field is taken to have
ITERATIONS = 3
MOST_ACCURATE = 0.95
COPIED = 0.8  # share of its values that a copier takes over
DEPENDENT = 0.2  # prior probability that of two sources one copies


def group_key(summary: Column) -> Column:
    """A text apart from case and white space."""
    return F.trim(F.regexp_replace(F.lower(summary), r"[\s\p{Z}]+", " "))


def claims(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """(group_id, field_name, value, source, id, created, trust) of all usable values in groups of two and more."""
    alive = facts.filter(~F.coalesce(F.col("is_deleted"), F.lit(False)) & F.col("fingerprint").isNotNull() & F.col("fact_summary").isNotNull())
    keyed = alive.select(
        F.xxhash64("fingerprint", group_key(F.col("fact_summary"))).alias("k1"),
        F.xxhash64(F.lit(7), group_key(F.col("fact_summary")), "fingerprint").alias("k2"),
        "id",
        "filename",
        "associated_date",
        F.when(F.col("severity_score").between(1, 10), F.col("severity_score")).alias("severity"),
        F.when(F.col("confidence").between(0.0, 1.0), F.col("confidence")).alias("conf"),
        F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(2**62))).alias("created"),
        F.xxhash64(F.coalesce("pipeline_id", F.lit("")), F.coalesce("pass_name", F.lit(""))).alias("source"),
    )
    groups = keyed.groupBy("k1", "k2").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # the members of groups are few; only their dates are read in Python
    members = keyed.join(groups, ["k1", "k2"]).drop("k1", "k2", "n")
    known = with_source(members, "filename", sources, "__zone", "__order")
    normal = F.col("associated_date").rlike(NORMAL) & F.expr("try_cast(substr(associated_date, 1, 10) as date)").isNotNull()
    read = F.when(normal, F.col("associated_date")).otherwise(normal_form_column(F.when(~F.coalesce(F.col("associated_date").rlike(NORMAL), F.lit(False)), F.col("associated_date")), F.col("__zone"), F.col("__order")))
    fields = F.array(
        F.struct(F.lit("confidence").alias("field_name"), F.col("conf").cast("string").alias("value")),
        F.struct(F.lit("severity_score").alias("field_name"), F.col("severity").cast("string").alias("value")),
        F.struct(F.lit("associated_date").alias("field_name"), F.col("day").alias("value")),
    )
    trust = F.coalesce("conf", F.lit(-1.0)).alias("trust")
    return known.withColumn("day", read).select("group_id", "id", "created", trust, "source", F.explode(fields).alias("f")).select("group_id", "f.field_name", "f.value", "source", "id", "created", "trust").filter("value is not null")


def dependences(accepted: DataFrame, at: list[str], accuracy: DataFrame | None) -> DataFrame:
    """(s, o, dependent) for pairs of sources in both orders: the probability that one of the two copies from the other.

    Without accuracies (before any value is accepted that copies may have decided), agreement alone counts: independent sources differ at least as often as MOST_ACCURATE ones.
    """
    # of each source the value it claims most in a group: as many rows as sources have groups
    main = accepted.groupBy(*at, "source").agg(F.max(F.struct("n", "value", "p")).alias("m")).select(*at, "source", "m.value", "m.p")
    x, y = main.alias("x"), main.alias("y")
    same = F.col("x.value") == F.col("y.value")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in at] + [F.col("x.source") < F.col("y.source")]
    met = x.join(y, on).groupBy(F.col("x.source").alias("s"), F.col("y.source").alias("o")).agg(
        F.sum(F.when(same, F.col("x.p")).otherwise(0.0)).alias("right"), F.sum(F.when(same, 1 - F.col("x.p")).otherwise(0.0)).alias("wrong"), F.sum(F.when(same, 0.0).otherwise(1.0)).alias("apart")
    )
    if accuracy is None:
        agree = MOST_ACCURATE**2 + (1 - MOST_ACCURATE) ** 2 / FALSE_VALUES
        llr = (F.col("right") + F.col("wrong")) * log((COPIED + (1 - COPIED) * agree) / agree) + F.col("apart") * log(1 - COPIED)
        return in_both_orders(met, llr)
    a, b = (accuracy.select(F.col("source").alias(c), F.col("accuracy").alias(f"a{c}")) for c in "so")
    both = met.join(a, "s").join(b, "o")
    t, f = F.col("as") * F.col("ao"), (1 - F.col("as")) * (1 - F.col("ao")) / FALSE_VALUES
    one = (F.col("as") + F.col("ao")) / 2
    llr = F.col("right") * F.log((COPIED * one + (1 - COPIED) * t) / t) + F.col("wrong") * F.log((COPIED * (1 - one) + (1 - COPIED) * f) / f) + F.col("apart") * F.log(F.lit(1 - COPIED))
    return in_both_orders(both, llr)


def in_both_orders(pairs: DataFrame, llr: Column) -> DataFrame:
    p = 1 / (1 + (1 - DEPENDENT) / DEPENDENT * F.exp(-F.greatest(F.least(llr, F.lit(50.0)), F.lit(-50.0))))
    each = pairs.select("s", "o", p.alias("dependent"))
    return each.unionByName(each.select(F.col("o").alias("s"), F.col("s").alias("o"), "dependent"))


def discounts(v: DataFrame, at: list[str], dependence: DataFrame) -> DataFrame:
    """(group, field, value, source, independent): how far a source's vote is its own, given the sources before it that claim the same."""
    key = [*at, "value"]
    several = v.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    some = v.join(several, key).select(*key, "source", "place")
    x, y = some.alias("x"), some.alias("y")
    pairs = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in key] + [F.col("y.place") < F.col("x.place")]).select(*[F.col(f"x.{c}") for c in key], F.col("x.source").alias("source"), F.col("y.source").alias("o"))
    known = pairs.join(dependence.withColumnRenamed("s", "source"), ["source", "o"])
    return known.groupBy(*key, "source").agg(F.exp(F.sum(F.log(1 - COPIED * F.col("dependent")))).alias("independent"))


def fuse(claimed: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """The surviving value of each (group_id, field_name): value, source_id, posterior, undisputed.

    undisputed: one claim is at least as recent and as trusted as all others of the field, and no second one is. It then survives.
    """
    best = F.struct("created", "trust", (-F.col("id")).alias("neg_id"))
    votes = cut(
        claimed.groupBy("group_id", "field_name", "value", "source").agg(
            F.count(F.lit(1)).alias("n"), F.max("created").alias("c_max"), F.max("trust").alias("t_max"), F.max(best).alias("first"), F.max(F.struct("created", "trust", "id")).alias("last")
        ),
        "fusion-votes",
    )
    at = ["group_id", "field_name"]
    fields = votes.groupBy(*at).agg(
        F.max("c_max").alias("c_top"), F.max("t_max").alias("t_top"), F.max("first").alias("g_first"), F.max("last").alias("g_last"), F.sum("n").alias("claims")
    ).withColumn(
        "undisputed",
        (F.col("g_first.created") == F.col("c_top")) & (F.col("g_first.trust") == F.col("t_top")) & (-F.col("g_first.neg_id") == F.col("g_last.id")),
    )
    accuracy = votes.select("source").distinct().select("source", F.lit(0.8).alias("accuracy"))
    dependence: DataFrame | None = None
    scored = None
    for k in range(iterations + 1):
        # sources are kinds of extraction pass, a handful; the check keeps a wrong use from broadcasting much
        acc = cut(accuracy.withColumn("place", F.row_number().over(Window.orderBy(F.desc("accuracy"), "source"))), "fusion-accuracy")
        acc = F.broadcast(acc) if acc.limit(10_001).count() <= 10_000 else acc
        weight = F.log(FALSE_VALUES * F.col("accuracy") / (1 - F.col("accuracy")))
        # votes of one source for one value count once and a little more: a source that repeats itself copies itself
        v = votes.join(acc, "source").select(*at, "value", "source", "place", "first", (weight * (1 + F.log2(F.col("n").cast("double")) / 8)).alias("vote"))
        if dependence is not None:
            v = v.join(discounts(v, at, dependence), [*at, "value", "source"], "left").withColumn("vote", F.col("vote") * F.coalesce("independent", F.lit(1.0))).drop("independent")
        per_value = v.groupBy(*at, "value").agg(F.least(F.sum("vote"), F.lit(VOTE_CAP)).alias("vote"), F.max("first").alias("first"))
        joined = per_value.join(fields, at)
        wins = F.col("undisputed") & (F.col("first") == F.col("g_first"))
        prior = F.when(F.col("undisputed") & ~wins, SUPERSEDED).otherwise(F.lit(0.0)) + F.greatest("first.trust", F.lit(0.0)) + F.when(F.col("first.created") == F.col("c_top"), 1.0).otherwise(0.0)
        scored = cut(joined.withColumn("score", prior + F.col("vote")), "fusion-scores")
        if k == iterations:
            break
        total = scored.groupBy(*at).agg(F.max("score").alias("top"), F.sum(F.exp(F.greatest("score", F.lit(-60.0)))).alias("mass"))
        # the values nobody claims have some of the mass too
        posterior = scored.join(total, at).select(*at, "value", (F.exp(F.greatest("score", F.lit(-60.0))) / (F.col("mass") + 1.0)).alias("p"))
        accepted = cut(votes.select(*at, "value", "source", "n").join(posterior, [*at, "value"]), "fusion-accepted")
        before = accuracy
        accuracy = accepted.groupBy("source").agg(F.least(F.greatest((F.sum("p") + 4.0) / (F.count(F.lit(1)) + 5.0), F.lit(0.05)), F.lit(MOST_ACCURATE)).alias("accuracy"))
        dependence = cut(dependences(accepted, at, before if k else None), "fusion-dependence")
        if k == 0:  # copies must not speak for a source's accuracy before they are known as such
            accuracy = before
    winner = F.max(F.struct("score", "first.neg_id", "value", "undisputed"))
    survivors = scored.groupBy(*at).agg(winner.alias("w"), F.max("score").alias("top"), F.sum(F.exp(F.greatest("score", F.lit(-60.0)))).alias("mass"))
    return survivors.select(*at, F.col("w.value").alias("value"), (-F.col("w.neg_id")).alias("source_id"), F.try_divide(F.exp("top"), F.col("mass")).alias("posterior"), F.col("w.undisputed").alias("undisputed"))


def survivors(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """fuse over the groups of facts of one file with one summary."""
    return fuse(claims(facts, sources))


def found(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """(group_id, field_name, source_id) of p5_found: the surviving values that nothing disputes."""
    return survivors(facts, sources).filter("undisputed").select("group_id", "field_name", "source_id")
