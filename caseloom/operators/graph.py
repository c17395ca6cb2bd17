"""Entity co-occurrence, centrality, communities, and locations.

Two entities of one file co-occur in all facts of the file, so facts are counted per file before anything is joined, and a ranking of pairs
only opens the files and entities that can reach it: a file of very many entities is never paired in full.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import alive, parsed_location, r6
from ..session import cut


def file_facts(facts: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Facts and their mean confidence by file."""
    return facts.filter(alive() & (F.col("confidence") >= min_confidence)).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("co"), F.avg("confidence").alias("mean_confidence"))


def relationships(facts: DataFrame, entities: DataFrame, entity_id: int | None = None, min_confidence: float = 0.0, limit: int = 100) -> DataFrame:
    """The pairs of entities that co-occur most, with one of them given or not (on either side); ties by ids."""
    files = file_facts(facts, min_confidence)
    e = entities.select("id", "fingerprint", "value")
    if entity_id is not None:
        own = e.filter(F.col("id") == entity_id)
        near = own.alias("o").join(files, "fingerprint").join(e.alias("x"), "fingerprint").filter(F.col("o.id") != F.col("x.id"))
        pairs = near.select(F.least("o.id", "x.id").alias("a"), F.greatest("o.id", "x.id").alias("b"), "co", "mean_confidence")
    else:
        # each file of two entities gives a pair at least, so `limit` files are enough; ties on co are all kept by the id of the least entity
        sizes = e.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("least")).filter("k > 1")
        top = files.join(sizes, "fingerprint").orderBy(F.desc("co"), "least").limit(limit)
        # of a file, pairs in order are those of its least entities
        first = Window.partitionBy("fingerprint").orderBy("id")
        some = e.join(F.broadcast(top.select("fingerprint", "co", "mean_confidence")), "fingerprint").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit + 1)
        x, y = some.alias("x"), some.alias("y")
        pairs = x.join(y, (F.col("x.fingerprint") == F.col("y.fingerprint")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "x.co", "x.mean_confidence")
    return pairs.select("a", "b", F.col("co").alias("cooccurrence"), r6(F.col("mean_confidence")).alias("mean_confidence")).orderBy(F.desc("cooccurrence"), "a", "b").limit(limit)


def connected(facts: DataFrame, entities: DataFrame, entity_id: int, depth: int = 1, min_confidence: float = 0.0) -> DataFrame:
    """Entities within `depth` shared files of one, with their distance. Only files with facts of the confidence link."""
    e = entities.join(file_facts(facts, min_confidence).select("fingerprint"), "fingerprint", "left_semi").select("id", "fingerprint", "value")
    seen = e.filter(F.col("id") == entity_id).select("id", "value", F.lit(0).alias("distance"))
    files = e.filter(F.col("id") == entity_id).select("fingerprint").distinct()
    for d in range(1, depth + 1):
        # values name the same thing across files
        reached = e.join(files, "fingerprint", "left_semi")
        seen = seen.unionByName(reached.select("id", "value", F.lit(d).alias("distance")))
        if d < depth:
            files = cut(e.join(reached.select("value").distinct(), "value", "left_semi").select("fingerprint").distinct(), "connected")
    return seen.groupBy("id", "value").agg(F.min("distance").alias("distance")).filter(F.col("distance") > 0)


def centrality(facts: DataFrame, entities: DataFrame, entity_type: str | None = None, min_confidence: float = 0.0, limit: int = 50) -> DataFrame:
    """The entities whose files hold most facts; centrality is relative to the first."""
    e = entities if entity_type is None else entities.filter(F.lower("entity_type") == entity_type.lower())
    occ = e.filter(F.col("confidence") >= min_confidence).join(file_facts(facts).select("fingerprint", "co"), "fingerprint")
    top = occ.select("id", "value", F.lower("entity_type").alias("entity_type"), F.col("co").alias("occurrences"), r6(F.col("confidence")).alias("confidence")).orderBy(F.desc("occurrences"), "id").limit(limit)
    return top.withColumn("centrality", r6(F.try_divide("occurrences", F.max("occurrences").over(Window.partitionBy()))))  # over `limit` rows


def value_centrality(facts: DataFrame, entities: DataFrame, min_confidence: float = 0.0, limit: int = 50) -> DataFrame:
    """The same by entity value: in how many files and facts it occurs."""
    occ = entities.filter((F.col("confidence") >= min_confidence) & F.col("value").isNotNull()).select(F.lower("entity_type").alias("entity_type"), "value", "fingerprint").distinct().join(file_facts(facts).select("fingerprint", "co"), "fingerprint")
    top = occ.groupBy("entity_type", "value").agg(F.count(F.lit(1)).alias("files"), F.sum("co").alias("occurrences")).orderBy(F.desc("occurrences"), "entity_type", "value").limit(limit)
    return top.withColumn("centrality", r6(F.try_divide("occurrences", F.max("occurrences").over(Window.partitionBy()))))


def people_pairs(facts: DataFrame) -> DataFrame:
    """Unordered pairs (a, b, n, strength) of people named in one fact; n counts facts. Pairs come from the lists of single facts, which a sentence bounds, never from a group of rows."""
    named = facts.filter(alive()).select("id", F.array_sort(F.array_distinct(F.filter(F.transform("people", lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != "")))).alias("p")).filter(F.size("p") > 1)
    first = named.select("id", "p", F.posexplode("p").alias("k", "a"))
    pairs = first.select("a", F.explode(F.expr("slice(p, k + 2, greatest(size(p) - k - 1, 0))")).alias("b"))
    total = facts.filter(alive()).agg(F.count(F.lit(1)).alias("facts"))
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(total)).select("a", "b", "n", r6(F.least(F.try_divide("n", "facts"), F.lit(1.0))).alias("strength"))


def field_pairs(facts: DataFrame, first: str, second: str) -> DataFrame:
    """Values (a, b, n) of two fields that stand in one fact; n counts facts."""
    return facts.filter(alive() & F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def nodes(edges: DataFrame) -> DataFrame:
    """The different endpoints of edges (a, b), labels cut at 15 signs."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.when(F.length("node") > 15, F.concat(F.substring("node", 1, 15), F.lit("..."))).otherwise(F.col("node")))


def degrees(edges: DataFrame) -> DataFrame:
    """Degree centrality: neighbours over all other nodes, 0 for a single node."""
    d = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("x")).select("x.*").groupBy("node").agg(F.countDistinct("to").alias("degree"))
    one = d.agg(F.count(F.lit(1)).alias("nodes"))
    return d.crossJoin(F.broadcast(one)).select("node", "degree", r6(F.coalesce(F.try_divide(F.col("degree"), F.col("nodes") - 1), F.lit(0.0))).alias("centrality"))


def clustering(edges: DataFrame) -> DataFrame:
    """Local clustering coefficient: closed pairs of neighbours over all. Triangles are listed from each edge's end of lower degree, which keeps hubs cheap."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    d = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    da, db = d.select(F.col("node").alias("a"), F.col("degree").alias("da")), d.select(F.col("node").alias("b"), F.col("degree").alias("db"))
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = e.join(da, "a").join(db, "b").select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedge = o.alias("p").join(o.alias("q"), (F.col("p.x") == F.col("q.x")) & (F.col("p.y") < F.col("q.y"))).select(F.col("p.x").alias("x"), F.col("p.y").alias("a"), F.col("q.y").alias("b"))
    triangles = wedge.join(e, ["a", "b"])
    t = triangles.select(F.explode(F.array("x", "a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    return d.join(t, "node", "left").select("node", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"), r6(F.coalesce(F.try_divide(2 * F.coalesce("triangles", F.lit(0)), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0))).alias("clustering"))


MAX_EDGES = 2_000_000


def betweenness(edges: DataFrame, max_edges: int = MAX_EDGES, sources: int | None = None) -> DataFrame:
    """Betweenness of each node of an unweighted graph, over (n - 1)(n - 2) ordered pairs. Sources are spread over tasks; each holds the edges, whose number is checked.

    sources: paths are followed from so many nodes only, drawn at random, and scaled up: an unbiased estimate in time sources times edges. None: from all.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    rows = e.limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise ValueError(f"more than {max_edges} edges: take the graph of a case or a community")
    names = sorted({x for r in rows for x in (r["a"], r["b"])})
    at = {x: k for k, x in enumerate(names)}
    n = len(names)
    ends = np.array([(at[r["a"]], at[r["b"]]) for r in rows], np.int64).reshape(-1, 2)
    heads, tails = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    degree = np.bincount(heads, minlength=n)
    first = np.concatenate([[0], np.cumsum(degree)]).astype(np.int64)
    near = tails[np.argsort(heads, kind="stable")]
    spark = edges.sparkSession
    if sources is None or sources >= n:
        # the paths from a leaf are those from its neighbour and one step more: it needs no search of its own
        leaf = (degree == 1) & (degree[near[np.minimum(first[:-1], max(0, len(near) - 1))]] > 1) if n else np.zeros(0, bool)
        begin, share = np.flatnonzero(~leaf), 1.0
        leaves = np.bincount(near[first[:-1][leaf]], minlength=n)
    else:
        begin, share = np.array(random.Random(7).sample(range(n), sources), np.int64), sources / n
        leaves = np.zeros(n, np.int64)
    shared = spark.sparkContext.broadcast((first, near.astype(np.int32), begin, leaves))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, near, begin, leaves = shared.value
        degree, total = np.diff(first), np.zeros(n)
        for batch in batches:
            for s in begin[batch.column("id").to_numpy()].tolist():
                paths, seen, steps = np.zeros(n), np.zeros(n, bool), []
                paths[s], seen[s] = 1.0, True
                layer = np.array([s])
                while True:  # the edges from each layer of the breadth-first search to the next
                    k = degree[layer]
                    w = near[np.arange(k.sum()) + np.repeat(first[layer] - np.cumsum(k) + k, k)]
                    on = ~seen[w]
                    v, w = np.repeat(layer, k)[on], w[on]
                    if not len(w):
                        break
                    if 8 * len(w) < n:
                        layer, back = np.unique(w, return_inverse=True)
                        paths[layer] = np.bincount(back, paths[v], len(layer))
                    else:
                        count = np.bincount(w, paths[v], n)
                        layer = np.flatnonzero(count)
                        paths[layer] = count[layer]
                    seen[layer] = True
                    steps.append((v, w, layer))
                part, each = np.zeros(n), np.zeros(n)
                for v, w, layer in reversed(steps):
                    each[layer] = (1 + part[layer]) / paths[layer]
                    if 8 * len(w) < n:
                        at, back = np.unique(v, return_inverse=True)
                        part[at] = paths[at] * np.bincount(back, each[w], len(at))
                    else:
                        part += paths * np.bincount(v, each[w], n)
                part[s] = 0.0
                total += part * (1 + leaves[s])
                total[s] += leaves[s] * (int(seen.sum()) - 2)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(total, pa.float64())], names=["k", "x"])

    parts = max(1, min(len(begin), 4 * spark.sparkContext.defaultParallelism))
    sums = spark.range(0, len(begin), 1, parts).mapInArrow(scan, "k bigint, x double").groupBy("k").agg(F.sum("x").alias("x"))
    table = spark.createDataFrame([(k, str(x)) for k, x in enumerate(names)], "k bigint, node string")
    scale = 1.0 / ((n - 1) * (n - 2) * share) if n > 2 else 0.0
    return table.join(sums, "k").select("node", r6(F.col("x") * scale).alias("betweenness"))


def modularity(edges: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row: the modularity of (node, community) over weighted edges (a, b, n): the share of weight inside communities less what chance gives."""
    a, b = labelled.select(F.col("node").alias("a"), F.col("community").alias("ca")), labelled.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    e = edges.join(a, "a").join(b, "b")
    inside = e.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("total"))
    ends = e.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "n"), F.struct(F.col("cb").alias("c"), "n"))).alias("x")).groupBy("x.c").agg(F.sum("x.n").alias("d"))
    squares = ends.agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("s"))
    return inside.crossJoin(squares).select(r6(F.try_divide("inside", "total") - F.try_divide(F.col("s"), 4.0 * F.col("total") * F.col("total"))).alias("modularity"))  # single rows


def communities(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, community): label propagation; a node takes the commonest label about it, the least of several, until nothing changes.

    Labels that swap for ever are settled by letting only half of the nodes (by hash and round) change in a round. RuntimeError if that doesn't end in `rounds` rounds.
    """
    both = edges.select("a", "b", F.col("n").alias("w")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("w")))
    both = cut(both.groupBy("a", "b").agg(F.sum("w").alias("w")), "communities-edges")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for k in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a", "label").agg(F.sum("w").alias("w"))
        own = labels.select(F.col("node").alias("a"), "label", F.lit(0.5).alias("w"))
        best = votes.select("a", "label", F.col("w").cast("double").alias("w")).unionByName(own).groupBy("a", "label").agg(F.sum("w").alias("w")).groupBy("a").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label"))
        turn = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0
        taken = best.withColumnRenamed("a", "node").withColumnRenamed("label", "to").join(labels, "node")
        wanted = taken.filter(F.col("to") != F.col("label")).limit(1).count()
        new = cut(taken.select("node", F.when(turn | F.lit(k < 3), F.col("to")).otherwise(F.col("label")).alias("label")), "communities")
        labels = new
        if not wanted:
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    return labels.select("node", F.col("label").alias("community"))


def resolve(aliases: DataFrame, entities: DataFrame, alias: str) -> DataFrame:
    """Entities that an alias stands for, surest first."""
    a = aliases.filter(F.col("alias_value") == alias).select("canonical_entity_id", "alias_type", F.col("confidence").alias("alias_confidence"))
    return entities.join(a, F.col("id") == F.col("canonical_entity_id")).select("id", "value", "entity_type", "alias_type", "alias_confidence").orderBy(F.desc("alias_confidence"), "id")


# "MR Smith" with small letters in the surname has initials, no title
LEADING = r"(?u)^(?!\s*\p{Lu}{2}\s+\S*\p{Ll}\S*\s*$)(?i)\s*(?:(?:mr|mrs|ms|miss|mx|dr|prof|professor|sir|dame|lady|lord|rev|herr|frau|madame|monsieur|mme|mlle|hon|judge|capt|captain|sgt)(?:\.\s*|\s+))+(?=\S)"
TRAILING = r"(?iu)(?:(?:^|[\s,]+)(?:jr|sr|ii|iii|iv|cfo|ceo|coo|cto|phd|ph\.d|md|esq|witness)\.?)+\s*$"
PARTICLES = ["van", "von", "der", "den", "de", "da", "di", "del", "la", "le", "ter", "zu", "al", "bin", "dos"]


def name_parts(value: str | Column) -> Column:
    """The words of a person's name, given name first: without notes in brackets, titles and roles; "Smith, J. P.", "SMITH John" and "Smith J" turned, "JP Smith" parted."""
    text = F.regexp_replace(value, r"\([^)]*\)", " ")
    bare = F.transform(F.split(text, ","), lambda x: F.regexp_replace(F.regexp_replace(x, TRAILING, ""), LEADING, ""))
    parts = F.filter(F.transform(bare, lambda x: F.filter(F.split(x, r"[\s.]+"), lambda w: w != "")), lambda p: F.size(p) > 0)
    w = F.concat(F.flatten(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))), F.coalesce(F.get(parts, F.lit(0)), F.array().cast("array<string>")))
    first, last = F.get(w, F.lit(0)), F.get(w, F.size(w) - 1)
    rest = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
    capitals, small = r"^[\p{Lu}'’-]+$", r"\p{Ll}"
    # a surname has more than one letter, a given name written in capitals beside small letters at most two: its initials
    turned = (F.size(parts) == 1) & (F.length(first) > 1) & ((F.length(last) == 1) | ((F.length(first) > 2) & first.rlike(capitals) & last.rlike(small)))
    glued = first.rlike(r"^\p{Lu}{2}$") & last.rlike(small)
    return F.when(turned, F.concat(rest, F.array(first))).when(glued, F.concat(F.split(first, ""), rest)).otherwise(w)


def alias_matches(entities: DataFrame) -> DataFrame:
    """Pairs of person values of one surname whose given names agree by initial ("J. Smith", "Dr. John P. Smith"): blocked by surname and initial, counted by value first.

    Middle names agree by initial as far as both have them.
    """
    p = entities.filter((F.lower("entity_type") == "person") & F.col("value").isNotNull()).select(F.trim("value").alias("value")).distinct()
    w, given = p.withColumn("w", name_parts("value")).filter(F.size("w") >= 2), F.get("w", F.lit(0))
    middle = F.transform(F.filter(F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))), lambda x: ~F.lower(x).isin(PARTICLES)), lambda x: F.lower(F.substring(x, 1, 1)))
    k = w.select("value", F.lower(F.get("w", F.size("w") - 1)).alias("last"), F.lower(F.substring(given, 1, 1)).alias("initial"), (F.length(given) == 1).alias("short"), middle.alias("middle"))
    both = F.least(F.size("s.middle"), F.size("l.middle"))
    agree = F.slice("s.middle", F.lit(1), both) == F.slice("l.middle", F.lit(1), both)
    return k.filter("short").alias("s").join(k.filter("not short").alias("l"), ["last", "initial"]).filter(agree).select(F.col("s.value").alias("alias_value"), F.col("l.value").alias("value"))


def locations(facts: DataFrame, entities: DataFrame, min_confidence: float = 0.0, limit: int = 100) -> DataFrame:
    """Location entities of files with facts, with coordinates where their text holds some."""
    e = entities.filter((F.lower("entity_type") == "location") & (F.col("confidence") >= min_confidence)).join(file_facts(facts).select("fingerprint"), "fingerprint", "left_semi")
    at = parsed_location(F.coalesce("normalized_value", "value"))
    return e.select("id", "value", "confidence", at["lat"].alias("lat"), at["lon"].alias("lon")).orderBy(F.desc("confidence"), "id").limit(limit)


def nearby(places: DataFrame, km: float) -> DataFrame:
    """Pairs of places (id, lat, lon) within km of one another.

    Places are unit vectors, joined by the cells of a grid as wide as the chord of km and the 26 cells around each; unlike degrees, that grid has
    neither poles nor a date line. Great circles decide.
    """
    chord = 2 * math.sin(min(km / 6371.0088, math.pi) / 2)
    size = max(chord * (1 + 1e-9), 1e-7)
    lat, lon = F.radians("lat"), F.radians("lon")
    axes = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    at = places.filter("lat is not null and lon is not null").select("id", "lat", "lon", *[F.floor(v / size).alias(k) for k, v in axes.items()])
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    around = at
    for k in axes:
        around = around.withColumn("d", F.explode(steps)).withColumn(k, F.col(k) + F.col("d")).drop("d")
    a, b = around.alias("a"), at.alias("b")
    h = F.pow(F.sin(F.radians((F.col("a.lat") - F.col("b.lat")) / 2)), 2) + F.cos(F.radians("a.lat")) * F.cos(F.radians("b.lat")) * F.pow(F.sin(F.radians((F.col("a.lon") - F.col("b.lon")) / 2)), 2)
    d = 2 * 6371.0088 * F.asin(F.least(F.sqrt(h), F.lit(1.0)))
    same = (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.z") == F.col("b.z"))
    return a.join(b, same & (F.col("a.id") < F.col("b.id"))).withColumn("km", d).filter(F.col("km") <= km).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.round("km", 3).alias("km"))

