"""Full-text search with AND, OR, NOT, phrases, prefixes and brackets, ranked by BM25 over several columns.

Neighbouring terms are joined by AND; NOT needs something to its left. A score is negative, better ones being lower. Statistics (documents,
mean length, frequency of each queried term) and hits come from a stored inverted index of which a search reads the terms it asks for;
the texts themselves are read for the rows that are shown.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import alive, r6, tokens
from ..session import cut, spread

K1, B = 1.2, 0.75


@dataclass
class Node:
    """A term, phrase or prefix (words), or an operator over parts."""

    kind: str
    words: tuple[str, ...] = ()
    parts: list[Node] = field(default_factory=list)


LEX = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|"(?P<phrase>[^"]*)"|(?P<word>[^\s()"]+))')


def parse(query: str) -> Node | None:
    """The query as a tree; None if it holds no term. Unbalanced brackets and a leading NOT raise ValueError."""
    items: list[tuple[str, str]] = [(m.lastgroup or "", m.group(m.lastgroup or 0)) for m in LEX.finditer(query)]
    at = 0

    def leaf(kind: str, text: str) -> Node | None:
        prefix = kind == "word" and text.endswith("*")
        w = tuple(re.findall(r"[^\W_]+", text.lower()))
        if not w:
            return None
        return Node("prefix" if prefix else "phrase" if len(w) > 1 else "term", w)

    def word(name: str) -> bool:
        return at < len(items) and items[at] == ("word", name)

    def unit() -> Node | None:
        nonlocal at
        kind, text = items[at]
        at += 1
        if kind == "open":
            inner = either()
            if at >= len(items) or items[at][0] != "close":
                raise ValueError("unbalanced bracket")
            at += 1
            return inner
        if kind == "close":
            raise ValueError("unbalanced bracket")
        return leaf(kind, text)

    def both() -> Node | None:
        nonlocal at
        left: Node | None = None
        started = False
        while at < len(items) and items[at][0] != "close" and not word("OR"):
            if word("AND"):
                at += 1
                if not started:
                    raise ValueError("AND needs a left side")
                continue
            if word("NOT"):
                at += 1
                if left is None:
                    raise ValueError("NOT needs a left side")
                right = unit() if at < len(items) else None
                if right is not None:
                    left = Node("not", parts=[left, right])
                continue
            right = unit()
            started = True
            if right is not None:
                left = right if left is None else Node("and", parts=[left, right])
        return left

    def either() -> Node | None:
        nonlocal at
        left = both()
        while word("OR"):
            at += 1
            right = both()
            left = right if left is None else left if right is None else Node("or", parts=[left, right])
        return left

    tree = either()
    if at < len(items):
        raise ValueError("unbalanced bracket")
    return tree


def leaves(node: Node) -> list[Node]:
    return [node] if not node.parts else [x for p in node.parts for x in leaves(p)]


def matches(node: Node, names: dict[int, str]) -> Column:
    if not node.parts:
        return F.col(names[id(node)]) > 0
    left, right = (matches(p, names) for p in node.parts)
    return left & right if node.kind == "and" else left | right if node.kind == "or" else left & ~right


@dataclass
class Index:
    """A stored inverted index: postings (column, term, doc, tf, positions, d) in the order of terms, and one row of totals (n, avg)."""

    postings: DataFrame
    totals: DataFrame


def placed(tokens_: str | Column, column: str) -> Column:
    """The tokens of a column with its name and their positions."""
    return F.transform(tokens_, lambda t, p: F.struct(F.lit(column).alias("column"), t.alias("term"), p.alias("pos")))


def shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda v: v - by)


def index(df: DataFrame, id_col: str, columns: list[str], name: str = "index") -> Index:
    """Writes the index of df's columns to the shared folder. Files are in the order of terms, so a search reads the row groups of its terms only; a hot term is split by document."""
    spark = df.sparkSession
    key = hashlib.sha256(repr((sorted(df.inputFiles()), df._jdf.queryExecution().analyzed().canonicalized().toString(), id_col, columns)).encode()).hexdigest()[:16]
    known = _indexes.get((spark.sparkContext.applicationId, key))
    if known is None:
        toks = spread(df.select(id_col, *columns)).select(F.col(id_col).alias("doc"), *[tokens(c).alias(f"t{k}") for k, c in enumerate(columns)])
        d = sum((F.size(f"t{k}") for k in range(len(columns))), F.lit(0)).alias("d")
        words = F.concat(*[placed(f"t{k}", c) for k, c in enumerate(columns)])
        sized = toks.select("doc", d, words.alias("w"))
        flat = sized.select("doc", "d", F.explode("w").alias("w")).select("doc", "d", "w.column", "w.term", "w.pos")
        # one shuffle: by term and a part of the documents, which also holds what the grouping needs
        dealt = flat.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(16))).repartition("term", "part")
        per = dealt.groupBy("term", "part", "column", "doc", "d").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
        ordered = per.drop("part").sortWithinPartitions("term", "doc")
        known = _indexes[spark.sparkContext.applicationId, key] = Index(cut(ordered, f"{name}-postings"), cut(sized.agg(F.count(F.lit(1)).alias("__n"), F.avg("d").alias("__avg")), f"{name}-totals"))
    return known


#: Indexes of this session by their source: searches of one table share an index.
_indexes: dict[tuple[str, str], Index] = {}


def forget(spark: SparkSession) -> None:
    """Searches after this build their index anew (for when its tables were cleared)."""
    for k in [k for k in _indexes if k[0] == spark.sparkContext.applicationId]:
        del _indexes[k]


def ranked(idx: Index, query: str) -> DataFrame:
    """(doc, rank) of the documents that match (BM25, lower is better), from the postings of the query's terms alone."""
    tree = parse(query)
    if tree is None:
        return idx.postings.select("doc", F.lit(0.0).alias("rank")).filter(F.lit(False))
    parts = leaves(tree)
    names = {id(p): f"__f{k}" for k, p in enumerate(parts)}
    term = F.col("term")
    exact = sorted({w for p in parts if p.kind != "prefix" for w in p.words})
    wanted = term.isin(exact) if exact else F.lit(False)
    for p in parts:
        if p.kind == "prefix":
            wanted = wanted | term.startswith(p.words[-1])
    read = idx.postings.filter(wanted)
    # first by column, as a phrase doesn't run over a column's end
    aggs = []
    for p in parts:
        if p.kind == "phrase":
            aggs += [F.max(F.when(term == w, F.col("positions"))).alias(f"{names[id(p)]}_{k}") for k, w in enumerate(p.words)]
        else:
            aggs.append(F.sum(F.when(term == p.words[0] if p.kind == "term" else term.startswith(p.words[-1]), F.col("tf")).otherwise(0)).alias(names[id(p)]))
    by_column = read.groupBy("doc", "d", "column").agg(*aggs)
    for p in parts:
        if p.kind == "phrase":
            at = [F.coalesce(F.col(f"{names[id(p)]}_{k}"), F.array().cast("array<int>")) for k in range(len(p.words))]
            starts = at[0]
            for k, x in enumerate(at[1:], 1):
                starts = F.array_intersect(starts, shifted(x, k))
            by_column = by_column.withColumn(names[id(p)], F.size(starts))
    docs = by_column.groupBy("doc", "d").agg(*[F.sum(n).alias(n) for n in names.values()])
    stats = docs.agg(*[F.count_if(F.col(names[id(p)]) > 0).alias(f"__n{k}") for k, p in enumerate(parts)])
    both = docs.filter(matches(tree, names)).crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(idx.totals))  # with single rows
    score = F.lit(0.0)
    for k, p in enumerate(parts):
        f, n = F.col(names[id(p)]).cast("double"), F.col(f"__n{k}")
        idf = F.log((F.col("__n") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        score = score + idf * F.try_divide(f * (K1 + 1), f + K1 * (1 - B + B * F.try_divide(F.col("d"), F.col("__avg"))))
    return both.select("doc", (-score).alias("rank"))


def best(table: DataFrame, hit: DataFrame, keep: list[str | Column], filters: list[Column], limit: int) -> DataFrame:
    """The best rows of table: ranked and filtered on narrow columns first; wide columns are read for those that are shown."""
    narrow = table
    for f in filters:
        narrow = narrow.filter(f)
    top = narrow.select("id").join(hit, F.col("id") == F.col("doc")).select("id", r6(F.col("rank")).alias("rank")).orderBy("rank", "id").limit(limit)
    return table.join(F.broadcast(top), "id").select(*keep, "rank").orderBy("rank", "id")


FACT_COLUMNS = ["fact_summary", "source_quote", "category"]
ENTITY_COLUMNS = ["value", "normalized_value", "entity_type"]


def facts(table: DataFrame, query: str, limit: int = 100, categories: list[str] | None = None, min_severity: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The best facts for a query. Statistics cover all facts that aren't deleted; filters apply to the hits."""
    own = table.filter(alive())
    filters = []
    if categories:
        filters.append(F.col("category").isin(categories))
    if min_severity is not None:
        filters.append(F.col("severity_score") >= min_severity)
    if start:
        filters.append(F.col("associated_date") >= start)
    if end:
        filters.append(F.col("associated_date") <= end)
    return best(own, ranked(index(own, "id", FACT_COLUMNS, "facts"), query), ["id", "filename", "fact_summary", "category", "severity_score"], filters, limit)


def entities(table: DataFrame, query: str, limit: int = 100, types: list[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    filters = []
    if types:
        filters.append(F.lower("entity_type").isin([t.lower() for t in types]))
    if min_confidence is not None:
        filters.append(F.col("confidence") >= min_confidence)
    return best(table, ranked(index(table, "id", ENTITY_COLUMNS, "entities"), query), ["id", "value", "normalized_value", F.lower("entity_type").alias("entity_type"), "confidence"], filters, limit)


def entity_facts(table: DataFrame, fact_table: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """The best entities of files with facts, with the name of such a file."""
    names = fact_table.filter(alive()).groupBy("fingerprint").agg(F.min("filename").alias("filename"))
    hit = ranked(index(table, "id", ENTITY_COLUMNS, "entities"), query)
    top = table.select("id", "value", "fingerprint").join(hit, F.col("id") == F.col("doc")).join(names, "fingerprint")
    return top.select("id", "value", "filename", r6(F.col("rank")).alias("rank")).orderBy("rank", "id").limit(limit)


def combined(fact_table: DataFrame, entity_table: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The best of facts and entities in one list."""
    f = facts(fact_table, query, limit).select(F.lit("fact").alias("kind"), "id", F.col("fact_summary").alias("title"), F.lit(None).cast("string").alias("description"), "category", "severity_score", "rank")
    e = entities(entity_table, query, limit).select(F.lit("entity").alias("kind"), "id", F.col("value").alias("title"), F.col("normalized_value").alias("description"), F.col("entity_type").alias("category"), F.lit(None).cast("int").alias("severity_score"), "rank")
    return f.unionByName(e).orderBy("rank", "kind", "id").limit(limit)


def postings(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """The inverted index over columns: (column, term, doc, tf, positions). Written bucketed by term it serves many queries.

    Positions count from 0 in each column; rows of one id count together, with the positions of all of them.
    """
    at = df.select(F.col(id_col).alias("doc"), F.explode(F.concat(*[placed(tokens(c), c) for c in columns])).alias("w")).select("w.column", "w.term", "doc", "w.pos")
    return at.groupBy("column", "term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
