"""Triples (s, p, o): building, traversal, paths, sets, cards and constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def triples_of(df: DataFrame, subject: Column, properties: dict[str, Column]) -> DataFrame:
    """A triple for each non-null property of each row; one pass over df."""
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), c.cast("string").alias("o")) for p, c in properties.items()])
    return df.select(subject.alias("s"), F.explode(pairs).alias("x")).select("s", "x.p", "x.o").where("o IS NOT NULL")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def with_evidence(triples: DataFrame) -> DataFrame:
    """One row a triple with its sorted set of evidence."""
    return triples.groupBy("s", "p", "o").agg(F.array_sort(F.collect_set("evidence")).alias("evidence"))


def node_json(triples: DataFrame) -> DataFrame:
    """(s, node): all of a node's predicates with their sorted objects as JSON."""
    lists = triples.groupBy("s", "p").agg(F.array_sort(F.collect_list("o")).alias("os"))
    return lists.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", "os"))).alias("ps")).select("s", F.to_json(F.map_from_entries("ps")).alias("node"))


def neighbours(triples: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """Undirected edges (a, b) over the allowed predicates."""
    t = triples.where(F.col("p").isin(predicates)) if predicates else triples
    return t.select(F.col("s").alias("a"), F.col("o").alias("b")).unionByName(t.select(F.col("o").alias("a"), F.col("s").alias("b"))).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, depth) within `hops` of seeds(node), over edges(a, b). Each level leaves out what is
    known, so a hub is expanded once."""
    found = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    level = found
    for d in range(1, hops + 1):
        level = edges.join(level.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node")).distinct().join(found, "node", "left_anti").withColumn("depth", F.lit(d))
        found = found.unionByName(level)
    return found


def simple_paths(spark, edges: DataFrame) -> DataFrame:
    """All simple directed paths of edges(a, b), as (a, b, path, length). A simple path is shorter than
    the number of nodes, which bounds the recursion and cuts nothing."""
    edges.createOrReplaceTempView("millrace_edges")
    nodes = edges.select("a").union(edges.select("b")).distinct().count()
    return spark.sql(f"""
        WITH RECURSIVE w(a, b, path, length) MAX RECURSION LEVEL {nodes + 1} AS (
          SELECT a, b, array(a, b), 1 FROM millrace_edges WHERE a <> b
          UNION ALL
          SELECT w.a, e.b, array_append(w.path, e.b), w.length + 1 FROM w JOIN millrace_edges e ON e.a = w.b
          WHERE NOT array_contains(w.path, e.b))
        SELECT a, b, array_join(path, '>') AS path, length FROM w""")


def set_algebra(a: DataFrame, b: DataFrame) -> DataFrame:
    """(part, x) of two one-column sets: both, a_only, b_only; one shuffle for all three."""
    x = a.columns[0]
    marked = a.select(F.col(x).alias("x"), F.lit(1).alias("m")).unionByName(b.select(F.col(b.columns[0]).alias("x"), F.lit(2).alias("m")))
    return marked.groupBy("x").agg(F.bit_or("m").alias("m")).select(F.when(F.col("m") == 3, "both").when(F.col("m") == 1, "a_only").otherwise("b_only").alias("part"), "x")


def target_partition(pairs: DataFrame, item: str, target: str, wanted: Column) -> DataFrame:
    """By item: only, also_others or none, as its targets are just the wanted, those and more, or not."""
    g = pairs.groupBy(item).agg(F.max(wanted).alias("w"), F.max(~wanted).alias("o"))
    return g.select(item, F.when(F.col("w") & ~F.col("o"), "only").when(F.col("w"), "also_others").otherwise("none").alias("part"))


def shared_by_all(pairs: DataFrame, item: str, owner: str, owners: list) -> DataFrame:
    """Items that every one of the owners has."""
    return pairs.where(F.col(owner).isin(owners)).groupBy(item).agg(F.count_distinct(owner).alias("n")).where(F.col("n") == len(owners)).select(item)


def merged_cards(triples: DataFrame, canonical: Column) -> DataFrame:
    """(id, p, values, sources, conflict): what all nodes of one canonical id say, side by side."""
    v = triples.select(canonical.alias("id"), "p", "o", "s").groupBy("id", "p", "o").agg(F.array_sort(F.collect_set("s")).alias("srcs"))
    return v.groupBy("id", "p").agg(F.array_sort(F.collect_list(F.struct("o", "srcs"))).alias("vs")).select("id", "p", F.array_join(F.transform("vs", lambda x: x["o"]), "|").alias("values"), F.array_join(F.array_distinct(F.flatten(F.transform("vs", lambda x: x["srcs"]))), "|").alias("sources"), (F.size("vs") > 1).alias("conflict"))


def references(texts: DataFrame, id_col: str, text: str, pattern: str) -> DataFrame:
    """(src, dst): ids that a row's text mentions, its own left out."""
    return texts.select(F.col(id_col).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("dst")).where("src <> dst")


# Constraints: each returns violations (code, node, detail).


def exactly_one(triples: DataFrame, nodes: DataFrame, p: str, code: str) -> DataFrame:
    """Nodes(s) that don't have exactly one value of p."""
    n = triples.where(F.col("p") == p).groupBy("s").agg(F.count_distinct("o").alias("n"))
    return nodes.join(n, "s", "left").where(F.coalesce("n", F.lit(0)) != 1).select(F.lit(code).alias("code"), F.col("s").alias("node"), F.coalesce("n", F.lit(0)).cast("string").alias("detail"))


def one_of(triples: DataFrame, p: str, allowed: list[str], code: str) -> DataFrame:
    return triples.where((F.col("p") == p) & ~F.col("o").isin(allowed)).select(F.lit(code).alias("code"), F.col("s").alias("node"), F.col("o").alias("detail"))


def of_type(triples: DataFrame, p: str, pattern: str, code: str) -> DataFrame:
    """Values of p that the pattern (a datatype's text) doesn't match."""
    return triples.where((F.col("p") == p) & ~F.col("o").rlike(pattern)).select(F.lit(code).alias("code"), F.col("s").alias("node"), F.col("o").alias("detail"))


def refers_to(triples: DataFrame, p: str, nodes: DataFrame, code: str) -> DataFrame:
    """Values of p that are no node(s)."""
    t = triples.where(F.col("p") == p)
    return t.join(nodes.select(F.col("s").alias("_n")), t["o"] == F.col("_n"), "left_anti").select(F.lit(code).alias("code"), F.col("s").alias("node"), F.col("o").alias("detail"))


def disjoint(a: DataFrame, b: DataFrame, code: str) -> DataFrame:
    return a.select("s").intersect(b.select("s")).select(F.lit(code).alias("code"), F.col("s").alias("node"), F.lit("").alias("detail"))


def required_if(triples: DataFrame, when_p: str, when_o: str, then_p: str, code: str) -> DataFrame:
    """Subjects with when_p = when_o that lack then_p."""
    have = triples.where(F.col("p") == then_p).select("s").distinct()
    return triples.where((F.col("p") == when_p) & (F.col("o") == when_o)).select("s").distinct().join(have, "s", "left_anti").select(F.lit(code).alias("code"), F.col("s").alias("node"), F.lit(then_p).alias("detail"))


def forbidden(triples: DataFrame, p: str | None, pattern: str, code: str) -> DataFrame:
    """Triples whose value matches a pattern that must not occur."""
    t = triples if p is None else triples.where(F.col("p") == p)
    return t.where(F.col("o").rlike(pattern)).select(F.lit(code).alias("code"), F.col("s").alias("node"), F.col("o").alias("detail"))


def in_range(triples: DataFrame, p: str, lo: float | None, hi: float | None, code: str) -> DataFrame:
    """Values of p that are no number, or lie below lo or above hi."""
    v = F.col("o").try_cast("double")
    bad = v.isNull()
    if lo is not None:
        bad = bad | (v < lo)
    if hi is not None:
        bad = bad | (v > hi)
    return triples.where((F.col("p") == p) & bad).select(F.lit(code).alias("code"), F.col("s").alias("node"), F.lit(p).alias("detail"))


def apart(triples: DataFrame, p: str, q: str, code: str) -> DataFrame:
    """Subjects with one and the same value of p and of q."""
    same = triples.where(F.col("p").isin(p, q)).groupBy("s", "o").agg(F.count_distinct("p").alias("n")).where("n = 2")
    return same.select(F.lit(code).alias("code"), F.col("s").alias("node"), F.col("o").alias("detail"))


def one_subtype(triples: DataFrame, nodes: DataFrame, types: list[str], code: str) -> DataFrame:
    """Nodes(s) whose types hold none or several of the given ones; detail says how many."""
    n = triples.where((F.col("p") == "type") & F.col("o").isin(types)).groupBy("s").agg(F.count_distinct("o").alias("n"))
    k = F.coalesce("n", F.lit(0))
    return nodes.join(n, "s", "left").where(k != 1).select(F.lit(code).alias("code"), F.col("s").alias("node"), k.cast("string").alias("detail"))


def required(triples: DataFrame, when_p: str, values: list[str], then: list[list[str]], code: str) -> DataFrame:
    """Subjects whose when_p has one of the values and that lack some property of every one of the groups
    in `then`: one whole group must be there. Each subject's properties combine before one shuffle."""
    used = sorted({x for group in then for x in group})
    g = triples.where(F.col("p").isin(when_p, *used)).groupBy("s").agg(F.max((F.col("p") == when_p) & F.col("o").isin(values)).alias("_when"), *[F.max(F.col("p") == x).alias(f"_{x}") for x in used])
    whole = F.lit(False)
    for group in then:
        one = F.lit(True)
        for x in group:
            one = one & F.col(f"_{x}")
        whole = whole | one
    return g.where(F.col("_when") & ~whole).select(F.lit(code).alias("code"), F.col("s").alias("node"), F.lit("+".join(used)).alias("detail"))


def forbidden_names(triples: DataFrame, names: list[str], code: str) -> DataFrame:
    """Properties whose names, case, '_' and '-' aside, are forbidden."""
    folded = F.lower(F.regexp_replace(F.regexp_replace("p", "^.*[/#: ]", ""), "[_-]", ""))
    return triples.where(folded.isin(names)).select(F.lit(code).alias("code"), F.col("s").alias("node"), F.col("p").alias("detail"))
