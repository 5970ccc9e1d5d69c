"""Ranking and packing: BM25, idf overlap, dense top-k, rank fusion, interleaving, budgets.

Postings (doc, term, tf) meet the terms of queries before they are shuffled; a document's score is a sum
that combines before its shuffle. Ties always go to the smaller id.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T


def postings(docs: DataFrame, doc_id: str, tokens: Column, terms: DataFrame | None = None) -> DataFrame:
    """(doc, term, tf, length). With terms(term) only these are counted: what no query asks for is left
    out before the shuffle, and a document's length is that of its whole text all the same."""
    d = docs.select(F.col(doc_id).alias("doc"), tokens.alias("ts")).withColumn("length", F.size("ts"))
    every = d.select("doc", "length", F.explode("ts").alias("term"))
    if terms is not None:
        every = every.join(terms.select("term").distinct(), "term", "left_semi")
    return every.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def query_terms(queries: DataFrame, query_id: str, tokens: Column) -> DataFrame:
    return queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(tokens)).alias("term"))


def bm25(post: DataFrame, queries: DataFrame, n_docs: int, avg_length: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score) of documents that share a term with the query. queries(query, term); post has
    the postings of all their terms."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / avg_length))
    return post.join(df, "term").withColumn("gain", gain).join(queries, "term").groupBy("query", "doc").agg(F.sum("gain").alias("score"))


def idf_overlap(post: DataFrame, queries: DataFrame, n_docs: int) -> DataFrame:
    """(query, doc, score): sum of ln(1 + N / (1 + df)) of shared terms."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return post.select("doc", "term").join(df, "term").join(queries, "term").groupBy("query", "doc").agg(F.sum(F.log(1 + n_docs / (1 + F.col("df")))).alias("score"))


def top_k(scores: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Adds rank by query; scores count to `digits` decimals so that sums in any order agree."""
    s = scores.withColumn("score", F.round("score", digits))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)


def _blocks(df: DataFrame, most_bytes: int, most_rows: int) -> DataFrame:
    """df(id, vector) as matrices: dim (0: no vector), ids, whether they are null, and the vectors' doubles."""

    def run(batches):
        for batch in batches:
            ids, v = batch.column(0), batch.column(1)
            no = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(-(1 << 63)).to_numpy()
            dims = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                step = max(1, min(most_rows, most_bytes // (8 * max(1, d))))
                for at in (own[i : i + step] for i in range(0, len(own), step)):
                    m = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64) if d else np.empty(0)
                    yield pa.RecordBatch.from_arrays([pa.array([d]), *(pa.array([x.tobytes()]) for x in (ids[at], no[at], m))], ["dim", "ids", "no", "m"])

    return df.mapInArrow(run, "dim long, ids binary, no binary, m binary")


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As F.round does, which takes halves of the number as it is written away from 0."""
    out = np.round(x, digits)
    scaled = np.abs(x) * 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


class _Best:
    """The k best of each query of a block so far, by rounded score, then by id; null ids come first."""

    def __init__(self, dim: int, ids: bytes, m: bytes, k: int, digits: int):
        self.dim, self.k, self.digits = dim, k, digits
        self.queries = np.frombuffer(ids, np.int64)
        self.q = np.frombuffer(m, np.float64).reshape(len(self.queries), dim)
        none = np.empty(0, np.int64)
        self.who, self.score, self.rank_score, self.doc, self.no = none, np.empty(0), np.empty(0), none, none.astype(bool)
        self.least = np.full(len(self.queries), -np.inf)
        self.unscored: list[tuple[bool, int]] = []  # (has an id, id) of vectors that have no score here

    def meet(self, dim: int, ids: bytes, no: bytes, m: bytes) -> None:
        docs, none = np.frombuffer(ids, np.int64), np.frombuffer(no, bool)
        if dim != self.dim or not dim:
            self.unscored = sorted(self.unscored + [(not n, d) for n, d in zip(none.tolist(), docs.tolist(), strict=True)])[: self.k]
            return
        v = np.frombuffer(m, np.float64).reshape(len(docs), dim)
        for at in range(0, len(self.q), 1024):
            s = self.q[at : at + 1024] @ v.T
            # products in another order differ in the 15th digit: what they pass is scored again
            floor = self.least[at : at + 1024]
            if len(docs) >= self.k and np.isinf(floor).any():
                floor = np.maximum(floor, np.partition(s, -self.k, axis=1)[:, -self.k])
            a, b = np.nonzero(s >= (floor - 2 * 10.0**-self.digits)[:, None])
            for i in range(0, len(a), 1 << 16):
                self._take(at + a[i : i + (1 << 16)], docs, none, v, b[i : i + (1 << 16)])

    def _take(self, who: np.ndarray, docs: np.ndarray, none: np.ndarray, v: np.ndarray, b: np.ndarray) -> None:
        score = np.cumsum(self.q[who] * v[b], axis=1)[:, -1]  # added one after another, as T.dot does
        mine = np.isin(self.who, who)
        who, score = np.concatenate((self.who[mine], who)), np.concatenate((self.score[mine], score))
        by = np.concatenate((self.rank_score[mine], _rounded(score[mine.sum() :], self.digits)))
        doc, no = np.concatenate((self.doc[mine], docs[b])), np.concatenate((self.no[mine], none[b]))
        order = np.lexsort((doc, ~no, -by, who))
        w = who[order]
        first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        place = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
        last = order[place == self.k - 1]
        self.least[who[last]] = by[last]
        stay, old = order[place < self.k], ~mine
        self.who, self.score, self.rank_score = (np.concatenate((x[old], y[stay])) for x, y in ((self.who, who), (self.score, score), (self.rank_score, by)))
        self.doc, self.no = np.concatenate((self.doc[old], doc[stay])), np.concatenate((self.no[old], no[stay]))

    def rows(self) -> pa.RecordBatch:
        short = np.flatnonzero(np.isinf(self.least)) if self.unscored else np.empty(0, np.int64)
        who, more = np.concatenate((self.who, np.repeat(short, len(self.unscored)))), self.unscored * len(short)
        doc = np.concatenate((self.doc, np.array([d for _, d in more], np.int64)))
        no = np.concatenate((self.no, np.array([not has for has, _ in more], bool)))
        score = np.concatenate((self.score, np.zeros(len(more))))
        return pa.RecordBatch.from_arrays([pa.array(self.queries[who]), pa.array(doc, mask=no), pa.array(score, mask=np.arange(len(who)) >= len(self.who))], ["query", "doc", "score"])


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, max_query_rows: int = 10_000, digits: int = 9) -> DataFrame:
    """(query, doc, score, rank): exact cosine of every vector with a stated set of query vectors,
    which is broadcast in blocks of at most max_query_rows. vectors(doc, v), queries(query, q),
    both normalised, ids longs. Blocks of vectors meet blocks of queries as matrices, and a task gives the
    k best of its vectors for each query, so that pairs are never rows. Where either has no vector or
    their lengths differ the score is null, which ranks last."""
    n = queries.count()
    blocks = max(1, -(-n // max_query_rows))
    every, out = _blocks(vectors.select("doc", "v"), 1 << 20, 1 << 16), None

    def run(batches):
        best: dict[tuple[bytes, int], _Best] = {}
        for batch in batches:
            for dim, ids, no, m, q_dim, q_ids, q_m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (q_ids, q_dim) not in best:
                    best[q_ids, q_dim] = _Best(q_dim, q_ids, q_m, k, digits)
                best[q_ids, q_dim].meet(dim, ids, no, m)
        for x in best.values():
            yield x.rows()

    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        asked = _blocks(part.select("query", "q").where("query IS NOT NULL").repartition(1), 4 << 20, max_query_rows)
        pairs = every.join(F.broadcast(asked.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))))
        got = top_k(pairs.mapInArrow(run, "query long, doc long, score double"), k, digits)
        out = got if out is None else out.unionByName(got)
    return out


def rrf(rankings: DataFrame, k: int = 60) -> DataFrame:
    """(query, doc, score) of rankings(query, doc, rank): the sum of 1 / (k + rank)."""
    return rankings.groupBy("query", "doc").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def with_tail(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Every (query, doc) with position: ranked ones first, the others by id. docs(doc); ranked(query, doc, rank)."""
    every = docs.select("doc").crossJoin(F.broadcast(ranked.select("query").distinct()))  # the stated queries
    return every.join(ranked, ["query", "doc"], "left").withColumn("position", F.row_number().over(W.partitionBy("query").orderBy(F.col("rank").asc_nulls_last(), "doc")))


def round_robin(df: DataFrame, facet: str, rank: str, by: list[str] | None = None) -> DataFrame:
    """Adds position: the first of every facet, then the second of each, …"""
    by = by or []
    rn = F.row_number().over(W.partitionBy(*by, facet).orderBy(rank))
    return df.withColumn("_rn", rn).withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy("_rn", facet))).drop("_rn")


def union_in_order(lists: DataFrame) -> DataFrame:
    """(query, item, position) of lists(query, list_no, pos, item): first mentions, in order."""
    first = lists.groupBy("query", "item").agg(F.min(F.struct("list_no", "pos")).alias("m"))
    return first.select("query", "item", F.row_number().over(W.partitionBy("query").orderBy("m")).alias("position"))


def pack(items: DataFrame, budget: int, most: int, by: str = "query") -> DataFrame:
    """(by, used, picked, skipped) of items(by, position, item, cost): in order, an item is taken if
    it still fits, else skipped and the next is tried; at most `most` are taken."""
    ordered = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("position", "item", "cost"))).alias("xs"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("picked"), F.array().cast("array<string>").alias("skipped"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["used"] + x["cost"] <= budget) & (F.size(a["picked"]) < most)
        one = F.array(x["item"].cast("string"))
        return F.struct(
            F.when(fits, a["used"] + x["cost"]).otherwise(a["used"]).cast("long").alias("used"),
            F.when(fits, F.concat(a["picked"], one)).otherwise(a["picked"]).alias("picked"),
            F.when(fits, a["skipped"]).otherwise(F.concat(a["skipped"], one)).alias("skipped"),
        )

    return ordered.select(by, F.aggregate("xs", zero, step).alias("r")).select(by, "r.used", "r.picked", "r.skipped")


def recall(selected: DataFrame, required: DataFrame, by: str = "query") -> DataFrame:
    """By query: hits, needed and complete, of selected(by, item) and required(by, item)."""
    need = required.select(by, "item").distinct()
    got = need.join(selected.select(by, "item").distinct().withColumn("hit", F.lit(1)), [by, "item"], "left")
    return got.groupBy(by).agg(F.count("hit").alias("hits"), F.count("*").alias("needed"), (F.count("hit") == F.count("*")).alias("complete"))


def _gram(n: int):
    return lambda i: F.array_join(F.slice("ws", i, F.lit(n)), " ")


def containment(texts: DataFrame, quotes: DataFrame, words: int = 5, block_rows: int = 10_000) -> DataFrame:
    """(doc_id, item_id) where a text holds a quote, white space aside. A quote may begin and end
    inside words, so its key is the first `words` of the words between; quotes meet only the texts
    that have their key, then the whole quote is looked for. Quotes of one or two words have no such
    key: they are a stated set, which every text is searched for in blocks of block_rows."""
    t = texts.select("doc_id", T.squeeze(F.col("text")).alias("x"))
    q = quotes.select("item_id", T.squeeze(F.col("text")).alias("q")).where("q <> ''").withColumn("qs", F.split("q", " "))
    q = q.withColumn("n", F.least(F.lit(words), F.size("qs") - 2))
    short = q.where("n < 1").select("item_id", "q")
    q = q.where("n >= 1").withColumn("key", F.array_join(F.slice("qs", F.lit(2), F.col("n")), " "))
    counts = {r.n: r["count"] for r in quotes.select(F.least(F.lit(words), F.size(F.split(T.squeeze(F.col("text")), " ")) - 2).alias("n")).where("n IS NOT NULL").groupBy("n").count().collect()}
    sizes, n = sorted(k for k in counts if k >= 1), sum(c for k, c in counts.items() if k < 1)  # at most `words` + 2 numbers
    found = None
    if sizes:
        grams = [F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), _gram(n)) for n in sizes]
        none = F.array().cast("array<string>")
        every = F.concat(*[F.when(F.size("ws") >= n, g).otherwise(none) for n, g in zip(sizes, grams, strict=True)])
        keys = q.select("key").distinct()
        seen = t.withColumn("ws", F.split("x", " ")).select("doc_id", F.explode(F.array_distinct(every)).alias("key")).join(keys, "key", "left_semi")
        pairs = seen.join(q.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
        found = pairs.join(t, "doc_id").join(q.select("item_id", "q"), "item_id").where(F.contains("x", F.col("q"))).select("doc_id", "item_id")
    for b in range(blocks := -(-n // block_rows)):
        part = short if blocks == 1 else short.where(F.pmod(F.xxhash64("item_id", "q"), F.lit(blocks)) == b)
        more = t.join(F.broadcast(part), F.contains("x", F.col("q"))).select("doc_id", "item_id")
        found = more if found is None else found.unionByName(more)
    return found if found is not None else t.join(q.select("item_id"), F.lit(False)).select("doc_id", "item_id")
