"""Text and retrieval queries over documents, benchmark, conversations, embeddings and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import retrieval as R
from .registry import Tables, query

#: Fixed pattern of a token, as in functions.text.
TOKENS_SQL = "flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[-_.][a-z0-9]+)*|[가-힣]+'), lambda w: list_concat([w], CASE WHEN regexp_matches(w, '[-_]') THEN list_filter(regexp_split_to_array(w, '[-_]'), lambda p: p <> '') ELSE [] END)))"
SQUEEZE_SQL = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, len({TOKENS_SQL.format('text')})::BIGINT AS n_tokens, len(list_distinct({TOKENS_SQL.format('text')}))::BIGINT AS n_terms FROM documents")
def tokenize_terms(tb):
    return tb.documents.select("doc_id", T.tokens(F.col("text")).alias("ts")).select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.size(F.array_distinct("ts")).cast("long").alias("n_terms"))


POST_SQL = f"d AS (SELECT doc_id AS doc, {TOKENS_SQL.format('text')} AS ts FROM documents), post AS (SELECT doc, term, count(*) AS tf, any_value(len(ts)) AS length FROM (SELECT doc, ts, unnest(ts) AS term FROM d) GROUP BY doc, term), st AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM d), q AS (SELECT DISTINCT item_id AS query, unnest({TOKENS_SQL.format('text')}) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"
BM25_SQL = f"{POST_SQL}, bm AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))), 9) AS score FROM post JOIN df USING (term) JOIN q USING (term), st GROUP BY query, doc)"
IDF_SQL = "idf AS (SELECT query, doc, round(sum(ln(1 + n / (1 + df))), 9) AS score FROM post JOIN df USING (term) JOIN q USING (term), st GROUP BY query, doc)"


def lexical(tb: Tables, every_term: bool = False) -> tuple[DataFrame, DataFrame, int, float]:
    """Postings (of the queries' terms, if not every_term), the queries' terms, the number of documents
    and their mean length."""
    toks = T.tokens(F.col("text"))
    stats = tb.documents.select(F.size(toks).alias("n")).agg(F.count("*"), F.avg("n")).first()
    terms = R.query_terms(tb.benchmark, "item_id", toks)
    return R.postings(tb.documents, "doc_id", toks, None if every_term else terms), terms, stats[0], float(stats[1] or 1.0)


def bm25_scores(tb: Tables) -> DataFrame:
    return R.bm25(*lexical(tb))


@query(f"WITH {BM25_SQL} SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm QUALIFY rank <= 10")
def bm25_topk(tb):
    return R.top_k(bm25_scores(tb), 10).select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {POST_SQL}, {IDF_SQL} SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM idf QUALIFY rank <= 10")
def idf_overlap_topk(tb):
    post, terms, n, _ = lexical(tb)
    return R.top_k(R.idf_overlap(post, terms, n), 10).select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {POST_SQL} SELECT term, df, (SELECT n FROM st) AS n_docs, round((SELECT al FROM st), 6) AS mean_length FROM df")
def term_statistics(tb):
    post, _, n, mean = lexical(tb, every_term=True)
    return post.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", F.lit(n).cast("long").alias("n_docs"), F.lit(round(mean, 6)).alias("mean_length"))


NORM_SQL = "nv AS (SELECT vec_id AS doc, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"
DENSE_SQL = f"{NORM_SQL}, de AS (SELECT a.doc AS query, b.doc AS doc, round(list_dot_product(a.v, b.v), 9) AS score FROM nv a, nv b WHERE a.doc % 25 = 0)"


def dense(tb: Tables, k: int) -> DataFrame:
    v = tb.embeddings.select(F.col("vec_id").alias("doc"), T.normalized(F.col("embedding")).alias("v"))
    return R.dense_top_k(v, v.where("doc % 25 = 0").select(F.col("doc").alias("query"), F.col("v").alias("q")), k)


@query(f"WITH {DENSE_SQL} SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM de QUALIFY rank <= 10")
def dense_topk(tb):
    return dense(tb, 10).select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


RANKS_SQL = "r1 AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm QUALIFY rank <= 50), r2 AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM idf QUALIFY rank <= 50), ru AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2), fu AS (SELECT query, doc, round(sum(1.0 / (60 + rank)), 9) AS score FROM ru GROUP BY query, doc), fr AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM fu)"


def fused(tb: Tables, k: int = 20) -> DataFrame:
    post, terms, n, mean = lexical(tb)
    a, b = R.top_k(R.bm25(post, terms, n, mean), 50), R.top_k(R.idf_overlap(post, terms, n), 50)
    return R.top_k(R.rrf(a.select("query", "doc", "rank").unionByName(b.select("query", "doc", "rank"))), k)


@query(f"WITH {BM25_SQL}, {IDF_SQL}, {RANKS_SQL} SELECT query, doc, score, rank FROM fr WHERE rank <= 20")
def rrf_fusion(tb):
    return fused(tb).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {BM25_SQL}, {IDF_SQL}, {RANKS_SQL}, f5 AS (SELECT * FROM fr WHERE rank <= 5 AND query < 10), al AS (SELECT DISTINCT query FROM f5), x AS (SELECT al.query, doc_id AS doc, row_number() OVER (PARTITION BY al.query ORDER BY rank NULLS LAST, doc_id) AS position FROM al CROSS JOIN documents LEFT JOIN f5 ON f5.query = al.query AND f5.doc = doc_id) SELECT query, doc, position FROM x")
def fused_with_tail(tb):
    top = fused(tb, 5).where("query < 10").select("query", "doc", "rank")
    return R.with_tail(top, tb.documents.select(F.col("doc_id").alias("doc"))).select("query", "doc", F.col("position").cast("long").alias("position"))


@query(f"WITH {BM25_SQL}, {IDF_SQL}, {RANKS_SQL}, f5 AS (SELECT * FROM fr WHERE rank <= 5 AND query % 100 = 0), al AS (SELECT DISTINCT query FROM f5), x AS (SELECT al.query, doc_id AS doc, row_number() OVER (PARTITION BY al.query ORDER BY rank NULLS LAST, doc_id) AS position FROM al CROSS JOIN documents LEFT JOIN f5 ON f5.query = al.query AND f5.doc = doc_id) SELECT query, doc, position FROM x")
def fused_with_tail_all(tb):
    """fused_with_tail for the stated query set: ids divisible by 100."""
    top = fused(tb, 5).where("query % 100 = 0").select("query", "doc", "rank")
    return R.with_tail(top, tb.documents.select(F.col("doc_id").alias("doc"))).select("query", "doc", F.col("position").cast("long").alias("position"))


@query("WITH x AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) SELECT doc_id, lang, row_number() OVER (ORDER BY rn, lang) AS position FROM x WHERE rn <= 25")
def round_robin_facets(tb):
    """The 25 longest of each language, interleaved; cut to the few before they meet in one order."""
    x = tb.documents.select("lang", "doc_id", "n_chars").withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))).where("rn <= 25")
    return R.round_robin(x, "lang", "rn").select("doc_id", "lang", F.col("position").cast("long").alias("position"))


@query(f"WITH {BM25_SQL}, {IDF_SQL}, {RANKS_SQL}, l AS (SELECT query, 1 AS list_no, rank AS pos, doc FROM r1 WHERE rank <= 8 UNION ALL SELECT query, 2, rank, doc FROM r2 WHERE rank <= 8), m AS (SELECT query, doc, min(list_no * 1000 + pos) AS k FROM l GROUP BY query, doc) SELECT query, doc AS item, row_number() OVER (PARTITION BY query ORDER BY k) AS position FROM m")
def candidate_union_order(tb):
    post, terms, n, mean = lexical(tb)
    a = R.top_k(R.bm25(post, terms, n, mean), 8).withColumn("list_no", F.lit(1))
    b = R.top_k(R.idf_overlap(post, terms, n), 8).withColumn("list_no", F.lit(2))
    u = a.unionByName(b).select("query", "list_no", F.col("rank").alias("pos"), F.col("doc").alias("item"))
    return R.union_in_order(u).withColumn("position", F.col("position").cast("long"))


@query(
    rf"WITH RECURSIVE {BM25_SQL}, rk AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm QUALIFY rank <= 12), it AS (SELECT query, rank, doc, len(regexp_extract_all(text, '\w+|[^\w\s]'))::BIGINT AS cost FROM rk JOIN documents ON doc = doc_id),"
    " f AS (SELECT DISTINCT query, 0::BIGINT AS rank, 0::BIGINT AS used, ''::VARCHAR AS picked FROM it UNION ALL SELECT f.query, it.rank, CASE WHEN used + cost <= 1500 THEN used + cost ELSE used END, CASE WHEN used + cost <= 1500 THEN picked || CASE WHEN picked = '' THEN '' ELSE ',' END || doc ELSE picked END FROM f JOIN it ON it.query = f.query AND it.rank = f.rank + 1)"
    " SELECT query, used, picked FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank DESC) = 1"
)
def budget_pack(tb):
    """Twelve best documents by query packed into 1,500 word counts; what doesn't fit is skipped."""
    ascii_words = F.regexp_count(F.col("text"), F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")).cast("long")
    top = R.top_k(bm25_scores(tb), 12).select("query", F.col("rank").alias("position"), F.col("doc").alias("item"))
    cost = tb.documents.select(F.col("doc_id").alias("item"), ascii_words.alias("cost"))
    return R.pack(top.join(cost, "item"), 1500, 24).select("query", "used", F.array_join("picked", ",").alias("picked"))


@query(f"SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains({SQUEEZE_SQL.format('d.text')}, {SQUEEZE_SQL.format('b.text')})")
def quote_provenance(tb):
    return R.containment(tb.documents, tb.benchmark)


@query(f"WITH q AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS said, text FROM benchmark) SELECT doc_id, item_id FROM documents d JOIN q ON said = sha256(q.text) AND contains({SQUEEZE_SQL.format('d.text')}, {SQUEEZE_SQL.format('q.text')})")
def validated_provenance(tb):
    """Quotes whose stated hash isn't their text's give no provenance."""
    q = tb.benchmark.withColumn("said", F.when(F.col("item_id") % 3 == 0, T.sha256(F.concat("text", F.lit("!")))).otherwise(T.sha256(F.col("text"))))
    return R.containment(tb.documents, q.where(F.col("said") == T.sha256(F.col("text"))).select("item_id", "text"))


@query("WITH l AS (SELECT item_id, list_filter(string_split(text, chr(10)), lambda s: length(trim(s)) > 0) AS ls FROM benchmark), r AS (SELECT item_id, unnest(range(1, len(ls) + 1)) AS \"row\", ls FROM l) SELECT 'T' || item_id || '#r' || \"row\" AS chunk_id, item_id, \"row\"::INTEGER AS \"row\", 'item ' || item_id || chr(10) || ls[\"row\"] AS text FROM r")
def split_table_rows(tb):
    x = tb.benchmark.select("item_id", F.explode(T.table_rows(F.concat(F.lit("item "), F.col("item_id").cast("string")), F.col("text"))).alias("r"))
    return x.select(F.concat(F.lit("T"), F.col("item_id").cast("string"), F.lit("#r"), F.col("r.row").cast("string")).alias("chunk_id"), "item_id", "r.row", "r.text")


@query("WITH l AS (SELECT item_id, list_filter(string_split(text, chr(10)), lambda s: length(trim(s)) > 0) AS ls FROM benchmark), r AS (SELECT item_id, unnest(range(1, len(ls) + 1)) AS \"row\", ls FROM l), p AS (SELECT item_id, item_id % 3 + 1 AS row_index FROM benchmark) SELECT p.item_id, CASE WHEN r.\"row\" IS NULL THEN 'T' || p.item_id ELSE 'T' || p.item_id || '#r' || r.\"row\" END AS chunk_id, CASE WHEN r.\"row\" IS NULL THEN 'table' ELSE 'row' END AS level FROM p LEFT JOIN r ON r.item_id = p.item_id AND r.\"row\" = row_index - 1")
def row_provenance(tb):
    """A row index counts the header as 1; what names no row falls back to the table."""
    rows = tb.benchmark.select(F.col("item_id").alias("i"), F.explode(T.table_rows(F.lit("t"), F.col("text"))).alias("r")).select("i", "r.row")
    p = tb.benchmark.select("item_id", (F.col("item_id") % 3 + 1).alias("row_index"))
    j = p.join(rows, (F.col("i") == F.col("item_id")) & (F.col("row") == F.col("row_index") - 1), "left")
    own = F.concat(F.lit("T"), F.col("item_id").cast("string"))
    return j.select("item_id", F.when(F.col("row").isNull(), own).otherwise(F.concat(own, F.lit("#r"), F.col("row").cast("string"))).alias("chunk_id"), F.when(F.col("row").isNull(), "table").otherwise("row").alias("level"))


@query(f"WITH {BM25_SQL}, sel AS (SELECT query, doc AS item FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm) WHERE rank <= 5), req AS (SELECT item_id AS query, doc_id AS item FROM documents d JOIN benchmark b ON contains({SQUEEZE_SQL.format('d.text')}, {SQUEEZE_SQL.format('b.text')})), g AS (SELECT req.query, count(sel.item) AS hits, count(*) AS needed FROM req LEFT JOIN sel ON sel.query = req.query AND sel.item = req.item GROUP BY req.query) SELECT coalesce(CAST(query % 4 AS VARCHAR), 'all') AS track, sum(hits)::BIGINT AS hits, sum(needed)::BIGINT AS needed, round(sum(hits) / sum(needed), 6) AS micro, round(avg(hits / needed), 6) AS macro, count(*) FILTER (hits = needed) AS complete FROM g GROUP BY GROUPING SETS ((query % 4), ())")
def retrieval_recall(tb):
    sel = R.top_k(bm25_scores(tb), 5).select("query", F.col("doc").alias("item"))
    req = R.containment(tb.documents, tb.benchmark).select(F.col("item_id").alias("query"), F.col("doc_id").alias("item"))
    g = R.recall(sel, req).withColumn("track", (F.col("query") % 4).cast("string"))
    out = g.rollup("track").agg(F.sum("hits").alias("hits"), F.sum("needed").alias("needed"), F.round(F.sum("hits") / F.sum("needed"), 6).alias("micro"), F.round(F.avg(F.col("hits") / F.col("needed")), 6).alias("macro"), F.count_if("complete").alias("complete"))
    return out.withColumn("track", F.coalesce("track", F.lit("all")))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs, len(regexp_extract_all(html, '<li>'))::BIGINT AS list_items, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def page_structure(tb):
    return tb.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("list_items"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("SELECT doc_id, unnest(list_transform(range(0, greatest(1, ceil((length(text) - 200) / 800.0)::INT)), lambda i: i * 800))::INTEGER AS start FROM documents WHERE lang = 'en'")
def fixed_chunks(tb):
    return tb.documents.where("lang = 'en'").select("doc_id", F.explode(T.chunks(F.col("text"))).alias("c")).select("doc_id", "c.start")


@query("SELECT doc_id, unnest(list_transform(range(0, greatest(1, ceil((length(text) - 200) / 800.0)::INT)), lambda i: i * 800))::INTEGER AS start FROM documents")
def fixed_chunks_all(tb):
    """fixed_chunks in every language, and none."""
    return tb.documents.select("doc_id", F.explode(T.chunks(F.col("text"))).alias("c")).select("doc_id", "c.start")


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_sha256, length(text) AS n, source || ' | ' || lang || chr(10) || substring(text, 1, 40) AS embedding_text FROM documents")
def scalar_text(tb):
    return tb.documents.select("doc_id", T.sha256(T.squeeze(F.col("text"))).alias("text_sha256"), F.length("text").cast("long").alias("n"), T.embedding_text(F.col("source"), F.col("lang"), F.substring("text", 1, 40)).alias("embedding_text"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_sha256, length(text) AS n, sha256(source || ' | ' || lang || chr(10) || text) AS embedding_sha256 FROM documents")
def scalar_text_all(tb):
    """scalar_text with the hash of the embedding text of the whole text."""
    return tb.documents.select("doc_id", T.sha256(T.squeeze(F.col("text"))).alias("text_sha256"), F.length("text").cast("long").alias("n"), T.sha256(T.embedding_text(F.col("source"), F.col("lang"), F.col("text"))).alias("embedding_sha256"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings")
def normalized_vectors(tb):
    e = F.col("embedding")
    return tb.embeddings.select("vec_id", F.round(F.sqrt(T.dot(e, e)), 5).alias("norm"), F.round(T.normalized(e)[0], 5).alias("first"))


@query("SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(text || ' [doc:' || (turn % 3) || '] [doc:1]', '\\[([A-Za-z0-9:_#-]+)\\]', 1))) = ['doc:1'] AS ok, array_to_string(list_filter(list_sort(list_distinct(regexp_extract_all(text || ' [doc:' || (turn % 3) || '] [doc:1]', '\\[([A-Za-z0-9:_#-]+)\\]', 1))), lambda x: x <> 'doc:1'), ',') AS unknown FROM conversations".replace("\\\\", "\\"))
def citation_check(tb):
    """Cited ids that weren't selected."""
    cited = T.cited_ids(F.concat("text", F.lit(" [doc:"), (F.col("turn") % 3).cast("string"), F.lit("] [doc:1]")))
    unknown = F.array_except(cited, F.array(F.lit("doc:1")))
    return tb.conversations.select("conv_id", "turn", (cited == F.array(F.lit("doc:1"))).alias("ok"), F.array_join(unknown, ",").alias("unknown"))


@query("WITH u AS (SELECT 'doc:' || doc_id AS id, 'chunk' AS kind, substring(text, 1, 80) AS text FROM documents UNION ALL SELECT 'item:' || item_id, 'quote', substring(text, 1, 80) FROM benchmark UNION ALL SELECT 'conv:' || conv_id || ':' || turn, 'turn', substring(text, 1, 80) FROM conversations) SELECT id, kind, length(text) AS n FROM u")
def evidence_universe(tb):
    parts = [tb.documents.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.lit("chunk").alias("kind"), F.substring("text", 1, 80).alias("text")), tb.benchmark.select(F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("id"), F.lit("quote").alias("kind"), F.substring("text", 1, 80).alias("text")), tb.conversations.select(F.concat_ws(":", F.lit("conv"), "conv_id", "turn").alias("id"), F.lit("turn").alias("kind"), F.substring("text", 1, 80).alias("text"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "kind", F.length("text").cast("long").alias("n"))


@query("WITH u AS (SELECT 'doc:' || doc_id AS id, 'chunk' AS kind, text FROM documents UNION ALL SELECT 'item:' || item_id, 'quote', text FROM benchmark UNION ALL SELECT 'conv:' || conv_id || ':' || turn, 'turn', text FROM conversations) SELECT id, kind, length(text) AS n, sha256(text) AS text_sha256 FROM u")
def evidence_universe_all(tb):
    """Units of the whole text, by length and hash."""
    parts = [tb.documents.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.lit("chunk").alias("kind"), "text"), tb.benchmark.select(F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("id"), F.lit("quote").alias("kind"), "text"), tb.conversations.select(F.concat_ws(":", F.lit("conv"), "conv_id", "turn").alias("id"), F.lit("turn").alias("kind"), "text")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "kind", F.length("text").cast("long").alias("n"), T.sha256(F.col("text")).alias("text_sha256"))


@query("WITH m AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY text) AS n FROM documents) SELECT doc_id, k AS copy, n AS copies FROM m WHERE n > 1")
def duplicate_texts(tb):
    """Chunk texts that stand under several ids, found by hash."""
    h = tb.documents.select("doc_id", T.sha256(F.col("text")).alias("h"))
    w = W.partitionBy("h")
    return h.withColumns({"copy": F.row_number().over(w.orderBy("doc_id")).cast("long"), "copies": F.count("*").over(w)}).where("copies > 1").drop("h")


@query("SELECT lang || '::' || doc_id % 4 AS uid, doc_id FROM documents WHERE doc_id < 0 UNION ALL SELECT CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '::part-' || row_number() OVER (PARTITION BY name ORDER BY doc_id) ELSE name END, doc_id FROM (SELECT doc_id, source || '-' || (doc_id % 7) AS name FROM documents)")
def namespaced_ids(tb):
    from ..operators.rules import numbered_ids

    d = tb.documents.select("doc_id", F.concat(F.col("source"), F.lit("-"), (F.col("doc_id") % 7).cast("string")).alias("name"))
    return numbered_ids(d, "name", "doc_id").select("uid", "doc_id")
