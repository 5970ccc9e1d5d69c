from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import graph, retrieval, rules, stateful


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("ST02_SEALING-CUR is 3.5"))) == ["st02_sealing-cur", "st02", "sealing", "cur", "is", "3.5"]
    assert one(spark, T.tokens(F.lit("센서에서는 값"))) == ["센서에서는", "센서", "값"]


def test_mentions_respect_boundaries(spark):
    for text, want in (("see ST01 now", True), ("see XST01", False), ("see ST01_A", False), ("a-ST01", False), ("ST01-2", True)):
        assert one(spark, T.mentions(F.lit(text), "ST01")) is want


def test_names(spark):
    assert one(spark, T.canonical_id(F.lit("doc::a::R1"))) == "R1"
    assert one(spark, T.short_name(F.lit("http://x/y#a%20b"))) == "a b"
    assert one(spark, T.station_of(F.lit("ST01_FILLING_TMP"))) == "ST01_FILLING"
    assert one(spark, T.plus_minus(F.lit("185 ± 10")))["hi"] == 195
    assert one(spark, T.finite_decimal(F.lit("3.30"))) == one(spark, T.finite_decimal(F.lit("3.3")))
    assert one(spark, T.finite_decimal(F.lit("NaN"))) is None
    assert one(spark, T.normalized(F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, T.row_text(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit(" ")))) == "a: 1"
    assert one(spark, T.content_id("x-", F.lit("a"), F.lit("bc"))) != one(spark, T.content_id("x-", F.lit("ab"), F.lit("c")))


def test_definitions(spark):
    p = one(spark, rules.type_parameters(F.lit("slope >0.1σ/min for 5+ readings; deviation >15 min")))
    assert (p["sigma_per_min"], p["readings"], p["window_min"]) == (0.1, 5, 15)
    p = one(spark, rules.type_parameters(F.lit("std(last 10)<0.001×nominal")))
    assert (p["window"], p["nominal_fraction"]) == (10, 0.001)
    assert one(spark, rules.correlation_effects(F.lit("ST01_FILL vibration increases with ST04_PACK speed"), F.lit("ST01_FILL_VIB"))) == ["ST04_PACK_SPD"]


def test_packing_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, 1, "a", 50), (1, 2, "b", 60), (1, 3, "c", 40)], "query long, position int, item string, cost long")
    r = retrieval.pack(df, 100, 10).first()
    assert (r.picked, r.skipped, r.used) == (["a", "c"], ["b"], 90)


def test_containment_equals_brute_force(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "a  quick\nbrown fox", "xquick brown foxy", "nothing", None, ""]
    quotes = ["quick brown fox", "fox", "the quick brown fox jumps over the lazy dog", "uick brown fox jum", "absent words here now ok then", ""]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in retrieval.containment(t, q).collect()}
    squeeze = lambda s: " ".join(s.split())
    want = {(i, j) for i, a in enumerate(texts) if a for j, b in enumerate(quotes) if b and squeeze(b) in squeeze(a)}
    assert got == want


def test_paths_and_bfs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "a string, b string")
    got = {r.path for r in graph.simple_paths(spark, e).collect()}
    assert got == {"a>b", "b>c", "c>a", "a>c", "a>b>c", "b>c>a", "c>a>b"}
    near = graph.bfs(e, spark.createDataFrame([("a",)], "node string"), 1)
    assert {(r.node, r.depth) for r in near.collect()} == {("a", 0), ("b", 1), ("c", 1)}


def test_paths_of_any_length(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(14)], "a string, b string")
    got = {(r.a, r.b): r.length for r in graph.simple_paths(spark, e).collect()}
    assert got == {(f"n{i}", f"n{j}"): j - i for i in range(15) for j in range(i + 1, 15)}


def test_constraints_name_their_violation_only(spark):
    t = spark.createDataFrame([("x", "st", "1"), ("x", "st", "2"), ("y", "st", "1"), ("y", "pri", "LOW"), ("z", "pri", "ODD")], "s string, p string, o string")
    nodes = spark.createDataFrame([("x",), ("y",)], "s string")
    assert [r.node for r in graph.exactly_one(t, nodes, "st", "S1").collect()] == ["x"]
    assert [r.node for r in graph.one_of(t, "pri", ["LOW"], "S2").collect()] == ["z"]
    assert [r.node for r in graph.required_if(t, "pri", "ODD", "st", "S3").collect()] == ["z"]


def feed(rows, **kw):
    s = stateful.Scanner("gt", 5.0, step=1, **kw)
    for t, v in rows:
        s.feed(t, v)
    s.finish()
    return [(e["trigger_at"], e["last_positive_at"], e["status"]) for e in s.out]


def test_scanner_confirms_and_clears():
    assert feed([(0, 9), (1, 1)]) == []
    assert feed([(0, 9), (1, 9), (2, 1), (3, 9), (4, 1), (5, 1)]) == [(1, 3, "recovered")]
    assert feed([(0, 9), (1, 9)]) == [(1, 1, "open_at_data_end")]
    assert feed([(0, 9), (1, 9), (3, 9)]) == [(1, 1, "data_gap_unconfirmed")]
    assert feed([(0, 9), (1, 9), (2, None), (3, 9), (4, 9)]) == [(1, 1, "data_gap_unconfirmed"), (4, 4, "open_at_data_end")]
    assert feed([(k, 9) for k in range(5)], duration=2) == [(4, 4, "open_at_data_end")]


def test_chunks_cover_the_text():
    text = "word " * 900
    spans = stateful.chunk_text(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= 1000 for a, b in spans)
    assert all(n[0] <= p[1] for p, n in zip(spans, spans[1:], strict=False))
    assert stateful.chunk_text("   ") == [] == stateful.chunk_text("")


def test_stream_equals_batch(spark, tmp_path):
    import random

    from millrace.streaming import scanner

    rnd = random.Random(5)
    rows, t = [], 0
    for _ in range(120):
        t += 10 if rnd.random() < 0.95 else 30
        rows.append(("s", t, float(rnd.randint(0, 10))))
    rule = spark.createDataFrame([("s", "r", "gt", 4.0, None, 0, 0), ("s", "d", "delta_gt", 3.0, None, 0, 20)], "entity string, rule_id string, op string, value double, second double, duration long, window long")
    schema = "entity string, t long, v double"
    batch = {tuple(r) for r in stateful.scan(spark.createDataFrame(rows, schema), rule, 10).where("status <> 'open_at_data_end'").collect()}
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 0:
            src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            q = scanner.scan_stream(src, rule, 10).writeStream.format("memory").queryName("closed").outputMode("append").start()
        q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("SELECT * FROM closed").collect()} == batch and batch
