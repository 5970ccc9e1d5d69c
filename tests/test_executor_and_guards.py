"""Rule dispatch, the scanner against a plain state machine, and the guards of files and indexes."""

import hashlib
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import executor, series, stateful
from millrace.sources import tables


def plain_scan(samples, op, value, step, confirm=2, clear=2, duration=0, window=0):
    """One sample at a time, straight from the rule: what is held is what the text says."""
    events, event, quiet, good, begun, before, seg = [], None, 0, 0, None, None, {}
    for t, v in samples:
        gone = v is None or before is None or t - before != step
        if gone:
            if event:
                events.append({**event, "status": "data_gap_unconfirmed", "closed_at": before})
            event, quiet, good, begun, seg = None, 0, 0, None, {}
            if v is None:
                before = None
                continue
        seg[t] = v
        known = op != "delta_gt" or t - window in seg
        hold = known and (v - seg[t - window] > value if op == "delta_gt" else v > value if op == "gt" else v < value)
        begun = (t if begun is None else begun) if hold else None
        fits = hold and (duration == 0 or t - begun > duration)
        good = good + 1 if fits else 0
        if event is None and good >= confirm:
            event, quiet = {"condition_start": begun, "trigger_at": t, "last_positive_at": t, "positive_observations": confirm, "qualified_observations": confirm, "nonqualifying_observations": 0}, 0
        elif event is not None and hold:
            quiet = 0
            event |= {"last_positive_at": t, "positive_observations": event["positive_observations"] + 1, "qualified_observations": event["qualified_observations"] + fits}
        elif event is not None and known:
            quiet += 1
            event["nonqualifying_observations"] += 1
            if quiet >= clear:
                events.append({**event, "status": "recovered", "closed_at": t})
                event = None
        before = t
    if event:
        events.append({**event, "status": "open_at_data_end", "closed_at": None})
    return events


@pytest.mark.parametrize("seed", range(40))
def test_scanner_equals_the_plain_machine(seed):
    rnd = random.Random(seed)
    t, samples = 0, []
    for _ in range(rnd.randint(0, 150)):
        t += 10 if rnd.random() < 0.93 else 30
        samples.append((t, None if rnd.random() < 0.04 else float(rnd.randint(0, 10))))
    kw = {"confirm": rnd.randint(1, 3), "clear": rnd.randint(1, 3), "duration": rnd.choice([0, 0, 15, 30])}
    op, window = rnd.choice([("gt", 0), ("lt", 0), ("delta_gt", 20)])
    value = {"gt": 5.0, "lt": 4.0, "delta_gt": 1.0}[op]
    want = plain_scan(samples, op, value, 10, window=window, **kw)
    whole = stateful.Scanner(op, value, step=10, window=window, **kw)
    whole.run(np.array([s[0] for s in samples], np.int64), np.array([np.nan if s[1] is None else s[1] for s in samples], np.float64))
    whole.finish()
    pieces = stateful.Scanner(op, value, step=10, window=window, **kw)
    at = 0
    while at < len(samples):
        n = rnd.randint(1, 9)
        part, at = samples[at : at + n], at + n
        pieces.run(np.array([s[0] for s in part], np.int64), np.array([np.nan if s[1] is None else s[1] for s in part], np.float64))
    pieces.finish()
    for s in (whole, pieces):
        assert [{k: e[k] for k in want[0]} for e in s.out] == want if want else s.out == []


def test_chunks_break_at_the_last_space_of_the_second_half():
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "b", " ", "  ", "ccccc"]) for _ in range(rnd.randint(0, 300)))
        most, overlap = rnd.randint(10, 60), rnd.randint(0, 9)
        spans = stateful.chunk_text(text, most, overlap)
        for a, b in spans:
            assert 0 < b - a <= most and text[a:b].strip()
            if b < len(text):
                assert b == a + most or (text[b] == " " and b >= a + most // 2 and " " not in text[b + 1 : a + most])
        covered = {k for a, b in spans for k in range(a, b)}
        assert all(not text[k].strip() for k in range(len(text)) if k not in covered)
        assert all(n[0] in (max(p[0] + 1, p[1] - overlap), n[0]) and n[0] <= p[1] or not text[p[1] : n[0]].strip() for p, n in zip(spans, spans[1:], strict=False))


def test_alias_spans_equal_one_pattern_an_alias(spark):
    import re

    names = [("station", "S1", "ST01"), ("station", "S2", "error log"), ("station", "S3", "error"), ("type", "T1", "온도"), ("type", "T2", "on the"), ("type", "T3", "on"), ("type", "T4", "the end")]
    rnd = random.Random(3)
    texts = [(i, " ".join(rnd.choices(["ST01", "st01-x", "Error", "log", "온도센서", "on", "the", "end", "error", "ON THE END"], k=rnd.randint(0, 12)))) for i in range(80)]
    want = []
    for i, t in texts:
        for kind, node, alias in names:
            p = re.compile(rf"(?<![A-Za-z0-9_-]){re.escape(alias)}(?![A-Za-z0-9_])" if alias.isascii() else re.escape(alias), re.I)
            want += [(i, kind, node, alias, m.start(), m.end()) for m in p.finditer(t)]
    got = stateful.alias_spans(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(names, "kind string, node string, alias string"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_every_executor_has_alarms_and_unknown_ones_raise(spark):
    from millrace import plans

    rows = plans.queries()["executed_alarms"](spark, "/root/testdata/sf0.01").collect()
    assert {"kg_threshold_warning", "kg_threshold_critical", "sop002_stuck_std", "kg_maint_drift", "sop002_out_of_range", "kg_document_rule_partial"} <= {r.kind for r in rows}
    assert {"STUCK", "DRIFT"} <= {r.anomaly_type for r in plans.queries()["executed_types"](spark, "/root/testdata/sf0.01").collect()}
    assert all(r.flag == "precondition_unobserved" for r in rows if r.kind == "kg_document_rule_partial")
    bad = executor.normalise(spark.createDataFrame([("r", "e", "nonsense")], "rule_id string, entity string, executor string"))
    with pytest.raises(Exception, match="unknown executor nonsense"):
        bad.collect()


def test_slope_rule_without_calibration_is_silent(spark):
    s = series.with_segments(spark.createDataFrame([("a", 10 * k, float(k)) for k in range(30)], "entity string, t long, v double"), 10)
    rule = executor.normalise(spark.createDataFrame([("r", "k", "a", "slope", 0.1, 4, 2, 0.0)], "rule_id string, kind string, entity string, executor string, value double, window int, readings int, nominal double"))
    for sigma, n in (([("a", 1.0)], 1), ([("a", 0.0)], 0), ([], 0)):
        assert executor.execute(s, rule, spark.createDataFrame(sigma, "entity string, sigma double"), 10).count() == n


def test_raw_files_by_allowlist(spark, tmp_path):
    root = tmp_path / "raw"
    (root / "in").mkdir(parents=True)
    (root / "in" / "a.csv").write_bytes(b"x,y\n")
    (root / "b.csv").write_bytes(b"z" * 50)
    with zipfile.ZipFile(f"{root}.zip", "w") as z:
        z.writestr("in/c.csv", b"packed")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.path: (bytes(r.content), r.sha256) for r in tables.raw_files(spark, str(root), ["in/a.csv", "in/c.csv"], {"in/a.csv": sha(b"x,y\n")}).collect()}
    assert got == {"in/a.csv": (b"x,y\n", sha(b"x,y\n")), "in/c.csv": (b"packed", sha(b"packed"))}
    with pytest.raises(ValueError, match="not under"):
        tables.raw_files(spark, str(root), ["../b.csv"])
    with pytest.raises(Exception, match="too large"):
        tables.raw_files(spark, str(root), ["b.csv"], most=10).collect()
    with pytest.raises(Exception, match="changed"):
        tables.raw_files(spark, str(root), ["b.csv"], {"b.csv": sha(b"other")}).collect()


def test_index_is_read_only_as_sealed(spark):
    rows = [(i, f"t{i}", [float(i), 1.0], i % 3) for i in range(30)]
    index = spark.createDataFrame(rows, "id long, text string, v array<double>, part long")
    sealed = tables.index_manifest(index, ["id", "text"], "v", "part")
    assert tables.load_index(index, sealed, ["id", "text"], "v", "part").count() == 30
    for touched, what in ((index.withColumn("text", F.upper("text")), "corpus"), (index.withColumn("v", F.array(F.lit(0.0))), "vectors"), (index.where("id <> 4"), "corpus,vectors")):
        with pytest.raises(ValueError, match=what):
            tables.load_index(touched, sealed, ["id", "text"], "v", "part")


def test_repeated_fields(spark):
    texts = ['{"a":1,"a":2}', '{"a":{"b":1,"b":1}}', '[{"a":1},{"a":2}]', "{}", "no json", None, '{"a":[{"b":{"c":1}},{"b":{"c":2,"c":3}}]}']
    got = [r.repeated for r in tables.repeated_fields(spark.createDataFrame([(t,) for t in texts], "j string"), "j").collect()]
    assert got == [True, True, False, False, None, None, True]


def test_entry_registers_whole_tables_only():
    import __spark_entry__
    from millrace import plans

    names = set(__spark_entry__.queries())
    cut = {n.removesuffix("_all") for n in plans.queries() if n.endswith("_all") and n.removesuffix("_all") in plans.queries()}
    assert cut and not cut & names and {f"{n}_all" for n in cut} <= names


def test_promotion_issues_name_each_break(spark):
    from millrace.operators import proofs

    base = {"alarm_id": "a", "entity": "e", "trigger_at": 100, "run_start": 90, "trigger_value": 9.0, "monitored_by": "c1", "anchor": 50, "window_to": 150}
    breaks = [({}, ""), ({"monitored_by": "c9"}, "no_such_cause"), ({"monitored_by": "c2"}, "no_warning"), ({"anchor": 40, "window_to": 140}, "wrong_anchor"), ({"window_to": 160}, "wrong_window"), ({"trigger_value": 1.0}, "wrong_direction"), ({"trigger_at": 151}, "outside_window"), ({"source": "sig-x"}, "signal_not_reconstructed"), ({"monitored_by": "c3"}, "no_such_pair")]
    rows = []
    for i, (change, _) in enumerate(breaks):
        r = base | {k: v for k, v in change.items() if k != "source"} | {"alarm_id": f"a{i}"}
        h = hashlib.sha256("|".join(str(r[k]) for k in ("entity", "trigger_at", "run_start", "trigger_value")).encode()).hexdigest()
        rows.append((r["alarm_id"], r["entity"], change.get("source", "sig-" + h[:20]), r["trigger_at"], r["run_start"], r["trigger_value"], r["monitored_by"], r["anchor"], r["window_to"]))
    promoted = spark.createDataFrame(rows, "alarm_id string, entity string, source_signal string, trigger_at long, run_start long, trigger_value double, monitored_by string, anchor long, window_to long")
    causes = spark.createDataFrame([("c1", "k", 50), ("c2", "k", None), ("c3", "other", 50)], "cause_id string, cause string, first_warning long")
    pairs = spark.createDataFrame([("k", "e", 100, "above_nominal")], "cause string, effect string, within long, direction string")
    got = {r.alarm_id: r.issues for r in proofs.promotion_issues(promoted, causes, pairs, spark.createDataFrame([("e", 5.0)], "entity string, nominal double")).collect()}
    assert [got[f"a{i}"] for i in range(len(breaks))] == [w for _, w in breaks]


def test_slope_proof_needs_a_sigma_and_a_whole_window(spark):
    from millrace.operators import proofs

    s = series.with_segments(spark.createDataFrame([("a", 10 * k, 2.0 * k) for k in range(12)], "entity string, t long, v double"), 10)
    rule = executor.normalise(spark.createDataFrame([("r", "k", "a", "slope", 0.1, 4, 2, 0.0)], "rule_id string, kind string, entity string, executor string, value double, window int, readings int, nominal double"))
    claims = spark.createDataFrame([("first", "a", "r", 40), ("early", "a", "r", 20), ("late", "a", "r", 50), ("none", "a", "r", 999)], "alarm_id string, entity string, rule_id string, at long")
    got = {r.alarm_id: (r.state, r.reason) for r in proofs.window_proofs(s, claims, rule, spark.createDataFrame([("a", 1.0)], "entity string, sigma double"), 10).collect()}
    assert got == {"first": ("consistent", ""), "early": ("inconsistent", "incomplete contiguous feature window"), "late": ("inconsistent", "not the first confirmation"), "none": ("inconsistent", "no such sample or rule")}
    blind = proofs.window_proofs(s, claims.where("alarm_id = 'first'"), rule, spark.createDataFrame([("a", 0.0)], "entity string, sigma double"), 10).first()
    assert (blind.state, blind.reason) == ("unassessed", "positive verified sigma required")
