"""Queries that SQL gives no answer for, against brute force on the smallest tables."""

from collections import defaultdict
from itertools import permutations

import numpy as np

from millrace import plans
from millrace.operators import evaluate, series
from millrace.plans import stateful as P
from millrace.plans.detection import H, found, gold
from millrace.plans.registry import Tables
from tests.test_executor_and_guards import plain_scan

SF = "/root/testdata/sf0.001"


def test_two_point_scanner(spark):
    tb = Tables(spark, SF)
    samples = defaultdict(list)
    for r in series.grid(tb.events, H).orderBy("t").collect():
        samples[r.entity].append((r.t, r.v))
    want = []
    for entity, rule, op, value, second, duration, window in P.RULES:
        s = samples[entity]
        if op == "outside":  # outside a band is above the second value, or below the first: a distance
            s = [(t, max(value - v, v - second)) for t, v in s]
            op, value = "gt", 0.0
        want += [(entity, rule, *(e[k] for k in ("condition_start", "trigger_at", "last_positive_at", "closed_at", "status", "positive_observations", "qualified_observations", "nonqualifying_observations"))) for e in plain_scan(s, op, value, H, duration=duration, window=window)]
    got = [tuple(r)[:10] for r in plans.queries()["two_point_scanner"](spark, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 5


def test_bipartite_match_is_a_maximum_matching(spark):
    tb = Tables(spark, SF)
    edges = defaultdict(set)
    for r in evaluate.event_hits(gold(tb), found(tb), H).select("entity", "found_id", "gold_id").collect():
        edges[r.found_id].add(r.gold_id)
    rows = plans.queries()["bipartite_match"](spark, SF).collect()
    left, right = {r.found_id: r.gold_id for r in rows}, {r.gold_id: r.found_id for r in rows}
    assert len(left) == len(right) == len(rows) and all(r.gold_id in edges[r.found_id] for r in rows)

    def grows(f, seen):  # a path of changes that would match one more
        for g in edges[f] - seen:
            seen.add(g)
            if g not in right or grows(right[g], seen):
                return True
        return False

    assert rows and not any(grows(f, set()) for f in edges if f not in left)


def test_assignment_match_is_the_best_of_all(spark):
    rows = Tables(spark, SF).embeddings.collect()
    unit = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(r.embedding) for r in rows}
    by = defaultdict(lambda: ([], []))
    for r in rows:
        by[r.label][r.vec_id % 2].append(r.vec_id)
    got = defaultdict(list)
    for r in plans.queries()["assignment_match"](spark, SF).collect():
        got[r.doc].append((r.a, r.b))
        assert r.score >= 0.2
    assert got
    for label, (evens, odds) in by.items():
        ok = {(a, b): float(unit[a] @ unit[b]) for a in evens for b in odds if unit[a] @ unit[b] >= 0.2}
        pairs = got[label]
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs) and all(p in ok for p in pairs)
        # no exchange of up to three pairs gives more pairs, or as many with a larger sum
        used_a, used_b = {a for a, _ in pairs}, {b for _, b in pairs}
        assert not any(a not in used_a and b not in used_b for a, b in ok)
        for k in range(2, 4):
            for chosen in permutations(pairs, k):
                turned = [(chosen[i][0], chosen[(i + 1) % k][1]) for i in range(k)]
                if all(p in ok for p in turned):
                    assert sum(ok[p] for p in turned) <= sum(ok[p] for p in chosen) + 1e-9


def test_assignments_equal_all_permutations(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for key in range(30):
        n, m = rng.integers(1, 5, 2)
        s = np.round(rng.uniform(0, 1, (n, m)), 3)
        rows += [(key, int(i), int(j), float(s[i, j])) for i in range(n) for j in range(m)]
        best = (0, 0.0)
        side = s if n <= m else s.T
        for p in permutations(range(side.shape[1]), side.shape[0]):
            hits = [side[i, j] for i, j in enumerate(p) if side[i, j] >= 0.5]
            best = max(best, (len(hits), round(float(sum(hits)), 6)))
        want[key] = best
    got = defaultdict(lambda: (0, 0.0))
    for r in evaluate.assign(spark.createDataFrame(rows, "doc long, a long, b long, score double"), 0.5).collect():
        got[r.doc] = (got[r.doc][0] + 1, round(got[r.doc][1] + r.score, 6))
    assert {k: got[k] for k in want} == want


def test_text_chunks(spark):
    texts = {r.doc_id: r.text for r in Tables(spark, SF).documents.collect()}
    want = []
    for d, t in texts.items():
        at, n = 0, 0
        while t and at < len(t):
            end = min(len(t), at + 1000)
            if end < len(t):
                while end > at + 500 and t[end - 1] != " ":  # back to the last space, no further than half
                    end -= 1
                end = end - 1 if t[end - 1] == " " and end - 1 >= at + 500 else at + 1000
            n += 1
            if t[at:end].strip():
                want.append((d, n, at, end))
            if end == len(t):
                break
            at = max(at + 1, end - 200)
    got = {(r.id, r.start, r.end) for r in plans.queries()["text_chunks"](spark, SF).collect()}
    assert got == {(d, a, b) for d, _, a, b in want} and len(got) > len(texts)


def test_entity_links(spark):
    import re

    rows = Tables(spark, SF).conversations.collect()
    want = set()
    for r in rows:
        t = "error log temperature, click current: " + (r.text or "") if r.text is not None else None
        if t is None:
            continue
        kept = []
        for kind in ("station", "type"):
            spans = sorted({(m.start(), m.end(), node, alias) for k, node, alias in P._LEXICON if k == kind for m in re.finditer(rf"(?<![A-Za-z0-9_-]){re.escape(alias)}(?![A-Za-z0-9_])", t, re.I)}, key=lambda s: (s[0] - s[1], s[0], s[2]))
            own = []
            for s in spans:
                if all(s[1] <= o[0] or s[0] >= o[1] for o in own):
                    own.append(s)
            kept += [(kind, s) for s in own]
        i = r.conv_id * 1000 + r.turn
        want |= {(i, s[2], s[3], s[0], s[1], k) for k, s in kept}
        stations = [s for k, s in kept if k == "station"]
        for k, s in kept:
            near = sorted((max(s[0] - o[1], o[0] - s[1], 0), o[0], o) for o in stations)
            if k == "type" and near and near[0][0] <= 14:
                o = near[0][2]
                want.add((i, f"{o[2]}_{s[2]}", f"{o[3]}+{s[3]}", min(s[0], o[0]), max(s[1], o[1]), "sensor"))
    got = {tuple(r) for r in plans.queries()["entity_links"](spark, SF).collect()}
    assert got == want and got
