import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import katz


def tokens(text):
    low = re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode())
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", low) if w] + [None]


class Plain:
    """The model by dictionaries and recursion."""

    def __init__(self, docs, order, kmax=5):
        self.order = order
        self.c = [None, *(Counter() for _ in range(order))]
        self.after = [None, *(defaultdict(set) for _ in range(order))]
        for w in docs:
            s = ["<s>"] * (order - 1) + w
            for i in range(order - 1, len(s)):
                for k in range(1, order + 1):
                    g = tuple(s[i - k + 1 : i + 1])
                    self.c[k][g] += 1
                    self.after[k][g[:-1]].add(g[-1])
        self.n, self.v = sum(self.c[1].values()), len(self.c[1])
        self.off = [None]
        for k in range(1, order + 1):
            n = Counter(self.c[k].values())
            last = (kmax + 1) * n[kmax + 1] / n[1] if n[1] else 1
            off = [0.0] + [0.5] * kmax
            for r in range(1, kmax + 1):
                if n[1] and n[r] and last < 1:
                    d = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last)
                    off[r] = r * (1 - d) if 0 < d < 1 else 0.5
            self.off.append(off)
        left = self.n - sum(self.d(1, x) for x in self.c[1].values())
        self.whole = self.n if left > 1e-9 else self.n + 1
        self.unseen = 1 - (self.n - left) / self.whole if self.n else 1.0
        self.memo = {}

    def d(self, k, x):
        return x - (self.off[k][x] if x < len(self.off[k]) else 0)

    def p(self, g):
        k = len(g)
        if k == 1:
            return self.d(1, self.c[1][g]) / self.whole if self.c[1][g] else self.unseen
        h = g[:-1]
        seen = self.after[k].get(h)
        if not seen:
            return self.p(g[1:])
        if h not in self.memo:
            n = sum(self.c[k][(*h, w)] for w in seen)
            kept = sum(self.d(k, self.c[k][(*h, w)]) for w in seen)
            whole = n if n - kept > 1e-9 else n + 1
            self.memo[h] = whole, (1 - kept / whole) / (1 - sum(self.p((*h[1:], w)) for w in seen))
        whole, alpha = self.memo[h]
        return self.d(k, self.c[k][g]) / whole if self.c[k][g] else alpha * self.p(g[1:])

    def score(self, w):
        s = ["<s>"] * (self.order - 1) + w
        return sum(math.log10(self.p(tuple(s[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(s)))


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


@pytest.mark.parametrize("order,options", [(2, {}), (2, {"chunk_bytes": 20_000, "bucket_rows": 900, "hot": 40}), (3, {"chunk_bytes": 20_000, "bucket_rows": 2_000, "hot": 40})])
def test_equals_the_plain_model(sample, order, options):
    rows = [(r.doc_id, tokens(r.text)) for r in sample.collect()]
    m = Plain([w for d, w in rows if not held(d)], order)
    got = {r.doc_id: r for r in katz.score(sample, order=order, **options).collect()}
    assert len(got) == len(rows)
    for d, w in rows:
        r = got[d]
        known = sum(m.c[1][(x,)] > 0 for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(w), known, m.n)
        base = sum(math.log10((m.c[1][(x,)] + 0.1) / (m.n + 0.1 * (m.v + 1))) for x in w)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, m.score(w), rel_tol=1e-9)


def test_every_context_sums_to_one(sample):
    rows = [tokens(r.text) for r in sample.collect()][:60]
    m = Plain(rows, 3)
    vocabulary = [g[0] for g in m.c[1]]
    for h in [("<s>", "<s>"), ("<s>", rows[0][0]), tuple(rows[0][:2]), (b"never", b"seen")]:
        assert math.isclose(sum(m.p((*h, w)) for w in vocabulary) + m.p((*h, b"no such word")), 1, rel_tol=1e-9)


def test_better_than_the_base_on_held_out(sample):
    rows = [r for r in katz.score(sample).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_odd_rows(odd, clashing):
    rows = katz.score(odd).collect()
    assert len(rows) == 9 and all(np.isfinite([r.score, r.base_score]).all() for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 1
    assert by[None].held_out
    assert sorted(map(str, katz.score(clashing).collect())) == sorted(map(str, rows))


def test_nothing_to_learn_from(spark, none):
    assert katz.score(none).count() == 0
    one = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, h boolean")
    r = katz.score(one, held_out="h").first()
    assert (r.train_tokens, r.n_known, r.n_tokens, r.score, r.base_score) == (0, 0, 3, 0.0, 0.0)


def test_good_turing_falls_back():
    assert (katz.good_turing(np.array([0, 0, 3, 0, 0, 0, 0]), 5).less == 0.5).all()
    d = katz.good_turing(np.array([0, 100, 40, 20, 12, 8, 5]), 5)
    assert (d.less > 0).all() and (d.of(np.array([1, 7])) == [1 - d.less[0], 7]).all()


@pytest.mark.parametrize("order,options", [(2, {}), (3, {"bucket_rows": 1_200, "hot": 40}), (2, {"bucket_rows": 300, "hot": 20, "fan_in": 3})])
def test_new_texts_by_the_stored_model(sample, order, options):
    rows = sample.orderBy("doc_id").collect()
    cut = len(rows) // 2
    spark = sample.sparkSession
    learn, other = (spark.createDataFrame(part, sample.schema) for part in (rows[:cut], rows[cut:]))
    plain = Plain([tokens(r.text) for r in rows[:cut]], order)
    model = katz.fit(learn, order=order, chunk_bytes=15_000, **options)
    for _ in range(2):
        got = {r.doc_id: r for r in model.score(other, chunk_bytes=9_000).collect()}
        assert len(got) == len(rows) - cut
        for r in rows[cut:]:
            w = tokens(r.text)
            assert math.isclose(got[r.doc_id].score, plain.score(w), rel_tol=1e-9)
            assert (got[r.doc_id].n_known, got[r.doc_id].train_tokens) == (sum(plain.c[1][(x,)] > 0 for x in w), plain.n)
    model.drop()


@pytest.mark.parametrize("order", [2, 3])
def test_requests_through_a_tree(sample, order):
    rows = [(r.doc_id, tokens(r.text)) for r in sample.collect()]
    m = Plain([w for d, w in rows if not held(d)], order)
    got = {r.doc_id: r for r in katz.score(sample, order=order, chunk_bytes=6_000, bucket_rows=400, hot=30, fan_in=3).collect()}
    assert all(math.isclose(got[d].score, m.score(w), rel_tol=1e-9) for d, w in rows)


def test_a_chunk_asks_few_however_many_buckets(sample):
    """Blobs of a chunk stay bounded by fan_in while buckets grow with the input."""
    rows = sample.select("text").collect()
    docs = sample.sparkSession.createDataFrame([(i, False, (rows[i % len(rows)].text or "").encode()) for i in range(40)], "d long, h boolean, t binary").coalesce(1)
    chunk = katz._chunks(docs, 1 << 20).first()
    for n in (8, 64, 512, 4096):
        p = katz._Params(40, 5, n, n, 1, 10**9, 8, [], 0, 0, 0.0, 0.0)
        grain = 1
        while -(-n // grain) > p.fan_in:
            grain *= p.fan_in
        assert len(list(katz._requests(katz._Chunk(chunk), p, grain))) <= 8


def test_a_node_holds_about_a_chunk(sample, monkeypatch):
    """With few more buckets than fan_in, a node once merged a third of what fan_in chunks have (F1)."""
    merged, save = [], katz.Scratch.save

    def watched(self, df, name, *more):
        out = save(self, df, name, *more)
        if name == "katz-2-requests":
            rows = [(r.bucket, r.chunk, len(katz._unpacked(r.blob)["word"])) for r in out.where("bucket >= 0").collect()]
            of = {}
            for _, c, n in rows:
                of[c] = of.get(c, 0) + n
            merged.append((len({b for b, _, _ in rows}), len(of), max(of.values())))
        return out

    monkeypatch.setattr(katz.Scratch, "save", watched)
    katz.score(sample, chunk_bytes=6_000, bucket_rows=8_000, fan_in=6)
    ranges, chunks, _ = merged[0]
    assert chunks > 6 and ranges > 3
    for n_chunks, n_dests, fan_in in ((960, 1080, 512), (4800, 5400, 512), (513, 513, 512), (40_000, 45_000, 128), (80, 90, 9)):
        share, parts, n = 1.0, n_dests, n_chunks  # of a chunk, in a request
        for grain, nodes, finer in katz._levels(n_chunks, n_dests, fan_in):
            ranges = -(-parts // grain)
            assert ranges <= fan_in and -(-n // nodes) * share / ranges <= 1.0 + 1e-9
            share, parts, n = -(-n // nodes) * share / ranges, grain, nodes
        assert parts <= fan_in and finer == 1
