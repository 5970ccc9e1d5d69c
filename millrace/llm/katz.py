"""Katz backoff language model, fitted over chunks and buckets, stored by order and bucket.

Texts become chunks (rows of a bucketed table in the shared folder): hashes of the chunk's distinct
words, the words as indexes, and where documents end. For each order k, every chunk sends its distinct
k-grams once, with their training counts and grouped by context, to buckets of contexts. A bucket adds
the counts of all chunks: that is the model's table of order k, a row for each bucket, with contexts,
their continuations, counts and numbers, and each context's mass at order k - 1. It answers each chunk in
the order it asked. No token is ever shuffled by itself, only distinct k-grams of a chunk.

A context of more than `hot` counts is dealt by its continuation to as many buckets as its count needs.
Their sums over it are added once, in a table of hot contexts, which a chunk asks for those it has.

Where there are more than `fan_in` chunks, they don't ask all buckets: a chunk asks at most `fan_in`
ranges of buckets, a node merges what as many chunks as there are ranges ask of one of them, so about one
chunk's k-grams, splits it among at most fan_in parts of the range, and so on; answers come back the same
way. Requests grow with the n-grams, what a node holds doesn't.

`score` fits and evaluates in one pass. `fit` keeps the tables, and Model.score evaluates any texts by
them: their requests meet the stored rows of the buckets.

Probabilities. Counts up to `gt_max` are discounted by Good-Turing (Katz's form); where count-of-counts
don't give a discount in (0, 1], 0.5 is taken off instead. With D(c) the discounted count,

    P(w | h) = D(c(h w)) / N(h)                    if h w was seen,
               a(h) P(w | h')                      if only h was seen,
               P(w | h')                           else, h' being h without its first word,
    a(h)     = (1 - sum of seen P(w | h)) / (1 - sum of seen P(w | h')),

so every distribution sums to 1 exactly over the training words and one class of unseen words, which
has the unigrams' discounted mass. N(h) is h's count, one more where discounting takes nothing off.
The recursion runs from unigrams up, for all tokens of a chunk at a time.

Tokens are lower-cased words (A-Z only) and one end a text; contexts before a text's first word are
a start mark. Null texts are empty: the end alone. A row with null doc_id counts as crc32 0 (held
out). Repeated rows count each. Without training rows every token has the unseen class, which then
has probability 1. Words are known by 64-bit hashes, k-grams by exact numbers. Very long texts are a
chunk of their own; an empty table gives no rows; other columns of docs, whatever their names, are not
read. Ids are longs, or texts of one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, hash_words, local_words, mix64, pack, save, text_batches, unpack

_END = b"\n"  # no word holds a space, so this one is free


@dataclass
class Discounts:
    """D(c) for one order, and for unigrams the total and the distinct words."""

    less: np.ndarray  # taken off counts 1..gt_max

    def of(self, c: np.ndarray) -> np.ndarray:
        n = len(self.less)
        table = np.concatenate(([0.0], self.less))
        return c - np.where(c <= n, table[np.minimum(c, n).astype(np.int64)], 0.0)


def good_turing(counts: np.ndarray, gt_max: int) -> Discounts:
    """counts[r]: how many n-grams were seen r times, up to gt_max + 1 at least."""
    less = np.full(gt_max, 0.5)
    n = counts.astype(np.float64)
    if n[1] > 0:
        last = (gt_max + 1) * n[gt_max + 1] / n[1]
        for r in range(1, gt_max + 1):
            if n[r] > 0 and last < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last)
                if 0 < d < 1:
                    less[r - 1] = r * (1 - d)
    return Discounts(less)


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """docs(doc_id, held_out, text binary) as chunks."""
    schema = "chunk long, n_tokens long, n_words long, ids array<long>, missing array<boolean>, held array<boolean>, blob binary"

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for k, rows in enumerate(text_batches(batches, chunk_bytes)):
            texts = [(r[2] or b"").translate(LOWER) for r in rows]
            words, ids, lens = local_words(texts)
            hashes = hash_words([*words, _END])
            often = np.append(np.bincount(ids, minlength=len(words)), len(lens))
            # hashes are kept sorted, as differences; words are numbered by falling frequency, so
            # that most of the stream is small numbers
            order = np.argsort(hashes)
            by_count = _by_count(often[order])
            rank = np.empty(len(order), np.int32)
            rank[order[by_count]] = np.arange(len(order))
            stream = np.insert(rank[ids], np.cumsum(lens), rank[-1])
            blob = pack(words=np.diff(hashes[order], prepend=np.uint64(0)), often=often[order].astype(np.int32), stream=stream.astype(np.int32), lens=(lens + 1).astype(np.int32), end=np.array([rank[-1]], np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + k]), pa.array([len(stream)], pa.int64()), pa.array([len(order)], pa.int64()), pa.array([[r[0] or 0 for r in rows]], pa.list_(pa.int64())), pa.array([[r[0] is None for r in rows]], pa.list_(pa.bool_())), pa.array([[r[1] for r in rows]], pa.list_(pa.bool_())), pa.array([blob], pa.binary())],
                ["chunk", "n_tokens", "n_words", "ids", "missing", "held", "blob"],
            )

    return docs.mapInArrow(run, schema)


def _by_count(often: np.ndarray) -> np.ndarray:
    return np.argsort(-often, kind="stable")


class _Chunk:
    """A chunk's tokens with what the answers so far say."""

    def __init__(self, row):
        a = unpack(row["blob"])
        self.sorted = np.cumsum(a["words"], dtype=np.uint64)
        self.by_count = _by_count(a["often"])  # place among the sorted hashes of each word
        self.stream, self.lens, self.end = a["stream"], a["lens"].astype(np.int64), int(a["end"][0])
        self.starts = np.cumsum(self.lens) - self.lens
        self.train = np.repeat(~np.asarray(row["held"], bool), self.lens)
        self.nw = len(self.sorted)
        # of each order: place of every token's k-gram among the distinct ones, and their counts and numbers
        self.local = [self.stream.astype(np.int64)]
        self.counts: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []
        self.ctx: list = [None]
        self.word: list = [np.arange(self.nw)]
        self.lower: list = [None]
        self.backoff: list = [None]

    def unigram_request(self) -> tuple[np.ndarray, np.ndarray]:
        count = np.empty(self.nw, np.int64)
        count[self.by_count] = np.bincount(self.stream[self.train], minlength=self.nw)
        return self.sorted, count

    def grams(self):
        """Distinct k-grams of the next order: context (n for the start), word, training count, and
        the k-gram of the order below that lacks the first word."""
        below = self.local[-1]
        n = len(self.counts[-1])
        ctx = np.empty(len(below), np.int64)
        ctx[1:] = below[:-1]
        ctx[self.starts] = n
        if len(self.starts) and self.lens.sum() != len(below):
            raise ValueError("a chunk's lengths and tokens differ")
        pair = ctx * self.nw + self.stream
        pairs, first, inv = np.unique(pair, return_index=True, return_inverse=True)
        count = np.bincount(inv[self.train], minlength=len(pairs))
        return pairs // self.nw, pairs % self.nw, count, below[first], inv

    def context_totals(self, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of every context of the next order, the start last."""
        return np.append(self.numbers[-1], -1), np.append(self.counts[-1], docs)


def _bucket(no: np.ndarray, sub: np.ndarray, n_buckets: int) -> np.ndarray:
    # a context's parts lie side by side: n_buckets of them reach every bucket
    return ((mix64(no.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64) + sub) % n_buckets


class _Plan:
    """A chunk's distinct k-grams of its next order, in the order of asking: by bucket, then context. A
    context of more than `hot` counts is dealt to several buckets by the continuation."""

    def __init__(self, c: _Chunk, p: _Params):
        self.ctx, self.word, self.count, self.lower, self.inv = c.grams()
        self.nos, self.totals = c.context_totals(p.docs)
        parts = np.maximum(1, -(-self.totals // p.hot))
        self.hot = parts > 1
        own, words = parts[self.ctx], c.numbers[0][self.word]
        sub = np.where(own > 1, mix64(words.view(np.uint64)) % own.astype(np.uint64), np.uint64(0)).astype(np.int64)
        bucket = _bucket(self.nos[self.ctx], sub, p.n_buckets)
        self.order = np.lexsort((self.ctx, bucket))
        b, x = bucket[self.order], self.ctx[self.order]
        cut = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (x[1:] != x[:-1])))) if len(b) else np.empty(0, np.int64)
        self.asked, self.where = x[cut], b[cut]
        self.lens = np.diff(np.append(cut, len(b)))
        self.hot_asked = np.unique(self.ctx[self.hot[self.ctx]])
        self.hot_where = -1 - (mix64(self.nos[self.hot_asked].view(np.uint64)) % np.uint64(p.hot_buckets)).astype(np.int64)


def _slices(dest: np.ndarray):
    """(destination, range) of each run of equal destinations, which rise."""
    edges = np.flatnonzero(np.concatenate(([True], dest[1:] != dest[:-1], [True]))) if len(dest) else np.zeros(1, np.int64)
    return [(int(dest[i]), slice(int(i), int(j))) for i, j in zip(edges[:-1], edges[1:], strict=True)]


def _cut(ask: dict[str, np.ndarray], grain: int):
    """A request by destination (buckets // grain): (destination, request)."""
    if "keys" in ask:
        for d, s in _slices(ask["at"] // grain):
            yield d, ask | {"keys": ask["keys"][s], "count": ask["count"][s], "at": ask["at"][s]}
        return
    ends = np.cumsum(ask["lens"])
    for d, s in _slices(ask["at"] // grain):
        first = int(ends[s.start] - ask["lens"][s.start])
        rows = slice(first, int(ends[s.stop - 1]))
        yield d, {f: a[s] if f in _BY_CONTEXT else a[rows] if len(a) else a for f, a in ask.items()}


_BY_CONTEXT = ("ctx", "lens", "hot", "at")


def _packed(ask: dict[str, np.ndarray]) -> bytes:
    if "keys" in ask:
        return pack(keys=np.diff(ask["keys"], prepend=np.uint64(0)), count=ask["count"], at=np.diff(ask["at"], prepend=0).astype(np.int32))
    return pack(**ask | {"at": np.diff(ask["at"], prepend=0).astype(np.int32)})


def _unpacked(blob: bytes) -> dict[str, np.ndarray]:
    a = unpack(blob)
    a["at"] = np.cumsum(a["at"], dtype=np.int64)
    if "keys" in a:
        a["keys"] = np.cumsum(a["keys"], dtype=np.uint64)
    return a


def _requests(c: _Chunk, p: _Params, grain: int):
    """(destination, blob) of what a chunk asks at its next order; below 0, its hot contexts."""
    if not c.counts:
        keys, count = c.unigram_request()
        at = (keys // np.uint64(-(-(1 << 64) // p.word_buckets))).astype(np.int64) if p.word_buckets > 1 else np.zeros(len(keys), np.int64)
        ask = {"keys": keys, "count": count, "at": at}
    else:
        x = _Plan(c, p)
        o = x.order
        # what the probability one order below is made of: a count, and its context's N above unigrams
        low = np.where(x.count[o] > 0, c.counts[-1][x.lower[o]], 0)
        whole = c.backoff[-1][0][c.ctx[-1][x.lower[o]]] if len(c.counts) > 1 else np.empty(0)
        ask = {"ctx": x.nos[x.asked], "lens": x.lens.astype(np.int32), "hot": x.hot[x.asked].astype(np.uint8), "at": x.where, "word": c.numbers[0][x.word[o]], "count": x.count[o].astype(np.int64), "low": low.astype(np.int64), "whole": whole}
        by = np.argsort(x.hot_where, kind="stable")
        for d, s in _slices(x.hot_where[by]):
            yield d, pack(ctx=x.nos[x.hot_asked[by][s]])
    for d, part in _cut(ask, grain):
        yield d, _packed(part)


def _merge(asks: list[dict[str, np.ndarray]]) -> tuple[dict[str, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """One request for all, and for each of them where its k-grams and its contexts stand in that one."""
    if "keys" in asks[0]:
        keys, first, inv = np.unique(np.concatenate([a["keys"] for a in asks]), return_index=True, return_inverse=True)
        count = np.bincount(inv, np.concatenate([a["count"] for a in asks]), len(keys)).astype(np.int64)
        ends = np.cumsum([0, *[len(a["keys"]) for a in asks]])
        at = np.concatenate([a["at"] for a in asks])[first]
        return {"keys": keys, "count": count, "at": at}, [(inv[i:j], inv[:0]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    names, place = np.unique(np.concatenate([a["ctx"] for a in asks]), return_inverse=True)
    at = np.concatenate([a["at"] for a in asks])
    contexts, first, own = np.unique(at * max(1, len(names)) + place, return_index=True, return_inverse=True)
    words, word = np.unique(np.concatenate([a["word"] for a in asks]), return_inverse=True)
    lens = np.concatenate([a["lens"] for a in asks])
    n_words = max(1, len(words))
    pairs, lead, inv = np.unique(np.repeat(own, lens) * n_words + word, return_index=True, return_inverse=True)
    count = np.concatenate([a["count"] for a in asks])
    out = {"ctx": names[contexts % max(1, len(names))], "lens": np.bincount(pairs // n_words, minlength=len(contexts)).astype(np.int32), "hot": np.concatenate([a["hot"] for a in asks])[first], "at": contexts // max(1, len(names)), "word": words[pairs % n_words], "count": np.bincount(inv, count, len(pairs)).astype(np.int64)}
    for f in ("low", "whole"):
        every = np.concatenate([a[f] for a in asks])
        out[f] = np.zeros(len(pairs) if len(every) else 0, every.dtype)
        if len(every):
            out[f][inv[count > 0]] = every[count > 0]
    e, c = np.cumsum([0, *[len(a["word"]) for a in asks]]), np.cumsum([0, *[len(a["ctx"]) for a in asks]])
    return out, [(inv[e[k] : e[k + 1]], own[c[k] : c[k + 1]]) for k in range(len(asks))]


def _counted(ask: dict[str, np.ndarray], bucket: int, p: _Params, k: int, last: bool) -> tuple[dict, dict, np.ndarray, dict | None]:
    """Of one bucket's merged request: the answer to it, the model's row, the count-of-counts and the
    sums over parts of hot contexts."""
    top = p.gt_max
    total = ask["count"]
    seen = np.bincount(np.minimum(total, top + 2), minlength=top + 3)[: top + 2].astype(np.int64)
    kept = np.flatnonzero(total > 0)
    if k == 1:
        rank = np.empty(len(total), np.int64)
        rank[_by_count(total)] = np.arange(len(total))  # frequent words get small numbers
        row = {"keys": np.diff(ask["keys"][kept], prepend=np.uint64(0)), "total": total[kept]}
        return {"total": total, "number": (np.int64(bucket) << 34) + rank}, row, np.concatenate((seen, [total.sum(), len(kept)])), None
    n, of = len(ask["ctx"]), np.repeat(np.arange(len(ask["ctx"])), ask["lens"])
    below = p.discounts[k - 2].of(ask["low"]) / (ask["whole"] if len(ask["whole"]) else max(p.whole, 1.0)) if len(total) else np.empty(0)
    mass = np.bincount(of[kept], below[kept], n)
    few = _few(total, of, n, top)
    row = {"ctx": ask["ctx"], "lens": np.bincount(of[kept], minlength=n).astype(np.int32), "word": ask["word"][kept], "total": total[kept], "number": np.diff(kept, prepend=0).astype(np.int32), "mass": mass}
    hot = ask["hot"] > 0
    sums = {"ctx": ask["ctx"][hot], "mass": mass[hot], **{f: x[hot] for f, x in few.items()}} if hot.any() else None
    # of a hot context each part knows a part; its sums come from the table of hot contexts
    answer = {"total": total, "number": np.empty(0, np.int64) if last else (np.int64(bucket) << 34) + np.arange(len(total)), "mass": np.where(hot, 0.0, mass), **{f: np.where(hot, 0, x).astype(np.int32) for f, x in few.items()}}
    return answer, row, seen, sums


def _few(total: np.ndarray, of: np.ndarray, n: int, top: int) -> dict[str, np.ndarray]:
    """By context, how many continuations have each small count."""
    return {f"r{r}": np.bincount(of[total == r], minlength=n).astype(np.int32) for r in range(1, top + 1)}


def _looked_up(ask: dict[str, np.ndarray], row: dict[str, np.ndarray] | None, bucket: int, p: _Params, k: int) -> dict[str, np.ndarray]:
    """The answer to a bucket's merged request by the model's row. What the model lacks has count 0 and a
    number that nothing else has."""
    if k == 1:
        keys = np.cumsum(row["keys"], dtype=np.uint64) if row else np.empty(0, np.uint64)
        total, number = np.zeros(len(ask["keys"]), np.int64), np.full(len(ask["keys"]), -2, np.int64)
        if len(keys):
            rank = np.empty(len(keys), np.int64)
            rank[_by_count(row["total"])] = np.arange(len(keys))
            i = np.minimum(np.searchsorted(keys, ask["keys"]), len(keys) - 1)
            there = keys[i] == ask["keys"]
            total[there], number[there] = row["total"][i[there]], (np.int64(bucket) << 34) + rank[i[there]]
        return {"total": total, "number": number}
    n_pairs, n = len(ask["word"]), len(ask["ctx"])
    total, number, mass = np.zeros(n_pairs, np.int64), np.full(n_pairs, -2, np.int64), np.zeros(n)
    few = {f"r{r}": np.zeros(n, np.int32) for r in range(1, p.gt_max + 1)}
    if row and len(row["ctx"]):
        order = np.argsort(row["ctx"], kind="stable")
        names = row["ctx"][order]
        i = np.minimum(np.searchsorted(names, ask["ctx"]), len(names) - 1)
        known, place = names[i] == ask["ctx"], order[i]
        of = np.repeat(np.arange(len(names)), row["lens"])
        cold = known & (ask["hot"] == 0)
        mass[cold] = row["mass"][place[cold]]
        for f, x in _few(row["total"], of, len(names), p.gt_max).items():
            few[f][cold] = x[place[cold]]
        words, w = np.unique(np.concatenate((row["word"], ask["word"])), return_inverse=True)
        have = of * len(words) + w[: len(of)]
        by = np.argsort(have, kind="stable")
        mine = np.repeat(np.arange(n), ask["lens"])
        want = place[mine] * len(words) + w[len(of) :]
        if len(have):
            j = np.minimum(np.searchsorted(have[by], want), len(have) - 1)
            there = known[mine] & (have[by][j] == want)
            j = by[j[there]]
            total[there], number[there] = row["total"][j], (np.int64(bucket) << 34) + np.cumsum(row["number"], dtype=np.int64)[j]
    return {"total": total, "number": number, "mass": mass, **few}


def _part(answer: dict[str, np.ndarray], pairs: np.ndarray, contexts: np.ndarray) -> bytes:
    """What one of the merged requests is answered."""
    return pack(**{f: (a[pairs] if f in ("total", "number") else a[contexts]) if len(a) else a for f, a in answer.items()})


_TABLE = "what string, bucket long, chunk long, blob binary, seen array<long>"
_ASK = "bucket long, chunk long, blob binary"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _levels(n_chunks: int, n_dests: int, fan_in: int) -> list[tuple[int, int, int]]:
    """(grain, nodes, finer) of each level: requests to ranges of `grain` buckets are merged by `nodes` nodes
    a range and split into ranges of `finer`. A node merges as many as the ranges that each was split into."""
    out, n, whole = [], n_chunks, n_dests
    if n_chunks > fan_in:
        while whole > fan_in:
            grain = -(-whole // fan_in)
            nodes = -(-n // -(-whole // grain))
            out.append((grain, nodes, -(-grain // fan_in)))
            n, whole = nodes, grain
    return out


def _exchange(scratch: Scratch, requests: DataFrame, k: int, p: _Params, last: bool, plan: list[tuple[int, int, int]], stored: DataFrame | None) -> DataFrame:
    """The answered table of one order. Rows by what: answer (of a chunk), model, hot (sums of parts),
    ask (of hot contexts), counts."""
    levels, rows = [], requests
    for _, nodes, finer in plan:
        rows = scratch.save(rows, f"katz-{k}-requests").withColumn("node", F.pmod(F.xxhash64("chunk"), F.lit(nodes)))

        def up(key, pdf: pd.DataFrame, nodes=nodes, finer=finer) -> pd.DataFrame:
            pdf = pdf.sort_values("chunk")
            whole = _merge([_unpacked(x) for x in pdf["blob"]])[0]
            return _frame([(d, int(key[0]) * nodes + int(key[1]), _packed(part)) for d, part in _cut(whole, finer)], _ASK)

        merged = rows.where("bucket >= 0").groupBy("bucket", "node").applyInPandas(_by_key(up), _ASK)
        levels.append((rows, nodes))
        rows = merged.unionByName(rows.where("bucket < 0").drop("node"))

    def settle(key, pdf: pd.DataFrame, model: pd.DataFrame | None = None) -> pd.DataFrame:
        bucket = int(key[0])
        if not len(pdf):
            return _frame([], _TABLE)
        if bucket < 0:  # hot contexts: to be answered when all parts have been added up
            return _frame([("ask", bucket, int(c), b, None) for c, b in zip(pdf["chunk"], pdf["blob"], strict=True)], _TABLE)
        pdf = pdf.sort_values("chunk")
        ask, where = _merge([_unpacked(x) for x in pdf["blob"]])
        out = []
        if model is None:
            answer, row, seen, sums = _counted(ask, bucket, p, k, last)
            out = [("model", bucket, -1, pack(**row), None), ("counts", bucket, -1, None, seen)] + ([("hot", bucket, -1, pack(**sums), None)] if sums else [])
        else:
            answer = _looked_up(ask, unpack(model["blob"].iloc[0]) if len(model) else None, bucket, p, k)
        return _frame(out + [("answer", bucket, int(c), _part(answer, *w), None) for c, w in zip(pdf["chunk"], where, strict=True)], _TABLE)

    if stored is None:
        # as many partitions as buckets, so that a task's share doesn't grow with the input
        n_buckets = p.word_buckets if k == 1 else p.n_buckets
        table = rows.repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(_by_key(settle), _TABLE)
    else:
        table = rows.groupBy("bucket").cogroup(stored.groupBy("bucket")).applyInPandas(lambda key, a, b: settle(key, a, b), _TABLE)
    table = scratch.save(table, f"katz-{k}-grams", ("what",)).select(*[c.split()[0] for c in _TABLE.split(", ")])
    for rows, nodes in reversed(levels):

        def down(key, asked: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
            if not len(asked):
                return _frame([], _TABLE)
            asked = asked.sort_values("chunk")
            where = _merge([_unpacked(x) for x in asked["blob"]])[1]
            got = [unpack(x) for x in said.sort_values("bucket")["blob"]]
            answer = {f: np.concatenate([g[f] for g in got]) for f in got[0]}
            return _frame([("answer", int(key[0]), int(c), _part(answer, *w), None) for c, w in zip(asked["chunk"], where, strict=True)], _TABLE)

        answers = table.where("what = 'answer'").select(F.floor(F.col("chunk") / nodes).alias("dest"), F.pmod("chunk", F.lit(nodes)).alias("node"), "bucket", "blob")
        back = rows.where("bucket >= 0").groupBy("bucket", "node").cogroup(answers.groupBy("dest", "node")).applyInPandas(lambda key, a, b: down(key, a, b), _TABLE)  # noqa: B023
        table = table.where("what <> 'answer'").unionByName(scratch.save(back, f"katz-{k}-answers"))
    return table


def _hot_sums(scratch: Scratch, table: DataFrame, p: _Params, k: int) -> DataFrame:
    """(ctx, mass, few): each hot context's sums over its parts."""

    def rows(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                a = unpack(blob)
                few = np.stack([a[f"r{r}"] for r in range(1, p.gt_max + 1)], axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a["ctx"]), pa.array(a["mass"]), pa.array(few.tolist(), pa.list_(pa.int64()))], ["ctx", "mass", "few"])

    parts = table.where("what = 'hot'").select("blob").mapInArrow(rows, "ctx long, mass double, few array<long>")
    few = [F.sum(F.col("few")[r]).alias(f"r{r + 1}") for r in range(p.gt_max)]
    return scratch.save(parts.groupBy("ctx").agg(F.sum("mass").alias("mass"), *few), f"katz-{k}-hot")


def _hot_answers(table: DataFrame, sums: DataFrame, p: _Params) -> DataFrame:
    """Answers to what chunks ask of hot contexts, in buckets below 0."""

    def own(batches):
        for batch in batches:
            no = batch.column(0).to_numpy()
            at = -1 - (mix64(no.view(np.uint64)) % np.uint64(p.hot_buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], ["bucket", *batch.schema.names])

    schema = "bucket long, ctx long, mass double, " + ", ".join(f"r{r} long" for r in range(1, p.gt_max + 1))

    def run(key, asked: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        said = said.sort_values("ctx")
        names, out = said["ctx"].to_numpy(np.int64), []
        for chunk, blob in zip(asked["chunk"], asked["blob"], strict=True):
            ctx = unpack(blob)["ctx"]
            i = np.minimum(np.searchsorted(names, ctx), max(len(names) - 1, 0))
            there = names[i] == ctx if len(names) else np.zeros(len(ctx), bool)
            got = said.iloc[i[there]]
            out.append(("answer", int(key[0]), int(chunk), pack(ctx=ctx[there], mass=got["mass"].to_numpy(np.float64), **{f"r{r}": got[f"r{r}"].to_numpy(np.int32) for r in range(1, p.gt_max + 1)}), None))
        return _frame(out, _TABLE)

    return table.where("what = 'ask'").groupBy("bucket").cogroup(sums.mapInArrow(own, schema).groupBy("bucket")).applyInPandas(lambda key, a, b: run(key, a, b), _TABLE)


def _load(c: _Chunk, said: pd.DataFrame, upto: int, p: _Params) -> None:
    """Puts the answers of orders 1 to upto into the chunk."""
    for k in range(1, upto + 1):
        rows = said[said["k"] == k].sort_values("bucket")
        got = [unpack(x) for x in rows["blob"][rows["bucket"] >= 0]]
        joined = {f: np.concatenate([g[f] for g in got]) for f in got[0]}
        if k == 1:
            c.counts.append(joined["total"][c.by_count])
            c.numbers.append(joined["number"][c.by_count])
            continue
        x = _Plan(c, p)
        total, number = np.empty(len(x.ctx), np.int64), np.empty(len(x.ctx), np.int64)
        total[x.order] = joined["total"]
        if len(joined["number"]):
            number[x.order] = joined["number"]
        n = len(x.totals)
        few = [np.bincount(x.asked, joined[f"r{r + 1}"], n) for r in range(p.gt_max)]
        mass = np.bincount(x.asked, joined["mass"], n)
        by = np.argsort(x.nos, kind="stable")
        for hot in (unpack(b) for b in rows["blob"][rows["bucket"] < 0]):
            at = by[np.searchsorted(x.nos[by], hot["ctx"])]
            mass[at] = hot["mass"]
            for r in range(p.gt_max):
                few[r][at] = hot[f"r{r + 1}"]
        off = sum(d * f for d, f in zip(p.discounts[k - 1].less, few, strict=True))
        whole = np.where(off > 1e-9, x.totals, x.totals + 1).astype(np.float64)  # N(h)
        alpha = np.where(x.totals > 0, (1 - (x.totals - off) / np.maximum(whole, 1)) / np.maximum(1 - mass, 1e-12), 1.0)
        c.ctx.append(x.ctx)
        c.word.append(x.word)
        c.lower.append(x.lower)
        c.backoff.append((whole, alpha))
        c.local.append(x.inv)
        c.counts.append(total)
        c.numbers.append(number)


@dataclass
class _Params:
    docs: int  # training documents
    gt_max: int
    word_buckets: int
    n_buckets: int
    hot_buckets: int
    hot: int
    fan_in: int
    discounts: list[Discounts]
    total: int  # training tokens
    words: int  # distinct ones
    unseen: float  # probability of the class of unseen words
    whole: float  # N of unigrams


def _probabilities(c: _Chunk, upto: int, p: _Params) -> list[np.ndarray]:
    """By order, the probability of each distinct k-gram's last word after the others."""
    n1 = c.counts[0]
    probs = [np.where(n1 > 0, p.discounts[0].of(n1) / max(p.whole, 1), p.unseen)]
    for k in range(2, upto + 1):
        whole, alpha = c.backoff[k - 1]
        ctx, n = c.ctx[k - 1], c.counts[k - 1]
        probs.append(np.where(n > 0, p.discounts[k - 1].of(n) / np.maximum(whole[ctx], 1), alpha[ctx] * probs[-1][c.lower[k - 1]]))
    return probs


def _by_key(f):
    return lambda key, pdf: f(key, pdf)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _evaluated(c: _Chunk, row, order: int, p: _Params) -> pd.DataFrame:
    logs = np.log10(_probabilities(c, order, p)[-1])[c.local[order - 1]]
    n = c.counts[0][c.stream]
    base = np.log10((n + 0.1) / (p.total + 0.1 * (p.words + 1)))
    at = c.starts
    ids = pd.arrays.IntegerArray(np.asarray(row["ids"], np.int64), np.asarray(row["missing"], bool))
    known, sums = np.add.reduceat((n > 0).astype(np.int64), at), (np.add.reduceat(base, at), np.add.reduceat(logs, at))
    return pd.DataFrame({"doc_id": ids, "held_out": np.asarray(row["held"], bool), "n_tokens": c.lens, "n_known": known, "train_tokens": np.full(len(at), p.total), "base_score": sums[0], "score": sums[1]})


def _passes(scratch: Scratch, chunks: DataFrame, n_chunks: int, order: int, p: _Params, model: Model | None) -> tuple[DataFrame | None, dict[int, DataFrame], dict[int, DataFrame]]:
    """All orders' requests and answers: what chunks are told, and the tables of model and hot contexts.
    With a model its tables answer, else the chunks' own counts do, which sets p's discounts."""
    told, tables, hots = None, {}, {}
    for k in range(1, order + 1):
        plan = _levels(n_chunks, p.word_buckets if k == 1 else p.n_buckets, p.fan_in)
        grain = plan[0][0] if plan else 1

        def ask(row, said, k=k, grain=grain) -> list[tuple[int, int, bytes]]:
            c = _Chunk(row)
            if said is not None:
                _load(c, said, k - 1, p)
            return [(d, int(row["chunk"]), x) for d, x in _requests(c, p, grain)]

        def words(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    out = list(zip(*ask(row, None), strict=True))  # noqa: B023
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["bucket", "chunk", "blob"])

        if told is None:
            requests = chunks.mapInArrow(words, _ASK)
        else:
            requests = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(lambda key, a, b: _frame(ask(a.iloc[0], b), _ASK), _ASK)  # noqa: B023
        stored = None if model is None else model.tables[k]
        table = _exchange(scratch, requests, k, p, k == order, plan, stored)
        if model is None:
            n = table.where("what = 'counts'").select(F.posexplode("seen").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).orderBy("r").collect()
            seen = np.array([r.n for r in n], np.int64)
            p.discounts.append(good_turing(seen[: p.gt_max + 2], p.gt_max))
            if k == 1:
                p.total, p.words = int(seen[-2]), int(seen[-1])
                off = float(sum(p.discounts[0].less[r] * seen[r + 1] for r in range(p.gt_max)))
                p.whole = float(p.total) if off > 1e-9 else p.total + 1.0
                p.unseen = 1 - (p.total - off) / p.whole if p.total else 1.0
            tables[k] = table.where("what = 'model'").select("bucket", "blob")
        answers = table.where("what = 'answer'")
        if k > 1:
            hots[k] = _hot_sums(scratch, table, p, k) if model is None else model.hots[k]
            answers = answers.unionByName(scratch.save(_hot_answers(table, hots[k], p), f"katz-{k}-hot-answers"))
        answers = answers.select(F.lit(k).alias("k"), "bucket", "chunk", "blob")
        told = answers if told is None else told.unionByName(answers)
    return told, tables, hots


def _scored(scratch: Scratch, docs: DataFrame, text: str, doc_id: str, held, chunk_bytes: int, order: int, start, model: Model | None, keep: bool) -> tuple[DataFrame | None, Model | None]:
    """Scores of docs' rows, by the model or by one of their own; or (keep) that model alone."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = scratch.bucketed(_chunks(rows, chunk_bytes), "katz-chunks", "chunk", max(1, -(-size // chunk_bytes)))
    train = F.size(F.filter("held", lambda h: ~h))
    n_chunks, tokens, words, n_train = chunks.agg(F.count("*"), F.sum("n_tokens"), F.sum("n_words"), F.sum(train)).first()
    if not n_chunks:
        return docs.sparkSession.createDataFrame([], _SCORES), None
    p = model.params if model else start(tokens, words, n_train)
    # a chunk asks for each hot context that it has, so what is asked grows with chunks and with contexts
    p = replace(p, hot_buckets=max(1, -(-n_chunks * p.n_buckets // p.hot)))
    told, tables, hots = _passes(scratch, chunks, n_chunks, order, p, model)
    if keep:
        return None, Model(p, order, tables, hots, scratch)

    def evaluate(chunk: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        c = _Chunk(chunk.iloc[0])
        _load(c, said, order, p)
        return _evaluated(c, chunk.iloc[0], order, p)

    out = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(lambda key, a, b: evaluate(a, b), _SCORES)
    return save(out, "katz-scores"), None


@dataclass
class Model:
    """A fitted model: its tables (bucket, blob) and hot contexts by order, in the shared folder."""

    params: _Params
    order: int
    tables: dict[int, DataFrame]
    hots: dict[int, DataFrame]
    scratch: Scratch

    def score(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chunk_bytes: int = 12 << 20) -> DataFrame:
        """Columns of score() for any texts, none of which the model learns from (held_out is true)."""
        scratch = Scratch(docs.sparkSession)
        try:
            return _scored(scratch, docs, text, doc_id, F.lit(True), chunk_bytes, self.order, None, self, False)[0]
        finally:
            scratch.clear()

    def drop(self) -> None:
        """Removes the model's tables."""
        self.scratch.clear()


def _start(gt_max: int, bucket_rows: int, hot: int, fan_in: int):
    def at(tokens: int, words: int, n_train: int) -> _Params:
        # a hot context has more than `hot` counts, so that there are at most tokens / hot of them
        return _Params(n_train, gt_max, max(1, -(-words // bucket_rows)), max(1, -(-tokens // bucket_rows)), 1, hot, fan_in, [], 0, 0, 0.0, 0.0)

    return at


def _held(docs: DataFrame, doc_id: str, held_out: str):
    if held_out == "crc32":
        return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 10 == 0
    return F.coalesce(F.col(held_out), F.lit(True))


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = 2, gt_max: int = 5, held_out: str = "crc32", chunk_bytes: int = 12 << 20, bucket_rows: int = 1_500_000, hot: int = 200_000, fan_in: int = 512) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs,
    the model learning from rows that aren't held out. held_out: 'crc32' (of the id's decimal text,
    modulo 10, is 0) or a boolean column of docs."""
    scratch = Scratch(docs.sparkSession)
    try:
        return _scored(scratch, docs, text, doc_id, _held(docs, doc_id, held_out), chunk_bytes, order, _start(gt_max, bucket_rows, hot, fan_in), None, False)[0]
    finally:
        scratch.clear()


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = 2, gt_max: int = 5, chunk_bytes: int = 12 << 20, bucket_rows: int = 1_500_000, hot: int = 200_000, fan_in: int = 512) -> Model:
    """A model of all rows of docs. Its tables stay until Model.drop()."""
    scratch = Scratch(docs.sparkSession)
    model = _scored(scratch, docs, text, doc_id, F.lit(False), chunk_bytes, order, _start(gt_max, bucket_rows, hot, fan_in), None, True)[1]
    if model is None:
        raise ValueError("no rows to learn from")
    return model
