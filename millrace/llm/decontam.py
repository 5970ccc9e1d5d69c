"""Benchmark decontamination by suffix arrays over shards of the training documents.

Every Arrow batch of documents is a shard. Its words become a suffix array (sorted by the first
`width` words of each suffix); every suffix of every benchmark item is binary-searched in it. The
range found holds all places of that window in the shard; runs of places that advance together in
item and document are the longest verbatim matches. Suffixes whose first words are not all words of
the benchmark cannot match and are left out of the array, which is exact.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is `width`
consecutive words of an item; an item with fewer words, but not none, is one window. Null texts
have no words: such documents are kept, such items match nothing. Repeated item ids count as one
item; a null one is named by the empty text. An empty benchmark leaves every document clean, an empty
table gives no rows. Documents are never shuffled or cut, however long. Columns `keep` pass through;
those that scan() adds must not be among them, remove() takes any names.

Windows that the same items own share one list of owners. A document's items are the union of the lists
that it hits, each once, however often a window occurs in it or in items; places of matches are worked
out only where they are asked for.

The benchmark goes to the executors as broadcast blocks of at most `block_bytes` of text each, one
in memory at a time, so that its size isn't bounded by an executor's memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_batches

#: Bytes to words: A-Z become a-z, other ASCII characters than letters and digits become spaces.
_TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _block(items: list[tuple[str, bytes]], width: int) -> tuple[dict, list, dict, list]:
    """Part of the benchmark: its words' numbers, its items' names, its windows by length in words (keys,
    places, number of the list of owners), and these lists. Plain values, so that executors read it
    without this package."""
    ids: dict[bytes, int] = {}
    names: list[str] = []
    found: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = {}
    for name, text in items:
        w = [ids.setdefault(x, len(ids) + 1) for x in words(text)]
        if not w:
            continue
        n, k = min(width, len(w)), len(names)
        names.append(name)
        for i in range(len(w) - n + 1):
            found.setdefault(n, {}).setdefault(tuple(w[i : i + n]), []).append((k, i))
    alike: dict[frozenset[str], int] = {}
    out = {}
    for n, ws in found.items():
        lists = [alike.setdefault(frozenset(names[k] for k, _ in places), len(alike)) for places in ws.values()]
        out[n] = _keys(np.array(list(ws), np.int64).reshape(-1, n)), list(ws.values()), lists
    return ids, names, out, list(alike)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that compare as the rows do."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").reshape(-1)


def _search(stream: np.ndarray, windows: dict):
    """(words, place in stream, window) of every window's occurrences, by length. stream: word numbers, 0
    for words that the benchmark lacks and between documents."""
    known = np.concatenate(([0], np.cumsum(stream > 0)))
    for n, (keys, _, _) in windows.items():
        starts = np.flatnonzero(known[n:] - known[:-n] == n) if len(stream) >= n else np.empty(0, np.int64)
        if not len(starts):
            continue
        suffixes = _keys(stream[starts[:, None] + np.arange(n)])
        order = np.argsort(suffixes, kind="stable")  # the suffix array
        ranked = suffixes[order]
        lo, hi = np.searchsorted(ranked, keys, "left"), np.searchsorted(ranked, keys, "right")
        size = hi - lo
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield n, starts[order[np.repeat(lo, size) + step]], np.repeat(np.arange(len(keys)), size)


def _runs(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(begin, end) of the runs of overlapping or touching stretches (begin, words)."""
    out: list[list[int]] = []
    for p, n in sorted(places):
        if out and p <= out[-1][1]:
            out[-1][1] = max(out[-1][1], p + n)
        else:
            out.append([p, p + n])
    return [(a, b) for a, b in out]


def _scan(texts: list[bytes | None], blocks, width: int, with_matches: bool = True):
    """Per text: words, words hit, item names, longest matches as (item, place in item, place in text, words)."""
    docs = [words(t) for t in texts]
    lens = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate(([0], np.cumsum(lens + 1)))[:-1]  # one 0 after each
    cover = np.zeros(int((lens + 1).sum()) + 1, np.int64)
    names: dict[int, set[str]] = {}
    matches: dict[int, list] = {}
    for handle in blocks:
        ids, item_names, windows, lists = handle.value if hasattr(handle, "value") else handle
        get = ids.get
        stream = np.zeros(int((lens + 1).sum()), np.int32)
        for s, d in zip(starts, docs, strict=True):
            stream[s : s + len(d)] = [get(w, 0) for w in d]
        runs: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        owned: set[tuple[int, int]] = set()
        for n, at, which in _search(stream, windows):
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            of = np.searchsorted(starts, at, "right") - 1
            _, places, owners = windows[n]
            owned.update(zip(of.tolist(), np.array(owners, np.int64)[which].tolist(), strict=True))
            if with_matches:
                for k, p, w in zip(of.tolist(), at.tolist(), which.tolist(), strict=True):
                    for item, place in places[w]:
                        runs.setdefault((k, item, p - place), []).append((p, n))
        for k, owner in owned:
            names.setdefault(k, set()).update(lists[owner])
        for (k, item, shift), stretches in runs.items():
            matches.setdefault(k, []).extend((item_names[item], a - shift, a - int(starts[k]), b - a) for a, b in _runs(stretches))
        if len(blocks) > 1 and hasattr(handle, "_value"):
            del handle._value  # read again from the executor's disk when the next shard comes
    hit = np.cumsum(cover) > 0
    for k, d in enumerate(docs):
        yield len(d), int(hit[starts[k] : starts[k] + len(d)].sum()), names.get(k, set()), sorted(matches.get(k, []))


def _blocks(benchmark: DataFrame, item_id: str, text: str, width: int, block_bytes: int) -> list:
    """Broadcast blocks. The driver holds one block at a time."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).cast("binary").alias("t")).where(F.col("t").isNotNull())
    held, size, out = [], 0, []
    for r in rows.toLocalIterator():
        if held and size + len(r.t) > block_bytes:
            out.append(sc.broadcast(_block(held, width)))
            held, size = [], 0
        held.append((r.i, bytes(r.t)))
        size += len(r.t)
    if held:
        out.append(sc.broadcast(_block(held, width)))
    return out


SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, matches array<struct<item_id:string,item_start:long,doc_start:long,length:long>>"


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, block_bytes: int = 16 << 20, shard_bytes: int = 4 << 20, ratio: int = 20, keep: tuple[str, ...] = ("doc_id",), only: str | None = None, with_matches: bool = True) -> DataFrame:
    """Columns `keep` of docs with SCHEMA. contaminated: n_hit > 0 and ratio * n_hit >= n_words.
    only: 'clean' or 'contaminated' drops the other rows. Without with_matches, matches are empty."""
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item_id, item_text, width, block_bytes)
    fields = docs.select(*keep).schema
    out = fields
    for f in docs.sparkSession.createDataFrame([], SCHEMA).schema:
        out = out.add(f)

    def run(batches):
        for rows in text_batches(batches, shard_bytes):
            cols = [[] for _ in out]
            for row, (n, hit, items, matches) in zip(rows, _scan([r[-1] for r in rows], blocks, width, with_matches), strict=True):
                dirty = hit > 0 and ratio * hit >= n
                if only and dirty != (only == "contaminated"):
                    continue
                digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
                found = [dict(zip(("item_id", "item_start", "doc_start", "length"), m, strict=True)) for m in matches]
                for c, v in zip(cols, (*row[:-1], n, hit, len(items), digest, dirty, found), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    types, names = [to_arrow_type(f.dataType) for f in out], [f.name for f in out]
    return docs.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(run, out)


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns, in one pass."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(options.pop('text', 'text'))}"
    return scan(safe, benchmark, text=text, keep=tuple(safe.columns), only="clean", with_matches=False, **options).select(*safe.columns).toDF(*names)
