"""Exact substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A window is `width` consecutive words of one document. The collection is its own reference, cut into
contiguous blocks of documents. A block is indexed by its anchors: of the short grams inside each
window the one with the smallest hash, so that equal windows have equal anchors wherever they stand.
Consecutive windows with one anchor are a group, some seven words further on the next. A directory of
anchors says which groups stand earlier elsewhere, and which anchors recur with other words around
them; nothing else is compared, so a document meets only blocks that share an anchor with it.

A document is then factored greedily from left to right. A factor is the longest run of windows that
advances with one source; where the groups around an anchor differ, as they do at the boundaries of a
passage, the windows that lie across them are looked up by themselves, so no window is missed there.
Factors have at least `width` words. Their words are sent to the block of their source and compared
there word by word; a difference (two hashes of 128 bits alike) raises an error. Words that a factor
covers are removed.

Windows are judged on the input. Rows that share a doc_id stand at the same place of the order, so
that neither is earlier than the other. A null doc_id comes before all others. Texts of fewer words
than a window, null and empty texts lose nothing; very long ones are a block of their own. An empty
table gives no rows; other columns of docs, whatever their names, are not read. Ids are longs, or
texts of one.

Scale. A block tells the directory each group and each window once, however often it repeats it, and
an anchor with several groups in one block once: a passage that millions of documents share costs one
row a block. Rows are as many as words at most, whatever the number of blocks; blocks stand in a
bucketed table, so that answers come to them and they are not shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACES, Scratch, hash_words, local_words, mix64, save, text_batches

_NULL = -(1 << 63)
#: Places within a block; an address is a block's number times this, plus a place in its words.
_PLACES = 1 << 28
_EVEN = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Sums:
    """Hashes of any run of words, from sums of words times powers of an odd number (mod 2^64)."""

    def __init__(self, words: np.ndarray, base: int):
        powers = np.full(len(words) + 1, np.uint64(base))
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers[:-1], dtype=np.uint64)))
        self.back = np.full(len(words) + 1, np.uint64(pow(base, -1, 1 << 64)))
        self.back[0] = 1
        self.back = np.multiply.accumulate(self.back)

    def of(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[at]) * self.back[at])


def _first_of(places: tuple[np.ndarray, ...], *keys: np.ndarray) -> np.ndarray:
    """For each row the row with its keys and the smallest place."""
    order = np.lexsort((*places[::-1], *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


#: Bytes of one row's part of a block. The JVM gives arrays of half a heap region or more a region of
#: their own, which it frees late; smaller rows keep its memory low.
_PIECE = 192 << 10
_SPACE = np.isin(np.arange(256), list(SPACES.encode()))


#: Spaces of all kinds to the plain one.
_FLAT = bytes(32 if _SPACE[b] else b for b in range(256))


class _Texts:
    """A block's texts and the places of their words."""

    def __init__(self, row):
        self.no = int(row["block"])
        sizes = np.asarray(row["sizes"], np.int64)
        ends = np.cumsum(sizes)
        raw = zstandard.ZstdDecompressor().decompress(bytes(row["blob"])) if ends[-1] else b""
        self.texts = [raw[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        # a word begins where no space stands after a space or at a text's first byte
        letter = ~_SPACE[np.frombuffer(raw, np.uint8)]
        begins = letter.copy()
        begins[1:] &= ~letter[:-1]
        first = (ends - sizes)[sizes > 0]
        begins[first] = letter[first]
        before = np.concatenate((np.zeros(1, np.int64), np.cumsum(begins, dtype=np.int64)))
        self.lens = before[ends] - before[ends - sizes]
        self.starts = np.cumsum(self.lens) - self.lens
        self._held: tuple[int, list[bytes]] = (-1, [])

    def words(self, d: int) -> list[bytes]:
        if self._held[0] != d:
            self._held = (d, self.texts[d].split())
        return self._held[1]

    def words_at(self, at: int, n: int) -> list[bytes] | None:
        """n words from a place in the block, if they lie in one document."""
        d = int(np.searchsorted(np.cumsum(self.lens), at, "right"))
        if d >= len(self.lens):
            return None
        k = at - int(self.starts[d])
        return self.words(d)[k : k + n] if k + n <= self.lens[d] else None


class _Block(_Texts):
    """A block with its windows in groups by anchor, and what it settles by itself."""

    def __init__(self, row, width: int):
        super().__init__(row)
        self.width = width
        self.ids, self.missing = np.asarray(row["ids"], np.int64), np.asarray(row["missing"], bool)
        distinct, ids, _ = local_words(self.texts)
        w = hash_words(distinct)[ids] if len(ids) else np.empty(0, np.uint64)
        doc = np.repeat(np.arange(len(self.lens)), self.lens)
        self.hashes = _Sums(w, _EVEN[0]), _Sums(mix64(w), _EVEN[1])
        n = len(w) - width + 1
        at = np.flatnonzero(doc[:n] == doc[width - 1 :]) if n > 0 else np.empty(0, np.int64)
        # the leftmost smallest gram of each window
        size = max(1, 2 * width // 5)
        grams = self.hashes[0].of(np.arange(len(w) - size + 1), np.arange(size, len(w) + 1)) if len(w) >= size else np.empty(0, np.uint64)
        n = max(n, 0)
        if (choices := width - size + 1) > 64:
            raise ValueError("windows of more than 100 words")
        # the gram's place in the window is kept in its last bits, so that the minimum names it
        low = np.uint64(63)
        least = grams[:n] & ~low
        for j in range(1, choices):
            np.minimum(least, (grams[j : j + n] & ~low) | np.uint64(j), out=least)
        anchor, least = (at + (least & low).astype(np.int64)[at], least[at] & ~low) if len(at) else (at, least[:0])
        cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[at[1:]] != doc[at[:-1]])))) if len(at) else np.empty(0, np.int64)
        self.at = at[cut]  # place of each group's first window
        self.n = np.diff(np.append(cut, len(at)))  # and its windows
        self.doc = doc[self.at] if len(at) else cut
        self.anchor = least[cut]
        end = self.at + self.n + width - 1
        shape = ((anchor[cut] - self.at) * (width + 1) + self.n).astype(np.uint64)
        self.group = mix64(self.hashes[1].of(self.at, end) + shape * np.uint64(_EVEN[0])) ^ self.hashes[0].of(self.at, end)
        self.first = _first_of(self.places(self.at, self.doc), self.group, self.anchor)
        lead = self.first == np.arange(len(self.at))
        # anchors that stand in several groups of this block
        names, inverse = np.unique(self.anchor, return_inverse=True)
        self.many = np.bincount(inverse[lead], minlength=len(names))[inverse] > 1
        self.lead = lead

    def places(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What orders occurrences: the document's id and the place in the document."""
        return self.ids[doc], at - self.starts[doc]

    def address(self, at: np.ndarray) -> np.ndarray:
        return self.no * _PLACES + at

    def of(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and documents of all windows of some groups."""
        n = self.n[groups]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(self.at[groups], n) + step, np.repeat(self.doc[groups], n)

    def windows(self, said_open: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the groups whose windows are looked up one by one (those at the places said_open, and
        those with `many`): place, document, hashes, and the row of each window's first occurrence."""
        open_ = np.flatnonzero(self.lead & (self.many | np.isin(self.at, said_open)))
        at, doc = self.of(open_)
        h = [s.of(at, at + self.width) for s in self.hashes]
        return at, doc, h[0], h[1], _first_of(self.places(at, doc), *h)

    def sources(self, said: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every place: the address of an earlier occurrence of the window there, or -1; its document
        and its start there. said: at, kind (0 of a group, 1 of a window, 2 of an open group), source."""
        size = int(self.lens.sum())
        out = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        where, kind = said["at"].to_numpy(np.int64), said["kind"].to_numpy(np.int64)
        far = [said[c].to_numpy(np.int64) for c in ("source", "source_doc", "source_start")]

        def put(at, doc, first, of_kind, n):
            """Rows of n windows take the source that is told of their first occurrence; those that stand
            later than it, and were told nothing, that occurrence itself."""
            rows = np.flatnonzero(kind == of_kind)
            rows = rows[np.argsort(where[rows])]
            i = np.searchsorted(where[rows], at[first])
            told = np.zeros(len(at), bool)
            if len(rows):
                i = np.minimum(i, len(rows) - 1)
                told = where[rows][i] == at[first]
            own, lead = self.places(at, doc), self.places(at[first], doc[first])
            source = [self.address(at[first]), *lead]
            if len(rows):
                source = [np.where(told, f[rows][i], x) for f, x in zip(far, source, strict=True)]
            use = np.flatnonzero(told | (own[0] != lead[0]) | (own[1] != lead[1]))
            step = np.arange(n[use].sum()) - np.repeat(np.cumsum(n[use]) - n[use], n[use])
            spot = np.repeat(at[use], n[use]) + step
            out[0][spot] = np.repeat(source[0][use], n[use]) + step
            out[1][spot] = np.repeat(source[1][use], n[use])
            out[2][spot] = np.repeat(source[2][use], n[use]) + step

        if len(self.at):
            put(self.at, self.doc, self.first, 0, self.n)
            at, doc, _, _, first = self.windows(where[kind == 2])
            put(at, doc, first, 1, np.ones(len(at), np.int64))
            # groups that stand at the very place of an open one, in a repeated row, share its windows
            is_open = self.lead & (self.many | np.isin(self.at, where[kind == 2]))
            tied = np.flatnonzero(~self.lead & is_open[self.first] & (out[0][self.at] != self.address(self.at[self.first])))
            spot, model = self.of(tied)[0], self.of(self.first[tied])[0]
            for x in out:
                x[spot] = x[model]
        return out

    def factors(self, said: pd.DataFrame) -> list[tuple[int, int, int, int, int, int]]:
        """Greedy factors from left to right: document, start, words, and the source's address, document
        and start."""
        src, src_doc, src_start = self.sources(said)
        at = np.flatnonzero(src >= 0)
        if not len(at):
            return []
        doc = np.searchsorted(np.cumsum(self.lens), at, "right")
        cut = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (src[at[1:]] != src[at[:-1]] + 1)))
        edges = np.append(np.flatnonzero(cut), len(at))
        a, n = at[edges[:-1]], np.diff(edges) + self.width - 1
        d = doc[edges[:-1]]
        return list(zip(d.tolist(), (a - self.starts[d]).tolist(), n.tolist(), src[a].tolist(), src_doc[a].tolist(), src_start[a].tolist(), strict=True))


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """docs(d, t) as blocks of at most block_bytes of text, one document at least."""
    schema = "block long, piece int, ids array<long>, missing array<boolean>, sizes array<long>, blob binary"

    def run(batches):
        base = TaskContext.get().partitionId() << 14
        for k, rows in enumerate(text_batches(batches, block_bytes)):
            if k >= 1 << 14:
                raise ValueError("a partition has more than 16384 blocks")
            texts = [r[1] or b"" for r in rows]
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            pieces = [blob[i : i + _PIECE] for i in range(0, max(1, len(blob)), _PIECE)]
            more, longs = [[]] * (len(pieces) - 1), pa.list_(pa.int64())
            columns = [
                pa.array([base + k] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int32()), pa.array([[_NULL if r[0] is None else r[0] for r in rows], *more], longs),
                pa.array([[r[0] is None for r in rows], *more], pa.list_(pa.bool_())), pa.array([[len(t) for t in texts], *more], longs), pa.array(pieces, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "piece", "ids", "missing", "sizes", "blob"])

    return docs.mapInArrow(run, schema)


def _joined(rows: list[dict]) -> dict:
    """A block's rows as one."""
    rows = sorted(rows, key=lambda r: r["piece"])
    return rows[0] | {"blob": b"".join(r["blob"] for r in rows)}


def _each(batches):
    """The blocks of a task: their rows stand together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["block"] != row["block"]:
                yield _joined(held)
                held = []
            held.append(row)
    if held:
        yield _joined(held)


def _of(block: pd.DataFrame) -> dict:
    if not len(block):
        raise ValueError("answers to no block")
    return _joined(block.to_dict("records"))


_DIRECTORY = "a long, c long, doc long, start int, address long"


def _table(schema: str, *columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int32() if c.split()[1] == "int" else pa.int64() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _directory(blocks: DataFrame, width: int) -> DataFrame:
    """Each block's anchors: one row a group, or, where an anchor has several groups in the block, one
    row (address -1) for all of them, as these are looked up by window whatever others say."""

    def run(batches):
        for row in _each(batches):
            b = _Block(row, width)
            one = np.flatnonzero(b.lead & ~b.many)
            several = np.unique(b.anchor[b.lead & b.many])
            ids, start = b.places(b.at[one], b.doc[one])
            own = several ^ mix64(np.full(len(several), b.no + 1, np.uint64))
            fill = np.zeros(len(several), np.int64)
            yield _table(_DIRECTORY, np.concatenate((b.anchor[one], several)).view(np.int64), np.concatenate((b.group[one], own)).view(np.int64), np.concatenate((ids, fill)), np.concatenate((start, fill)).astype(np.int32), np.concatenate((b.address(b.at[one]), fill - 1)))

    return blocks.mapInArrow(run, _DIRECTORY)


def _answers(directory: DataFrame) -> DataFrame:
    """block, at, kind (0: stands earlier, at source; 2: its anchor has other groups) and the source."""
    alike, anchor = W.partitionBy("a", "c"), W.partitionBy("a")
    place = F.struct("doc", "start")
    told = directory.withColumn("first", F.min(F.struct("doc", "start", "address")).over(alike)).withColumns({"lo": F.min("c").over(anchor), "hi": F.max("c").over(anchor)})
    late = F.struct("first.doc", "first.start") < place
    told = told.where("address >= 0").withColumn("kind", F.when(late, F.lit(0)).when(F.col("lo") != F.col("hi"), F.lit(2))).where("kind IS NOT NULL")
    return _said(told, F.col("kind"))


def _said(told: DataFrame, kind) -> DataFrame:
    own, first = F.col("address"), F.col("first")
    return told.select(F.shiftright(own, 28).alias("block"), own.bitwiseAND(F.lit(_PLACES - 1)).alias("at"), kind.alias("kind"), first["address"].alias("source"), first["doc"].alias("source_doc"), first["start"].cast("long").alias("source_start"))


_WINDOWS = "h long, g long, doc long, start int, address long"


def _window_answers(blocks: DataFrame, said: DataFrame, width: int) -> DataFrame:
    """Kind 1: windows of open groups that stand earlier elsewhere."""

    def run(key, block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _WINDOWS.split(", ")]
        b = _Block(_of(block), width)
        at, doc, h, g, first = b.windows(told["at"].to_numpy(np.int64))
        own = np.flatnonzero(first == np.arange(len(first)))
        ids, start = b.places(at[own], doc[own])
        return pd.DataFrame(dict(zip(names, (h[own].view(np.int64), g[own].view(np.int64), ids, start.astype(np.int32), b.address(at[own])), strict=True)))

    asked = blocks.groupBy("block").cogroup(said.where("kind = 2").groupBy("block")).applyInPandas(lambda key, a, b: run(key, a, b), _WINDOWS)
    told = asked.withColumn("first", F.min(F.struct("doc", "start", "address")).over(W.partitionBy("h", "g"))).where(F.struct("first.doc", "first.start") < F.struct("doc", "start"))
    return _said(told, F.lit(1))


_FOUND = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, factors array<struct<start:long,words:long,source_doc:long,source_start:long>>, source_block long, source long, n long, digest binary, asked binary"


def _factored(blocks: DataFrame, said: DataFrame, width: int, with_text: bool) -> DataFrame:
    """A row for each document, and one for each factor with a source in another block: its words."""

    def run(key, block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        b = _Block(_of(block), width)
        by_doc: dict[int, list] = {}
        for f in b.factors(told):
            by_doc.setdefault(f[0], []).append(f[1:])
        out, asks = [], {}
        for d in range(len(b.lens)):
            name = None if b.missing[d] else int(b.ids[d])
            if d not in by_doc:
                text = b.texts[d].translate(_FLAT).strip(b" ")
                text = b" ".join(text.split()) if b"  " in text else text
                out.append((name, int(b.lens[d]), 0, hashlib.sha256(text).hexdigest(), text.decode() if with_text else None, [], None, None, None, None, None))
                continue
            words, kept, at = b.texts[d].split(), [], 0
            for start, n, source, _, _ in by_doc[d]:
                own = words[start : start + n]
                if source // _PLACES == b.no:
                    if b.words_at(source % _PLACES, n) != own:
                        raise ValueError("two windows of one hash differ in their words")
                else:
                    joined = b"\n".join(own)
                    asks.setdefault((source, n, hashlib.sha256(joined).digest()), joined)
                kept += words[at:start]
                at = max(at, start + n)
            kept += words[at:]
            text = b" ".join(kept)
            found = [{"start": s, "words": n, "source_doc": None if x == _NULL else x, "source_start": y} for s, n, _, x, y in by_doc[d]]
            out.append((name, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None, found, None, None, None, None, None))
        pack = zstandard.ZstdCompressor(level=3)
        out += [(None, None, None, None, None, None, s // _PLACES, s, n, digest, pack.compress(joined)) for (s, n, digest), joined in asks.items()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "factors", "source_block", "source", "n", "digest", "asked"]
        frame = pd.DataFrame(out, columns=names)
        for c in ("doc_id", "n_words", "n_removed", "source_block", "source", "n"):
            frame[c] = pd.array([r[names.index(c)] for r in out], "Int64")
        return frame

    return blocks.groupBy("block").cogroup(said.groupBy("block")).applyInPandas(lambda key, a, b: run(key, a, b), _FOUND)


def _differ(blocks: DataFrame, found: DataFrame) -> int:
    """How many of the factors differ from the words at their source, compared in the source's block.
    Factors of equal words and source are compared once."""
    asks = found.where("source IS NOT NULL").groupBy("source_block", "source", "n", "digest").agg(F.max("asked").alias("asked")).withColumnRenamed("source_block", "block")

    def run(key, block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        bad = 0
        if len(asked):
            b = _Texts(_of(block))
            unpack = zstandard.ZstdDecompressor()
            for source, n, blob in sorted(zip(asked["source"], asked["n"], asked["asked"], strict=True), key=lambda r: r[0]):
                bad += b.words_at(int(source) % _PLACES, int(n)) != unpack.decompress(bytes(blob)).split(b"\n")
        return pd.DataFrame({"bad": [bad]})

    return blocks.groupBy("block").cogroup(asks.groupBy("block")).applyInPandas(lambda key, a, b: run(key, a, b), "bad long").agg(F.sum("bad")).first()[0] or 0


def _found(docs: DataFrame, text: str, doc_id: str, width: int, with_text: bool, chunk_bytes: int, bucket_windows: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("binary").alias("t"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-size // (6 * bucket_windows)))  # a word and its space take about six bytes
    scratch = Scratch(spark)
    try:
        blocks = scratch.bucketed(_blocks(rows, chunk_bytes), "substring-blocks", "block", buckets)
        said = scratch.save(_answers(_directory(blocks, width)), "substring-groups")
        said = said.unionByName(scratch.save(_window_answers(blocks, said, width), "substring-windows"))
        found = save(_factored(blocks, said, width, with_text), "substring-found")
        if bad := _differ(blocks, found):
            raise RuntimeError(f"{bad} factors differ from their sources: hashes of 128 bits are alike")
    finally:
        scratch.clear()
    return found.where("n_words IS NOT NULL")


def factors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 20, chunk_bytes: int = 4 << 20, bucket_windows: int = 1_200_000) -> DataFrame:
    """doc_id, start, words, source_doc, source_start: the duplicate spans, in words, of each document."""
    found = _found(docs, text, doc_id, width, False, chunk_bytes, bucket_windows)
    return found.select("doc_id", F.explode("factors").alias("f")).select("doc_id", "f.*")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 20, with_text: bool = False, chunk_bytes: int = 4 << 20, bucket_windows: int = 1_200_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, on request, kept_text (kept words joined by a space)."""
    found = _found(docs, text, doc_id, width, with_text, chunk_bytes, bucket_windows)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))
