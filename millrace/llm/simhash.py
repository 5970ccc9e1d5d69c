"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: 64 bits from the XXH64 (seed 42) of the text's 3-word shingles, repeats included; a bit
is 1 if set in over half of them. Fewer than 3 words: the whole sequence is the one shingle; none
(empty or null text): fingerprint zero, which links like any other.

Every bit position gets a non-zero vector of radius + 1 bits; each non-zero vector v of that size
names a table whose mask keeps the positions with odd inner product with v. For any `radius`
positions some v is orthogonal to all their vectors, so a pair that differs there agrees on that
table's mask: every pair within the radius collides, none is missed. Copies collapse to one
fingerprint first. A bucket of more than `bucket_limit` fingerprints is dealt again by the same
construction on the bits that its mask leaves out, which holds at most 4096 fingerprints a bucket
at radius 2; nothing is capped. Buckets give a spanning forest of their links, not all pairs, and
components are found by distributed star steps.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, one_of_each, save, small_batches, text_batches
from .graph import components

_BITS = 64


def _fingerprints(texts: list[bytes | None], width: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    lens = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        w = (t or b"").translate(LOWER).split()
        if w:
            grams = [b" ".join(g) for g in zip(*(w[i:] for i in range(width)), strict=False)] or [b" ".join(w)]
            hashes += [xxh64_intdigest(g, 42) for g in grams]
            lens[k] = len(grams)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(lens)
    h = np.array(hashes, dtype="<u8")
    ends = np.cumsum(lens)
    for k in full:
        own = h[ends[k] - lens[k] : ends[k]].view(np.uint8).reshape(-1, 8)
        ones = np.zeros(_BITS, np.int64)
        for a in range(0, len(own), 1 << 16):
            ones += np.unpackbits(own[a : a + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > lens[k], bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 3, batch_bytes: int = 4 << 20) -> DataFrame:
    """Columns `keep` and fp (the fingerprint's bits as a signed long)."""
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = docs.select(*keep).schema.add("fp", "long")
    arrow = to_arrow_schema(out)

    def run(batches):
        for rows in text_batches(batches, batch_bytes):
            fp = _fingerprints([r[-1] for r in rows], width).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True))[:-1], arrow, strict=False)), pa.array(fp)], schema=arrow)

    return docs.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(run, out)


def covering_masks(radius: int, positions: tuple[int, ...] = tuple(range(_BITS))) -> list[int]:
    """2^(radius+1) - 1 masks over `positions`; any two words that differ in at most `radius` of
    them agree on one mask."""
    vectors = [v for v in product((0, 1), repeat=radius + 1) if any(v)]
    given = {p: vectors[k % len(vectors)] for k, p in enumerate(positions)}
    return [sum(1 << p for p, g in given.items() if sum(a & b for a, b in zip(g, v, strict=True)) % 2) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _dealt(df: DataFrame, masks: list[list[int]], more: list[str]) -> DataFrame:
    """A row for each mask: t (table) and key. masks: for table `t0` of df, where it has one, its masks."""

    def keyed(ms: list[int], of: int) -> Column:
        return F.array(*[F.struct(F.lit(of * 64 + i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(ms)])

    if "t0" not in df.columns:
        arr = keyed(masks[0], 0)
    else:
        arr = F.when(F.col("t0") == 0, keyed(masks[0], 0))
        for t in range(1, len(masks)):
            arr = arr.when(F.col("t0") == t, keyed(masks[t], t))
    return df.select("fp", "rep", *more, F.explode(arr).alias("x")).select("fp", "rep", *more, "x.t", "x.key")


def _linked(fps: np.ndarray, reps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (rep, smaller rep) that connect what the links within one bucket connect."""
    order = np.argsort(reps, kind="stable")
    fps, reps = fps[order].view(np.uint64), reps[order]
    group = np.arange(len(fps))
    for a in range(0, len(fps), 128):
        near = np.bitwise_count(fps[a : a + 128, None] ^ fps[None, :]) <= radius
        for row in near:
            mine = group[row]
            least = mine.min()
            for other in np.unique(mine[mine != least]):
                group[group == other] = least
    return [(int(reps[i]), int(reps[r])) for i, r in enumerate(group) if r != i]


def links(reps: DataFrame, radius: int = 2, bucket_limit: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """Edges (src, dst) between the reps of distinct fingerprints reps(fp, rep): their components
    are those of all pairs within the radius."""
    first = covering_masks(radius)
    # counts only decide how a bucket is dealt; a bucket never meets in one row before they are known
    dealt = _dealt(reps, [first], [])
    sizes = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = (scratch.save if scratch else save)(sizes, "simhash-buckets")
    small = dealt.join(sizes.where(F.col("n") <= bucket_limit).select("t", "key"), ["t", "key"], "left_semi").select("fp", "rep", F.col("t").alias("t0"), F.col("key").alias("k0"), F.lit(-1).alias("t"), F.lit(0).cast("long").alias("key"))
    groups = small
    big = sizes.where(F.col("n") > bucket_limit).select("t", "key")
    if big.take(1):
        rest = [covering_masks(radius, tuple(p for p in range(_BITS) if not m >> p & 1)) for m in first]
        again = dealt.join(big, ["t", "key"], "left_semi").withColumnsRenamed({"t": "t0", "key": "k0"})
        groups = small.unionByName(_dealt(again, rest, ["t0", "k0"]))
    rows = groups.groupBy("t0", "k0", "t", "key").agg(F.collect_list(F.struct("fp", "rep")).alias("m")).where(F.size("m") > 1).select("m.fp", "m.rep")

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int]] = []
            for fp, rep in zip(batch.column(0), batch.column(1), strict=True):
                out += _linked(fp.values.to_numpy(zero_copy_only=False), rep.values.to_numpy(zero_copy_only=False), radius)
            a = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["src", "dst"])

    return rows.mapInArrow(run, "src long, dst long")


def _found(docs: DataFrame, text: str, doc_id: str, radius: int, width: int) -> DataFrame:
    """doc_id, fp, component (the smallest fingerprint of the component) and component_id of every row.
    Fingerprints are the nodes, so that no id, whatever its value, stands for anything but itself."""
    scratch = Scratch(docs.sparkSession)
    try:
        return save(_linked_rows(scratch, docs, text, doc_id, radius, width), "simhash-found")
    finally:
        scratch.clear()


def _linked_rows(scratch: Scratch, docs: DataFrame, text: str, doc_id: str, radius: int, width: int) -> DataFrame:
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    fps = scratch.save(fingerprints(named, keep=("doc_id",), width=width), "simhash-fps")
    nodes = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    comp = components(links(nodes.select("fp", F.col("fp").alias("rep")), radius, scratch=scratch))
    inside = nodes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = inside.groupBy("component").agg(F.min("low").alias("component_id"))
    return fps.join(inside.join(lowest, "component").select("fp", "component", "component_id"), "fp").select("doc_id", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 2, width: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits) and component_id, the
    smallest doc_id that links of at most `radius` bits reach. Rows with a null id count as their
    group's members, but never name it; a group of such rows alone has a null component. Ids are
    longs, of any value, or texts of one. Repeated rows stay repeated; very long texts are hashed
    whole; an empty table gives no rows; other columns of docs, whatever their names, are not read."""
    found = _found(docs, text, doc_id, radius, width)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 2, width: int = 3) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id; of rows that repeat it, one.
    Of a component of null ids alone, one row stays. Columns keep their names, whatever they are."""
    found = _found(docs, text, doc_id, radius, width)
    of_null = lambda rows: fingerprints(rows, text="_text", keep=("_key",), width=width).withColumnRenamed("fp", "_fp")
    return one_of_each(docs, found, of_null, text, doc_id)
