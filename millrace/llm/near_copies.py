"""Near copies: texts whose sets of five-word shingles are similar to 0.8 or more.

Candidates first come from SimHash: fingerprints of five-word shingles (simhash.fingerprints) that covering
LSH links at `radius` bits (simhash.links), confirmed on the sets. Pairs of 0.8 differ in some 10 of 64 bits,
up to 16, which no covering of that size can hold, so an exact step follows for the rest; it leaves alone
what SimHash has linked, and no link of 0.8 is lost.

Nothing is estimated. Equal sets are one node, named by their hash. Two sets that reach 0.8 share a
shingle among the first n - ceil(0.8 n) + 1 of each in any order common to all (prefix filter); the
order puts what a sample finds frequent last, so that common lines seldom meet. Pairs that share one
are sifted without loss by size and by a parity sketch, whose bits can't differ in more places than
the sets do, and confirmed on the sets. What sifted pairs connect is a cluster, and each of its sets
is first compared with one of them. Sets with sifted partners that this leaves in other components are
then brought together by cluster, once each, and compared there with all of these; only links come out,
at most one fewer than there are sets, never pairs. Keys and clusters of more sets than
`bucket_limit` are compared block by block; nothing is capped. Words are lower-cased (A-Z); fewer than five are one
shingle; texts without words are copies of each other only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import LOWER, Scratch, hash_words, local_words, mix64, one_of_each, save, text_batches
from .graph import components
from .simhash import fingerprints, links


def _sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    words, ids, lens = local_words([(t or b"").translate(LOWER) for t in texts])
    hashes, ends, out = hash_words(words), np.cumsum(lens), []
    for end, n in zip(ends.tolist(), lens.tolist(), strict=True):
        w = hashes[ids[end - n : end]]
        k = min(width, n)
        g = mix64(w[: n - k + 1]) if n else w
        for i in range(1, k):
            g = mix64(g * np.uint64(0x9E3779B97F4A7C15) + w[i : n - k + 1 + i])
        out.append(np.unique(g))
    return out


def _name(s: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(s.tobytes())).view(np.int64))


def _sketch(s: np.ndarray) -> bytes:
    """Whether an odd number of elements falls in each of as many places as the set has elements, rounded
    up to a power of 2. A sketch of half the places is the two halves' exclusive or."""
    places = max(64, 1 << (max(1, len(s)) - 1).bit_length())
    odd = np.bincount((mix64(s) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class _Sketches:
    """Sketches of several sizes, and the places in which they differ."""

    def __init__(self, sketches: list[bytes]):
        self.size = np.array([len(x) for x in sketches], np.int64)
        self.at = np.zeros(len(sketches), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for k in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == k)
            self.at[own] = np.arange(len(own))
            self.rows[k] = np.frombuffer(b"".join(sketches[i] for i in own), np.uint8).reshape(-1, k)
        self.half = {k: r[:, : k // 2] ^ r[:, k // 2 :] for k, r in self.rows.items() if k > 8}

    def differ(self, a: int, b: np.ndarray) -> np.ndarray:
        """Lower bounds on the size of the symmetric difference of set a and each of the sets b, whose
        sizes aren't farther apart than a factor of 2."""
        out, k = np.zeros(len(b), np.int64), int(self.size[a])
        for other in np.unique(self.size[b]).tolist():
            mine = np.flatnonzero(self.size[b] == other)
            x = self.rows[k][self.at[a]] if other >= k else self.half[k][self.at[a]]
            y = self.rows[other] if other <= k else self.half[other]
            out[mine] = np.bitwise_count(y[self.at[b[mine]]] ^ x).sum(axis=1, dtype=np.int64)
        return out


def _mapped(docs: DataFrame, keep: tuple[str, ...], make, schema: str, batch_bytes: int = 1 << 20) -> DataFrame:
    """make(rows, sets) gives the columns of `schema` for each batch of docs(*keep, _text)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for rows in text_batches(batches, batch_bytes):
            columns = make(rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(*keep, "_text").mapInArrow(run, kind)


def _frequent(docs: DataFrame, n: int, width: int, sample: int, most: int) -> np.ndarray:
    """Shingles that a sample of the texts repeats, the rarest first. They only choose the order."""

    def make(rows):
        sets = _sets([r[-1] for r in rows], width)
        return [np.concatenate(sets).view(np.int64)]

    some = docs.where(F.pmod("_th", F.lit(max(1, n // sample))) == 0)
    found = _mapped(some, (), make, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(most)
    return np.array([r.h for r in found.collect()][::-1], np.int64).view(np.uint64)


def _prefixes(docs: DataFrame, frequent: np.ndarray, width: int) -> DataFrame:
    """(key, fp): the shingles of each set by which it is found; a task names a set once, however many
    of its rows have it, as far as it remembers."""
    at = np.argsort(frequent)
    known = frequent[at]
    seen: set[int] = set()

    def make(rows):
        keys, names, sizes = [], [], []
        if len(seen) > 1 << 20:
            seen.clear()
        for s in _sets([r[-1] for r in rows], width):
            if len(s) and (name := _name(s)) not in seen:
                seen.add(name)
                rank = np.zeros(len(s), np.int64)
                if len(known):
                    i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[i] == s, at[i] + 1, 0)
                m = len(s) + -(4 * len(s)) // 5 + 1
                keys.append(s[np.argsort(rank, kind="stable")[:m]].view(np.int64))
                names.append(name)
                sizes.append(m)
        none = np.empty(0, np.int64)
        return [np.concatenate(keys or [none]), np.repeat(np.array(names, np.int64), sizes)]

    return _mapped(docs, (), make, "key long, fp long")


def _members(scratch: Scratch, found: DataFrame) -> DataFrame:
    """(key, fp) of the keys that several sets share. Keys with the same sets say the same, so one of
    them stands for all: a passage of many shingles is one group, not one for each shingle."""
    at = W.partitionBy("key")
    shared = scratch.save(found.withColumns({"lo": F.min("fp").over(at), "hi": F.max("fp").over(at)}).where("lo != hi").select("key", "fp").distinct(), "near-shared")
    alike = shared.groupBy("key").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.sum(F.shiftright("fp", 20)).alias("s"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    one = alike.groupBy("k", "x", "s", "lo", "hi").agg(F.min("key").alias("key")).select("key")
    return shared.join(one, "key", "left_semi")


def _sifted(fp: np.ndarray, n: np.ndarray, sketches: list[bytes], comp: np.ndarray):
    """For each set, in order of fp: the sets after it, of other components, that may reach 0.8 with it."""
    parity = _Sketches(sketches)
    for a in range(len(fp)):
        b = np.flatnonzero((comp != comp[a]) & (fp > fp[a]) & (5 * np.minimum(n, n[a]) >= 4 * np.maximum(n, n[a])))
        yield a, b[9 * parity.differ(a, b) <= n[b] + n[a]]


def _forest(fp, n, sketches, comp) -> list[tuple[int, int]]:
    """Pairs that connect what sifted pairs connect."""
    group, out = np.unique(comp, return_inverse=True)[1], []
    for a, b in _sifted(fp, n, sketches, comp):
        b = b[group[b] != group[a]]
        b = b[np.unique(group[b], return_index=True)[1]]
        group[np.isin(group, group[b])] = group[a]
        out += [(int(fp[a]), int(x)) for x in fp[b]]
    return out


def _active(fp, n, sketches, comp) -> list[tuple[int]]:
    """Sets that have a sifted partner."""
    out: set[int] = set()
    for a, b in _sifted(fp, n, sketches, comp):
        if len(b):
            out.add(int(fp[a]))
            out.update(fp[b].tolist())
    return [(x,) for x in sorted(out)]


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def _exact(fp, sketches, comp, sets: list[bytes]) -> list[tuple[int, int]]:
    """A forest of the links between components, sets compared wherever the sketch lets them."""
    own = [np.frombuffer(s, np.uint64) for s in sets]
    group, out = np.unique(comp, return_inverse=True)[1], []
    for a, b in _sifted(fp, np.array([len(s) for s in own], np.int64), sketches, comp):
        for k in b.tolist():
            if group[k] != group[a] and _similar(own[a], own[k]):
                out.append((int(fp[a]), int(fp[k])))
                group[group == group[k]] = group[a]
    return out


def _by_block(members: DataFrame, bucket_limit: int, more: tuple[str, ...] = ()) -> DataFrame:
    """members(key, fp, …) by key and pair of blocks of at most about bucket_limit sets, so that any two
    sets of a key meet in one row, whose arrays are at most twice as long."""
    size = members.groupBy("key").agg(F.ceil(F.count("*") / bucket_limit).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = members.join(size, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    fields = ("fp", "n", "sketch", "comp", *more)
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.struct(*fields).alias("m"))
    return dealt.groupBy("key", "i", "j").agg(F.collect_list("m").alias("m")).where(F.size("m") > 1).select("key", *[f"m.{f}" for f in fields])


def _in_blocks(members: DataFrame, bucket_limit: int, make, schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows that make() gives of each block: key and what it returns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            keys, out = [], []
            for key, fp, n, sketch, comp, *rest in zip(*batch.columns, strict=True):
                longs = [np.array(c.as_py(), np.int64) for c in (fp, n, comp)]
                got = make(*longs, sketch.as_py(), *[r.as_py() for r in rest])
                out += got
                keys += [key.as_py()] * len(got)
            cols = [keys, *([r[k] for r in out] for k in range(len(names) - 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return _by_block(members, bucket_limit, more).mapInArrow(run, schema)


def _wanted_sets(scratch: Scratch, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(fp, s): the sets of nodes(fp, th), th the hash of one of their texts."""

    def make(rows):
        sets = _sets([r[-1] for r in rows], width)
        return [[_name(s) for s in sets], [s.tobytes() for s in sets]]

    texts = docs.join(nodes.select("th"), F.col("_th") == F.col("th"), "left_semi")
    return scratch.save(_mapped(texts, (), make, "fp long, s binary").dropDuplicates(["fp"]), "near-sets")


def _confirmed(scratch: Scratch, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (src, dst): the pairs whose sets reach 0.8."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            ok = [_similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["src", "dst"])

    return scratch.save(both.mapInArrow(run, "src long, dst long"), "near-links")


def _by_simhash(scratch: Scratch, nodes: DataFrame, raw: DataFrame, width: int, radius: int) -> DataFrame:
    """Edges (src, dst) between sets that SimHash links and that reach 0.8. A set has the fingerprint of one of
    its texts; each set of a fingerprint meets the smallest, which meets those that its own is linked to."""
    texts = raw.join(nodes.select("th"), F.col("_th") == F.col("th"), "left_semi")
    prints = fingerprints(texts, text="_text", keep=("_th",), width=width).withColumnRenamed("fp", "bits").dropDuplicates(["_th"])
    named = scratch.save(nodes.where("n > 0").select("fp", "th").join(prints, F.col("th") == F.col("_th")).select("fp", "bits"), "near-prints")
    reps = scratch.save(named.groupBy("bits").agg(F.min("fp").alias("rep")), "near-reps")
    alike = named.join(reps, "bits").where("fp != rep").select(F.col("fp").alias("a"), F.col("rep").alias("b"))
    found = links(reps.select(F.col("bits").alias("fp"), "rep"), radius, scratch=scratch).toDF("a", "b")
    pairs = scratch.save(alike.unionByName(found).distinct(), "near-candidates")
    of = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return _confirmed(scratch, pairs, _wanted_sets(scratch, nodes.join(of, F.col("fp") == F.col("node"), "left_semi"), raw, width))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, bucket_limit: int = 2048, sample: int = 10_000, most: int = 50_000, radius: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fp (its set of shingles) and component_id, the smallest doc_id
    that links of Jaccard 0.8 reach; null where the component has null ids alone."""
    scratch = Scratch(docs.sparkSession)
    try:
        return save(_near(scratch, docs, text, doc_id, width, bucket_limit, sample, most, radius), "near-found")
    finally:
        scratch.clear()


def _near(scratch: Scratch, docs: DataFrame, text: str, doc_id: str, width: int, bucket_limit: int, sample: int, most: int, radius: int) -> DataFrame:
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text"))
    raw = raw.withColumn("_th", F.xxhash64("_text"))

    def make(rows):
        sets = _sets([r[-1] for r in rows], width)
        return [[r[0] for r in rows], [r[1] for r in rows], [_name(s) for s in sets], [len(s) for s in sets], [_sketch(s) for s in sets]]

    every = scratch.save(_mapped(raw, ("doc_id", "_th"), make, "doc_id long, th long, fp long, n long, sketch binary"), "near-fps")
    nodes = scratch.save(every.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min("th").alias("th"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "near-nodes")
    hashed = _by_simhash(scratch, nodes, raw, width, radius)
    first = scratch.save(components(hashed).toDF("fp", "first"), "near-first")
    found = _prefixes(raw, _frequent(raw, every.count(), width, sample, most), width)
    members = scratch.save(_members(scratch, found).join(nodes.select("fp", "n", "sketch"), "fp"), "near-members")
    begun = members.join(first, "fp", "left").withColumn("comp", F.coalesce("first", "fp")).drop("first")
    forest = _in_blocks(begun, bucket_limit, lambda fp, n, comp, sketch: _forest(fp, n, sketch, comp), "key long, src long, dst long")
    sifting = scratch.save(forest.select("src", "dst").distinct(), "near-pairs")
    # what sifted pairs and SimHash connect: every link lies within one of these clusters
    clustered = scratch.save(components(sifting.unionByName(hashed)), "near-clusters")
    # those that SimHash alone made are done
    unsettled = clustered.join(sifting.select(F.col("src").alias("node")), "node", "left_semi").select("component").distinct()
    sifted = scratch.save(clustered.join(unsettled, "component", "left_semi").select("node", "component"), "near-unsettled")
    sets = _wanted_sets(scratch, nodes.join(sifted, F.col("fp") == F.col("node"), "left_semi"), raw, width)
    # each set with one of its cluster
    known = hashed.unionByName(_confirmed(scratch, sifted.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")), sets))
    comp = components(known)
    # and, wherever that leaves sifted partners apart, all of them within their cluster
    clusters = sifted.select(F.col("component").alias("key"), F.col("node").alias("fp")).join(comp, F.col("fp") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "fp"))
    labelled = clusters.join(nodes.select("fp", "n", "sketch"), "fp").select("key", "fp", "n", "sketch", "comp")
    apart = _in_blocks(labelled, bucket_limit, lambda fp, n, comp, sketch: _active(fp, n, sketch, comp), "key long, fp long").distinct()
    open_ = scratch.save(labelled.join(apart, ["key", "fp"], "left_semi"), "near-open")
    if open_.take(1):
        more = _in_blocks(open_.join(sets, "fp"), bucket_limit, lambda fp, n, comp, sketch, s: _exact(fp, sketch, comp, s), "key long, src long, dst long", ("s",))
        comp = components(known.unionByName(scratch.save(more.select("src", "dst").distinct(), "near-links")))
    named = scratch.save(nodes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("component")), "near-components")
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return every.select("doc_id", "fp").join(named.join(low, "component").select("fp", "component", "component_id"), "fp").select("doc_id", "fp", "component", "component_id")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id; of rows that repeat it, one.
    Of a component of null ids alone, one row stays. Columns keep their names, whatever they are."""
    found = near_duplicates(docs, text, doc_id, **options)
    width = options.get("width", 5)

    def of_null(rows: DataFrame) -> DataFrame:
        raw = rows.select("_key", F.col("_text").cast("binary").alias("_text"))
        return _mapped(raw, ("_key",), lambda part: [[r[0] for r in part], [_name(s) for s in _sets([r[-1] for r in part], width)]], "_key long, _fp long")

    return one_of_each(docs, found, of_null, text, doc_id)
