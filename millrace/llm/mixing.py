"""Mixing sources to target weights by pivotal dependent rounding.

Each source shall give `target` words. All its documents start with target / source size copies; the
whole copies are certain, the fraction is a probability. Documents are paired in a seeded order and
mass moves between the two at random, size for size, so that the expected words of the pair stay
while one of the two becomes 0 or 1; the other meets the next document. What is left of a part of a
source, one document at most, meets the remains of other parts in a tree of groups, until one
remains for each source and is drawn by its own probability. A source's words thus differ from its
target by less than its largest document. A hot source is many parts of about `part_rows` documents,
rows that repeat an id and a size included: these are counted and numbered before they are dealt.

Sources are a table like any other: they are ranked by a range sort, and targets are found from sums
over them; the driver sees a few numbers a round.

Draws are hashes of (seed, document), never of positions in partitions, so reruns agree. Null texts
have size 0; documents of size 0 are taken 0 times in words whatever their copies. Repeated rows
count each for itself. A null source is a source of its own, ranked last. Very long texts have their
whole size; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

WEIGHTS = (5, 2, 1)


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, each at most `most` times its own size; what exceeds goes to
    the others by weight, until none is above."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}
    left = total
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > most * sizes[i]} if w else set()
        if not over:
            for i in free:
                out[i] = left * weights[i] / w if w else 0.0
            break
        for i in over:
            out[i] = most * sizes[i]
        left = total - sum(most * sizes[i] for i in range(len(sizes)) if i not in free or i in over)
        free -= over
    return out


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(name, g, source_size, target): targets() over the sources of sized(source, size), g their rank by
    code point (the order of UTF-8 bytes), null last."""
    spark = sized.sparkSession
    sources = sized.groupBy(F.col("source").alias("name")).agg(F.sum("size").cast("long").alias("source_size"))
    # a range sort: rows of a partition are numbered, and partitions follow each other
    ordered = save(sources.repartitionByRange(F.col("name").isNull(), "name").sortWithinPartitions(F.col("name").isNull(), "name").withColumn("m", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("m", 33)
    before, offsets = 0, []
    for r in ordered.groupBy(part.alias("p")).count().orderBy("p").collect():  # as many rows as partitions
        offsets.append((r["p"], before))
        before += r["count"]
    table = spark.createDataFrame(offsets, "p long, before long")
    ranked = ordered.withColumn("p", part).join(table, "p").withColumn("g", F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("g") % len(weights) + 1).cast("int"))
    goals = save(ranked.select("name", "g", "source_size", weight.alias("weight")), "mix-weights")
    full = F.col("source_size") > 0
    total, free = goals.agg(F.sum("source_size"), F.sum(F.when(full, F.col("weight")))).first()
    left, total = float(total or 0), float(total or 0)
    # what each weight unit gets only rises as sources are capped, so those once above stay above
    share = lambda: F.lit(left) * F.col("weight") / F.lit(free or 1.0)
    above = lambda: full & (share() > most * F.col("source_size"))
    while free:
        held, rest = goals.agg(F.sum(F.when(above(), most * F.col("source_size"))), F.sum(F.when(full & ~above(), F.col("weight")))).first()
        now = (total - (held or 0.0), rest)
        if not rest or now == (left, free):
            break
        left, free = now
    target = F.when(~full, F.lit(0.0)).when(above(), most * F.col("source_size")).otherwise(share())
    return goals.select("name", "g", "source_size", target.alias("target"))


def _pivot(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Probabilities moved until all but one are 0 or 1; the place of the one that isn't, or -1.
    Sizes are positive. Each step keeps size_i * p_i + size_j * p_j and, in the mean, each p."""
    p = p.copy()
    held = -1
    for j in range(len(p)):
        if not 1e-12 < p[j] < 1 - 1e-12:
            p[j] = round(p[j])
            continue
        if held < 0:
            held = j
            continue
        i = held
        ratio = size[j] / size[i]
        up = min(1 - p[i], p[j] * ratio)  # mass from j to i, in units of i
        down = min(p[i], (1 - p[j]) * ratio)  # and from i to j
        d = up if draw[j] * (up + down) < down else -down
        p[i] += d
        p[j] -= d / ratio
        for k in (i, j):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = round(p[k])
        held = j if p[i] in (0.0, 1.0) and p[j] not in (0.0, 1.0) else i if p[i] not in (0.0, 1.0) else -1
    return p, held


def round_dependently(df: DataFrame, group: str = "g", key: str = "k", seed: int = 11, part_rows: int = 2_000, fan_in: int = 1024) -> DataFrame:
    """df has columns `group` (long), `key` (long; rows that share it stay in one part), size (long), p
    (double in 0..1). Returns df with `one`: 1 where the draw takes the row, else 0."""
    names = df.columns
    counts = save(df.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / part_rows).alias("_parts")), "mix-parts")
    most = counts.agg(F.max("_parts")).first()[0] or 1
    work = df.join(counts, F.col(group) == F.col("_g")).drop("_g")
    parts = F.col("_parts")
    work = work.withColumns({c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(c), F.col(group), F.col(key)), 11) / F.lit(float(1 << 53)) for c in ("_draw", "_toss")})
    work = work.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), parts).cast("long")).drop("_parts").withColumn("one", F.lit(0)).withColumn("_open", F.lit(False))
    schema = work.schema
    done = None
    while True:
        last = most == 1  # pickled with run() in this turn of the loop

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_draw", key, "size"], kind="stable").reset_index(drop=True)
            size, p, draw = pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64), pdf["_toss"].to_numpy()
            full = size > 0
            out, held = np.where(p >= 0.5, 1.0, 0.0), -1
            out[full], at = _pivot(size[full], p[full], draw[full])
            if at >= 0:
                held = int(np.flatnonzero(full)[at])
                if last:
                    out[held] = float(draw[held] < out[held])
                    held = -1
            pdf["p"] = out
            pdf["_open"] = np.arange(len(pdf)) == held
            pdf["one"] = np.where(pdf["_open"], 0, np.round(out)).astype(np.int32)
            return pdf

        step = save(work.groupBy(group, "_part").applyInPandas(run, schema), "pivotal")
        settled = step.where("NOT _open")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done.select(*names, "one")
        most = -(-most // fan_in)
        work = step.where("_open").withColumn("_part", F.floor(F.col("_part") / fan_in) if most > 1 else F.lit(0).cast("long"))


def _numbered(sized: DataFrame, part_rows: int) -> DataFrame:
    """sized with `copy`, a number among the rows that are alike. They are counted, and come back in
    runs of at most part_rows from wherever the shuffle puts each run."""
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    runs = alike.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / part_rows))))
    runs = runs.withColumn("m", F.least(F.lit(part_rows), F.col("n") - F.col("run") * part_rows)).repartition("doc_id", "size", "run")
    return runs.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).select("doc_id", "source", "size", (F.col("run") * part_rows + F.col("j")).alias("copy"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, seed: int = 11, part_rows: int = 2_000) -> DataFrame:
    """doc_id, size, source_size, target (double, of the source), copies and taken (size * copies)."""
    sized = save(with_size(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))).select("doc_id", "source", "size"), "mix-sizes")
    goals = source_targets(sized, weights)
    rows = _numbered(sized, part_rows).join(goals, F.col("source").eqNullSafe(F.col("name")))
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "size", "source_size", "target", "g", F.xxhash64("doc_id", "size", "copy").alias("k"), F.floor(x).cast("long").alias("whole"), (x - F.floor(x)).alias("p"))
    out = round_dependently(rows, seed=seed, part_rows=part_rows)
    return out.withColumn("copies", F.col("whole") + F.col("one")).withColumn("taken", F.col("size") * F.col("copies")).select(F.col("doc_id").cast(sized.schema["doc_id"].dataType).alias("doc_id"), "size", "source_size", "target", "copies", "taken")
