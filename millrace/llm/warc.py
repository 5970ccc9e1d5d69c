"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing. Among payloads of at least `min_bytes` bytes with one digest the row with the smallest
page_id (every row that has it) becomes a response, the others revisit it; smaller payloads, null
ones included (empty payloads), are all responses. Spark's text writer puts records into files: the
separator that it writes after each row is the CRLF CRLF that ends a WARC record, so the files are plain
WARC, on whatever file system the path names. Pages are written by tiers of size, the larger the fewer
to a file, so that a file has about `file_bytes` at most, or one record. Digests are shuffled, payloads
never are (beyond a checked size of the revisit table, one join shuffles them).

Reading. The bytes of a payload may hold the magic that begins a record. Each task therefore emits
every place in its file where the magic stands with a header that parses, as a candidate, with the
offset of the record that would follow. Pointer jumping from offset 0 of each file (reach the
successors of what is reached, then double the pointers' length) retains the records of the chain
and rejects what lies inside payloads. A task also says where the walk from each candidate leaves
its block of the file; jumping goes over these leaps, so that its rounds grow with the logarithm of
a file's blocks, and each block's own part of the chain is then walked once. A chain that doesn't reach
the end of its file (a damaged or cut record) raises an error that names the file, or, with
resume=True, is taken up at the next candidate, which may then lie in the damaged record's payload.

A revisit gives the length and digest of the response that it refers to, as read back; `intact` says
whether a response's payload has the digest of its header, and whether a revisit's response is there.

Control characters in URLs are percent-encoded in the header. A null page_id or url gives no such
header line and reads back as null. Rows that repeat a page_id stay separate records; an empty table
gives no files' records; other columns of pages, whatever their names, are not written.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, save

#: Fixed strings of the WARC format.
MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"


def _hashed(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    return rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "payload_bytes": F.octet_length("html").cast("long")})


def _firsts(pages: DataFrame, min_bytes: int = 100, broadcast_rows: int = 500_000) -> tuple[DataFrame, int]:
    """(digest, first): the smallest page_id of each digest that several large payloads have."""
    digests = _hashed(pages).where(f"payload_bytes >= {min_bytes}").select("page_id", "digest")
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    firsts = save(firsts, "warc-firsts")
    # about 100 bytes a row: at most 50 MB are broadcast, more are joined by a shuffle
    return (F.broadcast(firsts) if firsts.count() <= broadcast_rows else firsts), min_bytes


def records(pages: DataFrame, firsts: tuple[DataFrame, int] | None = None, **options) -> DataFrame:
    """One column, value: each page's record as text. firsts: what _firsts says of all pages."""
    table, min_bytes = _firsts(pages, **options) if firsts is None else firsts
    rows = _hashed(pages).join(table, "digest", "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.withColumn("first", F.when(revisit, F.col("first"))).withColumn("payload", F.when(F.col("first").isNull(), F.col("html")).otherwise(F.lit("")))
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")

    def line(name, value):
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))

    digest = F.col("digest")
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(F.col("first").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Target-URI", url),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(":"), digest, F.lit(">"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("X-Page-Id", F.col("page_id")),
        line("X-Payload-Length", F.col("payload_bytes")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first"), F.lit(":"), digest, F.lit(">"))),
        line("X-Refers-To-Page", F.col("first")),
        line("Content-Length", F.octet_length("payload")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, "payload").alias("value"))


def write(pages: DataFrame, path: str, file_records: int = 1000, file_bytes: int = 64 << 20, **options) -> None:
    """pages(page_id, url, html) as WARC files in the folder `path`."""
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    least, out, firsts = -1, pages.select("page_id", "url", "html"), _firsts(pages, **options)
    while file_records >= 1:
        last = file_records == 1
        most = file_bytes // file_records
        tier = out.where((size > least) if last else (size > least) & (size <= most))
        records(tier, firsts).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", file_records).text(path)
        least, file_records = most, 0 if last else max(1, file_records // 32)


def parse(data: bytes):
    """Candidates of one file: (offset, successor, header as dict, payload's offset and end). Reading a
    header stops at the first line that can't be one of it, the next magic included, so that no byte is
    read for more than two magics."""
    at = data.find(MAGIC)
    while at >= 0:
        line, head = at + len(MAGIC), {}
        while (stop := data.find(b"\r\n", line)) > line:
            k, sep, v = data[line:stop].partition(b": ")
            if not sep:
                break
            head[k.decode("latin-1").lower()] = v.decode("utf-8", "replace")
            line = stop + 2
        if stop == line and head:
            size = head.get("content-length", "")
            if size.isascii() and size.isdigit() and len(size) < 19 and (end := stop + 2 + int(size)) + 4 <= len(data) and data[end : end + 4] == b"\r\n\r\n":
                yield at, end + 4, head, stop + 2, end
        at = data.find(MAGIC, at + 1)


CANDIDATE = "path string, at long, next long, leap long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, intact boolean"


def candidates(spark: SparkSession, path: str, block: int = 8 << 20) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def number(x):
        return int(x) if x is not None and x.lstrip("-").isdigit() else None

    def run(batches):
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in CANDIDATE.split(", "))])
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                out = []
                data = data.as_py()
                for at, nxt, h, begin, end in parse(data):
                    kind = h.get("warc-type")
                    own = hashlib.sha256(memoryview(data)[begin:end]).hexdigest()
                    said = h.get("warc-payload-digest", "").removeprefix("sha256:")
                    full = kind != "revisit"
                    out.append([name.as_py(), at, nxt, 0, number(h.get("x-page-id")), end - begin if full else number(h.get("x-payload-length")), own if full else said, kind, number(h.get("x-refers-to-page")), h.get("warc-target-uri"), not full or own == said])
                for row, leap in zip(out, leaps([(r[1], r[2]) for r in out], block), strict=True):
                    row[3] = leap
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return files.mapInArrow(run, CANDIDATE)


def leaps(edges: list[tuple[int, int]], block: int) -> list[int]:
    """For edges (at, next) by rising at: where the walk from at first leaves its block of `block`
    bytes, or ends."""
    out: dict[int, int] = {}
    for at, nxt in reversed(edges):
        out[at] = out[nxt] if nxt // block == at // block and nxt in out else nxt
    return [out[at] for at, _ in edges]


def chain(edges: DataFrame, block: int = 8 << 20, max_rounds: int = 60, more: DataFrame | None = None) -> DataFrame:
    """(path, at) of edges(path, at, next, leap) that a walk from offset 0 of each path, and from the
    places more(path, at), reaches.
    Pointer jumping over leaps, which skip what lies in one block, finds where the walk enters each
    block: after k rounds all entries within 2^k leaps. Then every block is walked by itself."""
    jump = edges.select("path", "at", F.col("leap").alias("next")).checkpoint()
    places = jump.select("path", "at")
    entered = jump.where("at = 0").select("path", "at")
    entered = (entered if more is None else entered.unionByName(more.select("path", "at"))).distinct()
    n = entered.count()
    for _ in range(max_rounds):
        # the last record's successor is the end of the file, where no record stands
        far = entered.join(jump, ["path", "at"]).select("path", F.col("next").alias("at")).join(places, ["path", "at"], "left_semi")
        entered = entered.unionByName(far).distinct().checkpoint()
        if (m := entered.count()) == n:
            break
        n = m
        ahead = jump.select("path", F.col("at").alias("next"), F.col("next").alias("beyond"))
        jump = jump.join(ahead, ["path", "next"]).select("path", "at", F.col("beyond").alias("next")).checkpoint()
    else:
        raise RuntimeError(f"a chain of more than 2^{max_rounds} blocks")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        on = dict(zip(pdf["at"], pdf["next"], strict=True))
        seen: list[int] = []
        for at in sorted(pdf.loc[pdf["entry"], "at"]):
            while at in on and (not seen or at > seen[-1]):
                seen.append(at)
                at = on[at]
        return pd.DataFrame({"path": pdf["path"].iloc[0], "at": pd.Series(seen, dtype="int64")})

    marked = edges.select("path", "at", "next").join(entered.withColumn("entry", F.lit(True)), ["path", "at"], "left").withColumn("entry", F.col("entry").isNotNull())
    return marked.groupBy("path", F.floor(F.col("at") / block).alias("b")).applyInPandas(walk, "path string, at long")


def read(spark: SparkSession, path: str, block: int = 8 << 20, resume: bool = False) -> DataFrame:
    """The records of the WARC files in the folder `path`: CANDIDATE's columns without next and leap."""
    found = save(candidates(spark, path, block), "warc-candidates")
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    more = None
    while True:
        kept = save(found.join(chain(found, block, more=more), ["path", "at"], "left_semi").drop("leap"), "warc-records")
        ends = kept.groupBy("path").agg(F.max("next").alias("end"))
        broken = files.join(ends, "path", "left").select("path", "length", F.coalesce("end", F.lit(0)).alias("end")).where("end < length").checkpoint()
        if not broken.take(1):
            break
        if not resume:
            raise ValueError("records are damaged: " + ", ".join(f"{r.path} at {r.end} of {r.length}" for r in broken.limit(5).collect()))
        starts = found.join(broken, "path").where("at > end OR (at = end AND end = 0)").groupBy("path").agg(F.min("at").alias("at"))
        # files that have no candidate beyond the break end there
        starts = (starts if more is None else starts.unionByName(more)).distinct().checkpoint()
        if more is not None and starts.count() == more.count() or not starts.take(1):
            break
        more = starts
    return _resolved(kept.drop("next"))


def _resolved(kept: DataFrame) -> DataFrame:
    """Revisits take length and digest from the response that they refer to, where it was read."""
    revisit = F.col("record_type") == "revisit"
    wanted = kept.where(revisit).select(F.col("payload_digest").alias("_digest")).distinct()
    there = kept.where(~F.coalesce(revisit, F.lit(False))).join(wanted, F.col("payload_digest") == F.col("_digest"), "left_semi")
    there = there.groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")).agg(F.min("payload_bytes").alias("_bytes"))
    out = kept.join(there, revisit & (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    same = F.col("_bytes").eqNullSafe(F.col("payload_bytes"))
    return out.withColumn("intact", F.when(revisit, F.col("_page").isNotNull() & same).otherwise(F.col("intact"))).withColumn("payload_bytes", F.when(revisit, F.coalesce("_bytes", "payload_bytes")).otherwise(F.col("payload_bytes"))).drop("_page", "_digest", "_bytes")


def roundtrip(pages: DataFrame, **options) -> DataFrame:
    """Writes pages as WARC files in the shared folder and reads them back; damaged records raise."""
    scratch = Scratch(pages.sparkSession)
    path = scratch.path("warc")
    try:
        write(pages, path, **options)
        out = save(read(pages.sparkSession, path), "warc-read")
    finally:
        scratch.clear()
    if bad := out.where("NOT intact").count():
        raise ValueError(f"{bad} records read back differ from what was written")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
