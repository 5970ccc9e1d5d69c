"""Reading and writing: typed scans with violations instead of failures, sealed and paged outputs.

Readers never infer a schema. What a scan rejects becomes rows of a violations table, so that one bad
row neither stops a job nor vanishes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import finite_decimal

OBSERVATION = ("timestamp", "zone", "station_id", "sensor_id", "sensor_type", "value", "unit")
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}$"


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All columns as text. A header in another order, or with other names, is an error; so are rows
    with more or fewer cells. A byte order mark is dropped."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("encoding", "UTF-8").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def observations(raw: DataFrame) -> DataFrame:
    """Adds t (seconds; null unless the stamp is plain local seconds) and v (exact; null unless finite)."""
    stamp = F.when(F.col("timestamp").rlike(STAMP), F.translate("timestamp", "T", " ")).try_cast("timestamp_ntz")
    return raw.withColumn("t", F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), stamp)).withColumn("v", finite_decimal(F.col("value")))


def violations(obs: DataFrame, sensors: DataFrame, step: int, limit: float = 1e12) -> DataFrame:
    """(code, sensor_id, timestamp) of observations() rows: bad_timestamp, off_grid, bad_value,
    unknown_sensor, unit_mismatch, duplicate. sensors(sensor_id, unit) is a dimension."""
    dim = sensors.select("sensor_id", F.col("unit").alias("_unit"))
    j = obs.join(dim, "sensor_id", "left").withColumn("_n", F.count("*").over(W.partitionBy("sensor_id", "timestamp")))
    checks = [
        ("bad_timestamp", F.col("t").isNull()),
        ("off_grid", F.col("t") % step != 0),
        ("bad_value", F.col("v").isNull() | (F.abs("v") > limit)),
        ("unknown_sensor", F.col("_unit").isNull()),
        ("unit_mismatch", F.col("_unit") != F.col("unit")),
        ("duplicate", F.col("_n") > 1),
    ]
    codes = F.filter(F.array(*[F.when(c, name) for name, c in checks]), lambda x: x.isNotNull())
    return j.select(F.explode(codes).alias("code"), "sensor_id", "timestamp")


def problems(obs: DataFrame, step: int) -> DataFrame:
    """(kind, sensor_id, at, missing_slots): values that are missing, which stay, and gaps."""
    w = W.partitionBy("sensor_id").orderBy("t")
    missing = obs.where("v IS NULL").select(F.lit("missing_value").alias("kind"), "sensor_id", F.col("t").alias("at"), F.lit(None).cast("long").alias("missing_slots"))
    g = obs.withColumn("_p", F.lag("t").over(w)).where(F.col("t") - F.col("_p") > step)
    return missing.unionByName(g.select(F.lit("gap").alias("kind"), "sensor_id", F.col("t").alias("at"), ((F.col("t") - F.col("_p")) / step - 1).cast("long").alias("missing_slots")))


def label_columns(annotated: DataFrame, raw: DataFrame) -> list[str]:
    """Columns that the annotated table has beyond the raw one."""
    return [c for c in annotated.columns if c not in set(raw.columns)]


def forbidden_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Columns whose names, case and marks aside, are forbidden."""
    fold = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    bad = {fold(n) for n in names}
    return [c for c in df.columns if fold(c) in bad]


def write_new(df: DataFrame, path: str, forbidden_prefix: str | None = None) -> None:
    """Parquet to a folder that must not exist yet, nor lie under the raw data."""
    if forbidden_prefix and path.rstrip("/").startswith(forbidden_prefix.rstrip("/")):
        raise ValueError(f"{path} lies in the folder of raw data")
    df.write.mode("errorifexists").parquet(path)


def manifest(df: DataFrame, name: str, parts: int = 64) -> DataFrame:
    """(name, part, n, seal): rows and an order-free seal (sums of two hashes of all columns) by part of
    a table, so that sealing is one small aggregate."""
    cols = df.columns
    h = df.select(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(name), *cols).alias("b"))
    g = h.groupBy(F.pmod("a", F.lit(parts)).alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("sa"), F.sum(F.col("b").cast("decimal(38,0)")).alias("sb"))
    return g.select(F.lit(name).alias("name"), "part", "n", F.sha2(F.concat_ws("|", F.col("sa").cast("string"), F.col("sb").cast("string")), 256).alias("seal"))


def seal_breaks(df: DataFrame, sealed: DataFrame, name: str, parts: int = 64) -> DataFrame:
    """Parts of a table whose manifest differs from the sealed one."""
    now = manifest(df, name, parts).select("part", F.col("n").alias("n_now"), F.col("seal").alias("seal_now"))
    j = sealed.where(F.col("name") == name).join(now, "part", "full")
    return j.where(~F.col("seal").eqNullSafe(F.col("seal_now")) | ~F.col("n").eqNullSafe(F.col("n_now"))).select("part", "n", "n_now")


def property_graph(triples: DataFrame, type_p: str = "type", literals: tuple[str, ...] = ("label",)) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, labels, properties) and relationships (src, type, dst) of triples, for a graph store."""
    lit = F.col("p").isin(*literals)
    nodes = triples.groupBy(F.col("s").alias("id")).agg(F.array_sort(F.collect_set(F.when(F.col("p") == type_p, F.col("o")))).alias("labels"), F.map_from_entries(F.array_sort(F.collect_set(F.when(lit, F.struct("p", "o"))))).alias("properties"))
    return nodes, triples.where(~lit & (F.col("p") != type_p)).select(F.col("s").alias("src"), F.col("p").alias("type"), F.col("o").alias("dst")).distinct()


def merge_statements(nodes: DataFrame, relationships: DataFrame) -> DataFrame:
    """One MERGE statement a row, with its parameters as JSON."""
    n = nodes.select(F.concat(F.lit("MERGE (n:"), F.array_join("labels", ":"), F.lit(" {id: $id}) SET n += $properties")).alias("statement"), F.to_json(F.struct("id", "properties")).alias("parameters"))
    r = relationships.select(F.concat(F.lit("MATCH (a {id: $src}), (b {id: $dst}) MERGE (a)-[:"), F.col("type"), F.lit("]->(b)")).alias("statement"), F.to_json(F.struct("src", "dst")).alias("parameters"))
    return n.unionByName(r)


def load_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of incoming whose key isn't there yet: loading a bundle twice adds nothing."""
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit in order, with total and next_offset. The page is the tail of a
    top-k; no row number is given to the whole table."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).limit(offset + limit).withColumn("n", F.row_number().over(W.orderBy(*order))).where(F.col("n") > offset)
    return rows.crossJoin(F.broadcast(total)).withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit)))


def replay_slice(obs: DataFrame, start: int, minutes: int) -> DataFrame:
    """All sensors' observations of the minutes from start, if the common grid covers them."""
    span = obs.groupBy("sensor_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).agg(F.max("a").alias("lo"), F.min("b").alias("hi"))
    end = start + 60 * minutes
    return obs.join(F.broadcast(span), (F.lit(start) >= F.col("lo")) & (F.lit(end) <= F.col("hi"))).where((F.col("t") >= start) & (F.col("t") < end)).drop("lo", "hi")


def raw_files(spark, root: str, allowed: list[str], hashes: dict[str, str] | None = None, most: int = 5 << 20) -> DataFrame:
    """(path, content, sha256) of the files of an allowlist (paths under root, no '..' and no link out),
    read from `root`, or from the archive root.zip where the folder hasn't got them. Larger files than
    `most` bytes, and content that hasn't the stated hash, raise. Only names are listed on the driver."""
    import io
    import zipfile

    if bad := [p for p in allowed if p.startswith("/") or ".." in p.split("/") or not p]:
        raise ValueError(f"not under the folder: {bad}")
    base = root.rstrip("/")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    there = [p for p in allowed if fs.exists(fs_path(f"{base}/{p}"))]
    parts = []
    if there:
        # names without the scheme, which the reader adds
        files = spark.read.format("binaryFile").load([f"{base}/{p}" for p in there])
        name = F.lit(None).cast("string")
        for p in there:
            name = F.when(F.endswith("path", F.lit(f"/{p}")), p).otherwise(name)
        parts.append(files.select(name.alias("path"), "length", "content"))
    missing = sorted(set(allowed) - set(there))
    if missing:
        wanted = set(missing)

        def members(batches):
            import pandas as pd

            for pdf in batches:
                for data in pdf["content"]:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        names = [i for i in z.infolist() if i.filename in wanted and i.file_size <= most]
                        yield pd.DataFrame({"path": [i.filename for i in names], "length": [i.file_size for i in names], "content": [z.read(i) for i in names]})

        parts.append(spark.read.format("binaryFile").load(f"{base}.zip").select("content").mapInPandas(members, "path string, length long, content binary"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    digest = F.sha2("content", 256)
    stated = F.lit(None).cast("string")
    for p, h in (hashes or {}).items():
        stated = F.when(F.col("path") == p, h).otherwise(stated)
    checked = F.when(F.col("length") > most, F.raise_error(F.concat(F.lit("too large: "), "path"))).when(stated != digest, F.raise_error(F.concat(F.lit("changed: "), "path"))).otherwise(digest)
    return out.select("path", "content", checked.alias("sha256"))


def corpus_violations(corpus: DataFrame, sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """(code, key) of corpus(key, source, text, text_sha256): unexpected_source (not in sources(source)),
    duplicate_id, blank_text, hash_mismatch. A corpus without rows here may be frozen."""
    listed = sources.select(F.col("source").alias("_s")).distinct()
    j = corpus.join(listed, F.col("source") == F.col("_s"), "left")
    checks = [("unexpected_source", F.col("_s").isNull()), ("blank_text", F.col("text").isNull() | (F.length(F.trim("text")) == 0)), ("hash_mismatch", F.col("text_sha256") != F.sha2(F.col("text").cast("binary"), 256))]
    codes = F.filter(F.array(*[F.when(c, n) for n, c in checks]), lambda x: x.isNotNull())
    rows = j.select(F.explode(codes).alias("code"), key)
    twice = corpus.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("code"), key)
    return rows.unionByName(twice)


def index_manifest(index: DataFrame, corpus: list[str], vector: str, part: str) -> DataFrame:
    """(part, n, corpus_seal, vector_seal) of a vector index: order-free seals of its corpus columns and of
    its vectors, as sums of hashes by part."""
    h = index.select(part, F.xxhash64(*corpus).cast("decimal(38,0)").alias("c"), F.xxhash64(corpus[0], vector).cast("decimal(38,0)").alias("v"))
    seal = lambda x: F.sha2(F.sum(x).cast("string"), 256)
    return h.groupBy(part).agg(F.count("*").alias("n"), seal("c").alias("corpus_seal"), seal("v").alias("vector_seal"))


def index_breaks(sealed: DataFrame, now: DataFrame, part: str) -> DataFrame:
    """(part, broken, n) by part: what differs from the sealed manifest, 'corpus', 'vectors', both, or ''."""
    b = now.select(F.col(part).alias("_p"), F.col("n").alias("_n"), F.col("corpus_seal").alias("_c"), F.col("vector_seal").alias("_v"))
    j = sealed.join(b, F.col(part) == F.col("_p"), "full")
    corpus = ~F.col("corpus_seal").eqNullSafe(F.col("_c")) | ~F.col("n").eqNullSafe(F.col("_n"))
    vectors = ~F.col("vector_seal").eqNullSafe(F.col("_v"))
    return j.select(F.coalesce(part, "_p").alias(part), F.concat_ws(",", F.when(corpus, "corpus"), F.when(vectors, "vectors")).alias("broken"), F.coalesce("_n", "n").alias("n"))


def load_index(index: DataFrame, sealed: DataFrame, corpus: list[str], vector: str, part: str) -> DataFrame:
    """The index, if no part of it differs from the sealed manifest; else an error that names the parts."""
    if bad := index_breaks(sealed, index_manifest(index, corpus, vector, part), part).where("broken <> ''").orderBy(part).limit(5).collect():
        raise ValueError("the index isn't what was sealed: " + ", ".join(f"{r[part]} ({r.broken})" for r in bad))
    return index


def repeated_fields(df: DataFrame, column: str) -> DataFrame:
    """Adds repeated: whether some object of the JSON names a field twice, null where it isn't JSON. A
    parser that keeps the last of two would hide it, so each object is looked at as it is read."""
    import json

    def twice(text: str | None) -> bool | None:
        found = []

        def fields(pairs):
            found.append(len({k for k, _ in pairs}) != len(pairs))

        try:
            json.loads(text, object_pairs_hook=fields)
        except (TypeError, ValueError):
            return None
        return any(found)

    return df.withColumn("repeated", F.udf(twice, "boolean", useArrow=True)(column))


def roundtrip_breaks(stored: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """(side, key) of rows that only the stored table, or only the one normalised again, has."""
    a = stored.exceptAll(again.select(*stored.columns)).select(F.lit("stored_only").alias("side"), key)
    return a.unionByName(again.select(*stored.columns).exceptAll(stored).select(F.lit("upload_only").alias("side"), key))
