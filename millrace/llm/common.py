"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all runs in one
    process (local mode, as in tests) is a temporary folder set instead when the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
        return base.rstrip("/")
    if (own := spark.sparkContext.getCheckpointDir()) is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage is cut, and a
    lost executor costs no recomputation of what is written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets the session hand Python at most about `most` bytes of rows at once, whatever a row's size (its
    default of 64 MB, held twice over by each side, is much of a small executor). A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


class Scratch:
    """Tables of one run in the shared folder, which clear() removes."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self._paths, self._tables = spark, [], []

    def path(self, name: str) -> str:
        self._paths.append(scratch_path(self.spark, name))
        return self._paths[-1]

    def save(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = self.path(name)
        df.write.partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, n: int) -> DataFrame:
        """df as a table of n buckets of key, which later groupings by key read without a shuffle. Rows
        are written where they are: each task adds a file to the buckets of its own rows."""
        table, path = f"scratch_{uuid.uuid4().hex}", self.path(name)
        df.write.option("path", path).bucketBy(n, key).sortBy(key).format("parquet").saveAsTable(table)
        self._tables.append(table)
        return self.spark.table(table)

    def clear(self) -> None:
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self._paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self._tables, self._paths = [], []


def one_of_each(docs: DataFrame, found: DataFrame, of_null, text: str, doc_id: str) -> DataFrame:
    """docs with one row of each component of found(doc_id, fp, component, component_id): that whose id
    names it, once; of a component of null ids alone, one row with its smallest fp. of_null gives (_key,
    _fp) of rows(_key, _text). docs' columns are renamed meanwhile, so that none can clash."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, t = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    stay = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_stay")).distinct()
    kept = safe.join(stay, F.col(at).cast("long") == F.col("_stay"), "left_semi").dropDuplicates([at])
    lone = found.where("component_id IS NULL").groupBy("component").agg(F.min("fp").alias("_lone")).select("_lone")
    if lone.take(1):
        # rows with the same text are alike here; of those that differ elsewhere, one stays
        nulls = safe.where(F.col(at).isNull()).withColumn("_key", F.xxhash64(F.col(t)))
        one = of_null(nulls.select("_key", F.col(t).alias("_text"))).join(lone, F.col("_fp") == F.col("_lone"), "left_semi").groupBy("_fp").agg(F.min("_key").alias("_k"))
        kept = kept.unionByName(nulls.join(one.select("_k"), F.col("_key") == F.col("_k"), "left_semi").dropDuplicates(["_key"]).select(*safe.columns))
    return kept.toDF(*names)


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; bytes of equal significance stand together, so that small
    or sorted integers (give their differences) take few bytes."""
    head, body = [], []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head.append((name, a.dtype.str, len(a)))
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    h = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(h).to_bytes(4, "little") + h + b"".join(body))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(blob))
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, {}
    for name, dtype, length in json.loads(raw[4 : 4 + n]):
        size = np.dtype(dtype).itemsize
        planes = np.frombuffer(raw, np.uint8, length * size, at).reshape(size, length)
        out[name] = np.ascontiguousarray(planes.T).reshape(-1).view(dtype) if length else np.empty(0, dtype)
        at += length * size
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words, so that any bits can choose a bucket."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def text_batches(batches, limit: int):
    """Joins Arrow batches of (…, text as binary last) to lists of rows of at most `limit` bytes of
    text, one row at least, whatever the sizes of the batches that Spark hands over."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = len(row[-1] or b"")
            if held and size + n > limit:
                yield held
                held, size = [], 0
            held.append(row)
            size += n
    if held:
        yield held


def local_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts, each text's words as indexes into them, and words per text."""
    from array import array

    seen: dict[bytes, int] = {}
    ids, lens = array("i"), np.zeros(len(texts), np.int64)
    put = seen.setdefault
    for k, t in enumerate(texts):
        words = t.split()
        lens[k] = len(words)
        ids.extend([put(w, len(seen)) for w in words])
    return list(seen), np.frombuffer(ids, np.int32) if len(ids) else np.empty(0, np.int32), lens


def hash_words(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
