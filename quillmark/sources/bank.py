"""A bank of questions that stays unique whoever appends, and however often.

    data/<id>/__bucket=<n>/   the rows of one append, with their key
    _commits/<version>.json   the folders that count at that version, and the names of the batches that are in

Readers take the folders of the latest version, so what an append writes is seen as a whole or not at all. A writer writes its folder first and then creates the next
version's file; a name that exists can't be created, so of two writers one comes too late: it takes out what the other brought in the meantime and tries again.
A writer that dies leaves a folder that no version names. Renaming must be atomic and refuse existing names, as it does on HDFS and local disks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


def _files(spark: SparkSession, path: str):
    """(a function that makes a path, its file system, its file context)."""
    fs = spark._jvm.org.apache.hadoop.fs
    at, conf = fs.Path(path), spark._jsc.hadoopConfiguration()
    system = at.getFileSystem(conf)
    return fs.Path, system, fs.FileContext.getFileContext(system.getUri(), conf)


def version_of(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(latest version, its manifest); 0 and an empty one for a bank that isn't there yet."""
    make, system, _ = _files(spark, path)
    log = make(f"{path}/_commits")
    names = [f.getPath().getName() for f in system.listStatus(log)] if system.exists(log) else []
    versions = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
    if not versions:
        return 0, {"folders": [], "batches": []}
    return versions[-1], json.loads(spark.read.text(f"{path}/_commits/{versions[-1]:012d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, version: int, manifest: dict) -> bool:
    """Whether this writer was the one to create the version."""
    make, system, context = _files(spark, path)
    draft, final = make(f"{path}/_drafts/{uuid.uuid4().hex}"), make(f"{path}/_commits/{version:012d}.json")
    out = system.create(draft, True)
    out.write(json.dumps(manifest).encode())
    out.close()
    system.mkdirs(final.getParent())
    try:
        context.rename(draft, final, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        system.delete(draft, False)
        return False
    return True


def _folders(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", True).option("basePath", f"{path}/data").parquet(*(f"{path}/data/append={f}" for f in folders))


def read_committed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The bank's rows at its latest version, or at an earlier one; None if nothing was ever appended."""
    latest, manifest = version_of(spark, path)
    if version is not None and version != latest:
        manifest = json.loads(spark.read.text(f"{path}/_commits/{version:012d}.json", wholetext=True).first()[0])
    return _folders(spark, path, manifest["folders"]).drop("__key", "__bucket", "append") if manifest["folders"] else None


def append_unique(path: str, incoming: DataFrame, key: Callable[[DataFrame], Column], order: str, batch: str | None = None, buckets: int = BUCKETS, before_commit: Callable[[], None] | None = None) -> int:
    """[K3, D3] Append the rows whose key the bank lacks, the first by `order` of each key; returns how many. All columns are kept; rows with a null key stay out.

    batch: a name; a batch that is in already is not appended again. Without one, a repeated append finds its keys in the bank. Only buckets that incoming rows fall
    into are read. `buckets` must be the same for all appends of a bank. before_commit is called when the rows are written and not yet counted in.
    """
    spark = incoming.sparkSession
    keyed = incoming.withColumn("__key", key(incoming)).filter(F.col("__key").isNotNull())
    # The first of a key is an aggregate; all columns travel as one struct.
    first = keyed.groupBy("__key").agg(F.min_by(F.struct(*incoming.columns), F.struct(F.col(order), F.struct(*(F.col(c).cast("string") for c in incoming.columns)))).alias("r"))
    rows = first.select("r.*", "__key", F.pmod(F.xxhash64("__key"), F.lit(buckets)).cast("int").alias("__bucket"))
    version, manifest = version_of(spark, path)
    if batch is not None and batch in manifest["batches"]:
        return 0
    rows = _lacking(spark, path, rows, manifest["folders"])
    while True:
        own = uuid.uuid4().hex
        rows.repartition(buckets, "__bucket").write.partitionBy("__bucket").parquet(f"{path}/data/append={own}")
        made, system, _ = _files(spark, path)
        some = any(f.getPath().getName().startswith("__bucket=") for f in system.listStatus(made(f"{path}/data/append={own}")))
        n = _folders(spark, path, [own]).count() if some else 0
        if before_commit is not None:
            before_commit()
        if not n and batch is None:
            return 0
        if _commit(spark, path, version + 1, {"folders": manifest["folders"] + [own] * bool(n), "batches": manifest["batches"] + ([batch] if batch else [])}):
            return n
        # Another writer was first: what it brought is taken out of what this one has written.
        known = set(manifest["folders"])
        version, manifest = version_of(spark, path)
        if batch is not None and batch in manifest["batches"]:
            return 0
        if n:
            rows = _lacking(spark, path, _folders(spark, path, [own]).drop("append"), [f for f in manifest["folders"] if f not in known])


def _lacking(spark: SparkSession, path: str, rows: DataFrame, folders: list[str]) -> DataFrame:
    if not folders:
        return rows
    told = [r[0] for r in rows.select("__bucket").distinct().collect()]  # buckets, a fixed number at most
    return rows.join(_folders(spark, path, folders).filter(F.col("__bucket").isin(told)).select("__key"), "__key", "left_anti")
