"""Tables that the plans write and read."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share. Only a local master may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-logloom-"))
    return "file://" + _LOCAL[0]


def materialised(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once, so that all that is derived from it reads the same rows and no part is computed twice."""
    path = f"{shared_dir(df.sparkSession)}/logloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_materialised(spark: SparkSession) -> int:
    """Removes what ``materialised`` wrote, once the results that read it are stored; the registered queries share such tables within a
    session, so after the last of them. Returns how many tables."""
    paths = [_WRITTEN.pop() for _ in range(len(_WRITTEN))]
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """Appends to a parquet table, split by a column's values where one is given."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def _where(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _where(spark, path)
    return files.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing where there is none."""
    where, files = _where(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    where, files = _where(spark, path)
    files.delete(where, True)


def put(rows: DataFrame, path: str, form: str = "parquet", options: dict[str, str] | None = None) -> None:
    """Writes a folder whole: beside its place under a name that readers skip, then renamed. What was there before goes."""
    spark, (parent, _, name) = rows.sparkSession, path.rstrip("/").rpartition("/")
    draft = f"{parent}/_{name}-{uuid.uuid4().hex}"
    rows.write.format(form).options(**(options or {})).save(draft)
    remove(spark, path)
    where, files = _where(spark, path)
    files.mkdirs(where.getParent())
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(draft), where):
        raise OSError(f"{draft} cannot become {path}")


def append_ledger(batches: DataFrame, path: str, run: int | None = None) -> None:
    """Appends sealed batches to a ledger of JSON lines; those of a ``run`` in a folder of its own, so a run that is repeated adds no line twice."""
    if run is None:
        batches.write.mode("append").json(path)
    else:
        put(batches.coalesce(1), f"{path}/run={run}", "json")


_CURRENT = "_current"  # the pointer's name, which readers of data skip


def _text(spark: SparkSession, path: str) -> str:
    where, files = _where(spark, path)
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _pointer(spark: SparkSession, path: str) -> dict[str, int]:
    """Version by bucket, of the newest whole pointer."""
    found = [n for n in names(spark, f"{path}/{_CURRENT}") if n.isdigit()]
    return json.loads(_text(spark, f"{path}/{_CURRENT}/{found[-1]}")) if found else {}


def version(spark: SparkSession, path: str) -> int | None:
    """The number of the pointer that counts; it grows with each ``upsert``."""
    found = [int(n) for n in names(spark, f"{path}/{_CURRENT}") if n.isdigit()]
    return max(found, default=None)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table that ``upsert`` keeps; None before its first rows."""
    folders = [f"{path}/version={v}/bucket={b}" for b, v in _pointer(spark, path).items()]
    return spark.read.parquet(*folders) if folders else None


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def touching(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> DataFrame | None:
    """What a table that ``upsert`` keeps has of the keys of ``rows``; None before its first rows. Only buckets that may have them are read."""
    spark, new = rows.sparkSession, _bucketed(rows.select(*keys), keys, buckets)
    at, touched = _pointer(spark, path), [str(r.bucket) for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
    folders = [f"{path}/version={at[b]}/bucket={b}" for b in touched if b in at]
    if not folders:
        return None if not at else current(spark, path).limit(0)
    kept, asked = spark.read.parquet(*folders), new.distinct()
    return kept.join(asked, [kept[k].eqNullSafe(asked[k]) for k in keys], "left_semi")


def upsert(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> list[int]:
    """Puts ``rows`` into a table: they replace all rows of their keys. Returns the buckets that were written anew.

    The table lies in ``buckets`` by hash of the keys, a folder for each version of each. Only buckets that ``rows`` touch are read and written;
    then a new pointer, written beside and renamed, says which version of each bucket counts. A run that is broken off leaves the old
    pointer, so readers see the state before. Versions that no pointer names go with the next run but one, when their readers are done.
    """
    spark = rows.sparkSession
    at, new_version = _pointer(spark, path), 1 + max((int(n.partition("=")[2]) for n in names(spark, path) if n.startswith("version=")), default=0)
    new = materialised(_bucketed(rows, keys, buckets), "upsert")
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most ``buckets``
    if not touched:
        return []
    old = [f"{path}/version={at[str(b)]}/bucket={b}" for b in touched if str(b) in at]
    if old:
        kept = _bucketed(spark.read.parquet(*old), keys, buckets)
        same = [kept[k].eqNullSafe(new[k]) for k in keys]
        new = new.unionByName(kept.join(new, [kept["bucket"] == new["bucket"], *same], "left_anti").select(*new.columns))
    new.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{path}/version={new_version}")
    for b in touched:
        at[str(b)] = new_version
    _write_text(spark, f"{path}/{_CURRENT}/{new_version:09d}", json.dumps(at))
    pointers = [n for n in names(spark, f"{path}/{_CURRENT}") if n.isdigit()]
    for stale in pointers[:-2]:
        remove(spark, f"{path}/{_CURRENT}/{stale}")
    named = {(v, b) for n in pointers[-2:] for b, v in json.loads(_text(spark, f"{path}/{_CURRENT}/{n}")).items()}
    for v in names(spark, path):
        for b in names(spark, f"{path}/{v}") if v.startswith("version=") else ():
            if b.startswith("bucket=") and (int(v.partition("=")[2]), b.partition("=")[2]) not in named:
                remove(spark, f"{path}/{v}/{b}")
    return touched


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed."""
    draft, files = _where(spark, f"{path}-draft")
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(draft, spark._jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"no pointer {path}")
