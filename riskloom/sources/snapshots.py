"""Score log with atomic commits.

A log is a folder with data and versions: ``score_commit=<id>/score_date=<day>/`` holds the rows that one
commit wrote for a day, ``versions/<number>`` says which commit's folder counts for each day (one line a day). A
commit first writes its day folders, which no version names yet, and then publishes the next version by one rename that
fails if the number is taken. So readers see the version before or the one after, whatever
happens in between, and of two writers that began from the same version the second is refused and leaves no trace.

Days without a replaced or new row keep their folder. Rows without ``scored_at`` have a day folder of
their own. The columns of a log are those of its latest version; a batch may bring new ones, null in older rows.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.operators.prefix import stored

DAY, COMMIT = "score_date", "score_commit"


class WriteConflict(RuntimeError):
    """Another writer has published a version since this commit began."""


class Version(NamedTuple):
    number: int
    schema: StructType | None
    days: dict[str, str]          # day folder -> commit

    def text(self) -> str:
        return "\n".join([self.schema.json(), *(json.dumps(x) for x in sorted(self.days.items()))])


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list:
    p, fs = _files(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The latest version, or the one of that number; number 0 is the empty log."""
    if number is None:
        number = max((int(s.getPath().getName()) for s in _names(spark, f"{path}/versions")
                      if re.fullmatch(r"\d{12}", s.getPath().getName())), default=0)
    if not number:
        return Version(0, None, {})
    head, *days = spark.read.text(f"{path}/versions/{number:012d}", wholetext=True).first()[0].split("\n")
    return Version(number, StructType.fromJson(json.loads(head)), dict(json.loads(x) for x in days))


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The rows of a version (default: the latest), with ``score_date``; None before the first commit.
    One scan over the day folders it names, so filters on the day prune them."""
    return _rows(spark, path, version(spark, path, number))


def _rows(spark: SparkSession, path: str, v: Version) -> DataFrame | None:
    if v.schema is None:
        return None
    if not v.days:
        return spark.createDataFrame([], v.schema)
    folders = [f"{path}/{COMMIT}={commit}/{day}" for day, commit in sorted(v.days.items())]
    return (spark.read.schema(StructType(v.schema.fields).add(COMMIT, "string")).option("basePath", path)
            .parquet(*folders).drop(COMMIT).select(*v.schema.names))


def stage(spark: SparkSession, batch: DataFrame, path: str, key: str = "transaction_id") -> Version:
    """Write what the log is after ``batch`` and return the version that would say so; nothing is
    visible before :func:`publish`. Of the rows of one id in the batch the latest (``scored_at``, then score)
    counts, and it replaces every row of that id in the log, whatever its day."""
    before = version(spark, path)
    latest = Window.partitionBy(key).orderBy(F.col("scored_at").desc_nulls_last(), F.col("fraud_score").desc_nulls_last())
    new = stored(batch.drop(DAY, COMMIT).withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")
                 .withColumn(DAY, F.to_date("scored_at")), "score-batch")
    old, rows, touched = _rows(spark, path, before), new, []
    if old is not None:
        mine = new.select(F.col(key).alias("_key"))
        same = F.col(key).eqNullSafe(F.col("_key"))
        days = old.join(mine, same, "left_semi").select(DAY).union(new.select(DAY)).distinct()
        # one value a day of the log
        touched = [r[0] for r in days.collect()]
        kept = old.where(F.col(DAY).isin([d for d in touched if d is not None]) | (F.col(DAY).isNull() & F.lit(None in touched)))
        rows = kept.join(mine, same, "left_anti").unionByName(new, allowMissingColumns=True)
    commit = uuid.uuid4().hex
    rows.write.partitionBy(DAY).parquet(f"{path}/{COMMIT}={commit}")
    written = {s.getPath().getName() for s in _names(spark, f"{path}/{COMMIT}={commit}") if s.isDirectory()}
    gone = {f"{DAY}={d.isoformat() if d is not None else '__HIVE_DEFAULT_PARTITION__'}" for d in touched}
    after = {d: c for d, c in before.days.items() if d not in gone} | {d: commit for d in written}
    return Version(before.number + 1, rows.schema, after)


def publish(spark: SparkSession, path: str, v: Version) -> None:
    """Make a staged version the latest. Raises :class:`WriteConflict` if its number is taken."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    draft, fs = _files(spark, f"{path}/versions/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(v.text().encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    target, _ = _files(spark, f"{path}/versions/{v.number:012d}")
    try:
        # unlike FileSystem.rename this one fails where the target exists
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, target, options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise WriteConflict(f"version {v.number} of {path} was published by another writer") from e
        raise


def commit(spark: SparkSession, batch: DataFrame, path: str) -> int:
    """Replace and add the rows of ``batch`` as one new version; returns its number."""
    v = stage(spark, batch, path)
    try:
        publish(spark, path, v)
    except WriteConflict:
        _drop(spark, path, set(v.days.values()) - set(version(spark, path, v.number - 1).days.values()))
        raise
    return v.number


def _drop(spark: SparkSession, path: str, commits: set[str]) -> None:
    for c in commits:
        p, fs = _files(spark, f"{path}/{COMMIT}={c}")
        fs.delete(p, True)


def clean(spark: SparkSession, path: str, keep: int = 2, older_than_hours: float = 24.0) -> int:
    """Delete versions but the latest ``keep`` and the commits that no kept version names and that are older than
    ``older_than_hours`` (younger ones may be staged by a writer); returns the number of deleted commits."""
    last = version(spark, path).number
    used: set[str] = set()
    for s in _names(spark, f"{path}/versions"):
        name = s.getPath().getName()
        if re.fullmatch(r"\d{12}", name):
            if int(name) > last - keep:
                used |= set(version(spark, path, int(name)).days.values())
            else:
                _files(spark, f"{path}/versions/{name}")[1].delete(s.getPath(), False)
    limit = (time.time() - 3600 * older_than_hours) * 1000
    found = {s.getPath().getName().partition("=")[2] for s in _names(spark, path)
             if s.getPath().getName().startswith(f"{COMMIT}=") and s.getModificationTime() <= limit}
    _drop(spark, path, found - used)
    return len(found - used)
