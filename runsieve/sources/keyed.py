"""Keyed tables in a shared folder: a base per key bucket, deltas of later writes, versioned manifests.

A write stores its rows as one new segment, a folder of Parquet files by key bucket, and then publishes the next
manifest, a small JSON file that lists the segments of that version. A reader takes one manifest, so it sees a
write whole or not at all. Files are never changed or deleted: a version stays readable after compaction, and a
writer that dies before it publishes leaves only files that no manifest names. Publishing needs a file system whose rename is atomic (HDFS and the like).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsieve.operators.ranking import latest_by

#: Writers that lose the race for a version try the next one this often.
ATTEMPTS = 20
_EMPTY = {"version": 0, "segments": [], "applied": {}}


class ConflictError(RuntimeError):
    """A version could not be published because other writers were always first."""


@dataclass(frozen=True)
class KeyedTable:
    """A table with one current row per ``keys``, below ``path``.

    ``schema`` lists the keys and the other columns. ``bucket_by`` (default: the keys) names the columns whose
    hash gives the bucket; rows that are read together should share them. The number of buckets is fixed
    when the table is made: choose it so that a bucket of the largest expected table fits a few tasks.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    bucket_by: tuple[str, ...] = ()
    buckets: int = 16

    def __post_init__(self) -> None:
        if {"seg", "bucket"} & {f.name.lower() for f in self._fields()}:
            raise ValueError("the columns seg and bucket are used by the folder layout")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.bucket_by or self.keys)), F.lit(self.buckets)).cast("int")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf)

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/versions/v{version:012d}.json"

    def latest_version(self) -> int:
        """The last published version, 0 before the first write."""
        at, fc = self._fs(f"{self.path}/versions")
        if not fc.util().exists(at):
            return 0
        names = [status.getPath().getName() for status in fc.util().listStatus(at)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """Segments (name, version of the write, base or delta, buckets) and applied batches of a version."""
        version = self.latest_version() if version is None else version
        if version == 0:
            return json.loads(json.dumps(_EMPTY))
        rows = self.spark.read.text(self._manifest_path(version), wholetext=True).take(1)
        return json.loads(rows[0].value)

    def _publish(self, manifest: dict) -> bool:
        """Make a manifest visible under its version; false if that version exists already.

        The text is written beside it and renamed: a rename without overwriting has one winner.
        """
        spare, fc = self._fs(f"{self.path}/pending/{uuid.uuid4().hex}")
        final, _ = self._fs(self._manifest_path(manifest["version"]))
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        fs = spare.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(final.getParent())
        out = fs.create(spare, False)
        out.write(json.dumps(manifest).encode("utf-8"))
        out.close()
        try:
            fc.rename(spare, final, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as exc:
            if "FileAlreadyExistsException" not in exc.java_exception.toString():
                raise
            return False
        return True

    def _store(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Write rows as a segment; its name and the buckets that it holds."""
        name = uuid.uuid4().hex
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self._fields()]
        dealt = rows.select(*columns, self._bucket().alias("bucket")).hint("rebalance", "bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/data/seg={name}")
        at, fc = self._fs(f"{self.path}/data/seg={name}")
        found = [status.getPath().getName() for status in fc.util().listStatus(at)]
        return name, sorted(int(n.split("=")[1]) for n in found if n.startswith("bucket="))

    def _fields(self) -> list[T.StructField]:
        return T.StructType.fromDDL(self.schema).fields

    def upsert(self, rows: DataFrame, order: list[str] | None = None, writer: str | None = None, batch_id: int | None = None) -> int:
        """Replace or add the rows of ``rows`` by key; the version that holds them.

        ``order`` (columns of ``rows``, a total order) tells which row of a repeated key counts; without it keys must
        not repeat. With ``writer`` and ``batch_id`` a batch that this writer has applied is skipped, so that
        a replayed micro-batch changes nothing.
        """
        if writer is not None and self.manifest()["applied"].get(writer, -1) >= batch_id:
            return self.latest_version()
        if order is not None:
            columns = [f.name for f in self._fields() if f.name not in self.keys]
            rows = latest_by(rows, list(self.keys), order, columns)
        name, held = self._store(rows)
        for _ in range(ATTEMPTS):
            now = self.manifest()
            if writer is not None and now["applied"].get(writer, -1) >= batch_id:
                return now["version"]
            now["version"] += 1
            now["segments"].append({"name": name, "seq": now["version"], "base": False, "buckets": held})
            if writer is not None:
                now["applied"][writer] = batch_id
            if self._publish(now):
                return now["version"]
        raise ConflictError(f"{self.path}: no version was free in {ATTEMPTS} attempts")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Current rows, or those of an earlier version; ``buckets`` limits the files that are read.

        Buckets without deltas are read as they are; only the others are merged by key.
        """
        pieces: dict[int, list[dict]] = {}
        for segment in self.manifest(version)["segments"]:
            for b in segment["buckets"]:
                if buckets is None or b in buckets:
                    pieces.setdefault(b, []).append(segment)
        plain = [(b, held[0]) for b, held in pieces.items() if len(held) == 1]
        merged = [(b, segment) for b, held in pieces.items() if len(held) > 1 for segment in held]
        out = self._files(plain).drop("_seq")
        if not merged:
            return out
        columns = [f.name for f in self._fields()]
        others = [c for c in columns if c not in self.keys]
        newest = latest_by(self._files(merged), list(self.keys), ["_seq"], others)
        return out.unionByName(newest.select(columns))

    def _files(self, parts: list[tuple[int, dict]]) -> DataFrame:
        """Rows of (bucket, segment) folders with the version ``_seq`` of their write."""
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*self._fields(), T.StructField("_seq", T.LongType())]))
        full = T.StructType([*self._fields(), T.StructField("seg", T.StringType()), T.StructField("bucket", T.IntegerType())])
        paths = [f"{self.path}/data/seg={segment['name']}/bucket={b}" for b, segment in parts]
        rows = self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths)
        written = {segment["name"]: segment["seq"] for _, segment in parts}
        seq = F.create_map(*[F.lit(v) for pair in written.items() for v in pair])[F.col("seg")]
        return rows.select(*[f.name for f in self._fields()], seq.cast("bigint").alias("_seq"))

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Current rows whose ``bucket_by`` columns (default: keys) are in ``keys``.

        Only the buckets of these keys are read; the driver learns bucket numbers, at most ``buckets`` of them.
        """
        named = list(self.bucket_by or self.keys)
        wanted = keys.select(*named).distinct()
        held = [r[0] for r in wanted.select(self._bucket().alias("b")).distinct().collect()]
        rows, names = self.read(version, held), [f.name for f in self._fields()]
        on = [rows[c].eqNullSafe(wanted[c]) for c in named]
        return rows.join(wanted, on, "left_semi").select(names)

    def compact(self, deltas: int = 1) -> int:
        """Rewrite the buckets with ``deltas`` or more deltas as one base each; the version that holds them.

        Writes that are published meanwhile stay deltas above the new base.
        """
        seen = self.manifest()
        counts: dict[int, list[dict]] = {}
        for segment in seen["segments"]:
            for b in segment["buckets"]:
                counts.setdefault(b, []).append(segment)
        touched = sorted(b for b, held in counts.items() if sum(not s["base"] for s in held) >= deltas)
        if not touched:
            return seen["version"]
        name, held = self._store(self.read(seen["version"], touched))
        replaced = {(s["name"], b) for b in touched for s in counts[b]}
        for _ in range(ATTEMPTS):
            now = self.manifest()
            kept = []
            for segment in now["segments"]:
                left = [b for b in segment["buckets"] if (segment["name"], b) not in replaced]
                missing = [b for b in touched if b in segment["buckets"] and b in left and segment["seq"] <= seen["version"]]
                if missing:
                    raise ConflictError(f"{self.path}: another compaction rewrote buckets {missing}")
                if left:
                    kept.append({**segment, "buckets": left})
            now["version"] += 1
            # The base ranks below every write that it does not hold.
            now["segments"] = [{"name": name, "seq": seen["version"], "base": True, "buckets": held}, *kept]
            if self._publish(now):
                return now["version"]
        raise ConflictError(f"{self.path}: no version was free in {ATTEMPTS} attempts")
