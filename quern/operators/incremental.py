"""Processing only new or changed records.

State is a versioned table of (key, content hash).  A run hashes the current rows, joins them with the
state, writes down what is new or changed and hands that out; its commit publishes just these records as
the next state version by one atomic rename that refuses to overwrite.  A run that dies before the rename
leaves the old version in force, so the next run sees the same records again; a run that got past it never
sees them again; records that change while a run works are pending for the next.

Defined results: exact duplicate rows are one record; per key the row with the greatest version stamp is
the current one (ties: the greatest hash); a null stamp sorts below all others; hashes compare without
letter case; a null hash equals only a null hash; a null key is a key of its own; empty tables give no
rows (current) or make every record new (state).  Further columns are carried along untouched.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def normal_hash(content_hash: Column) -> Column:
    return F.lower(F.trim(content_hash))


def latest_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One whole row per key: the greatest by ``order`` and then by the other columns.

    A ``max`` over a struct combines on the map side, so a key that holds most rows sends one row per
    map task and no row is sorted.
    """
    rest = [c for c in df.columns if c not in (key, *order)]
    orderable = [c for c in rest if not df.schema[c].dataType.typeName().startswith(("map", "variant"))]
    packed = F.struct(*[F.col(f"`{c}`") for c in (*order, *orderable)])
    best = df.groupBy(F.col(f"`{key}`").alias(key)).agg(F.max(packed).alias("__q_best"))
    return best.select(F.col(f"`{key}`"), *[F.col("__q_best").getField(c).alias(c) for c in (*order, *orderable)]).select(
        *[f"`{c}`" for c in df.columns if c in (key, *order, *orderable)]
    )


def changed_records(current: DataFrame, state: DataFrame, key: str, content_hash: str = "content_hash") -> DataFrame:
    """Rows of ``current`` (one per key) whose hash is absent from, or differs from, ``state(key, hash)``."""
    known = state.select(
        F.col(f"`{key}`").alias("__q_k"), normal_hash(F.col(f"`{content_hash}`")).alias("__q_h"), F.lit(True).alias("__q_known")
    )
    joined = current.join(known, F.col(f"`{key}`").eqNullSafe(F.col("__q_k")), "left")
    fresh = F.col("__q_known").isNull() | ~normal_hash(F.col(f"`{content_hash}`")).eqNullSafe(F.col("__q_h"))
    return joined.where(fresh).select(*[f"`{c}`" for c in current.columns])


def state_from_ledger(ledger: DataFrame, runs: DataFrame, key: str = "path") -> DataFrame:
    """The state left by committed runs: per key, the hash of the highest committed run."""
    committed = runs.where(F.lower(F.trim("status")) == "committed").select("run_id").distinct()
    kept = ledger.select(key, "run_id", "content_hash").join(committed, "run_id")
    return latest_by(kept, key, "run_id").select(key, "content_hash")


class VersionPointer:
    """The file CURRENT under ``root``: names the version in force and is replaced by one atomic rename.

    All file operations go through the Hadoop file system of the session, so ``root`` may be any shared folder.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("CURRENT").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        fs, at = self._fs(), self._path("CURRENT")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            raw = bytes(b & 0xFF for b in stream.readAllBytes())
        finally:
            stream.close()
        return json.loads(raw.decode())["version"]

    def swap(self, version: str) -> None:
        jvm, conf, temp = self.spark._jvm, self.spark._jsc.hadoopConfiguration(), self._path(f"CURRENT.{version}")
        out = self._fs().create(temp, True)
        try:
            out.write(bytearray(json.dumps({"version": version}).encode()))
        finally:
            out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self.spark.sparkContext._gateway.new_array(rename, 1)
        overwrite[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), conf)
        context.rename(context.makeQualified(temp), context.makeQualified(self._path("CURRENT")), overwrite)


class StaleState(RuntimeError):
    """Another run published its state since this one began; nothing of this run was published."""


@dataclass(frozen=True)
class Run:
    """One run: the records it has to process, fixed when it began, and the version of the state it began from."""

    rows: DataFrame
    version: int
    part: str


@dataclass
class StateStore:
    """Versions of the (key, hash) state under ``root``.

    A version is a manifest ``m-<number>.json`` that lists parts, oldest first; the latest part that has a key says
    its hash. A run writes one part, which holds just the records it processed, so its cost does not grow with the
    state; after ``merge_after`` parts they are merged into one. A version is published by renaming its manifest to
    the next number, which fails if that number is taken: of two runs that began from one version, one is published
    and the other raises StaleState, whatever the order. (This needs a file system whose rename is atomic and
    refuses to overwrite, as HDFS; on a local disk it is atomic between checks of one process only.)
    """

    spark: SparkSession
    root: str
    key: str
    content_hash: str = "content_hash"
    merge_after: int = 16

    def __post_init__(self) -> None:
        self.root = self.root.rstrip("/")

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        fs, at = self._fs(), self._path()
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith(prefix)) if fs.exists(at) else []

    def version(self) -> int:
        """The version in force; 0 before the first."""
        names = self._names("m-")
        return int(names[-1][2:-5]) if names else 0

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"parts": [], "key": None}
        stream = self._fs().open(self._path(f"m-{version:012d}.json"))
        try:
            return json.loads(bytes(b & 0xFF for b in stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: int, parts: list[str], key: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        temp, final = self._path(f"t-{uuid.uuid4().hex}"), self._path(f"m-{version:012d}.json")
        out = self._fs().create(temp, False)
        try:
            out.write(bytearray(json.dumps({"parts": parts, "key": key}).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(temp), context.makeQualified(final), none)
        except Exception as e:
            self._fs().delete(temp, False)
            raise StaleState(f"version {version} was published by another run") from e

    def _read(self, manifest: dict) -> DataFrame:
        """(key, hash, gone, seq) of the latest part of each key: one scan over all parts."""
        schema = f"`{self.key}` {manifest['key']}, __q_hash string, __q_gone boolean, __q_seq long"
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in manifest["parts"]])
        return latest_by(rows, self.key, "__q_seq")

    def load(self, version: int | None = None) -> DataFrame | None:
        """The state (key, content_hash) of a version; None before the first."""
        manifest = self._manifest(version)
        if not manifest["parts"]:
            return None
        return self._read(manifest).where("NOT __q_gone").select(F.col(f"`{self.key}`"), F.col("__q_hash").alias(self.content_hash))

    def pending(self, current: DataFrame, forget_missing: bool = False) -> Run:
        """Begin a run on ``current``, one row per key: what is new or changed is written down and stays as it is.

        However often ``rows`` of the run are read, and whatever the source holds by then, they are the records
        this call found. With ``forget_missing`` keys of the state that ``current`` lacks are forgotten by the commit.
        """
        version = self.version()
        state = self.load(version)
        fresh = current if state is None else changed_records(current, state, self.key, self.content_hash)
        hashed = fresh.withColumn("__q_hash", normal_hash(F.col(f"`{self.content_hash}`"))).withColumn("__q_gone", F.lit(False)).withColumn("__q_seq", F.lit(version + 1).cast("long"))
        if forget_missing and state is not None:
            here = current.select(F.col(f"`{self.key}`").alias("__q_k"))
            gone = state.select(F.col(f"`{self.key}`")).join(here, F.col(f"`{self.key}`").eqNullSafe(F.col("__q_k")), "left_anti")
            hashed = hashed.unionByName(gone.withColumn("__q_gone", F.lit(True)).withColumn("__q_seq", F.lit(version + 1).cast("long")), allowMissingColumns=True)
        part = f"p-{uuid.uuid4().hex}"
        hashed.write.parquet(f"{self.root}/{part}")
        rows = self.spark.read.schema(hashed.schema).parquet(f"{self.root}/{part}").where("NOT __q_gone").drop("__q_hash", "__q_gone", "__q_seq")
        return Run(rows, version, part)

    def commit(self, run: Run) -> int:
        """Publish exactly what ``run`` processed; call once its output is durable. Returns the new version.

        A commit that is repeated (after a lost answer, say) changes nothing. Raises StaleState if another run was
        published in between; the records of this run then stay pending.
        """
        now = self.version()
        if now != run.version:
            if run.part in self._manifest(now)["parts"]:
                return now
            raise StaleState(f"the run began from version {run.version}, version {now} is in force")
        parts, key = [*self._manifest(now)["parts"], run.part], run.rows.schema[self.key].dataType.simpleString()
        if len(parts) > self.merge_after:
            whole = f"p-{uuid.uuid4().hex}"
            self._read({"parts": parts, "key": key}).write.parquet(f"{self.root}/{whole}")
            parts = [whole]
        self._publish(now + 1, parts, key)
        return now + 1

    def clear(self, keep_versions: int = 2, older_than_seconds: float = 7 * 86_400) -> int:
        """Remove manifests but the last ones, and parts no kept manifest names that are older than any run may last."""
        fs = self._fs()
        names = self._names("m-")
        kept = names[-max(1, keep_versions) :] if names else []
        used = {p for n in kept for p in self._manifest(int(n[2:-5]))["parts"]}
        gone = [n for n in names if n not in kept]
        for n in [*self._names("p-"), *self._names("t-")]:
            if n not in used and fs.getFileStatus(self._path(n)).getModificationTime() / 1000 <= time.time() - older_than_seconds:
                gone.append(n)
        for n in gone:
            fs.delete(self._path(n), True)
        return len(gone)

    def adopt(self, history: DataFrame, run: str) -> int:
        """Publish the history of runs kept elsewhere, (key, content_hash, run number): one part for all of them.

        Only for a store without versions; per key the highest run counts.
        """
        rows = history.select(
            F.col(f"`{self.key}`"), normal_hash(F.col(f"`{self.content_hash}`")).alias("__q_hash"), F.lit(False).alias("__q_gone"), F.col(f"`{run}`").cast("long").alias("__q_seq")
        )
        last = rows.agg(F.max("__q_seq")).first()[0] or 0
        part = f"p-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{part}")
        if self.version():
            raise StaleState("the store has versions already")
        # Later runs count from here, so that their parts are later than all of these.
        self._publish(max(1, last), [part], history.schema[self.key].dataType.simpleString())
        return self.version()
