"""Deltas of micro-batches under one manifest, merged level by level while the stream writes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

FAN = 8  # deltas of one level that are merged into one of the next
KEEP = 32  # commits for which files that are no longer live stay, for readers under way

Reduce = Callable[[DataFrame], DataFrame]


class Manifest(NamedTuple):
    """What is committed: the last micro-batch, seeds, live deltas by level, retired ones, and the writer's note."""

    version: int = 0
    batch: int = -1
    seeds: tuple[int, ...] = ()
    deltas: tuple[tuple[int, str], ...] = ()  # level, folder
    retired: tuple[tuple[int, str], ...] = ()  # version that dropped it, folder
    note: dict[str, Any] = {}


class DeltaLog:
    """Folder of deltas, of which a manifest names the live ones.

    A batch writes its delta into a folder of a new name, merges levels that hold ``fan`` deltas, and commits
    by renaming one small file to the next version; readers take the highest version. What fails before the
    rename leaves only unnamed folders, so nothing is lost or doubled, and the next cleaning removes them. After n batches at most
    (fan - 1) * log(n) + 1 deltas are live, and a row has been rewritten log(n) times, logarithms to base ``fan``.

    One writer at a time. A repeat of the last batch or of a seed (a batch below 0) changes nothing; older
    numbers mean that the stream lost its checkpoint, and raise. A DataFrame that was read stays good for ``keep`` commits.
    """

    def __init__(self, path: str, schema: str, fan: int = FAN, keep: int = KEEP):
        self.path, self.schema, self.fan, self.keep = path.rstrip("/"), schema, fan, keep

    def manifest(self, spark: SparkSession) -> Manifest:
        found = self._versions(spark)
        return self._load(spark, max(found)) if found else Manifest()

    def read(self, spark: SparkSession) -> DataFrame:
        """Rows of all live deltas."""
        return self._rows(spark, [name for _, name in self.manifest(spark).deltas])

    def has(self, spark: SparkSession, batch_id: int) -> bool:
        """Whether the batch is committed."""
        return self._done(self.manifest(spark), batch_id)

    def append(self, rows: DataFrame, batch_id: int, reduce: Reduce, note: dict[str, Any] | None = None) -> None:
        """Commit ``rows`` as the delta of ``batch_id``, with ``note``; ``reduce`` maps the rows of several
        deltas to those that still matter, and must not mind which deltas it gets together."""
        spark = rows.sparkSession
        now = self.manifest(spark)
        if self._done(now, batch_id):
            return
        deltas, dropped = [*now.deltas, (0, self._write(rows))], []
        level = 0
        while len(full := [name for at, name in deltas if at == level]) >= self.fan:
            merged = self._write(reduce(self._rows(spark, full)))
            deltas = [(at, name) for at, name in deltas if at != level] + [(level + 1, merged)]
            dropped += full
            level += 1
        version = now.version + 1
        due = [name for at, name in now.retired if at <= version - self.keep]
        after = Manifest(
            version, max(now.batch, batch_id), tuple({*now.seeds, *([batch_id] if batch_id < 0 else [])}), tuple(deltas),
            tuple((at, name) for at, name in now.retired if name not in due) + tuple((version, name) for name in dropped),
            now.note if note is None else note,
        )
        self._commit(spark, after)
        if dropped or due:
            self._clean(spark, after)

    def _done(self, now: Manifest, batch_id: int) -> bool:
        if batch_id < 0:
            return batch_id in now.seeds
        if batch_id < now.batch:
            raise ValueError(f"batch {batch_id} after {now.batch}: {self.path} belongs to another checkpoint")
        return batch_id == now.batch

    def _rows(self, spark: SparkSession, names: list[str]) -> DataFrame:
        if not names:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/deltas/{name}" for name in names])

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/deltas/{name}")
        return name

    def _files(self, spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()), at

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        files, at = self._files(spark, f"{self.path}/{folder}")
        return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def _versions(self, spark: SparkSession) -> list[int]:
        return [int(name) for name in self._names(spark, "manifests") if name.isdigit()]

    def _load(self, spark: SparkSession, version: int) -> Manifest:
        files, at = self._files(spark, f"{self.path}/manifests/{version}")
        stream = files.open(at)
        try:
            fields = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        pairs = {k: tuple(tuple(p) for p in fields[k]) for k in ("deltas", "retired")}
        return Manifest(**fields | pairs | {"seeds": tuple(fields["seeds"])})

    def _commit(self, spark: SparkSession, manifest: Manifest) -> None:
        files, draft = self._files(spark, f"{self.path}/manifests/_draft-{uuid.uuid4().hex}")
        stream = files.create(draft)
        stream.write(bytearray(json.dumps(manifest._asdict()).encode()))
        stream.close()
        target = self._files(spark, f"{self.path}/manifests/{manifest.version}")[1]
        if files.exists(target) or not files.rename(draft, target):
            raise RuntimeError(f"{target} is there already: two writers on one table")

    def _clean(self, spark: SparkSession, now: Manifest) -> None:
        """Remove old manifests and every delta that none of the last ``keep`` commits names."""
        used = {name for _, name in (*now.deltas, *now.retired)}
        old = [f"deltas/{name}" for name in self._names(spark, "deltas") if name not in used]
        old += [f"manifests/{v}" for v in self._versions(spark) if v <= now.version - self.keep]
        for path in old:
            files, at = self._files(spark, f"{self.path}/{path}")
            files.delete(at, True)


class ReducedTable:
    """Table fed by micro-batches, of which only the rows that ``reduce`` keeps still matter."""

    def __init__(self, path: str, schema: str, fan: int = FAN, keep: int = KEEP):
        self.path, self.schema = path, schema
        self.log = DeltaLog(path, schema, fan, keep)

    def reduce(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def write(self, rows: DataFrame, batch_id: int) -> None:
        columns = [c.strip().split()[0] for c in self.schema.split(",")]
        if not self.log.has(rows.sparkSession, batch_id):
            self.log.append(self.reduce(rows.select(*columns)), batch_id, self.reduce)

    def changes(self, spark: SparkSession) -> DataFrame:
        return self.log.read(spark)
