"""Tables by day with versions: merges rewrite only the days they touch, and appear at once.

Below the table's folder, ``data/commit=<id>/<day column>=<day>/`` holds what one commit wrote and is
never changed; ``manifests/<version>.json`` names the folder of each day of a version, the last
batch of each writer, and notes. A version exists once its manifest does: it is created only if no
other writer has created that number before, and a manifest that was cut short is none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A day's rows are written by up to so many tasks.
TASKS_OF_A_DAY = 8


class Conflict(RuntimeError):
    """Another writer has made this version first."""


@dataclass
class Manifest:
    version: int = 0
    days: dict[str, str] = field(default_factory=dict)  # day -> folder below data/
    batches: dict[str, int] = field(default_factory=dict)  # writer -> the last batch it has brought
    notes: dict = field(default_factory=dict)
    schema: str = ""  # of the rows, as JSON


class VersionedTable:
    """A table partitioned by the date column ``day``. Its schema is fixed; other columns of merged rows are an error."""

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType, day: str = "service_date"):
        self.spark, self.root, self.day = spark, root.rstrip("/"), day
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = jvm.org.apache.commons.io.IOUtils

    @classmethod
    def existing(cls, spark: SparkSession, root: str, day: str = "service_date") -> VersionedTable | None:
        """The table below ``root`` with the schema it was made with, if it has a version."""
        table = cls(spark, root, StructType(), day)
        schema = table.manifest().schema
        if not schema:
            return None
        table.schema = StructType.fromJson(json.loads(schema))
        return table

    # --- manifests ---------------------------------------------------------------------------
    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(n[:-5]) for s in self._fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """Of the given version, else of the last whole one; an empty one if there is none."""
        for n in reversed(self.versions()) if version is None else [version]:
            stream = self._fs.open(self._path(f"{self.root}/manifests/{n:012d}.json"))
            try:
                return Manifest(**json.loads(self._text.toString(stream, "UTF-8")))
            except (ValueError, TypeError):
                if version is not None:
                    raise
            finally:
                stream.close()
        return Manifest()

    def _publish(self, manifest: Manifest) -> None:
        path = self._path(f"{self.root}/manifests/{manifest.version:012d}.json")
        if self._fs.exists(path):
            raise Conflict(str(path))
        stream = self._fs.create(path, False)  # fails if it has come to be meanwhile
        try:
            stream.write(bytearray(json.dumps(vars(manifest)).encode()))
        finally:
            stream.close()

    # --- reading -----------------------------------------------------------------------------
    def folders(self, version: int | None = None) -> dict[str, str]:
        return dict(self.manifest(version).days)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        base = f"{self.root}/data"
        rows = self.spark.read.option("basePath", base).schema(self.schema).parquet(*[f"{base}/{f}" for f in sorted(folders)])
        return rows.select(*self.schema.names)

    def read(self, version: int | None = None, days: list[str] | None = None) -> DataFrame:
        """The rows of a version, of all its days or of the given ones."""
        held = self.folders(version)
        return self._read([f for d, f in held.items() if days is None or d in days])

    # --- writing -----------------------------------------------------------------------------
    def stage(self, rows: DataFrame) -> dict[str, str]:
        """Write rows where no version has them yet; the folder of each of their days. Rows without a day are left out."""
        commit = f"commit={uuid.uuid4().hex}"
        path = f"{self.root}/data/{commit}"
        whole = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).where(F.col(self.day).isNotNull())
        # A day's rows go to several tasks, so that a large day is not one task's.
        spread = F.pmod(F.xxhash64(*[c for c in self.schema.names if c != self.day]), F.lit(TASKS_OF_A_DAY))
        whole.repartition(F.col(self.day), spread).write.partitionBy(self.day).parquet(path)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(path))]
        return {n.split("=", 1)[1]: f"{commit}/{n}" for n in names if n.startswith(f"{self.day}=")}

    def publish(self, found: Manifest, folders: dict[str, str | None], writer: str = "", batch: int | None = None, notes: dict | None = None) -> Manifest:
        """Make a version out of the one found: the named days have these folders (None: the day goes), all others keep theirs.

        Conflict if another version has come since ``found`` was read.
        """
        if self.manifest().version != found.version:
            raise Conflict(f"a version has come since {found.version}")
        days = {d: f for d, f in (found.days | folders).items() if f is not None}
        batches = found.batches if batch is None else found.batches | {writer: batch}
        made = Manifest(max([found.version, *self.versions()]) + 1, days, batches, found.notes | (notes or {}), self.schema.json())
        self._publish(made)
        return made

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], writer: str = "", batch: int | None = None, notes: dict | None = None) -> bool:
        """Merge rows by ``how(known, new)``, which gets and gives rows of the days that ``new`` touches, and no others.

        A batch that its writer has brought already, or an older one, changes nothing: False. The
        days are a few values, whatever the size of ``new``, which is read twice: hand in stored rows.
        """
        found = self.manifest()
        if batch is not None and batch <= found.batches.get(writer, -1):
            return False
        days = sorted(str(r[0]) for r in new.select(self.day).distinct().collect() if r[0] is not None)
        written = self.stage(how(self._read([found.days[d] for d in days if d in found.days]), new)) if days else {}
        if stray := set(written) - set(days):
            raise ValueError(f"rows of days that the batch doesn't touch: {sorted(stray)[:5]}")
        self.publish(found, dict.fromkeys(days) | written, writer, batch, notes)
        return True
