"""A keyed table kept as a log of changes, in storage that shrinks.

Every micro-batch writes the rows of the keys it changed to ``log/epoch=<id>``.
A manifest names what a reader has to read: one snapshot and the epochs after it.
It is published by renaming a finished file, so a reader sees the table before
or after a batch and nothing between. With ``compact_every`` epochs in the log
the batch also writes the newest row of every key as ``snapshot/upto=<id>``, and
its manifest names no epoch.

A batch that is replayed after its manifest was published is done already; before
that, nobody has read its files and it writes them again. After publishing, all
files that neither the new nor the last manifest names are removed: a reader may
go on for one more batch, and the folder holds no more than two snapshots and
about ``compact_every`` epochs, however long the stream runs.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folder import Folder

COMPACT_EVERY = 50


class ChangeLog:
    def __init__(self, spark: SparkSession, out_dir: str, key: list[str], compact_every: int = COMPACT_EVERY):
        self.spark, self.out_dir, self.key, self.compact_every = spark, out_dir, key, compact_every
        self.folder = Folder(spark, out_dir)

    def manifest(self) -> dict | None:
        """The newest manifest: epoch, snapshot (or None), epochs, note."""
        names = self.folder.names("manifest")
        return json.loads(self.folder.read(f"manifest/{names[-1]}")) if names else None

    def append(self, rows: DataFrame, epoch: int, note=None) -> None:
        """Publish a batch's changed rows. ``note`` (JSON, or a function of the
        rows as written that gives it) is kept in the manifest."""
        now = self.manifest() or {"epoch": -1, "snapshot": None, "epochs": []}
        if now["epoch"] < epoch:
            self._write(rows, f"log/epoch={epoch}")
            if callable(note):
                note = note(self.spark.read.schema(rows.schema).parquet(f"{self.out_dir}/log/epoch={epoch}"))
            new = {"epoch": epoch, "snapshot": now["snapshot"], "epochs": [*now["epochs"], epoch], "note": note}
            if self.compact_every and len(new["epochs"]) >= self.compact_every:
                self._write(self._rows(new), f"snapshot/upto={epoch}")
                new |= {"snapshot": epoch, "epochs": []}
            self._publish(new)
        else:
            # Done already; what the batch changes in its stream's state is not.
            rows.write.format("noop").mode("overwrite").save()
        self._clean()

    def latest(self, keys: DataFrame | None = None) -> DataFrame | None:
        """The newest row of every key (or of ``keys``), or None before the
        first batch."""
        now = self.manifest()
        return None if now is None else self._rows(now, keys).drop("_epoch")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.out_dir}/{name}")

    def _publish(self, manifest: dict) -> None:
        self.folder.publish(f"manifest/{manifest['epoch']:012d}.json", json.dumps(manifest))

    def _rows(self, manifest: dict, keys: DataFrame | None = None) -> DataFrame:
        parts = []
        if manifest["snapshot"] is not None:
            parts.append(self.spark.read.parquet(f"{self.out_dir}/snapshot/upto={manifest['snapshot']}"))
        if manifest["epochs"]:
            log = self.spark.read.option("basePath", f"{self.out_dir}/log").parquet(
                *[f"{self.out_dir}/log/epoch={e}" for e in manifest["epochs"]])
            parts.append(log.withColumn("_epoch", F.col("epoch").cast("long")).drop("epoch"))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if keys is not None:
            rows = rows.join(keys, self.key, "left_semi")
        others = [c for c in rows.columns if c not in self.key]
        latest = rows.groupBy(*self.key).agg(F.max_by(F.struct(*others), F.col("_epoch")).alias("_r"))
        return latest.select(*self.key, "_r.*")

    def _clean(self) -> None:
        """Remove what neither of the last two manifests names."""
        names = self.folder.names("manifest")
        kept = [json.loads(self.folder.read(f"manifest/{n}")) for n in names[-2:]]
        live = {f"epoch={e}" for m in kept for e in m["epochs"]}
        snaps = {f"upto={m['snapshot']}" for m in kept}
        for n in self.folder.names("log"):
            if n not in live and int(n.split("=")[1]) <= kept[-1]["epoch"]:
                self.folder.remove(f"log/{n}")
        for n in self.folder.names("snapshot"):
            if n not in snaps and int(n.split("=")[1]) <= kept[-1]["epoch"]:
                self.folder.remove(f"snapshot/{n}")
        for n in names[:-2]:
            self.folder.remove(f"manifest/{n}")
        self.folder.remove("_parts")
