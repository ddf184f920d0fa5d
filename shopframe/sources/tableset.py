"""Several tables that change together.

``TableSet.commit`` writes every changed table into a staging folder of its own
and then publishes one manifest that names, for each table, the folders it
consists of. A reader loads the tables that one manifest names, so it sees all
of a commit or nothing of it: a job that stops between two tables leaves the old
state. A table may be replaced, or added to without rewriting what it has.

Manifests are numbered. ``commit`` takes the version its input was read at and
fails when another one was published meanwhile. Folders that neither of the last
two manifests names are removed, so readers of the version before may finish.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .folder import Folder


class Conflict(RuntimeError):
    """Another commit came first."""


class TableSet:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)

    def manifest(self) -> dict:
        names = self.folder.names("manifest")
        return json.loads(self.folder.read(f"manifest/{names[-1]}")) if names else {"version": 0, "tables": {}}

    @property
    def version(self) -> int:
        return self.manifest()["version"]

    def load(self, manifest: dict | None = None) -> dict[str, DataFrame]:
        """All tables as one manifest (the newest) names them."""
        tables = (manifest or self.manifest())["tables"]
        return {name: self.spark.read.schema(StructType.fromJson(t["schema"])).parquet(
            *[f"{self.path}/{p}" for p in t["parts"]]) for name, t in tables.items()}

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None,
               version: int | None = None) -> int:
        """Change tables together; returns the new version."""
        now = self.manifest()
        if version is not None and version != now["version"]:
            raise Conflict(f"version {now['version']} was published after {version}")
        tables, stage = dict(now["tables"]), f"data/{now['version'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        for name, df in (replace or {}).items():
            tables[name] = {"parts": [self._write(df, f"{stage}/{name}")], "schema": json.loads(df.schema.json())}
        for name, df in (append or {}).items():
            if name not in tables:
                raise KeyError(f"no table {name} to add to")
            df = df.select(*[c["name"] for c in tables[name]["schema"]["fields"]])
            tables[name] = tables[name] | {"parts": [*tables[name]["parts"], self._write(df, f"{stage}/{name}-more")]}
        new = now["version"] + 1
        name = f"manifest/{new:09d}.json"
        if self.folder.exists(name):
            raise Conflict(f"version {new} was published meanwhile")
        self.folder.publish(name, json.dumps({"version": new, "tables": tables}))
        self._clean()
        return new

    def _write(self, df: DataFrame, name: str) -> str:
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _clean(self) -> None:
        names = self.folder.names("manifest")
        kept = [json.loads(self.folder.read(f"manifest/{n}")) for n in names[-2:]]
        live = {p.split("/")[1] for m in kept for t in m["tables"].values() for p in t["parts"]}
        for n in self.folder.names("data"):
            if n not in live and int(n.split("-")[0]) <= kept[-1]["version"]:
                self.folder.remove(f"data/{n}")
        for n in names[:-2]:
            self.folder.remove(f"manifest/{n}")
        self.folder.remove("_parts")
