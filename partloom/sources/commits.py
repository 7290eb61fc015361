"""Tables that appear together or not at all, and that a retry doesn't add twice.

A commit writes its tables to a folder of its own attempt and then one manifest that names them. Readers go by the
manifests: what no manifest names, as after a lost driver, isn't there. A commit whose manifest exists is done, so
running it again adds nothing. One driver writes a commit of one name at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "commit string, tables array<struct<name:string,path:string,rows:bigint,schema:string>>"


class CommitStore:
    """Committed tables below `root`, a path that every executor reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commit(self, name: str, tables: Mapping[str, DataFrame], *, bucket_by: str | None = None, buckets: int = 64) -> bool:
        """Writes the tables under one manifest; False if a commit of that name is there already.

        With `bucket_by` rows lie in folders by a hash of that column, so that few objects open few folders.
        """
        if self.is_committed(name):
            return False
        from partloom.sources.writers import write_bucketed

        attempt = f"data/{name}-{uuid.uuid4().hex}"
        entries = []
        for table, df in tables.items():
            path = f"{attempt}/{table}"
            if bucket_by and bucket_by in df.columns:
                write_bucketed(df, f"{self.root}/{path}", bucket_by, buckets)
            else:
                df.write.parquet(f"{self.root}/{path}")
            rows = self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}").count()
            entries.append({"name": table, "path": path, "rows": rows, "schema": df.schema.json()})
        self._publish(name, json.dumps({"commit": name, "tables": entries}))
        return True

    def is_committed(self, name: str) -> bool:
        return self._files().exists(self._path(f"commits/{name}.json"))

    def manifests(self) -> DataFrame:
        """One row per commit and table: `commit, name, path, rows`."""
        from pyspark.sql import functions as F

        if not self._files().exists(self._path("commits")):
            return self.spark.createDataFrame([], "commit string, name string, path string, rows bigint")
        read = self.spark.read.schema(MANIFEST).option("pathGlobFilter", "*.json").json(f"{self.root}/commits")
        return read.select("commit", F.inline("tables")).select("commit", "name", "path", "rows")

    def read(self, table: str, schema: str, commits: Sequence[str] | None = None) -> DataFrame:
        """All rows of a table in all commits, or in those listed; empty if there are none."""
        listed = self.manifests().filter(f"name = '{table}'").select("commit", "path").collect()
        paths = [f"{self.root}/{r['path']}" for r in listed if commits is None or r["commit"] in commits]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # Folders of buckets lie below each path.
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)

    def _publish(self, name: str, text: str) -> None:
        files, last = self._files(), self._path(f"commits/{name}.json")
        first = self._path(f"commits/.{name}-{uuid.uuid4().hex}")
        out = files.create(first, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not files.rename(first, last):
            raise OSError(f"commit {name} could not be published")

    def _path(self, below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}")

    def _files(self):
        return self._path("commits").getFileSystem(self.spark._jsc.hadoopConfiguration())
