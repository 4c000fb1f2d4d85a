"""Domain state as versioned Parquet tables under one folder, with commits of several tables at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ledgerloom import schemas
from ledgerloom.sources.storage import exists

TABLES = {
    "balance_delta": schemas.DELTA, "address": schemas.ADDRESS, "excluded_tx": schemas.EXCLUDED_TX, "merge_evidence": schemas.EVIDENCE, "invalidation": "chain_id string, op_id bigint, reason string, at timestamp",
    "cluster": schemas.CLUSTER, "cluster_membership": schemas.MEMBERSHIP, "label": schemas.LABEL, "sweep_target": schemas.SWEEP_TARGET, "audit_log": "actor string, action string, target string, rationale string, at timestamp",
    "chain": schemas.CHAIN, "heuristic": schemas.HEURISTIC, "chain_heuristic": schemas.CHAIN_HEURISTIC, "ingest_cursor": schemas.CURSOR, "block": schemas.BLOCK, "chain_config": schemas.CHAIN_CONFIG,
    "poison": "value string, offset bigint, error string", "super_entity": schemas.SUPER_ENTITY, "super_entity_member": schemas.SUPER_ENTITY_MEMBER,
}


class State:
    """A table is a list of folders; the file _current names them all, and a commit replaces that file by a rename.

    Tables are only appended to or replaced as a whole; evidence has no other way than append and invalidation.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        path = self._path("")
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def current(self) -> dict[str, list[str]]:
        if not exists(self.spark, f"{self.root}/_current"):
            return {}
        stream = self._fs.open(self._path("_current"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        schema = StructType.fromDDL(TABLES[table])
        folders = self.current().get(table, [])
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> None:
        """Writes all frames to new folders, then makes them current at once."""
        now = self.current()
        for changes, keep in ((append or {}, True), (replace or {}, False)):
            for table, df in changes.items():
                folder = f"{table}/{uuid.uuid4().hex}"
                names = [f.name for f in StructType.fromDDL(TABLES[table])]
                df.select(names).write.parquet(f"{self.root}/{folder}")
                now[table] = (now.get(table, []) if keep else []) + [folder]
        stream = self._fs.create(self._path("_next"), True)
        stream.write(bytearray(json.dumps(now), "utf-8"))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        option = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        context.rename(self._path("_next"), self._path("_current"), options)
