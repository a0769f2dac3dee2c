"""A folder of analysis results in versions, of which a run replaces the tables it worked on and no others.

Rows of a kind (profiles, value counts, grains, ...) are written below a name of their own for each run, cut by table. A version is a manifest:
one file that says for each kind and table which run's rows hold. It is written last, so a run that fails or is repeated leaves rows nobody
refers to, and a reader sees one version or the next. Two runs that start from the same version can't both commit.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.operators.value_freq import union_all

MANIFEST = "version bigint, kind string, schema_name string, table_name string, run string, since bigint, fields string"
#: What an entry says beside the version; fields is the schema of the rows, which a run without rows has too.
ENTRY = ("kind", "schema_name", "table_name", "run", "since", "fields")
#: The table of kinds that belong to all tables together.
WHOLE = ("", "")
PART = "of"


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifests(self) -> DataFrame:
        """All versions."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def version(self) -> int:
        """The newest version, 0 before the first."""
        return self.manifests().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def entries(self, version: int | None = None) -> list[Row]:
        """A version's manifest: kind, table, the run whose rows hold, and since which version. A row for each kind and table."""
        at = self.version() if version is None else version
        return self.manifests().where(F.col("version") == at).collect()

    def read(self, kind: str, entries: list[Row] | None = None, version: int | None = None) -> DataFrame | None:
        """The rows of a kind, with `since`; none if no table has any."""
        runs: dict[tuple[str, int, str], list[Row]] = defaultdict(list)
        for e in self.entries(version) if entries is None else entries:
            if e["kind"] == kind:
                runs[e["run"], e["since"], e["fields"]].append(e)
        parts = []
        for (run, since, fields), own in sorted(runs.items()):
            rows = self.spark.read.schema(T.StructType.fromJson(json.loads(fields))).parquet(f"{self.folder}/{kind}/{run}")
            # a partition of the folder for each table, so those that were replaced later aren't read
            parts.append(rows.where(F.col(PART).isin([_part(e["schema_name"], e["table_name"]) for e in own])).drop(PART).withColumn("since", F.lit(since).cast("bigint")))
        return union_all(parts) if parts else None

    def write(self, kind: str, run: str, rows: DataFrame, whole: bool = False) -> str:
        """Rows of a run, with their schema as the result; they are cut by table (schema_name, table_name), or belong to all together."""
        cut = F.lit(_part(*WHOLE)) if whole else F.concat_ws(".", F.lit("t"), "schema_name", "table_name")
        rows = rows.withColumn(PART, cut)
        rows.write.partitionBy(PART).parquet(f"{self.folder}/{kind}/{run}")
        return rows.schema.json()

    def commit(self, before: int, run: str, entries: list[tuple]) -> int:
        """Makes these entries (as ENTRY names them) the version after `before`."""
        version = before + 1
        rows = self.spark.createDataFrame([(version, *e) for e in entries], MANIFEST)
        # fails if another run has committed this version
        rows.coalesce(1).write.mode("error").parquet(f"{self.folder}/manifest/{version:012d}")
        return version

    @staticmethod
    def new_run() -> str:
        return uuid.uuid4().hex


def _part(schema: str, table: str) -> str:
    return "whole" if (schema, table) == WHOLE else f"t.{schema}.{table}"
