"""Run history: stored results and a list of past runs."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_analytics.plans.pipeline import AnalysisResult

SUMMARY = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("analyzed_at", T.TimestampType()),
        T.StructField("total_transactions", T.LongType()),
        T.StructField("flagged_transactions", T.LongType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("tier", T.StringType()),
    ]
)
# in the files: time as text, so that it does not depend on a session's time zone
_MANIFEST = T.StructType(
    [T.StructField("version", T.StringType()), T.StructField("stored", T.BooleanType())]
    + [T.StructField(f.name, T.StringType() if f.name == "analyzed_at" else f.dataType) for f in SUMMARY]
)


class RunHistory:
    """Past runs under a folder that any number of readers and writers share.

    The tables of a run lie in ``root/data/<version>/<table>``, where the version is new
    for each append. What makes them a run is its manifest ``root/runs/<run_id>.json``,
    one line of text with the version and the summary. It is written under another name
    and renamed when all tables are complete, so a reader sees a whole run or none, an
    append that ends half way leaves none, and since every run has a manifest of its own,
    writers of different runs do not meet. Of two writers of one run the later rename
    holds. ``sweep`` removes tables that no manifest names.

    All runs are kept. ``keep_results`` and ``keep_summaries``, where set, are how many of
    the newest ``append`` leaves in place.
    """

    def __init__(
        self, spark: SparkSession, root: str, keep_results: int | None = None, keep_summaries: int | None = None
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.keep_results = keep_results
        self.keep_summaries = keep_summaries

    def _data_path(self, version: str, table: str = "") -> str:
        return f"{self.root}/data/{version}/{table}".rstrip("/")

    def _manifest_path(self, run_id: str) -> str:
        return f"{self.root}/runs/{run_id}.json"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _commit(self, manifest: dict) -> None:
        """Put a manifest in its place, over the one that may be there."""
        final = self._manifest_path(manifest["run_id"])
        temporary = f"{self.root}/runs/_{uuid.uuid4().hex}"  # readers skip names with "_"
        fs, p = self._fs(temporary)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self.spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()
        )
        context.rename(p, jvm.org.apache.hadoop.fs.Path(final), overwrite)

    def _manifests(self) -> DataFrame:
        """One row per run. Only manifests that are in place are read, each of a few hundred bytes."""
        files = [n for n in self._names(f"{self.root}/runs") if n.endswith(".json") and not n.startswith(("_", "."))]
        if not files:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).json([f"{self.root}/runs/{n}" for n in files])

    def _manifest(self, run_id: str) -> dict | None:
        path = self._manifest_path(run_id)
        fs, p = self._fs(path)
        return self.spark.read.schema(_MANIFEST).json(path).first().asDict() if fs.exists(p) else None

    def append(
        self,
        result: AnalysisResult,
        run_id: str,
        filename: str,
        analyzed_at: dt.datetime | None = None,
    ) -> DataFrame:
        """Store a run, drop what is past the limits if there are any, and return the new history."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", run_id):
            raise ValueError("run_id starts with a letter or digit and may hold letters, digits, '_', '.' and '-' only")
        before = self._manifest(run_id)
        version = uuid.uuid4().hex
        for f in fields(AnalysisResult):
            getattr(result, f.name).write.parquet(self._data_path(version, f.name))
        summary = self.spark.read.parquet(self._data_path(version, "portfolio")).first()
        at = analyzed_at or dt.datetime.now(dt.timezone.utc)
        names = ("total_transactions", "flagged_transactions", "score", "tier")
        self._commit(
            {"version": version, "stored": True, "run_id": run_id, "filename": filename}
            | {"analyzed_at": (at if at.tzinfo else at.astimezone()).isoformat()}
            | {n: summary[n] for n in names}
        )
        if before and before["version"] != version:
            self._remove(self._data_path(before["version"]))
        self.prune(self.keep_results, self.keep_summaries)
        return self.history()

    def prune(self, keep_results: int | None = None, keep_summaries: int | None = None) -> None:
        """Delete all but the newest results and summaries; None deletes nothing. A run
        whose summary goes is gone; one whose tables go stays in the history."""
        if keep_results is None and keep_summaries is None:
            return
        newest = self._manifests().orderBy(F.to_timestamp("analyzed_at").desc(), F.desc("run_id")).collect()
        for at, run in enumerate(newest):
            if keep_summaries is not None and at >= keep_summaries:
                self.delete(run["run_id"])
            elif keep_results is not None and at >= keep_results and run["stored"]:
                self._commit(run.asDict() | {"stored": False})
                self._remove(self._data_path(run["version"]))

    def history(self) -> DataFrame:
        """Run summaries, newest first."""
        rows = self._manifests().withColumn("analyzed_at", F.to_timestamp("analyzed_at"))
        return rows.select(*SUMMARY.names).orderBy(F.desc("analyzed_at"), F.desc("run_id"))

    def load(self, run_id: str) -> AnalysisResult | None:
        """A stored result, or None when it was never stored or is no longer kept."""
        run = self._manifest(run_id)
        if run is None or not run["stored"]:
            return None
        return AnalysisResult(
            **{f.name: self.spark.read.parquet(self._data_path(run["version"], f.name)) for f in fields(AnalysisResult)}
        )

    def delete(self, run_id: str) -> DataFrame:
        """Remove a run: first its manifest, so that nobody finds it, then its tables."""
        run = self._manifest(run_id)
        if run:
            self._remove(self._manifest_path(run_id))
            self._remove(self._data_path(run["version"]))
        return self.history()

    def sweep(self) -> list[str]:
        """Remove the tables of appends that ended half way; call it when no append runs.
        Returns their versions."""
        known = {r["version"] for r in self._manifests().where("stored").select("version").collect()}
        left = [v for v in self._names(f"{self.root}/data") if v not in known]
        for version in left:
            self._remove(self._data_path(version))
        return left
