"""Tables that are rewritten as snapshots: upserts, replacement by partition, run log."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.ranking import top_by_group

_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()
SCHEMAS = {
    name: T.StructType([T.StructField(c, kind) for c, kind in columns])
    for name, columns in {
        "runs": [("run_id", _S), ("stage", _S), ("config_hash", _S), ("created_at", _TS), ("notes", _S)],
        "articles": [("pmid", _S), ("year", _I), ("doi", _S), ("title", _S), ("abstract", _S), ("intro", _S), ("text_work", _S), ("mesh_terms", _S), ("fetched_at", _TS)],
        "article_segments": [("pmid", _S), ("question", _S), ("results", _S), ("segmentation_method", _S), ("qc_score", _D), ("updated_at", _TS)],
        "citations": [("pmid", _S), ("citation_count", _L), ("horizon_years", _I), ("source", _S), ("fetched_at", _TS)],
        "article_impact": [("pmid", _S), ("impact_score", _D), ("is_critical", _I)],
        "questions": [("id", _L), ("pmid", _S), ("question_text", _S), ("year", _I), ("embedding", T.ArrayType(T.FloatType())), ("impact_score", _D), ("is_critical", _I)],
        "predictions": [("id", _L), ("target_year", _I), ("model", _S), ("rank", _I), ("question_predicted", _S), ("score", _D), ("run_id", _S), ("created_at", _TS)],
        "evaluations": [("id", _L), ("target_year", _I), ("model", _S), ("metric", _S), ("k", _I), ("value", _D), ("ci_low", _D), ("ci_high", _D), ("run_id", _S)],
    }.items()
}
DERIVED = ("article_segments", "article_impact", "questions", "predictions", "evaluations")


def merge_upsert(base: DataFrame, delta: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """base with the rows of delta in place of those of the same key, and its new keys; of equal keys within delta the
    first by ``order`` counts. delta may have more columns, to order by. Null keys are keys of their own."""
    last = top_by_group(delta, key, order, 1).select(*base.columns)
    same = [base[k].eqNullSafe(last[k]) for k in key]
    return base.join(last, same, "left_anti").unionByName(last)


class Store:
    """Tables under a folder. Each write makes a new snapshot and then a pointer to it, so readers always see a whole
    table; nothing is changed in place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _snapshot(self, name: str) -> str | None:
        jvm, fs = self._fs()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/current")
        if not fs.exists(place):
            return None
        stream = fs.open(place)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        """A table, empty if it was never written."""
        found = self._snapshot(name)
        if found is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{name}/{part}" for part in found.split()])

    def _fitted(self, name: str, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])

    def _point(self, name: str, parts: list[str]) -> None:
        """Makes the table the rows of these parts. The new pointer replaces the old one in one step."""
        jvm, fs = self._fs()
        new, now = (fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{x}")) for x in (f"next-{uuid.uuid4().hex}", "current"))
        stream = fs.create(new, True)
        try:
            stream.writeBytes("\n".join(parts))
        finally:
            stream.close()
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(now.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, now, over)

    def write(self, name: str, df: DataFrame) -> None:
        """Makes df the table; columns that it lacks are null, others are dropped."""
        part = uuid.uuid4().hex
        self._fitted(name, df).write.parquet(f"{self.root}/{name}/{part}")
        self._point(name, [part])

    def upsert(self, name: str, delta: DataFrame, key: list[str], order: list[Column]) -> None:
        extra = [c for c in delta.columns if c not in SCHEMAS[name].fieldNames()]
        have = set(delta.columns)
        fields = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]]
        self.write(name, merge_upsert(self.read(name), delta.select(*fields, *extra), key, order))

    def upsert_articles(self, delta: DataFrame, now: datetime) -> None:
        """Whole rows by pmid, of equal ones the last by fetched_at; text_work defaults to the abstract."""
        filled = delta.withColumns(
            {
                "text_work": F.coalesce(F.nullif("text_work", F.lit("")), F.col("abstract")) if "text_work" in delta.columns else F.col("abstract"),
                "fetched_at": F.coalesce("fetched_at", F.lit(now)) if "fetched_at" in delta.columns else F.lit(now),
            }
        )
        self.upsert("articles", filled, ["pmid"], [F.desc("fetched_at"), F.desc("title"), F.desc("abstract")])

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows as another part; what is stored isn't read."""
        part = uuid.uuid4().hex
        self._fitted(name, df).write.parquet(f"{self.root}/{name}/{part}")
        self._point(name, [*(self._snapshot(name) or "").split(), part])

    def replace_predictions(self, ranked: DataFrame) -> None:
        """Drops the rows of each (target_year, model, run_id) that comes, and adds what comes."""
        keys = ranked.select("target_year", "model", "run_id").distinct()
        self.write("predictions", self.read("predictions").join(keys, ["target_year", "model", "run_id"], "left_anti").unionByName(ranked, allowMissingColumns=True))

    def log_run(self, run_id: str, stage: str, now: datetime, notes: str = "", config_hash: str = "") -> None:
        row = self.spark.createDataFrame([(run_id, stage, config_hash, now, notes)], SCHEMAS["runs"])
        self.upsert("runs", row, ["run_id"], [F.desc("created_at")])

    def latest_run(self, stage: str) -> str | None:
        return self.read("runs").filter(F.col("stage") == stage).agg(F.max_by("run_id", F.struct("created_at", "run_id"))).first()[0]

    def clear_derived(self) -> None:
        """Empties all but articles, citations and the run log."""
        for name in DERIVED:
            self.write(name, self.spark.createDataFrame([], SCHEMAS[name]))


def run_id(stage: str, now: datetime) -> str:
    return f"{stage}_{now:%Y%m%dT%H%M%SZ}"
