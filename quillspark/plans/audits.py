"""Audits, classes and whole evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.models import HashingEncoder
from quillspark.operators import audit as A
from quillspark.operators.classify import classified
from quillspark.operators.drivers import benchmark_metrics
from quillspark.plans import common as C
from quillspark.plans import sqltext as Q
from quillspark.plans import vectors as V


def audit_generation(spark, sf_dir):
    """Lines seen and kept of each document, as counts out of the JSON log."""
    logs = A.generation_log(C.lines(spark, sf_dir), ["id"], "line", "pos")
    part = lambda p: F.get_json_object("log", p).cast("long")
    return logs.select("id", part("$.seen").alias("seen"), part("$.kept").alias("kept"), F.coalesce(part("$.rejected.too_many_words"), F.lit(0)).cast("long").alias("too_many"))


def audit_log_lines(spark, sf_dir):
    told = A.log_lines(C.lines(spark, sf_dir), ["id"], "line", "pos")
    return told.groupBy(F.split_part("line", F.lit(" "), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


def audit_contamination(spark, sf_dir):
    """Shares of vectors that others have already, by quarter of the ids."""
    some = lambda k: V._some(spark, sf_dir, k)
    return V._rounded(A.contamination(some(1), some(3), some(0), some(2), some(3), V.TAU))


def class_prototypes(spark, sf_dir):
    """Classes of all lines by their nearest prototypes."""
    found = classified(C.lines(spark, sf_dir), "line", HashingEncoder())
    return found.select("id", "pos", "label", F.round("confidence", 6).alias("confidence"))


def eval_benchmark(spark, sf_dir):
    """Every metric of predictions 1 mod 4 with 3 mod 4 as the baseline."""
    found = benchmark_metrics(V._some(spark, sf_dir, 1), V._refs(spark, sf_dir), {"other": V._some(spark, sf_dir, 3)}, [10, 50], V.TAU)
    return found.select("cell", "k", "metric", F.round("value", 6).alias("value"))


QUERIES = {f.__name__: f for f in (audit_generation, audit_log_lines, audit_contamination, class_prototypes, eval_benchmark)}


def _oracle() -> dict[str, str]:
    kept = f"with {C.LINES_SQL}, b as (select id, pos, {Q.bare('line')} s, {Q.normal_space(Q.bare('line'))} ns from lines), r as (select id, pos, s, {Q.rejection('s', 'ns')} reason from b), k as (select *, case when reason is null and row_number() over (partition by id, lower(s), reason is null order by pos) > 1 then 'duplicate' else reason end verdict from r)"
    rate = "{0} as (select cell, round(avg(hit::int::double), 6) {0} from ({1}) group by cell)"
    four = ", ".join(f"v{k} as (select * from v where id % 4 = {k})" for k in range(4))
    parts = ", ".join(rate.format(name, V._REC.format(V.TAU, a, b)) for name, a, b in (("corpus_recycling", "v1", "v0"), ("context_recycling", "v1", "v3"), ("train_eval_overlap", "v3", "v2")))
    return {
        "audit_generation": f"{kept} select id, count(*) seen, count(*) filter (verdict is null) kept, count(*) filter (verdict = 'too_many_words') too_many from k group by id",
        "audit_log_lines": f"{kept} select kind, count(*) n from (select 'RAW' kind from k union all select case when verdict is null then 'KEPT' else 'REJECT' end from k union all select 'EMPTY' from k group by id having count(*) filter (verdict is null) = 0) group by kind",
        "audit_contamination": f"with {V._V}, {four}, {parts} select c.cell, corpus_recycling, context_recycling, train_eval_overlap from corpus_recycling c join context_recycling x on c.cell = x.cell join train_eval_overlap t on c.cell = t.cell",
    }


ORACLE = _oracle()
