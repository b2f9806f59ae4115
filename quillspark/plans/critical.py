"""Critical labelling of articles by citation rate."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators.impact import citation_rate, label_critical
from quillspark.sources.tables import articles, citations

REF_YEAR = 2026


def critical_labelling(spark, sf_dir):
    """Articles with their citation rate and the critical mark of their year."""
    joined = articles(spark, sf_dir).select("pmid", "year").join(citations(spark, sf_dir), "pmid", "left")
    rated = joined.withColumn("rate", citation_rate(F.col("citation_count"), F.col("year"), REF_YEAR))
    return label_critical(rated).select("pmid", "year", F.round("rate", 6).alias("rate"), "is_critical")


RATED_SQL = """
a as (select cast(doc_id as varchar) pmid, cast(2000 + doc_id % 27 as int) as year, text as abstract from documents),
c as (select cast(l_partkey as varchar) pmid, count(*) citation_count from lineitem where l_partkey % 3 <> 0 group by l_partkey),
r as (select a.pmid, a.year, coalesce(citation_count, 0) / cast(greatest(1, 2026 - a.year) as double) rate
      from a left join c on a.pmid = c.pmid),
w as (select *, row_number() over (partition by year order by rate, pmid) rn, count(*) over (partition by year) n from r),
t as (select year, rate thr from w where rn = greatest(cast(floor(0.9::double * n) as bigint) - 1, 0) + 1),
labelled as (select w.pmid, w.year, w.rate, cast(case when w.rate >= t.thr and w.rate > 0 then 1 else 0 end as int) is_critical
             from w join t on w.year = t.year)
"""

QUERIES = {"critical_labelling": critical_labelling}
ORACLE = {"critical_labelling": f"with {RATED_SQL} select pmid, year, round(rate, 6) rate, is_critical from labelled"}
