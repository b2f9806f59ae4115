"""Articles from a searchable service: search terms, a data source of found ids, fetching, citation counts.

The service is a client that is given by name (``module:factory``, a function without arguments), so that everything works
without a network in tests; no client is built in. Ids are found by a data source whose partitions are stretches of dates,
joined with what is stored, and only the rest is fetched, in batches dealt over the cluster.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from datetime import date, timedelta
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: No page of a search begins after so many results.
PAGE_LIMIT = 9999
#: Ids a page, ids a fetch, and attempts at a call.
PAGE, BATCH, ATTEMPTS = 1000, 200, 4


class Client(Protocol):
    """A service of articles."""

    def search(self, term: str, start: int, limit: int) -> str:
        """A page of ids as JSON."""

    def fetch(self, ids: list[str]) -> str:
        """Articles as export text."""

    def cited(self, pmid: str, doi: str | None) -> int | None:
        """How often an article is cited; None if it isn't known."""


@dataclass(frozen=True)
class Collect:
    """What is searched for."""

    heading: str = "Neurosciences"
    term: str = ""
    year_from: int = 2000
    year_to: int = 2026
    exclude_reviews: bool = True


def _dated(what: Collect, first: date, last: date) -> str:
    base = what.term or f"{what.heading}[MeSH Terms]"
    if what.exclude_reviews and "review" not in base.lower():
        base = f"({base}) NOT review[pt]"
    return f'{base} AND ("{first:%Y/%m/%d}"[PDAT] : "{last:%Y/%m/%d}"[PDAT])'


def search_term(what: Collect, year: int | None = None, month: int | None = None) -> str:
    """A search term for a month, a year or all years; reviews are left out unless the term asks for them."""
    if month is not None and year is None:
        raise ValueError("a month needs a year")
    last = date(year or what.year_to, month or 12, 1)
    return _dated(what, date(year or what.year_from, month or 1, 1), _month_end(last))


def _month_end(day: date) -> date:
    return (day.replace(day=1) + timedelta(days=31)).replace(day=1) - timedelta(days=1)


def retried(call: Callable, *args, attempts: int = ATTEMPTS, wait: float = 1.0, accept: Callable = bool):
    """call(*args), again after a growing pause while it fails or gives what isn't accepted; then the last error."""
    error: Exception = RuntimeError("no attempt was made")
    for attempt in range(attempts):
        try:
            found = call(*args)
            if accept(found):
                return found
            error = RuntimeError(f"not accepted: {str(found)[:200]!r}")
        except Exception as raised:  # whatever a client raises
            error = raised
        if attempt + 1 < attempts:
            time.sleep(min(wait * 2**attempt, 60.0))
    raise error


def _is_json(body: str) -> bool:
    try:
        json.loads(body)
    except (TypeError, ValueError):
        return False
    return True


def found_page(client: Client, term: str, start: int, limit: int, wait: float = 1.0) -> tuple[list[str], int]:
    """The ids of a page and how many results there are in all; an error that the service reports is raised."""
    result = json.loads(retried(client.search, term, start, limit, wait=wait, accept=_is_json))["esearchresult"]
    if "ERROR" in result:
        raise RuntimeError(f"search error: {result['ERROR']}")
    return result.get("idlist", []), int(result.get("count", 0))


def stretches(what: Collect, total: Callable[[str], int], limit: int = PAGE_LIMIT) -> list[tuple[int, str]]:
    """(year, term) of stretches of dates that hold at most so many results: years, and where a year has more, its months,
    and then days. A single day with more is an error, as its rest could not be reached."""
    out: list[tuple[int, str]] = []
    todo = [(date(y, 1, 1), date(y, 12, 31)) for y in range(what.year_to, what.year_from - 1, -1)]
    while todo:
        first, last = todo.pop()
        term = _dated(what, first, last)
        if total(term) <= limit:
            out.append((first.year, term))
        elif first == last:
            raise RuntimeError(f"more than {limit} results on {first}")
        elif first.month != last.month:
            todo += [(first.replace(month=m), _month_end(first.replace(month=m))) for m in range(12, 0, -1)]
        else:
            todo += [(first + timedelta(days=k),) * 2 for k in range((last - first).days, -1, -1)]
    return out


def client_named(name: str) -> Client:
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)()


@dataclass
class _Stretch(InputPartition):
    year: int
    term: str


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.client, self.wait = options["client"], float(options.get("wait", "1"))
        self.what = Collect(**json.loads(options["what"]))

    def partitions(self):
        client = client_named(self.client)
        return [_Stretch(*s) for s in stretches(self.what, lambda term: found_page(client, term, 0, 0, self.wait)[1])]

    def read(self, partition):
        client, start = client_named(self.client), 0
        while True:
            ids, total = found_page(client, partition.term, start, PAGE, self.wait)
            yield from ((partition.year, pmid) for pmid in ids)
            start += len(ids)
            if not ids or start >= total:
                return


class SearchSource(DataSource):
    """Ids that a search finds, a partition for each stretch of dates. Options: client, what (a Collect as JSON), wait."""

    @classmethod
    def name(cls):
        return "article_search"

    def schema(self):
        return "year int, pmid string"

    def reader(self, schema):
        return _Reader(self.options)


def found_ids(spark: SparkSession, what: Collect, client: str, wait: float = 1.0) -> DataFrame:
    """(year, pmid) of all results of a search."""
    spark.dataSource.register(SearchSource)
    return spark.read.format("article_search").options(client=client, what=json.dumps(asdict(what)), wait=wait).load()


def worklist(found: DataFrame, stored: DataFrame, most: int | None = None) -> DataFrame:
    """Ids that are found and not yet stored, the first ``most`` by id."""
    todo = found.select("pmid").distinct().join(stored.select("pmid"), "pmid", "left_anti")
    return todo if most is None else todo.orderBy("pmid").limit(most)


def fetched(ids: DataFrame, client: str, wait: float = 1.0) -> DataFrame:
    """(value) export texts of the ids, BATCH to a call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = client_named(client)
        for batch in batches:
            wanted = batch["pmid"].tolist()
            groups = [wanted[at : at + BATCH] for at in range(0, len(wanted), BATCH)]
            yield pd.DataFrame({"value": [retried(service.fetch, group, wait=wait) for group in groups]}, dtype=object)

    return ids.select("pmid").mapInPandas(run, "value string")


def skipped(requested: DataFrame, articles: DataFrame) -> DataFrame:
    """Ids that were asked for and gave no article."""
    return requested.select("pmid").distinct().join(articles.select("pmid"), "pmid", "left_anti")


def uncited(articles: DataFrame, citations: DataFrame) -> DataFrame:
    """Articles of a known year without a citation count."""
    return articles.filter("year is not null").join(citations.select("pmid"), "pmid", "left_anti")


def citation_counts(articles: DataFrame, client: str, wait: float = 1.0) -> DataFrame:
    """(pmid, citation_count) of articles (pmid, doi), asked for one by one; 0 for what isn't known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = client_named(client)
        for batch in batches:
            asked = zip(batch["pmid"], batch["doi"], strict=True)
            counts = [retried(service.cited, pmid, doi, wait=wait, accept=lambda _: True) for pmid, doi in asked]
            yield pd.DataFrame({"pmid": batch["pmid"], "citation_count": [int(c or 0) for c in counts]})

    return articles.select("pmid", "doi").mapInPandas(run, "pmid string, citation_count long").withColumn("source", F.lit("lookup"))
