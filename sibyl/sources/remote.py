"""Sources behind HTTP as Spark tables: a graph endpoint that is read page by page, and a web search that is asked query by query.

The endpoint is a data source of its own, so that pages are partitions of a scan, filters go to the server, and a lost task asks for its pages
again. Requests are tried a bounded number of times with growing pauses; an answer that never comes fails the task, so results are whole or absent.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from .cache import ResultCache

#: States of a server that may pass: too many requests, and failures of its own.
PASSING = frozenset({408, 429, 500, 502, 503, 504})


def get_json(url: str, params: dict[str, str], tries: int = 4, pause: float = 0.5, patience: float = 60.0) -> dict:
    """The JSON object at an address. Passing failures are tried again, `tries` times in all, after pauses that double; others end at once."""
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", headers={"Accept": "application/sparql-results+json, application/json"})
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(request, timeout=patience) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code not in PASSING:
                raise
            reason = e
        except (OSError, json.JSONDecodeError) as e:  # no connection, a broken or a cut answer
            reason = e
        if attempt + 1 < tries:
            time.sleep(pause * 2**attempt)
    raise RuntimeError(f"{url}: no answer in {tries} tries, the last with {reason!r}")


def quoted(value: str) -> str:
    """A string as a literal of the endpoint's language."""
    marks = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return '"' + "".join(marks.get(c, c) for c in value) + '"'


@dataclass
class Pages(InputPartition):
    """Rows from `start` on, up to `stop`; None: up to the end."""

    start: int
    stop: int | None


class GraphEndpoint(DataSource):
    """Rows of a graph pattern, three columns a variable: its value, whether it is an IRI, its language.

    Options: endpoint; pattern (what stands between the braces); variables (by blanks); prefixes; pageSize (rows of a request, 1000), pagesPerTask (10);
    tries, pause, patience (`get_json`); pushFilters (false; true needs the session's setting of `FilteringGraphReader`). Rows are distinct and ordered by all variables, so that pages don't overlap; the last task reads on until a page
    is not full. The graph must stay as it is during a scan; each of a task's pages is one request.
    """

    @classmethod
    def name(cls) -> str:
        return "graph_endpoint"

    def _variables(self) -> list[str]:
        found = self.options.get("variables", "").replace("?", "").split()
        if not found or not all(re.fullmatch(r"[A-Za-z_]\w*", v) for v in found):
            raise ValueError("variables: names of the pattern's variables, with blanks between")
        return found

    def schema(self) -> str:
        return ", ".join(f"{v} string, {v}_is_uri boolean, {v}_lang string" for v in self._variables())

    def reader(self, schema) -> GraphReader:
        kind = FilteringGraphReader if self.options.get("pushFilters", "false") == "true" else GraphReader
        return kind(dict(self.options), self._variables())


class GraphReader(DataSourceReader):
    def __init__(self, options: dict, variables: list[str]):
        self.variables = variables
        self.conditions: list[str] = []
        low = {k.lower(): v for k, v in options.items()}
        self.endpoint, self.pattern, self.prefixes = low["endpoint"], low["pattern"], low.get("prefixes", "")
        self.page, self.per_task = int(low.get("pagesize", 1000)), int(low.get("pagespertask", 10))
        if self.page < 1 or self.per_task < 1:
            raise ValueError("pageSize and pagesPerTask must be 1 or more")
        self.asking = {"tries": int(low.get("tries", 4)), "pause": float(low.get("pause", 0.5)), "patience": float(low.get("patience", 60))}

    def _rows_of(self) -> str:
        names = " ".join("?" + v for v in self.variables)
        return f"SELECT DISTINCT {names} WHERE {{ {self.pattern} {' '.join(f'FILTER({c})' for c in self.conditions)} }}"

    def _ask(self, query: str) -> list[dict]:
        return get_json(self.endpoint, {"query": f"{self.prefixes} {query}".strip(), "format": "json"}, **self.asking)["results"]["bindings"]

    def partitions(self) -> list[Pages]:
        """One request counts the rows; each task then gets as many pages as asked, the last one all that follows."""
        count = int(self._ask(f"SELECT (COUNT(*) AS ?n) WHERE {{ {{ {self._rows_of()} }} }}")[0]["n"]["value"])
        step = self.page * self.per_task
        starts = range(0, max(count, 1), step)
        return [Pages(s, s + step if s + step < count else None) for s in starts]

    def read(self, partition: Pages) -> Iterator[tuple]:
        order = " ".join("?" + v for v in self.variables)
        start = partition.start
        while partition.stop is None or start < partition.stop:
            found = self._ask(f"{self._rows_of()} ORDER BY {order} LIMIT {self.page} OFFSET {start}")
            for row in found:
                yield tuple(x for v in self.variables for x in self._cells(row.get(v)))
            if len(found) < self.page:
                if partition.stop is not None:
                    raise RuntimeError(f"{self.endpoint}: {len(found)} of {self.page} rows from {start} on, though more were counted; the server cuts pages, so ask for smaller ones")
                return
            start += self.page

    @staticmethod
    def _cells(binding: dict | None) -> tuple:
        return (None, None, None) if binding is None else (binding["value"], binding["type"] == "uri", binding.get("xml:lang"))


class FilteringGraphReader(GraphReader):
    """A reader that gives conditions to the server. Spark has it only where spark.sql.python.filterPushdown.enabled is true."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality, lists, beginnings and presence of a variable's value go to the server; other conditions stay with Spark."""
        for f in filters:
            condition = self._condition(f)
            if condition is None:
                yield f
            else:
                self.conditions.append(condition)

    def _condition(self, f: Filter) -> str | None:
        if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in self.variables:
            return None
        value = f"STR(?{f.attribute[0]})"
        if isinstance(f, EqualTo) and isinstance(f.value, str):
            return f"{value} = {quoted(f.value)}"
        if isinstance(f, In) and f.value and all(isinstance(v, str) for v in f.value):
            return f"{value} IN ({', '.join(map(quoted, f.value))})"
        if isinstance(f, StringStartsWith):
            return f"STRSTARTS({value}, {quoted(f.value)})"
        return f"BOUND(?{f.attribute[0]})" if isinstance(f, IsNotNull) else None


def graph_rows(spark: SparkSession, endpoint: str, pattern: str, variables: str, **options: object) -> DataFrame:
    """Rows of a pattern at a graph endpoint (`GraphEndpoint`). Filters reach the server where spark.sql.python.filterPushdown.enabled is true when this is called."""
    spark.dataSource.register(GraphEndpoint)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(GraphEndpoint.name()).option("endpoint", endpoint).option("pattern", pattern).option("variables", variables).option("pushFilters", push)
    return reader.options(**{k: str(v) for k, v in options.items()}).load()


def endpoint_triples(spark: SparkSession, endpoint: str, pattern: str = "?s ?p ?o", **options: object) -> DataFrame:
    """Triples (s, p, o, o_is_uri, lang) of a pattern over ?s, ?p and ?o, in the shape of `readers.triples_nt`."""
    return graph_rows(spark, endpoint, pattern, "s p o", **options).select("s", "p", "o", "o_is_uri", F.col("o_lang").alias("lang"))


def web_search(queries: DataFrame, url: str, k: int = 6, asked: int = 30, tasks: int = 8, key: str | None = None, tries: int = 4, pause: float = 0.5) -> DataFrame:
    """(query, rank, title, description, url) of the first k of `asked` results of each distinct query at a search address that answers q, count and key with
    {"results": [{"title", "description", "url"}]}. Null and blank queries have none. At most `tasks` requests run at a time; each query is asked once."""
    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query in batch["query"]:
                params = {"q": query, "count": str(asked)} | ({"key": key} if key else {})
                for rank, r in enumerate(get_json(url, params, tries, pause).get("results", [])[:k], 1):
                    rows.append((query, rank, r.get("title"), r.get("description"), r.get("url")))
            yield pd.DataFrame(rows, columns=["query", "rank", "title", "description", "url"])

    rows = queries.select("query").filter("trim(query) <> ''").distinct().repartition(tasks, "query")
    return rows.mapInPandas(answers, "query string, rank int, title string, description string, url string")


def cached_search(queries: DataFrame, cache: ResultCache, search: Callable[[DataFrame], DataFrame], k: int = 6) -> DataFrame:
    """Results of queries as `ResultCache.load` gives them; only queries of which the cache holds nothing are searched, and what is found is saved as one version.

    Queries without results are searched again each time."""
    asked = queries.select("query").filter("trim(query) <> ''").distinct()
    missing = asked.join(cache.load(asked, k=1), "query", "left_anti")
    if not missing.isEmpty():
        cache.save(search(missing))
    return cache.load(asked, k)
