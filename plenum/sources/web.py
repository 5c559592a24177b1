"""A web search service as a Spark data source: one request per query, from the executors."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The results that are asked for, and the shortest query that is sent; names of parameters and fields are the service's.
MOST, SHORTEST = 10, 2
SCHEMA = "query string, place long, title string, link string, snippet string, site string, thumbnail string, error string"


class _Part(InputPartition):
    def __init__(self, queries: list[str]):
        super().__init__(queries)
        self.queries = queries


def records(query: str, answer: dict) -> Iterator[tuple]:
    """Records of one answer, as far as the service gave items; missing texts are empty, a missing picture is null."""
    for place, item in enumerate((answer.get("items") or [])[:MOST]):
        pictures = item.get("pagemap") or {}
        sources = [p.get("src") for kind in ("cse_thumbnail", "cse_image") for p in (pictures.get(kind) or [])[:1]]
        thumbnail = next((s for s in sources if s), None)
        yield query, place, item.get("title") or "", item.get("link") or "", item.get("snippet") or "", item.get("displayLink") or "", thumbnail, None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.key, self.engine = options["url"], options.get("key", ""), options.get("engine", "")
        self.timeout = float(options.get("timeout", "10"))
        asked = [q.strip() for q in json.loads(options["queries"])]
        self.queries = list(dict.fromkeys(q for q in asked if len(q) >= SHORTEST))
        self.requests = int(options.get("requestsPerTask", "20"))

    def partitions(self) -> list[_Part]:
        return [_Part(self.queries[i : i + self.requests]) for i in range(0, len(self.queries), self.requests)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        from urllib.error import HTTPError, URLError
        from urllib.parse import urlencode
        from urllib.request import urlopen

        for query in partition.queries:
            parameters = urlencode({"key": self.key, "cx": self.engine, "q": query, "num": MOST})
            try:
                with urlopen(f"{self.url}?{parameters}", timeout=self.timeout) as answer:  # noqa: S310 the caller's address
                    yield from records(query, json.load(answer))
            except HTTPError as e:
                try:
                    told = json.load(e)["error"]["message"]
                except (ValueError, KeyError, TypeError):
                    told = None
                yield query, None, None, None, None, None, None, told or f"search failed ({e.code})"
            except (URLError, ValueError, OSError) as e:
                yield query, None, None, None, None, None, None, str(e)


class WebSearch(DataSource):
    """Options: url, queries (a JSON list), key, engine, timeout (seconds), requestsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "web_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def web_search(spark: SparkSession, url: str, queries: list[str], **options: str) -> DataFrame:
    """query, place, title, link, snippet, site, thumbnail, error: up to ten results for each different query of two characters or more.

    A query that fails has one row with the error and no result; the others are
    answered all the same. The queries are what the caller asks for, a short
    list; a task sends up to requestsPerTask of them one after the other. Each
    action on the frame sends them again, so results should be written, or asked
    for through a cache (streaming.cache).
    """
    spark.dataSource.register(WebSearch)
    return spark.read.format(WebSearch.name()).options(url=url, queries=json.dumps(queries), **options).load()
