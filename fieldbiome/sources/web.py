"""Web sources as Python data sources: one partition for each search term or batch of accessions.

Fetching is a function of the options (fetch: 'module:function'), so that tests run without a network.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import warnings
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


# Five tries, and 1.5 seconds more to wait after each.
TRIES, WAIT = 5, 1.5


def get(url: str, tries: int = TRIES, wait: float = WAIT, timeout: float = 60) -> str:
    """The text at a url; on 'too many requests' waits longer each time, on other errors gives up at once."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
                return r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code != 429 or k == tries - 1:
                raise
            time.sleep(wait * (k + 1))
    raise RuntimeError("unreachable")


def batches(ids: list[str], size: int) -> list[list[str]]:
    return [ids[k : k + size] for k in range(0, len(ids), size)]


def fetcher(options: dict[str, str]) -> Callable[[str], str]:
    module, _, function = options.get("fetch", f"{__name__}:get").partition(":")
    return getattr(importlib.import_module(module), function)


def or_nothing(fetch: Callable[[str], str], url: str) -> str:
    """What fetch gives, or an empty text with a warning where the server answers with an error or not at all."""
    try:
        return fetch(url)
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        warnings.warn(f"nothing from {url}: {e}", stacklevel=2)
        return ""


class JsonRows(DataSource):
    """format('json_rows'): rows of JSON arrays fetched from url with {key} filled in for each of keys (a JSON list).

    Options: url, keys, size (keys a request, comma-joined; default 1), fields (comma-separated), fetch, errors ('raise', the
    default, or 'warn', for searches: a request that fails gives no rows, and a warning on its executor). The column batch numbers the requests, so that later ones can win
    (readers.later_wins).
    """

    @classmethod
    def name(cls) -> str:
        return "json_rows"

    def schema(self) -> str:
        return "key string, batch int, " + ", ".join(f"{f.strip()} string" for f in self.options["fields"].split(","))

    def reader(self, schema: object) -> JsonReader:
        return JsonReader(dict(self.options))


class Batch(InputPartition):
    def __init__(self, number: int, value: str):
        super().__init__(value)
        self.number = number


class JsonReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Batch(k, ",".join(b)) for k, b in enumerate(batches(json.loads(self.options["keys"]), int(self.options.get("size", 1))))]

    def fetched(self, partition: Batch) -> str:
        fetch, url = fetcher(self.options), self.options["url"].replace("{key}", urllib.parse.quote(partition.value))
        return fetch(url) if self.options.get("errors", "raise") != "warn" else or_nothing(fetch, url)

    def read(self, partition: Batch) -> Iterator[tuple]:
        fields = [f.strip() for f in self.options["fields"].split(",")]
        for row in json.loads(self.fetched(partition) or "[]"):
            yield (partition.value, partition.number, *[None if row.get(f) is None else str(row[f]) for f in fields])


class TextRows(DataSource):
    """format('text_rows'): (key, batch, text): the whole text fetched from url for each of keys; options as of json_rows but fields.

    Run tables (readers.runinfo) and records of sample attributes (sample_attributes) start from it.
    """

    @classmethod
    def name(cls) -> str:
        return "text_rows"

    def schema(self) -> str:
        return "key string, batch int, text string"

    def reader(self, schema: object) -> TextReader:
        return TextReader(dict(self.options))


class TextReader(JsonReader):
    def read(self, partition: Batch) -> Iterator[tuple]:
        yield partition.value, partition.number, self.fetched(partition)


def sample_attributes(spark: SparkSession, url: str, keys: list[str], **options: str) -> DataFrame:
    """(key, attributes) of sample records fetched as XML, one request a key, tried again while the server asks to wait."""
    from fieldbiome.sources.readers import sample_attributes as parsed

    spark.dataSource.register(TextRows)
    got = spark.read.format("text_rows").options(url=url, keys=json.dumps(keys), **options).load()
    return parsed(got.where("trim(text) <> ''"), "text").select("key", "attributes")


def run_tables(spark: SparkSession, url: str, keys: list[str], **options: str) -> DataFrame:
    """(run, fields) of run tables fetched as CSV, in batches of keys."""
    from fieldbiome.sources.readers import runinfo

    spark.dataSource.register(TextRows)
    return runinfo(spark.read.format("text_rows").options(url=url, keys=json.dumps(keys), **options).load(), "text")
