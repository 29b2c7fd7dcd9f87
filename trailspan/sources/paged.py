"""A paged feature service as a Spark data source: one partition a page, with retries."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def post(url: str, params: dict, tries: int = 4, wait: Callable[[float], None] = time.sleep) -> dict:
    """JSON answer of a POST; after a failure it waits 1, 2, 4, ... seconds and tries again."""
    body = urllib.parse.urlencode(params).encode()
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data=body), timeout=60) as answer:
                return json.load(answer)
        except (OSError, ValueError):
            if attempt == tries - 1:
                raise
            wait(2.0**attempt)
    raise ValueError("tries must be positive")


class Page(InputPartition):
    def __init__(self, offset: int):
        super().__init__(offset)
        self.offset = offset


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.size = options["url"], int(options.get("pageSize", 1000))

    def partitions(self) -> list[Page]:
        count = int(post(f"{self.url}/query", {"where": "1=1", "returnCountOnly": "true", "f": "json"})["count"])
        return [Page(i) for i in range(0, count, self.size)] or [Page(0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        answer = post(f"{self.url}/query", {"where": "1=1", "outFields": "*", "orderByFields": "OBJECTID", "f": "geojson", "resultOffset": partition.offset, "resultRecordCount": self.size})
        for feature in answer.get("features", []):
            yield json.dumps(feature.get("properties")), json.dumps(feature.get("geometry"))


class FeatureService(DataSource):
    """``spark.read.format("paged_features").option("url", layer)``: properties and geometry as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "properties string, geometry string"

    def reader(self, schema) -> FeatureReader:
        return FeatureReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeatureService)
