"""A paged JSON source: pages in a folder, each naming the next, as a paged web service gives them.

Register it with ``spark.dataSource.register(JsonPages)`` and read with
``spark.read.format("json_pages").options(path=..., items="news").load()``.
The pages of one folder are one partition, because each page is known only from the one before;
several folders (comma-separated) are read in parallel.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIRST_PAGE = "first"


class JsonPages(DataSource):
    """Rows ``value`` (the JSON of an item) and ``page``. Options: ``path``, ``items`` (key of the list), ``token`` (key of the next page), ``max_pages``."""

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "value string, page int"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(dict(self.options))


class _Pages(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folders = [p for p in options["path"].split(",") if p]
        self.items, self.token = options.get("items", "news"), options.get("token", "next_page_token")
        self.most = int(options.get("max_pages", "200"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.folders]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int]]:
        page, seen = FIRST_PAGE, 0
        while page:
            if seen >= self.most:
                raise RuntimeError(f"more than {self.most} pages; what was read would be incomplete")
            with open(os.path.join(partition.value, f"{page}.json"), encoding="utf-8") as f:
                body = json.load(f)
            for item in body.get(self.items) or []:
                if isinstance(item, dict):
                    yield json.dumps(item), seen
            page, seen = body.get(self.token), seen + 1
