"""A Spark data source of provider listings: one partition for each provider, pages followed inside it.

``spark.read.format("catalog_listing")`` reads listings that an ingestion step has landed as files, or
any transport that is registered under a name.  A provider that fails is one row with its problem and
leaves the others as they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A transport gets (location, provider, page token) and returns the page's text.
Transport = Callable[[str, str, str | None], str]
#: Member that lists the records and member that names the next page, by kind of endpoint.
KINDS = {"openai": ("data", None), "anthropic": ("data", None), "google": ("models", "nextPageToken"), "vertex": ("publisherModels", "nextPageToken")}


def landed_files(location: str, provider: str, token: str | None) -> str:
    """Pages landed as ``<location>/<provider>/<page>.json``, the first named ``first``."""
    return (Path(location) / provider / f"{token or 'first'}.json").read_text(encoding="utf-8")


TRANSPORTS: dict[str, Transport] = {"files": landed_files}


class _Provider(InputPartition):
    def __init__(self, provider: str, kind: str):
        self.provider, self.kind = provider, kind


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.location = options["path"]
        self.transport = TRANSPORTS[options.get("transport", "files")]
        self.kinds = dict(p.split(":") if ":" in p else (p, "openai") for p in options.get("providers", "").split(",") if p)
        self.pages = int(options.get("pages", "1000"))

    def partitions(self) -> list[InputPartition]:
        kinds = self.kinds or {p.name: "openai" for p in sorted(Path(self.location).iterdir()) if p.is_dir()}
        return [_Provider(p, k) for p, k in kinds.items()]

    def read(self, partition: _Provider) -> Iterator[tuple]:
        try:
            yield from self._pages(partition.provider, partition.kind)
        except (OSError, ValueError, KeyError, TypeError) as problem:
            yield partition.provider, None, None, None, f"{type(problem).__name__}: {problem}"[:500]

    def _pages(self, provider: str, kind: str) -> Iterator[tuple]:
        member, following = KINDS[kind]
        token, seen, rows = None, set(), []
        for number in range(self.pages):
            page = json.loads(self.transport(self.location, provider, token))
            rows += [(provider, number, i, json.dumps(r), None) for i, r in enumerate(page[member])]
            token = page.get(following) if following else None
            if not token:
                break
            if token in seen:
                raise ValueError(f"page token {token!r} repeats")
            seen.add(token)
        yield from rows  # a provider is read whole or not at all


class ListingSource(DataSource):
    """Options: path; providers as ``name:kind,...`` (by default all directories); transport; pages, the most that are followed."""

    @classmethod
    def name(cls) -> str:
        return "catalog_listing"

    def schema(self) -> str:
        return "provider_id string, page int, place int, record string, problem string"

    def reader(self, schema) -> ListingReader:  # noqa: ANN001
        return ListingReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)
