"""A data source for listings that come in pages, each of which names the next one by a cursor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: What gives a page: from a cursor the items, and the next cursor or None.
Fetch = Callable[[str], tuple[list[str], str | None]]
SCHEMA = "cursor string, pos int, item string"
END = "\x00"


def paged(short: str, fetch: Fetch, first: str = "", per_batch: int = 10) -> type[DataSource]:
    """A source named short, to be registered with spark.dataSource.register and read in batch or as a stream.

    Batch: the whole chain, in one task, as each page is known only from the one before. Stream: some pages a batch;
    the offset is the cursor that comes next, so a restarted query goes on there. A cursor that comes twice ends a chain.
    """

    def rows(cursor: str) -> tuple[list[tuple], str | None]:
        items, following = fetch(cursor)
        return [(cursor, i, x) for i, x in enumerate(items)], following

    class Whole(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(first)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            cursor, seen = partition.value, set()
            while cursor is not None and cursor not in seen:
                seen.add(cursor)
                found, cursor = rows(cursor)
                yield from found

    class Pages(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"cursor": first, "pages": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            cursor, out, n = start["cursor"], [], 0
            while cursor != END and n < per_batch:
                found, following = rows(cursor)
                out += found
                cursor, n = END if following is None else following, n + 1
            return iter(out), {"cursor": cursor, "pages": start["pages"] + n}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            cursor, n = start["cursor"], start["pages"]
            while n < end["pages"]:
                found, following = rows(cursor)
                yield from found
                cursor, n = END if following is None else following, n + 1

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return short

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Whole()

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Pages()

    return Paged
