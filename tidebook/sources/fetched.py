"""A data source whose rows an injected function fetches: one entry (a session, a feed, a ticker) at a time, in tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import GRID_COLUMNS, grid_header, grid_rows

SCHEMA = "entry string, outcome string, reason string, attempts int, cells array<string>"
#: fetch(entry, address) gives the rows of an entry, each a list of cells, or None where there is nothing, such as no session.
Fetch = Callable[[str, str], Sequence[Sequence] | None]


class Refused(Exception):
    """The other side won't answer: another address may, trying again won't."""


@dataclass
class Entries(InputPartition):
    entries: list[str]


@dataclass
class Fetcher:
    """How entries are fetched. Errors of the network (OSError) are tried again after backoff seconds, then twice as many, and
    so on; a refusal goes on to the next address at once; any other error ends the entry. An entry that fails is a row with
    the reason, and stops no other.
    """

    fetch: Fetch
    addresses: tuple[str, ...] = ("",)
    retries: int = 2
    backoff: float = 2.0
    delay: float = 0.0
    check: Callable[[Sequence[Sequence]], Sequence[Sequence]] = list
    sleep: Callable[[float], None] = time.sleep

    def rows(self, entry: str) -> Iterator[tuple]:
        outcome, reason, tries = "failed", "no address", 0
        for address in self.addresses:
            for attempt in range(self.retries + 1):
                tries += 1
                try:
                    found = self.fetch(entry, address)
                    if found is None:
                        yield entry, "nothing", None, tries, None
                        return
                    body = self.check(found)
                    yield entry, "fetched", None, tries, None
                    for row in body:
                        yield entry, "row", None, tries, [None if c is None else str(c) for c in row]
                    return
                except Refused as e:
                    outcome, reason = "refused", str(e)
                    break
                except OSError as e:
                    outcome, reason = "failed", f"{type(e).__name__}: {e}"
                    if attempt < self.retries:
                        self.sleep(self.backoff * (attempt + 1))
                except Exception as e:
                    yield entry, "failed", f"{type(e).__name__}: {e}", tries, None
                    return
        yield entry, outcome, reason, tries, None

    def read(self, partition: Entries) -> Iterator[tuple]:
        for k, entry in enumerate(partition.entries):
            if k and self.delay:
                self.sleep(self.delay)
            yield from self.rows(entry)


def source(name: str, fetcher: Fetcher, entries: Sequence[str], due: Callable[[], int] | None = None, together: int = 1) -> type[DataSource]:
    """A data source class of this name over entries, together of them in a task (one after another, delay between them).

    due: how many of the entries, in their order, are there by now, for a stream, whose offsets are such numbers; all by
    default. A batch of a stream that runs again fetches the same entries. Register it with spark.dataSource.register().
    """
    held = list(entries)

    def dealt(a: int, b: int) -> list[Entries]:
        return [Entries(held[k : min(k + together, b)]) for k in range(a, b, together)]

    class Batch(DataSourceReader):
        def partitions(self) -> list[Entries]:
            return dealt(0, len(held)) or [Entries([])]

        def read(self, partition: Entries) -> Iterator[tuple]:
            return fetcher.read(partition)

    class Stream(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"at": 0}

        def latestOffset(self) -> dict:
            return {"at": min(due() if due else len(held), len(held))}

        def partitions(self, start: dict, end: dict) -> list[Entries]:
            return dealt(start["at"], end["at"]) or [Entries([])]

        def read(self, partition: Entries) -> Iterator[tuple]:
            return fetcher.read(partition)

        def commit(self, end: dict) -> None:
            pass

    class Fetched(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Batch:
            return Batch()

        def streamReader(self, schema) -> Stream:
            return Stream()

    return Fetched


def outcomes(fetched: DataFrame) -> DataFrame:
    """entry, outcome (fetched, nothing, refused, failed), reason and attempts: one row an entry."""
    return fetched.filter("outcome <> 'row'").select("entry", "outcome", "reason", "attempts")


def failures(fetched: DataFrame) -> DataFrame:
    """entry, reason of the entries that gave no answer; those without a session did."""
    return outcomes(fetched).filter("outcome in ('refused', 'failed')").select("entry", "reason")


def sessions(spark: SparkSession, name: str, fetch: Fetch, days: Sequence[str], together: int = 1, **how) -> DataFrame:
    """What a batch fetches of session sheets: session_rows() and outcomes() read it. Write it once: every action fetches anew."""
    spark.dataSource.register(source(name, Fetcher(fetch, check=grid_header, **how), days, together=together))
    return spark.read.format(name).load()


def session_rows(fetched: DataFrame) -> DataFrame:
    """entry and the rows of fetched sheets, as files.session_grid() gives them."""
    cells = fetched.filter("outcome = 'row'").select("entry", *[F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(GRID_COLUMNS)])
    return grid_rows(cells, "entry")
