"""A listing that comes in pages, as a source of Spark: a task for each folder follows its page tokens; a stream takes the pages that have come since."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: A listed item; ``folder`` is the folder that it was listed in, ``child_count`` is null for files.
ITEM = "folder string, id string, name string, web_url string, modified_ms long, child_count int"
_FIELDS = tuple(f.split()[0] for f in ITEM.split(", "))


class Client(Protocol):
    """A service that lists: its folders, and a page of a folder by its token (the first one's is empty) with the next page's token, None at the end."""

    def folders(self) -> list[str]: ...
    def page(self, folder: str, token: str) -> tuple[list[dict], str | None]: ...


class PageFiles:
    """A client over pages that ``write_pages`` wrote: any store that Arrow opens by address."""

    def __init__(self, path: str):
        from pyarrow import fs

        self._fs, self._root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self._fs_module = fs

    def _names(self, path: str) -> list[str]:
        found = self._fs.get_file_info(self._fs_module.FileSelector(path, allow_not_found=True))
        return sorted(i.base_name for i in found if not i.base_name.startswith(("_", ".")))

    def folders(self) -> list[str]:
        return [n.removeprefix("folder=") for n in self._names(self._root)]

    def page(self, folder: str, token: str) -> tuple[list[dict], str | None]:
        path = f"{self._root}/folder={folder}/token={token or 'p0'}"
        lines = [line for n in self._names(path) for line in self._fs.open_input_stream(f"{path}/{n}").read().decode().splitlines()]
        if len(lines) != 1:
            raise OSError(f"a page has one line: {path}")
        page = json.loads(lines[0])
        return page["items"], page.get("next")


def pages_of(client: Client, folder: str, token: str, tries: int, wait_s: float) -> Iterator[tuple[list[dict], str | None]]:
    """A folder's pages from a token on. A page that is lost (OSError) is asked again; after ``tries`` in a row the error stands, and the task is Spark's to repeat."""
    at: str | None = token
    while at is not None:
        for left in range(tries - 1, -1, -1):
            try:
                items, at = client.page(folder, at)
                break
            except OSError:
                if not left:
                    raise
                time.sleep(wait_s)
        yield items, at


class Folder(InputPartition):
    def __init__(self, folder: str, start: int = 0, end: int | None = None):
        self.folder, self.start, self.end = folder, start, end


class _Options:
    def __init__(self, options: dict[str, str]):
        self.path, self.tries, self.wait_s = options["path"], int(options.get("tries", 3)), float(options.get("waitSeconds", 0.1))

    def client(self) -> Client:
        return PageFiles(self.path)

    def rows(self, part: Folder) -> Iterator[tuple]:
        for n, (items, _) in enumerate(pages_of(self.client(), part.folder, "" if not part.start else f"p{part.start}", self.tries, self.wait_s), part.start):
            if part.end is not None and n >= part.end:
                return
            for item in items:
                yield (part.folder, *(item.get(f) for f in _FIELDS[1:]))


class _Batch(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Folder]:
        return [Folder(f) for f in self.options.client().folders()]

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.options.rows(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are each folder's number of pages read; pages are only added, so a batch is the pages between two offsets, however often it is read."""

    def __init__(self, options: _Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        client = self.options.client()
        return {f: sum(1 for _ in pages_of(client, f, "", self.options.tries, self.options.wait_s)) for f in client.folders()}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return [Folder(f, start.get(f, 0), n) for f, n in end.items() if n > start.get(f, 0)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.options.rows(partition)


class PagedListing(DataSource):
    """``spark.read.format("paged_listing").option("path", ...)``. Options: tries (of a lost page, 3) and waitSeconds between them."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Options(self.options))


def listed(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """All items of the folders that a service lists, each once."""
    spark.dataSource.register(PagedListing)
    return (spark.readStream if stream else spark.read).format("paged_listing").options(path=path, **options).load()


def folders_of(items: DataFrame) -> DataFrame:
    return items.filter(F.col("child_count").isNotNull())


def files_of(items: DataFrame) -> DataFrame:
    return items.filter(F.col("child_count").isNull())


def write_pages(items: DataFrame, path: str, size: int, mode: str = "error") -> None:
    """Writes a listing as pages of ``size`` items for each folder, in order of ids; the next page's token goes with each but the last. items: ``ITEM``."""
    from ..operators.prefix import numbered

    nth = numbered(items, ["folder"], [F.asc("id")], "_nth").withColumn("_page", F.floor((F.col("_nth") - 1) / size))
    fields = F.struct(*_FIELDS[1:])
    each = nth.groupBy("folder", "_page").agg(F.array_sort(F.array_agg(F.struct("_nth", fields.alias("item")))).alias("all"))
    last = each.groupBy(F.col("folder").alias("_of")).agg(F.max("_page").alias("_last"))
    told = each.join(last, F.col("folder") == F.col("_of"))
    follows = F.when(F.col("_page") < F.col("_last"), F.concat(F.lit("p"), (F.col("_page") + 1).cast("string")))
    page = F.to_json(F.struct(F.transform("all", lambda x: x["item"]).alias("items"), follows.alias("next")))
    told.select("folder", F.concat(F.lit("p"), F.col("_page").cast("string")).alias("token"), page.alias("value")).write.mode(mode).partitionBy("folder", "token").text(path)
