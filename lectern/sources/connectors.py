"""Connectors to services, as seams: a callable makes the calls, Spark deals the batches.

The callables are the caller's: HTTP clients, language models, embedding models. Each gets a list and returns a list of
the same length, null where a row has no answer.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lectern.functions import text, vectors


def in_batches(rows: DataFrame, key: str, value: str, call: Callable[[Sequence], Sequence], result: str, kind: str, size: int = 500, pause: float = 0.0) -> DataFrame:
    """(key, result) of call over value, in batches of one task's rows; answers are matched by position."""
    schema = f"{key} {dict(rows.dtypes)[key]}, {result} {kind}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), size):
                part = frame.iloc[k : k + size]
                answers = list(call(part[value].tolist()))
                if len(answers) != len(part):
                    raise ValueError(f"{len(part)} rows were asked for, {len(answers)} came back")
                yield pd.DataFrame({key: part[key].to_numpy(), result: pd.Series(answers, dtype=object)})
                if pause:
                    time.sleep(pause)

    return rows.select(key, value).mapInPandas(run, schema)


def zipped(batches: DataFrame) -> DataFrame:
    """(id, answer) from batches (ids, answers): answer i belongs to id i; missing answers are null."""
    return batches.select(F.explode(F.arrays_zip("ids", "answers")).alias("p")).where("p.ids is not null").select(F.col("p.ids").alias("id"), F.col("p.answers").alias("answer"))


def stand_in_embedding(column: Column, dims: int = 64) -> Column:
    """A text's vector where no model is at hand."""
    words = F.split(F.lower(column), r"[ ,.;:\n]")
    return vectors.word_hash_vector(words, dims)


def passages(papers: DataFrame, longest: int = 4000) -> DataFrame:
    """(paper_id, text) as an embedding model gets it."""
    return papers.select("paper_id", text.document_text(F.col("title"), text.truncated(F.col("abstract"), longest)).alias("text"))


class Throttle:
    """At least `interval` seconds from one call to the next in this process."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.last = interval, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (rest := self.last + self.interval - self.clock()) > 0:
            self.sleep(rest)
        self.last = self.clock()


class Busy(OSError):
    """A service asks to be called again after some seconds."""

    def __init__(self, retry_after: float = 0.0):
        super().__init__(f"busy for {retry_after} s")
        self.retry_after = retry_after


def harvest(fetch: Callable[[str | None], tuple[str, str | None]], token: str | None = None, attempts: int = 5, throttle: Throttle | None = None, longest_wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[str | None, str]]:
    """Pages (token, body) from fetch(token) -> (body, next token), until no token follows.

    A failed call is repeated, `attempts` times in all, after the time that a busy service asks for, longest_wait at most.
    The token of the last page that was stored resumes a harvest.
    """
    while True:
        for left in range(attempts - 1, -1, -1):
            if throttle:
                throttle.wait()
            try:
                body, following = fetch(token)
                break
            except OSError as error:
                if not left:
                    raise
                if isinstance(error, Busy) and error.retry_after > 0:
                    sleep(min(longest_wait, error.retry_after))
        yield token, body
        if not following:
            return
        token = following


def paged(fetch: Callable[[str, str, str, int, int], tuple[int, list]], category: str, since: str, until: str, size: int = 100, most: int | None = None, throttle: Throttle | None = None) -> Iterator[list]:
    """Pages of a category's entries between two times, from fetch(category, since, until, start, size) -> (total, entries).

    A page that comes empty although the total says there is more is asked for once again; if it stays empty, the rest is
    taken to be missing. most: entries after which to stop.
    """
    start = 0
    while most is None or start < most:
        for again in (True, False):
            if throttle:
                throttle.wait()
            total, entries = fetch(category, since, until, start, size)
            if entries or start >= total or not again:
                break
        if not entries:
            return
        entries = entries if most is None else entries[: most - start]
        yield entries
        start += len(entries)
        if start >= total:
            return


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def named(name: str) -> Callable:
    """What "module:name" names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class HarvestStream(DataSource):
    """spark.readStream.format("harvest_pages"): a harvest, page after page; the offset is the resumption token.

    Options: path, a folder of files with a line of JSON (token, next, body) for each page, the first with an empty token; fetch,
    "module:function" of a live service, called as harvest calls it. A live page is stored in path before an offset names it, so
    after a failure it is read from there and not fetched again. The driver knows tokens and places; tasks read the bodies.
    """

    @classmethod
    def name(cls) -> str:
        return "harvest_pages"

    def schema(self) -> str:
        return "token string, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _HarvestReader(self.options["path"], self.options.get("fetch"), int(self.options.get("pages", 64)))


class _HarvestReader(DataSourceStreamReader):
    def __init__(self, path: str, fetch: str | None, pages: int):
        self.path, self.fetch, self.pages = path, fetch, pages
        self.index: dict[str, tuple[str, int, int, str]] = {}
        self.seen: set[str] = set()
        self.at = {"token": "", "done": False}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"token": "", "done": False}

    def _place(self, token: str) -> tuple[str, int, int, str] | None:
        """Where a token's page is, and the next token: each file is opened once, when a token isn't known yet."""
        if token not in self.index:
            from pyarrow import fs

            store, root = _store(self.path)
            for found in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if found.is_file and found.path not in self.seen and found.base_name[0] not in "._":
                    self.seen.add(found.path)
                    with store.open_input_file(found.path) as f:
                        at = 0
                        for line in f.read().split(b"\n"):
                            if line.strip():
                                page = json.loads(line)
                                self.index[page["token"] or ""] = (found.path, at, len(line), page["next"] or "")
                            at += len(line) + 1
        return self.index.get(token)

    def _fetched(self, token: str) -> bool:
        """Fetch and store a page of a live service."""
        got: list = []

        def once(asked: str | None) -> tuple[str, None]:
            got[:] = named(self.fetch)(asked)
            return got[0], None

        next(harvest(once, token or None))
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name = f"{root}/page-{hashlib.sha1(token.encode()).hexdigest()}.json"
        with store.open_output_stream(f"{root}/.{name.rsplit('/', 1)[-1]}") as out:
            out.write(json.dumps({"token": token, "next": got[1], "body": got[0]}).encode())
        store.move(f"{root}/.{name.rsplit('/', 1)[-1]}", name)
        return True

    def latestOffset(self, *_) -> dict:  # noqa: N802
        """All recorded pages from where this reader was, and of a live service one more."""
        live = self.fetch is not None
        while not self.at["done"]:
            place = self._place(self.at["token"])
            if place is None and live and self._fetched(self.at["token"]):
                place, live = self._place(self.at["token"]), False
            if place is None:
                break
            self.at = {"token": place[3], "done": not place[3]}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        places, now = [], dict(start)
        while now != end and not now["done"]:
            path, at, length, following = self._place(now["token"])
            places.append((path, at, length))
            now = {"token": following, "done": not following}
        return [InputPartition(places[k : k + self.pages]) for k in range(0, len(places), self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        store, files = _store(self.path)[0], {}
        for path, at, length in partition.value:
            if path not in files:
                files = {path: store.open_input_file(path)}  # pages of a file mostly follow each other
            page = json.loads(files[path].read_at(length, at))
            yield page["token"] or "", page["body"]

    def commit(self, end: dict) -> None:
        pass


class PagedService(DataSource):
    """spark.read.format("paged_service"): entries of a paged service, its pages as partitions.

    Options: fetch, "module:function" called as paged calls it, with the other options as its last argument; categories, by commas;
    since, until; size of a page; lanes: tasks that ask at a time; interval: seconds from one call to the next of all tasks. The first
    page of each category says how many there are; the others are dealt over the lanes, each of which waits lanes x interval.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_service"

    def schema(self) -> str:
        return "category string, start int, entry string"

    def reader(self, schema) -> DataSourceReader:
        return _ServiceReader(dict(self.options))


class _ServiceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.size, self.lanes = options, int(options.get("size", 100)), int(options.get("lanes", 1))
        self.interval = float(options.get("interval", 0.0))

    def _asked(self, category: str, start: int, throttle: Throttle) -> tuple[int, list]:
        """A page; one that comes empty although the total says there is more is asked for once again."""
        for again in (True, False):
            throttle.wait()
            total, entries = named(self.options["fetch"])(category, self.options.get("since", ""), self.options.get("until", ""), start, self.size, self.options)
            if entries or start >= total or not again:
                break
        return total, entries

    def partitions(self) -> list[InputPartition]:
        lanes, throttle, n = [[] for _ in range(self.lanes)], Throttle(self.interval), 0
        for category in filter(None, self.options["categories"].split(",")):
            total, entries = self._asked(category, 0, throttle)
            lanes[n % self.lanes].append((category, 0, entries))
            n += 1
            for start in range(self.size, total, self.size):
                lanes[n % self.lanes].append((category, start, None))
                n += 1
        return [InputPartition(lane) for lane in lanes if lane]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        throttle = Throttle(self.interval * self.lanes)
        for category, start, entries in partition.value:
            for entry in self._asked(category, start, throttle)[1] if entries is None else entries:
                yield category, start, str(entry)


def stored_reply(category: str, since: str, until: str, start: int, size: int, options: dict) -> tuple[int, list]:
    """A recorded service: a folder lang=.../page=... with a reply (total, ids) for each page, in option at."""
    from pyarrow import fs

    store, root = _store(options["at"])
    files = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/lang={category}/page={start // size}", allow_not_found=True)) if f.base_name.endswith(".json")]
    if not files:
        return start, []
    with store.open_input_file(files[0]) as f:
        reply = json.loads(f.read())
    return reply["total"], reply["ids"]


def scored_by_length(pairs: DataFrame, call: Callable[[list[tuple[str, str]]], list[float]], size: int = 32, tasks: int | None = None) -> DataFrame:
    """(query_id, paper_id, score, padded) of pairs (query_id, paper_id, query, passage), by call over batches of `size` pairs.

    A cross-encoder pads a batch to its longest pair, so pairs are dealt and sorted by range of length, which puts pairs of about one
    length in a batch. padded: by how much a pair's batch is longer than it. Null texts count as empty.
    """
    text_of = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = pairs.select("query_id", "paper_id", text_of("query").alias("query"), text_of("passage").alias("passage"))
    rows = rows.withColumn("length", F.length("query") + F.length("passage"))
    keys = ["length", "query_id", "paper_id"]
    dealt = (rows.repartitionByRange(tasks, *keys) if tasks else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), size):
                part = frame.iloc[k : k + size]
                scores = list(call(list(zip(part["query"], part["passage"]))))
                if len(scores) != len(part):
                    raise ValueError(f"{len(part)} pairs were asked for, {len(scores)} came back")
                yield pd.DataFrame({"query_id": part["query_id"], "paper_id": part["paper_id"], "score": scores, "padded": part["length"].max() - part["length"]})

    kinds = dict(pairs.dtypes)
    return dealt.mapInPandas(run, f"query_id {kinds['query_id']}, paper_id {kinds['paper_id']}, score double, padded int")


class PagedSource(DataSource):
    """spark.read.format("paged_pages"): pages of a recorded service reply, one file each, dealt over tasks.

    Options: path, a folder that driver and executors share; pages per task.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_pages"

    def schema(self) -> str:
        return "page string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options["path"], int(self.options.get("pages", 16)))


class _PagedReader(DataSourceReader):
    def __init__(self, path: str, pages: int):
        self.path, self.pages = path, pages

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        names = iter(sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.is_file))
        out = []
        while part := list(islice(names, self.pages)):
            out.append(InputPartition(part))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for name in partition.value:
            with store.open_input_file(name) as f:
                yield name.rsplit("/", 1)[-1], f.read().decode()
