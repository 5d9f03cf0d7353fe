"""A paged REST endpoint as a Spark data source: one partition for each page of an offset or page scheme."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

CASTS = {"bigint": int, "int": int, "double": float, "string": str}


def walk(data: object, path: str) -> object:
    """The value at a dotted path; numbers index lists."""
    for key in [k for k in path.split(".") if k]:
        data = data[int(key)] if isinstance(data, list) else (data or {}).get(key)
    return data


def cast(value: object, kind: str) -> object:
    if value is None:
        return None
    if kind == "boolean":
        return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).lower())
    return CASTS[kind](value) if kind in CASTS and not isinstance(value, (dict, list)) else json.dumps(value)


class Pages(InputPartition):
    """The (number, size) of the pages of one task, and how many tasks there are."""

    def __init__(self, pages: list[tuple[int, int]], tasks: int) -> None:
        self.pages, self.tasks = pages, tasks


class RestSource(DataSource):
    """A paged endpoint.

    url, timeout; rows: path of the list in an answer; header.X, param.X: sent with each request; params: names that param.X may have, comma-separated, another
    raises ValueError. count: how many rows at most; page_size. scheme: none, offset, page, seek (each page asks for what follows the last row's seek_path) or
    token (each answer names the next page at token_path, none at the end); limit_key, and offset_key for what tells the page. Pages of seek and token
    schemes are read one after another by one task. A page without rows ends the pages of its task. per_second bounds the requests of all tasks together:
    there are tasks of them (1 if unset), each of which waits between its requests.
    """

    @classmethod
    def name(cls) -> str:
        return "tidewright_rest"

    def schema(self) -> str:
        raise ValueError("a REST source needs a schema")

    def reader(self, schema: StructType) -> RestReader:
        return RestReader(schema, dict(self.options))


class RestReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema]
        self.o = {k.lower(): v for k, v in options.items()}
        allowed = {p.strip().lower() for p in self.o.get("params", "").split(",") if p.strip()}
        unknown = {k[6:] for k in self.o if k.startswith("param.")} - allowed
        if allowed and unknown:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        self.scheme, self.size = self.o.get("scheme", "none"), int(self.o.get("page_size", 100))
        if self.scheme not in ("none", "offset", "page", "seek", "token"):
            raise ValueError(f"unknown scheme {self.scheme}")

    def partitions(self) -> list[Pages]:
        count = int(self.o.get("count", 100))
        sizes = [count] if self.scheme == "none" else [min(self.size, count - k * self.size) for k in range(math.ceil(count / self.size))]
        if self.scheme in ("seek", "token"):
            tasks = 1
        else:
            tasks = int(self.o.get("tasks", 1 if "per_second" in self.o else len(sizes)))
        numbered = list(enumerate(sizes))
        return [Pages(numbered[k::tasks], tasks) for k in range(min(tasks, len(numbered)))]

    def read(self, pages: Pages) -> Iterator[tuple]:
        at = None
        for number, size in pages.pages:
            if "per_second" in self.o:
                time.sleep(pages.tasks / float(self.o["per_second"]))
            answer = self.ask(number, size, at)
            rows = walk(answer, self.o.get("rows", "")) or []
            for row in rows if self.scheme == "none" else rows[:size]:
                yield tuple(cast(walk(row, name), kind) for name, kind in self.fields)
            if self.scheme == "seek" and rows:
                at = walk(rows[-1], self.o["seek_path"])
            if self.scheme == "token":
                at = walk(answer, self.o["token_path"])
            if not rows or (self.scheme in ("seek", "token") and at is None):
                return

    def ask(self, number: int, size: int, at: object) -> object:
        params = {k[6:]: v for k, v in self.o.items() if k.startswith("param.")}
        if self.scheme != "none":
            params[self.o.get("limit_key", "limit")] = str(size)
            place = {"offset": number * self.size, "page": number + 1}.get(self.scheme, at)
            if place is not None:
                params[self.o.get("offset_key", self.scheme)] = str(place)
        request = Request(self.o["url"] + ("?" + urlencode(params) if params else ""), headers={k[7:]: v for k, v in self.o.items() if k.startswith("header.")})
        with urlopen(request, timeout=float(self.o.get("timeout", 30))) as answer:
            return json.load(answer)
