"""``spark.readStream.format("weft_pages")``: services whose records come in numbered pages, read as a stream.

An offset says for each service how many of its pages were read; a batch reads what is new, one partition for each service and ``pages`` pages of it, so services are
read side by side and a long one by several tasks.  Restarted from a checkpoint, no page is read again.  Services may be added at any time and start at their first page.

Options: ``path``, the folder of all services (service=<name>/page=<n>/ with files of JSON lines, numbered from 0), or ``source`` ("module:Class", made with the options, with services(),
count(service) and read(service, page)); ``fields`` (name=dotted path;...); ``pages``, the most pages of one task (100).
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Folder:
    """Services as folders of pages, on any file system that Arrow knows."""

    def __init__(self, options: dict):
        self._where = options["path"].rstrip("/")

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self._where if re.match(r"[a-z0-9+]+:", self._where) else f"file://{self._where}")

    def _folders(self, below: str, key: str) -> dict[str, str]:
        from pyarrow import fs

        store, root = self._open()
        found = store.get_file_info(fs.FileSelector(f"{root}/{below}".rstrip("/"), allow_not_found=True))
        return {unquote(f.base_name.split("=", 1)[1]): f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(f"{key}=")}

    def services(self) -> list[str]:
        return sorted(self._folders("", "service"))

    def count(self, service: str) -> int:
        """The pages that are there without a gap; a page behind a gap waits for it."""
        have = {int(p) for p in self._folders(self._folders("", "service")[service], "page")}
        return next(n for n in range(len(have) + 1) if n not in have)

    def read(self, service: str, page: int) -> Iterator[dict]:
        from pyarrow import fs

        store, root = self._open()
        for f in sorted(store.get_file_info(fs.FileSelector(f"{root}/{self._folders('', 'service')[service]}/page={page}")), key=lambda f: f.path):
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
                with store.open_input_stream(f.path) as lines:
                    yield from (json.loads(x) for x in lines.read().splitlines() if x.strip())


def _source(options: dict):
    if "source" not in options:
        return Folder(options)
    module, name = options["source"].split(":")
    return getattr(importlib.import_module(module), name)(options)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weft_pages"

    def schema(self) -> str:
        return "service string, page long, " + ", ".join(f"`{f.split('=')[0]}` string" for f in self.options["fields"].split(";"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self._options = options
        self._fields = [f.split("=", 1)[1] for f in options["fields"].split(";")]
        self._most = int(options.get("pages", 100))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        source = _source(self._options)
        return {s: source.count(s) for s in source.services()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((s, a, min(a + self._most, n))) for s, n in sorted(end.items()) for a in range(start.get(s, 0), n, self._most)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from .web import dig

        source, (service, start, end) = _source(self._options), partition.value
        for page in range(start, end):
            for record in source.read(service, page):
                values = (dig(record, path) for path in self._fields)
                yield (service, page, *(None if v is None else v if isinstance(v, str) else json.dumps(v) for v in values))

    def commit(self, end: dict) -> None:
        pass
