"""Recorded answers of the archive's index and of object stores, a page of an answer per partition.

``recorded_cdx`` reads the index server's JSON pages (a header row, then rows),
``recorded_listing`` the XML pages of a bucket listing. Comparisons of
timestamps, status codes and prefixes are pushed into the reader: pages whose
name tells that they hold nothing of what is asked are not opened, other rows
are dropped as they are read. Needs ``spark.sql.python.filterPushdown.enabled``
for that, which :func:`read_cdx` and :func:`read_listing` set; without it Spark
filters after the scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)

from .tree import opened

#: The index server's fields, by position where a page has no header.
CDX_FIELDS = ("urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "length")
CDX = "url string, page int, " + ", ".join(f"{f} string" for f in CDX_FIELDS)
LISTING = "key string, page int"
_KEY = re.compile(r"<Key>([\s\S]*?)</Key>")
_TOKEN = re.compile(r"<NextContinuationToken>[\s\S]*?</NextContinuationToken>")
_TRUNCATED = re.compile(r"<IsTruncated>\s*true\s*</IsTruncated>", re.I)

_TESTS = {
    EqualTo: lambda v, w: v == w,
    In: lambda v, w: v in w,
    GreaterThan: lambda v, w: v > w,
    GreaterThanOrEqual: lambda v, w: v >= w,
    LessThan: lambda v, w: v < w,
    LessThanOrEqual: lambda v, w: v <= w,
    StringStartsWith: lambda v, w: v.startswith(w),
}
#: Entities of XML, the ampersand last.
_XML = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


@dataclass
class Page(InputPartition):
    """A recorded page: its file, what its name says, and whether it is an answer's last."""

    path: str
    names: dict[str, str]
    number: int
    last: bool


@dataclass
class Wanted:
    """Comparisons of strings that a reader applies itself."""

    fields: tuple[str, ...]
    tests: list[tuple[str, type, object]] = field(default_factory=list)

    def take(self, filters: Iterable[Filter]) -> Iterator[Filter]:
        """Keeps the filters that it can apply and gives back the others."""
        for f in filters:
            values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in self.fields and all(isinstance(v, str) for v in values):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def fits(self, row: dict[str, str | None]) -> bool:
        """Whether a row holds; fields that it does not have are not looked at, null fits nothing."""
        return all(row[n] is not None and _TESTS[kind](row[n], value) for n, kind, value in self.tests if n in row)


def _pages(root: str, suffix: str) -> list[tuple[str, str, int]]:
    """(file, answer, number) of the files ``<answer>.<number><suffix>`` below a root."""
    system, base = opened(root)
    infos = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    named = [(i.path, re.fullmatch(rf"(?:.*/)?([^/]*)\.(\d+){re.escape(suffix)}", i.path)) for i in infos if i.is_file]
    return sorted((path, m[1], int(m[2])) for path, m in named if m)


class _Reader(DataSourceReader):
    suffix, schema, fields, named = "", "", (), ""

    def __init__(self, options: dict[str, str]):
        self.root, self.wanted = options["path"], Wanted(self.fields)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        yield from self.wanted.take(filters)

    def partitions(self) -> list[Page]:
        pages = _pages(self.root, self.suffix)
        last: dict[str, int] = {}
        for _, answer, n in pages:
            last[answer] = max(n, last.get(answer, n))
        made = [Page(path, {self.named: unquote(answer)}, n, n == last[answer]) for path, answer, n in pages]
        # An answer of no page would leave Spark without a partition.
        return [p for p in made if self.wanted.fits(p.names)] or [Page("", {}, 0, True)]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        if not page.path:
            return
        system, _ = opened(self.root)
        with system.open_input_stream(page.path) as file:
            text = file.read().decode("utf-8")
        rows = [r for r in self.rows(text, page) if self.wanted.fits(r)]
        if rows:
            kinds = [f.strip().split(" ") for f in self.schema.split(",")]
            names = {n: pa.int32() if k == "int" else pa.string() for n, k in kinds}
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(names.items())))

    def rows(self, text: str, page: Page) -> Iterator[dict]:
        raise NotImplementedError


class CdxReader(_Reader):
    suffix, schema, fields, named = ".json", CDX, ("url", *CDX_FIELDS), "url"

    def rows(self, text: str, page: Page) -> Iterator[dict]:
        """Rows of a page by its header; an answer that is no JSON list (an error page) has none."""
        try:
            found = json.loads(text)
        except ValueError:
            return
        if not isinstance(found, list) or not found or not isinstance(found[0], list):
            return
        header = found[0] if set(found[0]) <= set(CDX_FIELDS) else None
        for row in found[1:] if header else found:
            if isinstance(row, list):
                own = dict(zip(header or CDX_FIELDS, (None if v is None else str(v) for v in row), strict=False))
                yield {"url": page.names["url"], "page": page.number} | {f: own.get(f) for f in CDX_FIELDS}


class ListingReader(_Reader):
    suffix, schema, fields, named = ".xml", LISTING, ("key",), "bucket"

    def rows(self, text: str, page: Page) -> Iterator[dict]:
        """Keys of a page; a listing whose recording breaks off is an error, since keys would be missing."""
        goes_on = bool(_TRUNCATED.search(text) and _TOKEN.search(text))
        if goes_on == page.last:
            raise ValueError(f"the listing {page.names['bucket']} {'breaks off after' if goes_on else 'ends before its last recorded'} page {page.number}")
        for key in _KEY.findall(text):
            for entity, char in _XML:
                key = key.replace(entity, char)
            yield {"key": key, "page": page.number}


class CdxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_cdx"

    def schema(self) -> str:
        return CDX

    def reader(self, schema) -> CdxReader:
        return CdxReader(self.options)


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def page_name(answer: str, number: int, suffix: str) -> str:
    """The file name of a recorded page of an answer (a URL's rows, or a bucket's keys)."""
    return f"{quote(answer, safe='')}.{number}{suffix}"


def _read(spark: SparkSession, source: type[DataSource], root: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load(root)


def read_cdx(spark: SparkSession, root: str) -> DataFrame:
    """url, page and the index fields of all recorded answers below a root, unordered; damaged answers have no rows."""
    return _read(spark, CdxSource, root)


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    """key and page of the recorded bucket listings below a root."""
    return _read(spark, ListingSource, root)
