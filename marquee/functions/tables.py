"""The extractors as table functions in SQL, for use with LATERAL.

    SELECT p.page_id, l.link FROM pages p, LATERAL ics_links(p.html, p.url, 20) l

register() gives a session ``anchors(html)``, ``ics_links(html, url, limit)``, ``ics_events(body)`` and
``schema_org_events(html, url, limit)``. Each checks its arguments when a query is analysed: texts are texts, a
body is binary or text, a limit is a constant that a run may have. Rows are those of the DataFrame forms in
marquee.sources.extract, in their order: ``ordinal`` or ``position`` counts from 0. A null argument gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, DataType, IntegerType, IntegralType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from marquee.functions.markup import links, plain, unescape
from marquee.operators.runs import run_limit
from marquee.sources.extract import ROWS, parse_ics, parse_ics_links, parse_jsonld

_EVENT = tuple(c.split()[0] for c in ROWS.split(", "))


def _schema(columns: str) -> StructType:
    """Columns of text and numbers; a schema in words needs the driver's JVM, which analyze() hasn't."""
    kinds = {"string": StringType(), "int": IntegerType()}
    return StructType([StructField(name, kinds[kind]) for name, kind in map(str.split, columns.split(", "))])


def _checked(name: str, argument: AnalyzeArgument, *kinds: type[DataType]) -> None:
    if argument.isTable or not isinstance(argument.dataType, kinds):
        raise ValueError(f"{name} is {' or '.join(k.typeName() for k in kinds)}, not {argument.dataType.simpleString() if argument.dataType else 'a table'}")


def _checked_page(html: AnalyzeArgument, url: AnalyzeArgument, limit: AnalyzeArgument) -> None:
    _checked("html", html, StringType)
    _checked("url", url, StringType)
    if not limit.isConstantExpression or not isinstance(limit.dataType, IntegralType) or limit.value is None:
        raise ValueError("limit is a constant number")
    run_limit(limit.value, replay=True)


def _rows(found: list[dict]) -> Iterator[tuple]:
    for i, row in enumerate(found):
        yield tuple(i if c == "ordinal" else row.get(c) for c in _EVENT)


class Anchors:
    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        _checked("html", html, StringType)
        return AnalyzeResult(_schema("position int, href string, label string"))

    def eval(self, html: str) -> Iterator[tuple]:
        if html is not None:
            for i, (href, markup) in enumerate(links(html)):
                yield i, unescape(href), plain(markup)


class IcsLinks:
    @staticmethod
    def analyze(html: AnalyzeArgument, url: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        _checked_page(html, url, limit)
        return AnalyzeResult(_schema("position int, link string, reason string"))

    def eval(self, html: str, url: str, limit: int) -> Iterator[tuple]:
        if html is not None and url is not None:
            for i, row in enumerate(parse_ics_links(html, url, limit)):
                yield i, row.get("url"), row.get("reason")


class IcsEvents:
    @staticmethod
    def analyze(body: AnalyzeArgument) -> AnalyzeResult:
        _checked("body", body, BinaryType, StringType)
        return AnalyzeResult(_schema(ROWS))

    def eval(self, body: bytes | str) -> Iterator[tuple]:
        if body is not None:
            yield from _rows(parse_ics(body.encode() if isinstance(body, str) else bytes(body)))


class SchemaOrgEvents:
    @staticmethod
    def analyze(html: AnalyzeArgument, url: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        _checked_page(html, url, limit)
        return AnalyzeResult(_schema(ROWS))

    def eval(self, html: str, url: str, limit: int) -> Iterator[tuple]:
        if html is not None and url is not None:
            yield from _rows(parse_jsonld(html, url, limit))


FUNCTIONS = {"anchors": Anchors, "ics_links": IcsLinks, "ics_events": IcsEvents, "schema_org_events": SchemaOrgEvents}


def register(spark: SparkSession) -> None:
    for name, kind in FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind, useArrow=True))
