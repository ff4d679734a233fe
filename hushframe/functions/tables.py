"""Table functions to be called laterally from SQL: a page's elements and text nodes, and the tiles of a page."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from hushframe.functions.text import JS_SPACE_CHARS
from hushframe.operators.boxes import TILES
from hushframe.sources import html as H


def _parsed(html: str | None) -> tuple[list[tuple], list[tuple[int, int, int]], bytes]:
    rows = H._Rows()
    rows.add(None, html)
    return rows.elements, rows.texts, rows.pages[0][1] or b""


class PageElements:
    def eval(self, html: str) -> Iterator[tuple]:
        for idx, parent, tag, attrs, visible, *_ in _parsed(html)[0]:
            yield idx, parent, tag, attrs, visible


class PageTexts:
    def eval(self, html: str) -> Iterator[tuple]:
        elements, texts, body = _parsed(html)
        for k, (parent, start, stop) in enumerate(texts):
            yield k, parent, elements[parent][4], body[start:stop].decode().strip(JS_SPACE_CHARS)


class PageTiles:
    def eval(self, height: float, viewport: float) -> Iterator[tuple]:
        if height is None or viewport is None or not viewport > 0:
            return
        needed, last, seen = max(int(-(-height // viewport)), 1), max(height - viewport, 0.0), []
        for k in range(min(needed, TILES)):
            if (y := min(k * viewport, last)) not in seen:
                seen.append(y)
                yield len(seen) - 1, y, needed > TILES, needed


FUNCTIONS = {
    "page_elements": (PageElements, "node_idx int, parent_idx int, tag string, attrs map<string,string>, visible boolean"),
    "page_texts": (PageTexts, "text_idx int, parent_idx int, visible boolean, text string"),
    "page_tiles": (PageTiles, "slice_idx int, scroll_y double, truncated boolean, needed int"),
}


def register(spark: SparkSession) -> None:
    """page_elements(html), page_texts(html) and page_tiles(height, viewport) for SQL: SELECT ... FROM pages p, LATERAL page_elements(p.html) e.

    A null page has no rows. Rows come in Arrow batches; a page is parsed once for each call.
    """
    for name, (kind, returns) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind, returnType=returns, useArrow=True))
