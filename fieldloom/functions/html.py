"""Page content functions: Arrow UDFs around the page helper, native columns around them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom import constants as C
from fieldloom.functions import html_tree as H
from fieldloom.functions import text as X

LARGEST_BLOCK = "largest_block"
FULL_BODY = "full_body"


def _largest_block(found: list[H.Element]) -> H.Element | None:
    blocks = []
    for element in found:
        if element.tag in ("div", "section", "article"):
            string = H.only_string(element)
            if string is not None and len(string.strip()) > C.MIN_BLOCK_LENGTH:
                blocks.append(element)
    return max(blocks, key=H.compact_length).parent if blocks else None


def _main_content(html: str, host: str, selectors, sites) -> tuple[str | None, str | None]:
    root = H.parse(html, C.CONTENT_DROPPED_TAGS)
    found = H.elements(root)
    for name, test in selectors:
        element = next((e for e in found if test(e)), None)
        if element is not None:
            text = H.plain_text(element)
            if len(text) > C.MIN_CONTENT_LENGTH:
                return name, text
    block = _largest_block(found)
    if block is not None:
        text = H.plain_text(block)
        if len(text) > C.MIN_CONTENT_LENGTH:
            return LARGEST_BLOCK, text
    for site, tests in sites:
        if site in host:
            element = next((e for e in H.first_matches(found, tests) if e is not None), None)
            text = "" if element is None else H.plain_text(element)
            if text:
                return f"site_{site}", text
            break
    return FULL_BODY, H.plain_text(H.page_body(root, found))


def main_content(
    html: Column,
    url: Column,
    selectors: list[str] = C.CONTENT_SELECTORS,
    sites: list[tuple[str, list[str]]] = C.SITE_SELECTORS,
) -> Column:
    """``struct<strategy, content>`` of a page.

    Tried in order: the first element of each selector, the parent of the largest plain block,
    the rules of the page's site, the whole body. A page that cannot be read gives nulls.
    """

    @F.pandas_udf("strategy string, content string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tests = [(s, H.compile_selector(s)) for s in selectors]
        site_tests = [(site, [H.compile_selector(s) for s in rules]) for site, rules in sites]
        for pages, hosts in batches:
            rows = []
            for page, host in zip(pages, hosts):
                try:
                    rows.append(_main_content(page or "", host or "", tests, site_tests))
                except (AssertionError, ValueError):
                    rows.append((None, None))
            yield pd.DataFrame(rows, columns=["strategy", "content"], dtype=object)

    return extract(html, X.url_host(url))


def strategy_profile(html: Column, selectors: list[str] = C.PROFILE_SELECTORS) -> Column:
    """``array<struct<strategy, length, preview>>``: what each way of reading a page yields."""

    @F.pandas_udf("array<struct<strategy:string,length:int,preview:string>>")
    def profile(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tests = [H.compile_selector(s) for s in selectors]
        names = [f"selector_{s}" for s in selectors] + [FULL_BODY]
        for pages in batches:
            rows = []
            for page in pages:
                root = H.parse(page or "", C.PROFILE_DROPPED_TAGS)
                found = H.elements(root)
                chosen = [*H.first_matches(found, tests), H.page_body(root, found)]
                texts = [(n, H.plain_text(e)) for n, e in zip(names, chosen) if e is not None]
                rows.append([
                    {"strategy": n, "length": len(t), "preview": t[: C.PREVIEW_LENGTH + 1]}
                    for n, t in texts
                ])
            yield pd.Series(rows, dtype=object)

    return F.transform(
        profile(html),
        lambda s: F.struct(
            s["strategy"].alias("strategy"),
            s["length"].alias("length"),
            X.preview(s["preview"]).alias("preview"),
        ),
    )


def page_title(html: Column) -> Column:
    """Text of the title element, with entities decoded."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return F.when(
        F.regexp_like(html, F.lit(r"(?i)<title[\s>]")), X.decode_entities(raw)
    ).otherwise(C.NO_TITLE)
