"""One pass over malformed HTML: an array of tags for each page. The only Python on this path, as an Arrow UDF.

Everything that can be said on the tags is said in SQL afterwards; pages are
tokenised once and go to Python once, the other columns stay where they are.
Scripts and styles are raw text, unclosed tags are left at the end of the page,
and character references are resolved.

The tags stand in document order and carry interval numbers: ``pos`` is a tag's
place in the array and ``stop`` the place behind its last descendant. So what
is inside an element is one slice, and whether a tag is inside is a comparison.
A tag without other tags in it holds its text; text between tags is a row
``#text`` of its own. Nothing is repeated for ancestors: an array's size is
linear in its page, whatever the depth.

A null or empty page has no tags.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catloom.shipping import ship_package

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style")
TEXT = "#text"
TAGS = "array<struct<pos:int,tag:string,attrs:map<string,string>,text:string,stop:int>>"

Condition = Callable[[Column], Column]


class _Tags(HTMLParser):
    """Collects columns; ``open`` holds the place of each open tag and whether it has tags in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[list | None] = []
        self.texts: list[str | None] = []
        self.stops: list[int] = []
        self.open: list[list] = []
        self.held: list[str] = []

    def _row(self, tag: str, attrs: list | None, text: str | None) -> None:
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.texts.append(text)
        self.stops.append(len(self.tags))

    def _flush(self) -> None:
        if self.held:
            self._row(TEXT, None, "".join(self.held))
            self.held = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if self.open:
            self.open[-1][1] = True
        self._row(tag, list(own.items()), "")
        if tag not in VOID:
            self.open.append([len(self.tags) - 1, False])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def _close(self) -> None:
        at, full = self.open.pop()
        if full:
            self._flush()
            self.texts[at] = None
        else:
            self.texts[at], self.held = "".join(self.held), []
        self.stops[at] = len(self.tags)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.tags[self.open[k][0]] == tag:
                while len(self.open) > k:
                    self._close()
                return

    def handle_data(self, data):
        if self.open:
            self.held.append(data)

    def end(self) -> None:
        while self.open:
            self._close()


def tags_of(html: str | None) -> _Tags:
    """The tags of a page, as columns."""
    reader = _Tags()
    reader.feed(html or "")
    reader.close()
    reader.end()
    return reader


def _lists(pages: pa.Array) -> pa.Array:
    tags, attrs, texts, stops, pos, ends = [], [], [], [], [], [0]
    for page in pages:
        own = tags_of(page.as_py())
        tags += own.tags
        attrs += own.attrs
        texts += own.texts
        stops += own.stops
        pos += range(len(own.tags))
        ends.append(len(tags))
    # values stand in the rows of their page; keys can't be null, so text rows have no map
    rows = pa.StructArray.from_arrays(
        [pa.array(pos, pa.int32()), pa.array(tags, pa.string()), pa.array(attrs, pa.map_(pa.string(), pa.string())), pa.array(texts, pa.string()), pa.array(stops, pa.int32())],
        names=["pos", "tag", "attrs", "text", "stop"],
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def with_tags(pages: DataFrame, html: str = "html", out: str = "tags") -> DataFrame:
    """``pages`` with the array of each page's tags. Filter pages before, not after."""
    ship_package(pages.sparkSession)
    return pages.withColumn(out, F.arrow_udf(_lists, TAGS)(F.col(html)))


def tag_lists(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``page`` and ``tags``, one row for each page."""
    return with_tags(pages.select(F.col(key).alias("page"), F.col(html).alias("__html")), "__html").select("page", "tags")


def tag_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``page, pos, tag, attrs, text, stop``: one row for each tag and text."""
    return tag_lists(pages, key, html).select("page", F.inline("tags"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used, in lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def first(tags: Column, condition: Condition) -> Column:
    return F.try_element_at(F.filter(tags, condition), F.lit(1))


def inside(tags: Column, element: Column) -> Column:
    """The tags within an element, in order, without texts. ``element`` should be bound."""
    return F.filter(_slice(tags, element), lambda t: t["tag"] != TEXT)


def _slice(tags: Column, element: Column) -> Column:
    return F.slice(tags, element["pos"] + 2, element["stop"] - element["pos"] - 1)


def text_of(tags: Column, element: Column) -> Column:
    """All text within an element, blanks put together, scripts and styles in it left out. ``element`` should be bound."""
    parts = F.filter(_slice(tags, element), lambda t: t["text"].isNotNull() & ~t["tag"].isin(*RAW))
    whole = F.coalesce(element["text"], F.array_join(F.transform(parts, lambda t: t["text"]), ""))
    return F.when(element.isNotNull(), plain(whole))


def plain(text: Column) -> Column:
    """Blanks of any kind put together and cut off at both ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def first_text(tags: Column, condition: Condition) -> Column:
    """Text of the first tag that meets a condition."""
    return bound(first(tags, condition), lambda e: text_of(tags, e))


def texts(tags: Column, condition: Condition) -> Column:
    """Texts of the tags that meet a condition, in order."""
    return F.transform(F.filter(tags, condition), lambda t: text_of(tags, t))


def meta_content(tags: Column, name: str) -> Column:
    """Content of the first ``meta`` whose property or name is ``name``."""
    return first(tags, lambda t: (t["tag"] == "meta") & (F.coalesce(t["attrs"]["property"], t["attrs"]["name"]) == name))["attrs"]["content"]


def class_text(tags: Column, pattern: str) -> Column:
    """Text of the first tag whose class matches."""
    return first_text(tags, lambda t: F.coalesce(t["attrs"]["class"], F.lit("")).rlike(pattern))


def itemprop(tags: Column, name: str) -> Column:
    """Microdata value: ``content``, else an image's lazy or plain source, else the text."""

    def value(own: Column) -> Column:
        return F.coalesce(F.nullif(own["attrs"]["content"], F.lit("")), own["attrs"]["data-original"], own["attrs"]["src"], text_of(tags, own))

    return bound(first(tags, lambda t: t["attrs"]["itemprop"] == name), value)


def headings(tags: Column) -> Column:
    return texts(tags, lambda t: t["tag"] == "h1")


def heading(tags: Column, rule: str = "first") -> Column:
    """``first``; ``second``, else the first; ``second_only``."""

    def at(own: Column) -> Column:
        one, two = F.try_element_at(own, F.lit(1)), F.try_element_at(own, F.lit(2))
        return {"first": one, "second": F.coalesce(two, one), "second_only": two}[rule]

    return bound(headings(tags), at)


def around(containers: Column, tag: Column) -> Column:
    """Those of ``containers`` that a tag stands in."""
    return F.filter(containers, lambda c: (c["pos"] < tag["pos"]) & (tag["pos"] < c["stop"]))


#: Elements that ``anchors`` looks for around a link.
CONTAINERS = ("nav", "header", "menu", "aside", "footer")


def anchors(lists: DataFrame, tags: str = "tags") -> DataFrame:
    """The links of pages with ``tags``: their columns, and ``pos, href, text, in_nav, class_id, inside`` (names of the containers around)."""

    def link(containers: Column, t: Column) -> Column:
        return F.struct(
            t["pos"].alias("pos"),
            t["attrs"]["href"].alias("href"),
            text_of(F.col(tags), t).alias("text"),
            F.lower(F.concat_ws(" ", t["attrs"]["class"], t["attrs"]["id"])).alias("class_id"),
            F.transform(around(containers, t), lambda c: c["tag"]).alias("inside"),
        )

    found = F.filter(tags, lambda t: (t["tag"] == "a") & t["attrs"]["href"].isNotNull())
    rows = bound(F.filter(tags, lambda t: t["tag"].isin(*CONTAINERS)), lambda c: F.transform(found, lambda t: link(c, t)))
    kept = [c for c in lists.columns if c != tags]
    return lists.select(*kept, F.inline(rows)).withColumn("in_nav", F.exists("inside", lambda a: a.isin("nav", "header", "menu")))


def specs(tags: Column) -> Column:
    """Specification map: table rows of two cells, and list items ``key: value``; later keys win."""
    cells = F.filter(tags, lambda t: t["tag"].isin("tr", "td", "th", "li"))
    read = F.transform(cells, lambda t: F.struct(t["tag"].alias("tag"), F.when(t["tag"] != "tr", text_of(tags, t)).alias("text")))

    def pairs(rows: Column) -> Column:
        def pair(t: Column, i: Column) -> Column:
            cell = lambda x: F.coalesce(x["tag"].isin("td", "th"), F.lit(False))
            one, two, three = (F.get(rows, i + k) for k in (1, 2, 3))
            table = (t["tag"] == "tr") & cell(one) & cell(two) & ~cell(three)
            item = (t["tag"] == "li") & t["text"].contains(":")
            return (
                F.when(table, F.struct(one["text"].alias("k"), i.alias("i"), two["text"].alias("v")))
                .when(item, F.struct(F.trim(F.substring_index(t["text"], ":", 1)).alias("k"), i.alias("i"), F.trim(F.regexp_replace(t["text"], r"^[^:]*:", "")).alias("v")))
            )

        return F.array_sort(F.filter(F.transform(rows, pair), lambda p: p.isNotNull()))

    def last_of_each(found: Column) -> Column:
        return F.filter(found, lambda p, i: F.coalesce(F.get(found, i + 1)["k"] != p["k"], F.lit(True)))

    found = bound(bound(read, pairs), last_of_each)
    return F.map_from_entries(F.transform(found, lambda p: F.struct(p["k"], p["v"])))
