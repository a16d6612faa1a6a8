"""Weather bulletins: text out of web pages, and JSON replies kept as text.

Pages are read tag by tag with a stack of open elements, since a paragraph may hold others
(lists in lists, cells in tables) and tags that were never closed. No regular expression over
a page and no built-in expression gives that, so pages go through Python in Arrow batches; a
page is looked at once and nothing is kept between pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.functions.text import strip

# --- fixed values: where a bulletin may sit in a page, in order of preference ----------------
CONTAINERS = [
    ("div", "class", "bulletin-content"),
    ("div", "id", "bulletin"),
    ("div", "class", "advisory"),
    ("div", "class", "content"),
    ("div", "class", "report"),
    ("table", "class", "bulletin"),
]
CONTAINER_MIN_CHARS = 31
PAGE_MIN_CHARS = 60
PARTS, PAGE_PARTS = ("p", "td", "li"), ("p", "td")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Tags before which an open paragraph ends.
BLOCKS = set(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search "
    "section summary table tbody td tfoot th thead tr ul body".split()
)
#: What a tag ends when it opens, and the elements behind which it does not look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that an end tag of something else does not reach through.
WALLS = {"table", "td", "th", "caption"}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <[!?][^>]*+> | <(?P<unseen>script|style)\b[^>]*+>.*?(?:</(?P=unseen)\s*>|\Z)
      | <(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*+)> | (?P<text>[^<]++|<)""",
    re.S | re.I | re.X,
)
ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


class Page:
    """The strings of a page in order, and of its elements where their strings begin and end."""

    def __init__(self, page: str):
        self.strings, self.parts, self.containers, self.open, self.opened = [], [], {}, [], 0
        for token in TOKEN.finditer(page):
            if token["text"]:
                text = entities.unescape(token["text"]).strip()
                if text:
                    self.strings.append(text)
            elif token["tag"]:
                tag = token["tag"].lower()
                if token["end"]:
                    self._end(tag)
                else:
                    self._begin(tag)
                    if tag not in VOID:
                        self.opened += 1
                        self.open.append((tag, self.opened, len(self.strings), self._kinds(tag, token["rest"])))
        self._pop(0)
        self.parts.sort()

    @staticmethod
    def _kinds(tag: str, rest: str) -> list[int]:
        if tag not in ("div", "table") or not rest:
            return []
        has = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(ATTRIBUTE.finditer(rest)))}
        return [k for k, (t, a, v) in enumerate(CONTAINERS) if t == tag and (v in has.get(a, "").split() if a == "class" else has.get(a) == v)]

    def _pop(self, depth: int) -> None:
        """Close the elements above a depth."""
        while len(self.open) > depth:
            tag, number, begin, kinds = self.open.pop()
            if tag in PARTS:
                self.parts.append((number, tag, begin, len(self.strings)))
            for kind in kinds:
                # The first of a kind in the page, with the number of the last element in it; an inner one closes before an outer one.
                found = self.containers.get(kind)
                if found is None or number < found[0]:
                    self.containers[kind] = (number, self.opened)

    def _find(self, tags: set[str], walls: set[str]) -> int | None:
        """Depth of the innermost open element of these tags, not looking behind the walls."""
        for depth in reversed(range(len(self.open))):
            if self.open[depth][0] in tags:
                return depth
            if self.open[depth][0] in walls:
                return None
        return None

    def _begin(self, tag: str) -> None:
        if tag in ENDS:
            depth = self._find(*ENDS[tag])
            if depth is not None:
                self._pop(depth)
        if tag in BLOCKS:
            depth = self._find({"p"}, WALLS | {"button", "object", "template"})
            if depth is not None:
                self._pop(depth)

    def _end(self, tag: str) -> None:
        depth = self._find({tag}, WALLS - {tag} if tag not in ("tr", "tbody", "thead", "tfoot", "table") else {"table"} - {tag})
        if depth is not None:
            self._pop(depth)

    def text(self) -> str | None:
        """Text of the long parts of the bulletin container, else of the page's; None if there are none."""
        first = min(self.containers, default=None)
        if first is None:
            kept, least, inside = PAGE_PARTS, PAGE_MIN_CHARS, lambda n: True
        else:
            begin, end = self.containers[first]
            kept, least, inside = PARTS, CONTAINER_MIN_CHARS, lambda n: begin < n <= end
        texts = [" ".join(self.strings[a:b]) for n, tag, a, b in self.parts if tag in kept and inside(n)]
        return "\n\n".join(t for t in texts if len(t) >= least) or None


def _texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([None if page is None else Page(page).text() for page in batch], dtype=object)


def page_text(html: Column) -> Column:
    """Text of the bulletin container, else of every long paragraph or cell; null if there is none.

    The text of an element is that of all its strings, each without white space around it, with
    blanks between them. An element within another gives its text again. Scripts, styles
    and comments are not text. Entities are resolved, named ones and numbers alike.
    """
    return F.pandas_udf(_texts, T.StringType())(html.cast("string"))


def from_pages(pages: DataFrame, html: str, source: str, metadata: dict[str, Column]) -> DataFrame:
    """Bulletin rows. A page without text stays, with null text and status `empty`."""
    pairs = [x for name, value in metadata.items() for x in (F.lit(name), value.cast("string"))]
    return pages.withColumns(
        {
            "source": F.upper(strip(F.lit(source))),
            "raw_text": page_text(F.col(html)),
            "metadata": F.create_map(*pairs),
        }
    ).withColumn("source_status", F.when(F.col("raw_text").isNull(), "empty").otherwise("live"))


def from_replies(replies: DataFrame, fields: list[str], source: str, metadata: dict[str, Column]) -> DataFrame:
    """Bulletin rows from a JSON service: the reply itself, as text, is the bulletin."""
    pairs = [x for name, value in metadata.items() for x in (F.lit(name), value.cast("string"))]
    return replies.withColumns(
        {
            "source": F.upper(strip(F.lit(source))),
            "raw_text": F.to_json(F.struct(*fields)),
            "metadata": F.create_map(*pairs),
            "source_status": F.lit("live"),
        }
    )
