"""Paragraphs of bulletin pages keep their text behind inline and void tags."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from fieldcast.sources import bulletins

LONG = "Light rain is likely over the northern blocks on Tuesday, so spraying should wait until Thursday"


@pytest.mark.parametrize(
    "inside, text",
    [
        (f"Advice: <img src='a.png' alt='x'> {LONG}", f"Advice: {LONG}"),
        (f"Advice: <input type=text/> {LONG}", f"Advice: {LONG}"),
        (f"Advice: <code>R7</code> {LONG}", f"Advice: R7 {LONG}"),
        (f"Ad<wbr>vice: <label>to all</label> {LONG}", f"Ad vice: to all {LONG}"),
        (f"<custom-tag a='b'>{LONG}</custom-tag> end", f"{LONG} end"),
    ],
)
def test_text_behind_inline_tags_stays(spark, inside, text):
    pages = [f"<html><body><p>{inside}</p><h2>no paragraph</h2>x<p>short</p></body></html>", f"<div class='bulletin-content'><ul><li>{inside}<li>{inside}</ul></div>"]
    rows = spark.createDataFrame([(p,) for p in pages], "html string").select(bulletins.page_text(F.col("html"))).collect()
    assert [r[0] for r in rows] == [text, f"{text}\n\n{text}"]


def test_a_paragraph_ends_at_the_next_block_and_a_cell_does_not(spark):
    page = f"<p>{LONG}<div>aside</div><td>{LONG}<hr>too"
    assert spark.createDataFrame([(page,)], "html string").select(bulletins.page_text(F.col("html"))).first()[0] == f"{LONG}\n\n{LONG} too"


class _Tree(HTMLParser):
    """A second reader: a tree of [tag, attributes, children], whose texts are gathered afterwards."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.path = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "li":
            self._leave({"li"}, {"ul", "ol"})
        elif tag in ("td", "th"):
            self._leave({"td", "th"}, {"table", "tr"})
        elif tag == "tr":
            self._leave({"tr"}, {"table"})
        if tag in bulletins.BLOCKS:
            self._leave({"p"}, {"table", "td", "th"})
        node = [tag, dict(attrs), []]
        self.path[-1][2].append(node)
        if tag not in bulletins.VOID:
            self.path.append(node)

    def handle_endtag(self, tag):
        self._leave({tag}, {"table", "td", "th"} - {tag} if tag not in ("tr", "table") else {"table"} - {tag})

    def _leave(self, tags, walls):
        for k in range(len(self.path) - 1, 0, -1):
            if self.path[k][0] in tags:
                del self.path[k:]
                return
            if self.path[k][0] in walls:
                return

    def handle_data(self, data):
        if self.path[-1][0] not in ("script", "style"):
            self.path[-1][2].append(data)


def _walk(node):
    yield node
    for child in node[2]:
        if isinstance(child, list):
            yield from _walk(child)


def _strings(node):
    for child in node[2]:
        if isinstance(child, str):
            if child.strip():
                yield child.strip()
        else:
            yield from _strings(child)


def second_reading(page):
    root = _Tree(page).root
    tags, least = ("p", "td"), 60
    for tag, attribute, value in bulletins.CONTAINERS:
        found = [n for n in _walk(root) if n[0] == tag and (value in (n[1].get(attribute) or "").split() if attribute == "class" else n[1].get(attribute) == value)]
        if found:
            root, tags, least = found[0], ("p", "td", "li"), 31
            break
    texts = [" ".join(_strings(n)) for n in _walk(root) if n[0] in tags and n is not root]
    return "\n\n".join(x for x in texts if len(x) >= least) or None


NESTED = [
    f"<div class='content'><ul><li>{LONG}: <ul><li>{LONG} one<li>{LONG} two</ul> after the list of things to do</li></ul></div>",
    f"<table class='bulletin'><tr><td>{LONG}<td><p>{LONG} in a cell</p>rest of the cell of this row, to the end</td><tr><td><table><tr><td>{LONG} inside</table> outside the inner table again</table>",
    f"<div id=bulletin><p>Max 38 &deg;C, min 21&#176;C &#xB0; &frac12; &nbsp; &hellip; {LONG}</div><div class='bulletin-content'><p>{LONG} the preferred one</p><div><p>{LONG} deeper</p></div></div>",
    f"<p>{LONG}<b>never closed <p>{LONG} second</p></b><td>{LONG} third<script>var a = '<p>{LONG} not this</p>'</script> end",
    f"<div class='x report y'><p title='a > b'>{LONG} quoted</p><!-- <p>{LONG} hidden</p> --><p>5 &lt; 6 and 7 < 8 {LONG}</p></div><p>{LONG} after</p>",
    "<p>tiny</p>", "", "<div class=content></div><p>" + LONG,
]


@pytest.mark.parametrize("page", NESTED)
def test_two_readers_agree(page):
    assert bulletins.Page(page).text() == second_reading(page)


def test_entities_lists_and_cells(spark):
    found = [r[0] for r in spark.createDataFrame([(p,) for p in NESTED] + [(None,)], "html string").select(bulletins.page_text(F.col("html"))).collect()]
    assert found[0] == "\n\n".join([f"{LONG}: {LONG} one {LONG} two after the list of things to do", f"{LONG} one", f"{LONG} two"])
    assert f"{LONG} inside outside the inner table again" in found[1] and f"{LONG} in a cell rest of the cell of this row, to the end\n\n{LONG} in a cell" in found[1]
    assert found[2] == f"{LONG} the preferred one\n\n{LONG} deeper"
    assert "38 \u00b0C, min 21\u00b0C \u00b0 \u00bd" in bulletins.Page(NESTED[2].split("<div class=")[0]).text()
    assert found[5] is found[6] is found[8] is None and found[7] is None


def test_given_pages_read_alike(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", bulletins.page_text(F.col("html")).alias("text")).collect()
    assert len(pages) > 20 and all(r.text == second_reading(r.html) for r in pages)
