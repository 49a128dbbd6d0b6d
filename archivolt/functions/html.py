"""HTML to text and links, one Arrow batch at a time."""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F, types as T

from archivolt import fixed

_BLANK = " \t\n\r\x0b\x0c"


class _Events(HTMLParser):
    """Markup as a flat list: ("+", tag, attributes), ("-", tag), ("=", text), ("!",) for a comment."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        self.found.append(("+", tag, attrs))

    def handle_endtag(self, tag):
        self.found.append(("-", tag))

    def handle_data(self, data):
        self.found.append(("=", data))

    def handle_comment(self, data):
        self.found.append(("!",))


def _events(html: str) -> list[tuple]:
    parser = _Events()
    parser.feed(html)
    parser.close()
    return parser.found


def _shown(events: list[tuple], hidden: list[str]) -> list[tuple[int, str]]:
    """Texts outside hidden tags, each with the number of markup events before it."""
    out, inside, marks = [], 0, 0
    for kind, *what in events:
        if kind == "=":
            if not inside:
                out.append((marks, what[0]))
            continue
        marks += 1
        if kind in "+-" and what[0] in hidden:
            inside = inside + 1 if kind == "+" else max(0, inside - 1)
    return out


@F.pandas_udf(T.StringType())
def document_text(html: pd.Series) -> pd.Series:
    """Text of an HTML document: scripts and styles dropped, runs joined by a space."""
    def one(source):
        if source is None:
            return None
        # Texts with no markup between them are one run.
        shown = groupby(_shown(_events(source), fixed.HTML_HIDDEN_TAGS), key=lambda run: run[0])
        runs = ["".join(text for _, text in run) for _, run in shown]
        # A run of blanks alone counts as one line end or one space.
        return " ".join(r if r.strip(_BLANK) else ("\n" if "\n" in r else " ") for r in runs)
    return html.map(one)


@F.pandas_udf(T.StructType([
    T.StructField("text", T.StringType()), T.StructField("hrefs", T.ArrayType(T.StringType())),
]))
def page_content(html: pd.Series) -> pd.DataFrame:
    """Visible text of a web page and its link targets, menus left out of the text."""
    texts, links = [], []
    for source in html:
        events = _events(source or "")
        shown = (text.strip() for _, text in _shown(events, fixed.HTML_SKIP_TAGS))
        texts.append(" ".join(text for text in shown if text))
        targets = (dict(e[2]).get("href") for e in events if e[0] == "+" and e[1] == "a")
        links.append(list(dict.fromkeys(t for t in targets if t)))
    return pd.DataFrame({"text": texts, "hrefs": links})
