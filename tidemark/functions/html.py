"""Text of HTML."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements whose text is not shown.
HIDDEN = ("script", "style", "template")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in HIDDEN

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in HIDDEN and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def text_of(html: str | None) -> str | None:
    """The shown text, pieces joined and white space runs made one space; null stays null, markup that can't be parsed stays as it is."""
    if not html:
        return html
    parser = _Text()
    try:
        parser.feed(html)
        parser.close()
    except Exception:
        return html
    return " ".join(" ".join(parser.parts).split())


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(text_of, na_action="ignore")
