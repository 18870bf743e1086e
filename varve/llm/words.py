"""Words of a text as a reader sees them."""

from __future__ import annotations

import html
import re
import unicodedata

COMMENT = re.compile(r"<!--.*?-->", re.S)
TAG = re.compile(r"</?[a-zA-Z][^<>]*>|\[/?(?:quote|url|img|code|list|size|color|email|spoiler|b|i|u|s|\*)(?:=[^\[\]]*)?\]", re.I)
QUOTE_MARK = re.compile(r"^[ \t]*(?:[>|][ \t]*)+", re.M)
WORD = re.compile(r"[^\W_]+")


def _visible(text: str) -> str:
    if text.isascii():
        return text
    return "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\r\t")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits: letter case, punctuation, entities, invisible characters, compatibility code
    points, line ends and quote marks make no difference, and tags part words. None has no words."""
    if not text:
        return []
    text = QUOTE_MARK.sub(" ", text)
    text = TAG.sub(" ", COMMENT.sub(" ", text))
    text = _visible(html.unescape(text))
    if not text.isascii():
        text = _visible(unicodedata.normalize("NFKC", text))
    return WORD.findall(text.casefold())
