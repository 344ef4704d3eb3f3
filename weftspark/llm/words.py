"""Words of a text, without what doesn't count when two texts are compared."""

from __future__ import annotations

import html
import unicodedata

import regex

ESCAPE = regex.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrtfv])|(?=[^\w\s]))")
MARKUP = regex.compile(r"<\|[^|<>\n]{1,40}\|>|</?[A-Za-z][^<>\n]{0,200}>|<!--.*?-->|(?<=\])\([^()\s]{0,300}\)", regex.S)
#: Without width: format characters and marks, and signs inside a word or number.
INVISIBLE = regex.compile(r"[\p{Cf}\p{M}\x00-\x08\x0e-\x1b]+|(?<=\p{L})['`’ʼ](?=\p{L})|(?<=\p{N})[.,'’](?=\p{N})")
#: Scripts without spaces between words have a word for each sign.
WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[^\W_\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+")


def _unescaped(m: regex.Match) -> str:
    code = m[1] or m[2]
    return chr(int(code, 16)) if code else " " if m[3] else ""


def words(text: str | None) -> list[str]:
    """Case, punctuation, markup, escapes, spacing, line breaks, invisible characters and Unicode forms don't count."""
    if not text:
        return []
    if not text.isascii() or "&" in text or "\\" in text or "<" in text or "](" in text:
        if "&" in text:
            text = html.unescape(html.unescape(text))
        if "\\" in text:
            text = ESCAPE.sub(_unescaped, text)
        if "<" in text or "](" in text:
            text = MARKUP.sub(" ", text)
        if not text.isascii():
            text = unicodedata.normalize("NFKD", text)
    return WORD.findall(INVISIBLE.sub("", text).casefold())
