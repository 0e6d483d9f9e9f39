"""Words of a text as they are compared: without case, accents, markup, punctuation and line or word breaks."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
#: A word broken at a line end, with whatever marks a quoted or listed line at its start.
_BROKEN = re.compile(r"(?<=\w)[-‐‑][ \t]*(?:\r\n|\r|\n)[ \t>|*#]*(?=\w)")
_APOSTROPHE = re.compile(r"(?<=\w)['‘’ʼʹ′`´＇](?=\w)")
_WORD = re.compile(r"[^\W_]+")
#: Letters of other scripts, and letters that no decomposition resolves, by the Latin letters they are written for.
LOOKALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
        "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
        "ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i", "ſ": "s", "ŧ": "t", "ɑ": "a", "ɡ": "g", "ƒ": "f",
    }
)
_MIXED = re.compile(r"[a-z]")
#: Accents and invisible characters.
MARKS = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")


def words(text: str | None) -> list[str]:
    """The words of ``text`` in their order; none for NULL.

    Tags and character references are resolved, compatibility variants, accents and invisible characters dropped,
    words broken at a line end joined. A word that mixes Latin with lookalike letters is written in Latin.
    """
    if not text:
        return []
    if "&" in text or "<" in text:
        text = _TAG.sub("", html.unescape(text))
    text = _BROKEN.sub("", text)
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
        text = _BROKEN.sub("", text)
    text = _APOSTROPHE.sub("", text.casefold())
    found = _WORD.findall(text)
    if not text.isascii():
        found = [w.translate(LOOKALIKES) if not w.isascii() and _MIXED.search(w) else w for w in found]
    return found
