"""Words as the text operators of this subpackage see them."""

from __future__ import annotations

import html
import re
import sys
import unicodedata

_ASCII_WORD = re.compile(r"[a-z0-9]+").findall
_WORD = re.compile(r"[^\W_]+").findall

#: Invisible characters outside the categories Cf and Cc (joiners, fillers, variation selectors).
_INVISIBLE_EXTRA = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]


def _invisible() -> dict[int, None]:
    table = dict.fromkeys(_INVISIBLE_EXTRA)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))
        if kind == "Cf" or (kind == "Cc" and not chr(cp).isspace()):
            table[cp] = None
    return table


INVISIBLE = _invisible()


def normal_words(text: str) -> list[str]:
    """Runs of letters or digits, without regard to case, width, character references or invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return _ASCII_WORD(text.lower())
    return _WORD(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text.translate(INVISIBLE)).casefold()))
