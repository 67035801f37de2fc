"""Cutting texts into the pre-tokens that byte-level BPE encodes one by one.

The public pattern looks at four classes of characters only: letters, numbers, white space and
the rest. Regular expression engines follow different editions of Unicode, so a character is
unsure if its class is another in the oldest edition that Python knows than in its newest, or
if neither knows it. No pre-token goes on from a character that is sure and no white space to
a space, so a text with unsure characters is cut there first, and only the stretches between
two such spaces that hold one stay whole.
"""

from __future__ import annotations

import re
import unicodedata

from quarry.llm.common import memo

#: Finds a character outside of Latin.
FOREIGN = re.compile("[^\x00-\x1b\x20-ɏ]")

# The public pattern with its classes written out for Latin; letters come first, as no other alternative starts with one.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = re.compile(f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


#: Characters that some engines take for white space.
_CONTROLS = "\x1c\x1d\x1e\x1f"


def _unsure() -> tuple[re.Pattern, re.Pattern]:
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    kind = {k: k[0] if k[0] in "LNZ" else "" for k in {new(chr(i)) for i in range(0x30000)} | {"Cn", "Co", "Cs"}}
    odd, at = [], None  # ranges
    for i in range(0x110000):
        x, y = old(chr(i)), new(chr(i))
        if x != y and kind[x] != kind[y] or x == y == "Cn" or chr(i) in _CONTROLS:
            if at != i - 1:
                odd.append([i, i])
            odd[-1][1] = at = i
    odd = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in odd)
    return re.compile(f"[{odd}]"), re.compile(f"(?<=[^\\s{odd}])(?= )")


def unsure() -> tuple[re.Pattern, re.Pattern]:
    """Find an unsure character, and a place before a space and after a sure character that is no white space."""
    return memo("unsure", _unsure)


def latin(text: str) -> bool:
    if text.isascii():
        return not any(c in text for c in _CONTROLS)
    return not FOREIGN.search(text)


def is_unsure(text: str) -> bool:
    return not latin(text) and unsure()[0].search(text) is not None


class Cutter:
    """Lists of the pre-tokens of texts, which joined are the text; a stretch on which engines may differ is one piece."""

    def __init__(self):
        import public_tokenizers
        import regex

        self.rest = regex.compile(public_tokenizers.PATTERN).findall

    def __call__(self, text: str) -> list[str]:
        if latin(text):
            return LATIN.findall(text)
        odd, safe = unsure()
        if not odd.search(text):
            return self.rest(text)
        return [p for s in safe.split(text) for p in ([s] if odd.search(s) else self.rest(s))]
