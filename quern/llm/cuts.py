"""Places in a text where a byte-level BPE may be cut without changing it.

Such tokenizers first split a text by ``public_tokenizers.PATTERN`` and then
merge bytes inside each match. A place is *stable* if no match of the pattern
can hold the characters on both of its sides: every scan that sees both
characters then ends a match there, whatever else it sees, so the tokens left
and right of it do not depend on each other.

Matches are letters, digits or other signs with at most one blank before
them, an apostrophe with a few letters, or white space alone. So these pairs
are never inside one match: no white space then white space; letter or digit
then a sign or the other of both; a sign other than the apostrophe then letter
or digit. For the first pair any character counts that is no white space in any
version of Unicode, so all scripts with blanks have stable places; for the
others only characters whose class is the same in every version. Where no place
is near, callers widen their windows, at worst to the whole text, and stay
right.
"""

from __future__ import annotations

import re

_LETTER = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡА-я一-龥あ-ん"
_DIGIT = "0-9"
_SIGN = "!-&(-/:-@\\[-`{-~、。"

_BLANK = "(?<=[^\\s\u180e])(?=[ \\n\\t\\r])"
_PIECES = re.compile(_BLANK)
#: The same pieces in texts without other white space.
_RARE, _PLAIN = re.compile("[^\\S \\n\\t\\r]|\u180e"), re.compile("[ \\n\\t\\r]*[^ \\n\\t\\r]+|[ \\n\\t\\r]+")
_BLANKS = frozenset(" \n\t\r")
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace()) | {"\u180e"}

STABLE = re.compile(
    f"{_BLANK}"
    f"|(?<=[{_LETTER}])(?=[{_DIGIT}{_SIGN}'])"
    f"|(?<=[{_DIGIT}])(?=[{_LETTER}{_SIGN}'])"
    f"|(?<=[{_SIGN}])(?=[{_LETTER}{_DIGIT}])"
)


def pieces(text: str) -> list[str]:
    """The text cut wherever a blank follows any other character; the tokens of a piece are those it has alone."""
    return _PIECES.split(text) if _RARE.search(text) else _PLAIN.findall(text)


def joinable(piece: str) -> bool:
    """Whether pieces put side by side are cut again where this one begins and ends."""
    return piece[:1] in _BLANKS and piece[-1] not in _SPACES


def last_cut(text: str, start: int, end: int) -> int:
    """Last stable place p, start < p < end, by characters inside; -1: none."""
    found = -1
    for m in STABLE.finditer(text, start + 1, end):
        if m.start() < end:
            found = m.start()
    return found


def first_cut(text: str, start: int, end: int) -> int:
    """First stable place p, start < p < end; -1: none."""
    m = STABLE.search(text, start + 1, end)
    return m.start() if m and m.start() < end else -1
