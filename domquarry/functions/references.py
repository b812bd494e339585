"""Character references: decoding in plain Python, shared by the tokenizer and the column functions."""

from __future__ import annotations

import re
from html.entities import html5

#: Names that stand with a semicolon, and the few that may stand without; longest name: 32 characters.
WITH_SEMICOLON = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
BARE = {k: v for k, v in html5.items() if not k.endswith(";")}
LONGEST_NAME = max(map(len, html5))
LONGEST_BARE = max(map(len, BARE))

#: What numbers 128 to 159 stand for, as Windows-1252 has them; 0 and 13 are overridden too.
OVERRIDES = {i: bytes([i]).decode("cp1252") for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)} | {i: chr(i) for i in (0x81, 0x8D, 0x8F, 0x90, 0x9D, 0x0D)} | {0: "�"}

_RUN = re.compile(r"[0-9A-Za-z]+")


def is_disallowed(code: int) -> bool:
    """Controls and noncharacters, an error wherever they stand."""
    return 1 <= code <= 8 or code == 0x0B or 0x0E <= code <= 0x1F or 0x7F <= code <= 0x9F or 0xFDD0 <= code <= 0xFDEF or code & 0xFFFE == 0xFFFE


def of_number(code: int) -> tuple[str, bool]:
    """The text of a numeric reference, and whether the number is an error."""
    if code in OVERRIDES:
        return OVERRIDES[code], True
    if 0xD800 <= code <= 0xDFFF or code > 0x10FFFF:
        return "�", True
    return chr(code), is_disallowed(code)


def number_of(digits: str, base: int) -> int:
    """The number that digits, with a sign or without, write: 0 if negative, one and the same beyond 32 bits, however many digits there are."""
    if digits.startswith("-"):
        return 0
    digits = digits.lstrip("+").lstrip("0")
    return min(int(digits or "0", base), 0xFFFFFFFF) if len(digits) <= 10 else 0xFFFFFFFF


def of_name(text: str, at: int) -> tuple[str, int] | None:
    """The longest known name at that place of the text: what it stands for and its length with the semicolon."""
    run = _RUN.match(text, at, at + LONGEST_NAME)
    if not run:
        return None
    name = run.group()
    if text[run.end() : run.end() + 1] == ";" and name in WITH_SEMICOLON:
        return WITH_SEMICOLON[name], len(name) + 1
    for n in range(min(len(name), LONGEST_BARE), 1, -1):
        if name[:n] in BARE:
            return BARE[name[:n]], n
    return None
