"""A lexer for HTML that pulls one token at a time.

The tree builder steers it: it may change ``state`` (to rcdata, rawtext, script or plaintext) after any token, and tells whether
CDATA sections are allowed. Text, names and values are taken in runs by compiled patterns; the states of the standard are the
branches of the few methods below. Tokens are tuples that begin with their kind:

    ("chars", text)  ("start", name, attrs, self_closing)  ("end", name, attrs, self_closing)  ("comment", data)
    ("doctype", name, public_id, system_id, force_quirks)  ("error", message)

Attributes are a dict in the order of the source; of equal names the first counts.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable

from ..functions.references import is_disallowed, number_of, of_name, of_number

SPACE = "\t\n\f "
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}
_NEWLINES = re.compile(r"\r\n?")
_ODD = re.compile("[\x01-\x08\x0b\x0e-\x1f\x7f-\x9f﷐-﷯￾￿]|[\U0001fffe-\U0010ffff]")
_TEXT = re.compile(r"[^<&]+")
_RAW = re.compile(r"[^<]+")
_SKIP = re.compile(r"[\t\n\f ]*")
_TAG_NAME = re.compile(r"[^\t\n\f />]*")
_ATTR_NAME = re.compile(r"[^\t\n\f />=]*")
_UNQUOTED = re.compile(r"[^\t\n\f >]*")
_COMMENT_END = re.compile(r"--!?>")
_COMMENT_CUT = re.compile(r"-(-!?)?\Z")
_DOCTYPE_NAME = re.compile(r"[^\t\n\f >]*")
_SCRIPT_MARK = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f />])", re.I)
#: Tags as most are written: no attributes, or plain quoted ones; all others take the long way.
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?: [A-Za-z][A-Za-z-]*=\"[^\"&\0]*\")*)>")
_PLAIN_ATTR = re.compile(r' ([A-Za-z][A-Za-z-]*)="([^"]*)"')
_DIGITS, _HEX = re.compile(r"[+-]?[0-9]+"), re.compile(r"[0-9A-Fa-f]+")


def lower(s: str) -> str:
    """A to Z only."""
    return s.lower() if s.isascii() else s.translate(_UPPER)


def normalize_newlines(text: str) -> str:
    return _NEWLINES.sub("\n", text) if "\r" in text else text


class Tokenizer:
    def __init__(self, text: str, state: str = "data", last_start_tag: str | None = None, allows_cdata: Callable[[], bool] = lambda: False):
        self.text = normalize_newlines(text)
        self.at, self.end = 0, len(self.text)
        self.state, self.last_start_tag, self.allows_cdata = state, last_start_tag, allows_cdata
        self.queue: deque[tuple] = deque()
        self._odd = [m.start() for m in _ODD.finditer(self.text) if is_disallowed(ord(m.group()))]
        self._odd_at = 0

    def __iter__(self):
        while (token := self.next()) is not None:
            yield token

    def next(self) -> tuple | None:
        """The next token, None at the end."""
        while not self.queue:
            if self.at >= self.end and self.state != "eof":
                self.state = "eof"
                self._report_odd()
                if not self.queue:
                    return None
                break
            if self.state == "eof":
                return None
            self._step()
            self._report_odd()
        return self.queue.popleft()

    def _report_odd(self) -> None:
        while self._odd_at < len(self._odd) and self._odd[self._odd_at] < self.at:
            self.queue.appendleft(("error", "control character or noncharacter in the input"))
            self._odd_at += 1

    # ---- output

    def _error(self, message: str) -> None:
        self.queue.append(("error", message))

    def _chars(self, text: str) -> None:
        if text:
            self.queue.append(("chars", text))

    # ---- states

    def _step(self) -> None:
        if self.state == "data":
            self._data()
        elif self.state == "plaintext":
            self._chars(self._no_nul(self.text[self.at :]))
            self.at = self.end
        elif self.state == "script":
            self._script()
        else:
            self._raw(self.state == "rcdata")

    def _no_nul(self, s: str) -> str:
        if "\0" in s:
            for _ in range(s.count("\0")):
                self._error("NUL in text or markup")
            s = s.replace("\0", "�")
        return s

    def _data(self) -> None:
        parts, text = [], self.text
        while self.at < self.end:
            run = _TEXT.match(text, self.at)
            if run:
                parts.append(run.group())
                self.at = run.end()
                if "\0" in parts[-1]:  # the tree builder drops them
                    for _ in range(parts[-1].count("\0")):
                        self._error("NUL in text")
            elif text[self.at] == "&":
                parts.append(self._reference(""))
            else:
                break
        self._chars("".join(parts))
        if self.at < self.end:
            self._tag_open()

    def _reference(self, extra: str, in_attribute: bool = False, stop: int | None = None) -> str:
        """Decodes at an ampersand and moves on; the ampersand itself if there is no reference."""
        text, at = self.text, self.at + 1
        end = self.end if stop is None else stop
        self.at = at
        c = text[at] if at < end else ""
        if not c or c in "\t\n\f <&" or (extra and c == extra):
            return "&"
        if c == "#":
            hexadecimal = text[at + 1 : at + 2] in ("x", "X")
            digits = (_HEX if hexadecimal else _DIGITS).match(text, at + (2 if hexadecimal else 1), end)
            if not digits:
                self._error("numeric reference without digits")
                return "&"
            self.at = digits.end()
            if text[self.at : self.at + 1] == ";" and self.at < end:
                self.at += 1
            else:
                self._error("numeric reference without semicolon")
            value, wrong = of_number(number_of(digits.group(), 16 if hexadecimal else 10))
            if wrong:
                self._error("numeric reference to no allowed character")
            return value
        found = of_name(text, at)
        if not found:
            run = re.compile(r"[0-9A-Za-z]+;").match(text, at, end)
            if run:
                self._error("unknown named reference")
            return "&"
        value, length = found
        if text[at + length - 1] != ";":
            following = text[at + length : at + length + 1] if at + length < end else ""
            if in_attribute and following and (following == "=" or following.isalnum()):
                if following == "=":
                    self._error("named reference without semicolon before an equals sign")
                return "&"
            self._error("named reference without semicolon")
        self.at = at + length
        return value

    def _tag_open(self) -> None:
        """At a ``<`` in data."""
        plain = _PLAIN_TAG.match(self.text, self.at)
        if plain:
            closing, name, rest = plain.groups()
            pairs = [(k.lower(), v) for k, v in _PLAIN_ATTR.findall(rest)] if rest else ()
            attrs = dict(pairs)
            if len(attrs) == len(pairs) and not (closing and pairs):
                self.at, name = plain.end(), name.lower()
                if not closing:
                    self.last_start_tag = name
                self.queue.append(("end" if closing else "start", name, attrs, False))
                return
        text, at = self.text, self.at + 1
        c = text[at] if at < self.end else ""
        if c.isascii() and c.isalpha():
            self._tag(at, "start")
        elif c == "!":
            self.at = at + 1
            self._declaration()
        elif c == "/":
            after = text[at + 1] if at + 1 < self.end else ""
            if after.isascii() and after.isalpha():
                self._tag(at + 1, "end")
            elif after == ">":
                self._error("end tag without a name")
                self.at = at + 2
            elif not after:
                self._error("end of input in a tag")
                self._chars("</")
                self.at = self.end
            else:
                self._error("end tag that begins with no letter")
                self._bogus_comment(at + 1)
        elif c == "?":
            self._error("processing instruction")
            self._bogus_comment(at)
        else:
            self._error("less-than sign that opens nothing")
            self._chars("<")
            self.at = at

    def _bogus_comment(self, at: int) -> None:
        stop = self.text.find(">", at)
        data = self.text[at : stop if stop >= 0 else self.end]
        self.queue.append(("comment", data.replace("\0", "�")))
        self.at = stop + 1 if stop >= 0 else self.end

    def _tag(self, at: int, kind: str) -> None:
        run = _TAG_NAME.match(self.text, at)
        self.at = run.end()
        self._after_name(kind, lower(self._no_nul(run.group())))

    def _after_name(self, kind: str, name: str) -> None:
        """Attributes and the end of the tag; a tag that the input's end cuts off is dropped."""
        text, attrs, closing = self.text, {}, False
        while True:
            self.at = _SKIP.match(text, self.at).end()
            if self.at >= self.end:
                self._error("end of input in a tag")
                return
            c = text[self.at]
            if c == ">":
                self.at += 1
                break
            if c == "/":
                self.at += 1
                if self.at >= self.end:
                    self._error("end of input in a tag")
                    return
                if text[self.at] == ">":
                    closing = True
                    self.at += 1
                    break
                self._error("solidus inside a tag")
                continue
            start = self.at
            stop = _ATTR_NAME.match(text, start + 1).end()
            raw = text[start:stop]
            for sign in raw:
                if sign in "\"'<" or (sign == "=" and raw[0] == "="):
                    self._error("sign that should not be in an attribute name")
            attr = lower(self._no_nul(raw))
            self.at = _SKIP.match(text, stop).end()
            value = ""
            if text[self.at : self.at + 1] == "=":
                self.at = _SKIP.match(text, self.at + 1).end()
                value = self._value()
                if value is None:
                    return
            if attr in attrs:
                self._error("attribute stands twice")
            else:
                attrs[attr] = value
        if kind == "end":
            if attrs:
                self._error("end tag with attributes")
            if closing:
                self._error("end tag that closes itself")
        else:
            self.last_start_tag = name
        self.queue.append((kind, name, attrs, closing))

    def _value(self) -> str | None:
        """An attribute's value; None if the input ends in it."""
        text = self.text
        c = text[self.at] if self.at < self.end else ""
        if not c:
            self._error("end of input in a tag")
            return None
        if c == ">":
            self._error("attribute without the value announced")
            return ""
        if c in "\"'":
            self.at += 1
            stop = text.find(c, self.at)
            if stop < 0:
                self.at = self.end
                self._error("end of input in an attribute value")
                return None
            value = self._decoded(stop, c)
            self.at = stop + 1
            if self.at < self.end and text[self.at] not in "\t\n\f />":
                self._error("no space between attributes")
            return value
        stop = _UNQUOTED.match(text, self.at).end()
        for sign in text[self.at : stop]:
            if sign in "\"'<=`":
                self._error("sign that should not be in an unquoted value")
        value = self._decoded(stop, ">")
        self.at = stop
        return value

    def _decoded(self, stop: int, extra: str) -> str:
        text, parts = self.text, []
        while self.at < stop:
            amp = text.find("&", self.at, stop)
            if amp < 0:
                parts.append(self._no_nul(text[self.at : stop]))
                break
            if amp > self.at:
                parts.append(self._no_nul(text[self.at : amp]))
            self.at = amp
            parts.append(self._reference(extra, True, stop))
        self.at = stop
        return "".join(parts)

    # ---- text of title, style, script and their like

    def _appropriate(self, at: int) -> int:
        """If an end tag of the last start tag's name opens there, where its name ends; else 0."""
        name = self.last_start_tag
        if name and self.text.startswith("</", at):
            stop = at + 2 + len(name)
            if lower(self.text[at + 2 : stop]) == name and self.text[stop : stop + 1] and self.text[stop] in "\t\n\f />":
                return stop
        return 0

    def _raw(self, references: bool) -> None:
        parts, text, pattern = [], self.text, _TEXT if references else _RAW
        stop = 0
        while self.at < self.end:
            run = pattern.match(text, self.at)
            if run:
                parts.append(self._no_nul(run.group()))
                self.at = run.end()
            elif text[self.at] == "&":
                parts.append(self._reference(""))
            else:
                stop = self._appropriate(self.at)
                if stop:
                    break
                parts.append("<")
                self.at += 1
        self._chars("".join(parts))
        if stop:
            self._end_raw(stop)

    def _end_raw(self, stop: int) -> None:
        self.at, self.state = stop, "data"
        self._after_name("end", self.last_start_tag)

    def _script(self) -> None:
        """Up to the end tag: one inside ``<!-- <script>`` does not count."""
        text, at, depth = self.text, self.at, 0  # 0 plain, 1 in a comment, 2 in a script in a comment
        name = self.last_start_tag or "script"
        while True:
            mark = _SCRIPT_MARK.search(text, at)
            if name != "script":
                stop = next((self._appropriate(i) for i in self._ends(at) if self._appropriate(i)), 0)
                close = stop - len(name) - 2 if stop else self.end
                break
            if not mark:
                stop, close = 0, self.end
                break
            kind = mark.group()
            at = mark.end()
            if kind == "<!--":
                if depth == 0:
                    depth, at = 1, mark.end() - 2  # its dashes may begin the end
            elif kind == "-->":
                depth = 0
            elif mark.group(1):
                if depth < 2:
                    stop, close = mark.end(), mark.start()
                    break
                depth = 1
            elif depth == 1:
                depth = 2
        if not stop and depth:
            self._error("end of input in a script's comment")
        self._chars(self._no_nul(text[self.at : close]))
        self.at = close
        if stop:
            self._end_raw(stop)

    def _ends(self, at: int):
        while (at := self.text.find("</", at)) >= 0:
            yield at
            at += 2

    # ---- comments, document types, CDATA

    def _declaration(self) -> None:
        text, at = self.text, self.at
        if text.startswith("--", at):
            self._comment(at + 2)
        elif lower(text[at : at + 7]) == "doctype":
            self.at = at + 7
            self._doctype()
        elif text.startswith("[CDATA[", at) and self.allows_cdata():
            stop = text.find("]]>", at + 7)
            self._chars(text[at + 7 : stop if stop >= 0 else self.end])
            self.at = stop + 3 if stop >= 0 else self.end
        else:
            self._error("declaration of no known kind")
            self._bogus_comment(at)

    def _comment(self, at: int) -> None:
        text = self.text
        for short in (">", "->"):
            if text.startswith(short, at):
                self._error("comment that closes too early")
                self.queue.append(("comment", ""))
                self.at = at + len(short)
                return
        stop = _COMMENT_END.search(text, at)
        if stop:
            data, self.at = text[at : stop.start()], stop.end()
            if stop.group() == "--!>":
                self._error("comment that ends with a bang")
        else:
            data, self.at = _COMMENT_CUT.sub("", text[at:]), self.end
            self._error("end of input in a comment")
        for _ in re.findall(r"--(?!>)", data):
            self._error("dashes in a comment")
        self.queue.append(("comment", self._no_nul(data)))

    def _doctype(self) -> None:
        text = self.text
        name: str | None = None
        ids: dict[str, str | None] = {"public": None, "system": None}

        def emit(quirks: bool) -> None:
            self.queue.append(("doctype", name, ids["public"], ids["system"], quirks))

        def ended(message: str) -> bool:
            """At the input's end: emits with quirks."""
            if self.at >= self.end:
                self._error(message)
                emit(True)
                return True
            return False

        def skip() -> str:
            self.at = _SKIP.match(text, self.at).end()
            return text[self.at] if self.at < self.end else ""

        def bogus(quirks: bool) -> None:
            stop = text.find(">", self.at)
            self.at = stop + 1 if stop >= 0 else self.end
            emit(quirks)

        if ended("end of input in a document type"):
            return
        if text[self.at] not in SPACE:
            self._error("no space before a document type's name")
        c = skip()
        if ended("end of input in a document type"):
            return
        if c == ">":
            self._error("document type without a name")
            self.at += 1
            return emit(True)
        run = _DOCTYPE_NAME.match(text, self.at)
        name = lower(self._no_nul(run.group()))
        self.at = run.end()
        c = skip()
        if ended("end of input in a document type"):
            return None
        if c == ">":
            self.at += 1
            return emit(False)
        word = lower(text[self.at : self.at + 6])
        if word not in ("public", "system"):
            self._error("unexpected text after a document type's name")
            return bogus(True)
        self.at += 6
        for which in ("public", "system") if word == "public" else ("system",):
            spaced = text[self.at : self.at + 1] in tuple(SPACE)
            c = skip()
            if ended("end of input in a document type"):
                return None
            if which == "system" and word == "public" and c == ">":
                self.at += 1
                return emit(False)
            if c == ">":
                self._error("document type without its identifier")
                self.at += 1
                return emit(True)
            if c not in "\"'":
                self._error("identifier of a document type without quotes")
                return bogus(True)
            if not spaced:
                self._error("no space before an identifier")
            stop = text.find(c, self.at + 1)
            cut = text.find(">", self.at + 1)
            if cut >= 0 and (stop < 0 or cut < stop):
                ids[which] = self._no_nul(text[self.at + 1 : cut])
                self._error("document type that ends in an identifier")
                self.at = cut + 1
                return emit(True)
            if stop < 0:
                ids[which] = self._no_nul(text[self.at + 1 :])
                self.at = self.end
                ended("end of input in a document type")
                return None
            ids[which] = self._no_nul(text[self.at + 1 : stop])
            self.at = stop + 1
        c = skip()
        if ended("end of input in a document type"):
            return None
        if c == ">":
            self.at += 1
            return emit(False)
        self._error("unexpected text after the system identifier")
        return bogus(False)
