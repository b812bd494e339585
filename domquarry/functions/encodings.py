"""Which encoding a page has: labels, byte order marks, Content-Type, and what a meta element may change."""

from __future__ import annotations

import codecs
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LABELS = {
    "UTF-8": "unicode-1-1-utf-8 utf-8 utf8",
    "IBM866": "866 cp866 csibm866 ibm866",
    "ISO-8859-2": "csisolatin2 iso-8859-2 iso-ir-101 iso8859-2 iso88592 iso_8859-2 iso_8859-2:1987 l2 latin2",
    "ISO-8859-3": "csisolatin3 iso-8859-3 iso-ir-109 iso8859-3 iso88593 iso_8859-3 iso_8859-3:1988 l3 latin3",
    "ISO-8859-4": "csisolatin4 iso-8859-4 iso-ir-110 iso8859-4 iso88594 iso_8859-4 iso_8859-4:1988 l4 latin4",
    "ISO-8859-5": "csisolatincyrillic cyrillic iso-8859-5 iso-ir-144 iso8859-5 iso88595 iso_8859-5 iso_8859-5:1988",
    "ISO-8859-6": "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6 iso-8859-6-e iso-8859-6-i iso-ir-127 iso8859-6 iso88596 iso_8859-6 iso_8859-6:1987",
    "ISO-8859-7": "csisolatingreek ecma-118 elot_928 greek greek8 iso-8859-7 iso-ir-126 iso8859-7 iso88597 iso_8859-7 iso_8859-7:1987 sun_eu_greek",
    "ISO-8859-8": "csiso88598e csisolatinhebrew hebrew iso-8859-8 iso-8859-8-e iso-ir-138 iso8859-8 iso88598 iso_8859-8 iso_8859-8:1988 visual",
    "ISO-8859-8-I": "csiso88598i iso-8859-8-i logical",
    "ISO-8859-10": "csisolatin6 iso-8859-10 iso-ir-157 iso8859-10 iso885910 l6 latin6",
    "ISO-8859-13": "iso-8859-13 iso8859-13 iso885913",
    "ISO-8859-14": "iso-8859-14 iso8859-14 iso885914",
    "ISO-8859-15": "csisolatin9 iso-8859-15 iso8859-15 iso885915 iso_8859-15 l9",
    "ISO-8859-16": "iso-8859-16",
    "KOI8-R": "cskoi8r koi koi8 koi8-r koi8_r",
    "KOI8-U": "koi8-ru koi8-u",
    "macintosh": "csmacintosh mac macintosh x-mac-roman",
    "windows-874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874",
    "windows-1250": "cp1250 windows-1250 x-cp1250",
    "windows-1251": "cp1251 windows-1251 x-cp1251",
    "windows-1252": "ansi_x3.4-1968 ascii cp1252 cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii windows-1252 x-cp1252",
    "windows-1253": "cp1253 windows-1253 x-cp1253",
    "windows-1254": "cp1254 csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5 windows-1254 x-cp1254",
    "windows-1255": "cp1255 windows-1255 x-cp1255",
    "windows-1256": "cp1256 windows-1256 x-cp1256",
    "windows-1257": "cp1257 windows-1257 x-cp1257",
    "windows-1258": "cp1258 windows-1258 x-cp1258",
    "x-mac-cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "GBK": "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "gb18030": "gb18030",
    "Big5": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "EUC-JP": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "ISO-2022-JP": "csiso2022jp iso-2022-jp",
    "Shift_JIS": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "EUC-KR": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "replacement": "csiso2022kr hz-gb-2312 iso-2022-cn iso-2022-cn-ext iso-2022-kr replacement",
    "UTF-16BE": "utf-16be",
    "UTF-16LE": "utf-16 utf-16le",
    "x-user-defined": "x-user-defined",
}
LABELS = {label: name for name, labels in _LABELS.items() for label in labels.split()}
_CODECS = {"macintosh": "mac_roman", "x-mac-cyrillic": "mac_cyrillic", "x-user-defined": "cp1252", "windows-874": "cp874", "ISO-8859-8-I": "iso8859_8", "IBM866": "cp866"}
_BLANK = " \t\n\r\f"
CERTAIN, TENTATIVE, IRRELEVANT = "certain", "tentative", "irrelevant"


def encoding_of(label: str | None) -> str | None:
    """The encoding's name for a label; None for unknown ones and for those that stand for no decoder."""
    name = LABELS.get((label or "").strip().lower())
    return None if name == "replacement" else "windows-1252" if name == "x-user-defined" else name


def encoding_for_label(label: Column | str) -> Column:
    """The same as a column expression: a lookup in a constant map."""
    label = F.col(label) if isinstance(label, str) else label
    pairs = [F.lit(x) for k in sorted(LABELS) if (v := encoding_of(k)) for x in (k, v)]
    return F.create_map(*pairs)[F.lower(F.trim(F.regexp_replace(label, r"^\s+|\s+$", "")))]


def decode(body: bytes, name: str) -> str | None:
    """Strictly; None if the bytes aren't of that encoding."""
    try:
        return body.decode(_CODECS.get(name, name))
    except (UnicodeDecodeError, LookupError):
        return None


def decode_1252(body: bytes) -> str:
    """Windows-1252 with U+FFFD for the bytes that it lacks."""
    return body.decode("cp1252", "replace")


_CHARSET = re.compile(r'charset="?([^"]*)', re.I)
_META_CHARSET = re.compile(r"charset[ \t\n\r\f]*(=?)[ \t\n\r\f]*", re.I)


def sniff_decode(body: bytes, content_type: str | None) -> tuple[str, str, str]:
    """(text, encoding, confidence): byte order mark if all decodes, Content-Type, else Windows-1252."""
    for mark, name in ((codecs.BOM_UTF16_BE, "UTF-16BE"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF8, "UTF-8")):
        if body.startswith(mark):
            text = decode(body[len(mark) :], name)
            if text is not None:
                return text, name, CERTAIN
    found = _CHARSET.search(content_type or "")
    name = encoding_of(found.group(1)) if found else None
    if name:
        text = decode(body, name)
        if text is not None:
            return text, name, CERTAIN
    return decode_1252(body), "windows-1252", TENTATIVE


def of_meta(attrs: dict[str, str]) -> str | None:
    """The encoding that a meta element's attributes name."""
    if "charset" in attrs:
        return encoding_of(attrs["charset"])
    if attrs.get("http-equiv", "").lower() == "content-type" and "content" in attrs:
        content, at = attrs["content"], 0
        while m := _META_CHARSET.search(content, at):
            at = m.end()
            if not m.group(1):
                continue
            rest = content[at:]
            if rest[:1] in ('"', "'"):
                stop = rest.find(rest[0], 1)
                return encoding_of(rest[1:stop]) if stop > 0 else None
            return encoding_of(re.split(r"[ \t\n\r\f;]", rest, maxsplit=1)[0])
    return None
