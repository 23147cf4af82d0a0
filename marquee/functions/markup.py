"""Tags, attributes and entities of HTML, read in linear time from any text; nothing is raised."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

#: A quote counts as one after an equals sign alone, as browsers have it; one that is never closed is a character.
_QUOTED = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
#: An href in quotes as the only attribute, which is what attributes() finds first.
_HREF = re.compile(r"""\s++href\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')\s*+""")
#: An anchor with an href in quotes alone, and text without tags up to its end.
_ANCHOR = re.compile(r"""<[aA]\s++href\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')\s*+>([^<]*+)</[aA]>""")
_BIG = re.compile(r"&#(?:0*+[1-9][0-9]{7,}+|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{7,}+);?")
_ZEROS = re.compile(r"&#0{5,}+(?=[0-9])")
_ANY_TAG = re.compile(r"<[^<>]++>")
_BLANKS = re.compile(r"[ \t\r\n\f]+")
_SURROGATES = re.compile("[\ud800-\udfff]")


class Tag(NamedTuple):
    start: int
    end: int
    closing: bool
    name: str  # in lower case
    rest: str  # what follows the name


def unescape(text: str) -> str:
    """Text with its character references replaced; those beyond Unicode become U+FFFD, however long."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _ZEROS.sub("&#", _BIG.sub("�", text))
    return html.unescape(text)


def well_formed(text: str) -> str:
    """Text without lone surrogates, which no column holds."""
    return text if text.isascii() else _SURROGATES.sub("�", text)


def attributes(rest: str) -> dict[str, tuple[str, bool]]:
    """(value, whether it is quoted) by name in lower case; the first of a name counts."""
    out: dict[str, tuple[str, bool]] = {}
    for m in _ATTRIBUTE.finditer(rest):
        name = m[1].lower()
        if name not in out:
            quoted = m[2] if m[2] is not None else m[3]
            out[name] = (m[4] or "", False) if quoted is None else (quoted, True)
    return out


class Scanner:
    """``next(at)`` gives the first tag from ``at`` on. Calls go forward.

    A ``<`` that begins no tag is text. Once a tag has no end outside quotes, quotes no longer count,
    so every character is looked at a bounded number of times. With ``comments``, tags in comments
    and declarations count like others; without, ``skipped`` holds the end of those passed over.
    """

    def __init__(self, text: str, comments: bool = False):
        self.text, self.comments, self.pattern = text, comments, _QUOTED
        self.last = text.rfind(">")

    def tokens(self, at: int) -> tuple[Tag | None, int, int]:
        """(tag, start, end) of the next tag or, with tag None, of a comment; (None, n, n) at the end."""
        text, n = self.text, len(self.text)
        while True:
            at = text.find("<", at)
            if at < 0:
                return None, n, n
            mark = text[at + 1 : at + 2]
            if not self.comments and mark in ("!", "?"):
                if text.startswith("<!--", at):
                    end = text.find("-->", at + 4)
                    return None, at, n if end < 0 else end + 3
                if at < self.last:
                    return None, at, text.find(">", at) + 1
            elif at < self.last:
                m = self.pattern.match(text, at)
                if m is None and self.pattern is _QUOTED and (mark.isalpha() or mark == "/"):
                    m = _PLAIN.match(text, at)
                    if m is not None:
                        self.pattern = _PLAIN
                if m is not None:
                    return Tag(at, m.end(), bool(m[1]), m[2].lower(), m[3]), at, m.end()
            else:
                return None, n, n
            at += 1

    def tags(self) -> Iterator[Tag]:
        at = 0
        while at < len(self.text):
            tag, _, at = self.tokens(at)
            if tag is not None:
                yield tag


def links(page: str) -> Iterator[tuple[str, str]]:
    """(href, what stands between the tags) of each anchor with an href and an end tag. Anchors in
    an open one count as its text."""
    open_at, href, pattern = -1, "", _QUOTED
    # as Scanner(page, comments=True) finds tags, without making one of each
    at, last = page.find("<"), page.rfind(">")
    while 0 <= at < last:
        if open_at < 0 and pattern is _QUOTED:
            whole = _ANCHOR.match(page, at)
            if whole is not None:
                yield whole[1] if whole[2] is None else whole[2], whole[3]
                at = page.find("<", whole.end())
                continue
        m = pattern.match(page, at)
        if m is None and pattern is _QUOTED and (page[at + 1].isalpha() or page[at + 1] == "/"):
            m = _PLAIN.match(page, at)
            pattern = _QUOTED if m is None else _PLAIN
        if m is None:
            at = page.find("<", at + 1)
            continue
        if m[2] in ("a", "A"):
            if not m[1] and open_at < 0:
                alone = _HREF.fullmatch(m[3])
                if alone is not None:
                    open_at, href = m.end(), alone[alone.lastindex]
                else:
                    found = attributes(m[3]).get("href") if "=" in m[3] or "href" in m[3].lower() else None
                    if found is not None:
                        open_at, href = m.end(), found[0]
            elif m[1] and open_at >= 0:
                yield href, page[open_at:at]
                open_at = -1
        at = page.find("<", m.end())


def scripts(page: str, kind: str) -> Iterator[str]:
    """Contents of the scripts with a quoted ``type`` of ``kind``."""
    scanner, at = Scanner(page, comments=True), 0
    ends = re.compile(r"</script\s*+>", re.I)
    while at < len(page):
        tag, _, at = scanner.tokens(at)
        if tag is None or tag.closing or tag.name != "script":
            continue
        value, quoted = attributes(tag.rest).get("type", ("", False))
        if quoted and value.lower() == kind:
            end = ends.search(page, tag.end)
            if end is None:
                return
            yield page[tag.end : end.start()]
            at = end.end()


def plain(markup: str) -> str:
    """Markup with each tag as a space, references replaced, and runs of white space as one space."""
    return _BLANKS.sub(" ", unescape(_ANY_TAG.sub(" ", markup) if "<" in markup else markup).strip())
