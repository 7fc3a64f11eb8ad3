"""Markdown read into blocks and inline parts, with where each text stands in the source, and rendered with its words in spans.

Blocks: headings of both kinds, fenced and indented code, quotes, lists, rules, tables, definitions of links, paragraphs. Inline: code,
emphasis and strikethrough by a stack of delimiters, links, images, autolinks, bare URLs with a scheme or `www.`, escapes, entities;
a line break is a break. HTML is text. Containers nest MOST deep, delimiters are looked up by kind, and closing code marks by length, so
the time is linear in the text.

Edge cases (tests/test_markdown.py): null gives null; an empty text renders to nothing; what is not closed is text, or reaches to the
end of its container; a text that differs from its source (escapes, entities) has no place. Bare domains without `www.` stay text.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.operators.extraction import place_spans, place_tokens

MOST = 40
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})(.*)$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|([0-9]{1,9})[.)])(?=[ \t]|$)")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_COLUMNS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>]*)>|(\S+))(?:[ \t]+(?:\"([^\"]*)\"|'([^']*)'|\(([^()]*)\)))?[ \t]*$")
_TARGET = re.compile(r"\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)))?\s*\)")
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")
_AUTO = re.compile(r"<(?:([A-Za-z][A-Za-z0-9+.-]{1,31}:[^<>\x00-\x20]*)|([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*))>")
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
_BARE = re.compile(r"(?<![\w/])(?:(?:https?|ftp)://|mailto:|www\.)[^\s<>\"'`|]*[^\s<>\"'`|.,:;!?)\]}*_~]", re.I)
_SPECIAL = re.compile(r"[\\`*_~\[\]!<&\n]")
_BAD_LINK = re.compile(r"(?:vbscript|javascript|file|data):(?!image/(?:gif|png|jpeg|webp);)", re.I)

Lines = list[tuple[int, str]]  # (place in the source, text) of each line of a container


def escaped(x: str) -> str:
    return x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _plain(x: str) -> str:
    """A target or title without escapes and entities."""
    return entities.unescape(re.sub(rf"\\([{re.escape(PUNCTUATION)}])", r"\1", x))


def _label(x: str) -> str:
    return " ".join(x.split()).casefold()


def _indent(x: str) -> int:
    n = 0
    for c in x:
        if c not in " \t":
            break
        n += 4 - n % 4 if c == "\t" else 1
    return n


class Node:
    """A text with its place, or markup; closers and openers of delimiters become markup when they pair up."""

    __slots__ = ("text", "place", "markup")

    def __init__(self, text: str, place: int | None = None, markup: bool = False):
        self.text, self.place, self.markup = text, place, markup


class Document:
    """`parts`: the page in order, markup and Nodes of text."""

    def __init__(self, source: str):
        self.parts: list[Node] = []
        self.links: dict[str, tuple[str, str]] = {}
        self.inlines: list[tuple[int, str, list[int], list[int]]] = []
        lines, at = [], 0
        for line in re.split("\r\n|\n|\r", source):
            lines.append((at, line))
            at += len(line)
            at += 2 if source[at : at + 2] == "\r\n" else 1
        if not lines[-1][1]:
            lines.pop()
        self.blocks(lines, 0, False)
        inlines = {at: rest for at, *rest in self.inlines}
        self.parts = [x for i, part in enumerate(self.parts) for x in ([part] if i not in inlines else Inline(self, *inlines[i]).nodes())]

    def markup(self, x: str) -> None:
        self.parts.append(Node(x, markup=True))

    def inline(self, lines: Lines) -> None:
        """Text of consecutive lines, read once all definitions are known."""
        stripped = [(at + len(x) - len(x.lstrip(" \t")), x.lstrip(" \t")) for at, x in lines]
        stripped[-1] = stripped[-1][0], stripped[-1][1].rstrip(" \t")
        starts = [0]
        for _, x in stripped[:-1]:
            starts.append(starts[-1] + len(x) + 1)
        content = "\n".join(x for _, x in stripped)
        self.inlines.append((len(self.parts), content, starts, [at for at, _ in stripped]))
        self.parts.append(Node(""))

    def starts_block(self, line: str, in_paragraph: bool = True) -> bool:
        if _indent(line) >= 4:
            return False
        item = _ITEM.match(line)
        if item and in_paragraph and (not line[item.end() :].strip() or item[3] not in (None, "1")):
            item = None
        return bool(item or _FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line))

    def blocks(self, lines: Lines, depth: int, tight: bool) -> None:
        i = 0
        while i < len(lines):
            at, line = lines[i]
            if not line.strip():
                i += 1
            elif _indent(line) >= 4:
                i = self.indented(lines, i)
            elif m := _FENCE.match(line):
                i = self.fence(lines, i, m)
            elif m := _HEADING.match(line):
                text = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", line[m.end() :])
                self.tagged(f"h{len(m[1])}", [(at + m.end(), text)])
                i += 1
            elif _RULE.match(line):
                self.markup("<hr>\n")
                i += 1
            elif depth < MOST and _QUOTE.match(line):
                i = self.quote(lines, i, depth)
            elif depth < MOST and _ITEM.match(line):
                i = self.list(lines, i, depth)
            elif "|" in line and i + 1 < len(lines) and "|" in lines[i + 1][1] + line and _COLUMNS.match(lines[i + 1][1]) and len(self.cells(*lines[i])) == len(self.cells(*lines[i + 1])):
                i = self.table(lines, i)
            else:
                i = self.paragraph(lines, i, tight)

    def tagged(self, tag: str, lines: Lines) -> None:
        self.markup(f"<{tag}>")
        if any(x.strip() for _, x in lines):
            self.inline(lines)
        self.markup(f"</{tag}>\n")

    def indented(self, lines: Lines, i: int) -> int:
        first, last = i, i
        while i < len(lines) and (_indent(lines[i][1]) >= 4 or not lines[i][1].strip()):
            last = i if lines[i][1].strip() else last
            i += 1
        body = "\n".join(re.sub(r"^(?: {0,3}\t| {0,4})", "", x, count=1) if x.strip() else x[4:] for _, x in lines[first : last + 1])
        self.markup(f"<pre><code>{escaped(body)}\n</code></pre>\n")
        return last + 1

    def fence(self, lines: Lines, i: int, m: re.Match) -> int:
        closing, body = re.compile(rf" {{0,3}}{m[2][0]}{{{len(m[2])},}}[ \t]*$"), []
        i += 1
        while i < len(lines) and not closing.match(lines[i][1]):
            x = lines[i][1]
            body.append(x[min(len(m[1]), len(x) - len(x.lstrip(" "))) :] + "\n")
            i += 1
        info = _plain(m[3].strip())
        if info == "mermaid":
            self.markup(f'<div class="mermaid">{"".join(body).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")}</div>\n')
        else:
            language = f' class="language-{escaped(info)}"' if info else ""
            self.markup(f"<pre><code{language}>{escaped(''.join(body))}</code></pre>\n")
        return i + 1

    def quote(self, lines: Lines, i: int, depth: int) -> int:
        inner: Lines = []
        while i < len(lines):
            at, line = lines[i]
            if m := _QUOTE.match(line):
                inner.append((at + m.end(), line[m.end() :]))
            elif line.strip() and inner and inner[-1][1].strip() and not self.starts_block(line) and not _FENCE.match(inner[-1][1]):
                inner.append((at, line))
            else:
                break
            i += 1
        self.markup("<blockquote>\n")
        self.blocks(inner, depth + 1, False)
        self.markup("</blockquote>\n")
        return i

    def list(self, lines: Lines, i: int, depth: int) -> int:
        first = _ITEM.match(lines[i][1])
        kind, items, loose, blank = first[2][-1], [], False, False
        while i < len(lines) and (m := _ITEM.match(lines[i][1])) and m[2][-1] == kind and not (_RULE.match(lines[i][1]) and kind in "-*"):
            loose |= blank
            at, line = lines[i]
            rest = line[m.end() :]
            gap = len(rest) - len(rest.lstrip(" "))
            gap = 1 if not rest.strip() or gap > 4 or not gap else gap
            width = m.end() + gap
            inner, blank, within = [(at + min(width, len(line)), line[width:])], not rest.strip(), False
            nested = 0 if (deeper := _ITEM.match(line[width:])) is None else deeper.end() + 1
            i += 1
            while i < len(lines):
                at, line = lines[i]
                if not line.strip():
                    if len(inner) == 1 and not inner[0][1].strip():
                        break
                    inner.append((at, ""))
                    blank = True
                elif _indent(line) >= width or line[:1] == "\t":
                    within |= blank and len(inner) > 1 and not (nested and _indent(line) - width >= nested)
                    cut = width if _indent(line) >= width and line[:1] != "\t" else 1
                    inner.append((at + cut, line[cut:]))
                    if deeper := _ITEM.match(line[cut:]):
                        nested = deeper.end() + 1
                    blank = False
                elif not blank and not self.starts_block(line, False):
                    inner.append((at, line))
                else:
                    break
                i += 1
            while inner and len(inner) > 1 and not inner[-1][1].strip():
                inner.pop()
            loose |= within
            items.append(inner)
        tag = "ol" if first[3] else "ul"
        start = f' start="{int(first[3])}"' if first[3] and int(first[3]) != 1 else ""
        self.markup(f"<{tag}{start}>\n")
        for inner in items:
            self.markup("<li>")
            self.blocks(inner, depth + 1, not loose)
            self.markup("</li>\n")
        self.markup(f"</{tag}>\n")
        return i

    def cells(self, at: int, line: str) -> Lines:
        """(place, text) of the cells of a row; a pipe behind a backslash is none."""
        bounds = [m.start() for m in re.finditer(r"(?<!\\)\|", line)]
        edges = [-1, *bounds, len(line)]
        found = [(at + a + 1, line[a + 1 : z]) for a, z in zip(edges, edges[1:])]
        if not line[: edges[1]].strip() and len(found) > 1:
            found = found[1:]
        if len(found) > 1 and not found[-1][1].strip():
            found = found[:-1]
        return found

    def table(self, lines: Lines, i: int) -> int:
        ways = []
        for _, x in self.cells(*lines[i + 1]):
            x = x.strip()
            way = {(1, 1): "center", (1, 0): "left", (0, 1): "right"}.get((x.startswith(":"), x.endswith(":")))
            ways.append(f' style="text-align:{way}"' if way else "")

        def row(line: tuple[int, str], tag: str) -> None:
            self.markup("<tr>\n")
            found = self.cells(*line)[: len(ways)]
            for cell, way in zip(found + [(line[0], "")] * (len(ways) - len(found)), ways):
                self.markup(f"<{tag}{way}>")
                if cell[1].strip():
                    self.inline([cell])
                self.markup(f"</{tag}>\n")
            self.markup("</tr>\n")

        self.markup("<table>\n<thead>\n")
        row(lines[i], "th")
        self.markup("</thead>\n")
        i += 2
        first = i
        while i < len(lines) and lines[i][1].strip() and not self.starts_block(lines[i][1]) and _indent(lines[i][1]) < 4:
            self.markup("<tbody>\n" if i == first else "")
            row(lines[i], "td")
            i += 1
        self.markup("</tbody>\n</table>\n" if i > first else "</table>\n")
        return i

    def paragraph(self, lines: Lines, i: int, tight: bool) -> int:
        begun = i
        while i < len(lines) and (m := _DEFINITION.match(lines[i][1])):
            self.links.setdefault(_label(m[1]), (_plain(m[2] if m[2] is not None else m[3]), _plain(m[4] or m[5] or m[6] or "")))
            i += 1
        if i > begun and (i == len(lines) or not lines[i][1].strip() or self.starts_block(lines[i][1], False)):
            return i
        first = i
        while i < len(lines) and lines[i][1].strip() and (i == first or not self.starts_block(lines[i][1]) or _UNDERLINE.match(lines[i][1])):
            if i > first and (m := _UNDERLINE.match(lines[i][1])):
                self.tagged("h1" if m[1][0] == "=" else "h2", lines[first:i])
                return i + 1
            i += 1
        if tight:
            self.inline(lines[first:i])
        else:
            self.tagged("p", lines[first:i])
        return i


class Inline:
    """Nodes of the text of a block: what is special is read from the left; delimiters wait on stacks until theirs closes them."""

    def __init__(self, document: Document, content: str, starts: list[int], places: list[int]):
        self.links, self.x, self.starts, self.places = document.links, content, starts, places
        self.out: list[Node] = []
        self.delimiters: list[list] = []  # [sign, how many, node number, opens, closes, how many at first]
        self.brackets: list[tuple] = []  # (node number, image, delimiters before it, place behind it)
        self.no_links = 0  # so many brackets hold a link already and can't become one
        self.runs: dict[int, list[int]] = defaultdict(list)
        for m in re.finditer("`+", content):
            self.runs[len(m[0])].append(m.start())

    def place(self, i: int) -> int:
        k = bisect_right(self.starts, i) - 1
        return self.places[k] + i - self.starts[k]

    def text(self, x: str, i: int | None) -> None:
        self.out.append(Node(x, None if i is None else self.place(i)))

    def markup(self, x: str) -> None:
        self.out.append(Node(x, markup=True))

    def nodes(self) -> list[Node]:
        x, i = self.x, 0
        while i < len(x):
            m = _SPECIAL.search(x, i)
            stop = m.start() if m else len(x)
            if stop > i:
                self.text(x[i:stop], i)
            i = self.special(stop) if m else stop
        self.pair(0)
        merged: list[Node] = []
        for node in self.out:
            last = merged[-1] if merged else None
            if node.markup or last is None or last.markup:
                if node.text:
                    merged.append(node)
            else:
                follows = last.place is not None and node.place == last.place + len(last.text)
                merged[-1] = Node(last.text + node.text, last.place if follows else None) if node.text else last
        found, linked = [], False
        for node in merged:
            found += [node] if node.markup or linked else self.bare(node)
            if node.markup and node.text.startswith(("<a ", "</a>")):
                linked = node.text != "</a>"
        return found

    def special(self, i: int) -> int:
        x, c = self.x, self.x[i]
        if c == "\\":
            if x[i + 1 : i + 2] == "\n":
                return self.line_break(i + 1)
            if x[i + 1 : i + 2] and x[i + 1] in PUNCTUATION:
                self.text(x[i + 1], i + 1)
                return i + 2
        elif c == "\n":
            return self.line_break(i)
        elif c == "`":
            return self.code(i)
        elif c in "*_~":
            return self.delimiter(i)
        elif c == "[" or c == "!" and x[i + 1 : i + 2] == "[":
            size = 1 + (c == "!")
            self.no_links = min(self.no_links, len(self.brackets))
            self.brackets.append((len(self.out), c == "!", len(self.delimiters), i + size))
            self.text(x[i : i + size], i)
            return i + size
        elif c == "]":
            return self.bracket(i)
        elif c == "<" and (m := _AUTO.match(x, i)):
            target = m[1] or f"mailto:{m[2]}"
            if not _BAD_LINK.match(target):
                self.markup(f'<a href="{escaped(target)}">')
                self.text(m[1] or m[2], i + 1)
                self.markup("</a>")
                return m.end()
        elif c == "&" and (m := _ENTITY.match(x, i)) and (found := entities.unescape(m[0])) != m[0]:
            self.text(found, None)
            return m.end()
        self.text(c, i)
        return i + 1

    def line_break(self, i: int) -> int:
        if self.out and not self.out[-1].markup:
            self.out[-1].text = self.out[-1].text.rstrip(" ")
        self.markup("<br>\n")
        return i + 1

    def code(self, i: int) -> int:
        size = re.compile("`+").match(self.x, i).end() - i
        closing = self.runs[size]
        k = bisect_left(closing, i + size)
        if k == len(closing):
            self.text("`" * size, i)
            return i + size
        body = self.x[i + size : closing[k]].replace("\n", " ")
        if body[:1] == body[-1:] == " " and body.strip(" "):
            body = body[1:-1]
        self.markup(f"<code>{escaped(body)}</code>")
        return closing[k] + size

    def delimiter(self, i: int) -> int:
        x, c = self.x, self.x[i]
        stop = i
        while stop < len(x) and x[stop] == c:
            stop += 1
        before, after = x[i - 1 : i] if i else " ", x[stop : stop + 1] or " "
        sign = lambda y: y in PUNCTUATION or not (y.isalnum() or y.isspace()) and not y.isidentifier()
        left = not after.isspace() and (not sign(after) or before.isspace() or sign(before))
        right = not before.isspace() and (not sign(before) or after.isspace() or sign(after))
        opens, closes = (left and (not right or sign(before)), right and (not left or sign(after))) if c == "_" else (left, right)
        if c != "~" or stop - i > 1:
            self.delimiters.append([c, stop - i, len(self.out), opens, closes, stop - i])
        self.text(x[i:stop], i)
        return stop

    def pair(self, first: int) -> None:
        """Pair the delimiters from number `first` on; those that find no partner stay text."""
        stack, marks = self.delimiters[first:], defaultdict(list)
        before, after = defaultdict(list), defaultdict(list)  # markup by node number
        floor: dict[tuple, int] = {}
        open_at: dict[str, list[int]] = {c: [] for c in "*_~"}
        for k, (c, _, node, opens, closes, size) in enumerate(stack):
            at, own = open_at[c], stack[k]
            kind = c, opens, size % 3
            while closes and own[1] and at:
                j, found = len(at) - 1, -1
                while j >= 0 and at[j] >= floor.get(kind, 0):
                    other = stack[at[j]]
                    odd = c != "~" and (other[4] or opens) and (other[5] + size) % 3 == 0 and (other[5] % 3 or size % 3)
                    if not odd and (c != "~" or min(other[1], own[1]) >= 2):
                        found = j
                        break
                    j -= 1
                if found < 0:
                    floor[kind] = k
                    break
                other, opener = stack[at[found]], at[found]
                n = 2 if min(other[1], own[1]) >= 2 else 1
                tag = "s" if c == "~" else "strong" if n == 2 else "em"
                other[1] -= n
                own[1] -= n
                after[other[2]].append(f"<{tag}>")
                before[node].append(f"</{tag}>")
                for d in open_at.values():  # delimiters between the two can pair no more
                    while d and d[-1] > opener:
                        d.pop()
                if not other[1]:
                    at.pop()
            if opens and own[1]:
                at.append(k)
        for _, left, node, *_ in stack:
            own = self.out[node]
            own.text = own.text[:left]
            if closed := before.get(node):
                marks[node] = [Node("".join(closed), markup=True)]
            if opened := after.get(node):
                marks[node] = [*marks.get(node, []), own, Node("".join(reversed(opened)), markup=True)]
            elif node in marks:
                marks[node].append(own)
        del self.delimiters[first:]
        if marks:
            low = min(marks)
            moved, tail = [], self.out[low:]
            for n, node in enumerate(tail, low):
                moved += marks.get(n) or [node]
            self.out[low:] = moved

    def bracket(self, i: int) -> int:
        x = self.x
        if not self.brackets:
            self.text("]", i)
            return i + 1
        node, image, first, start = self.brackets.pop()
        found, stop = None, i + 1
        if image or len(self.brackets) >= self.no_links:
            if (m := _TARGET.match(x, i + 1)) and not _BAD_LINK.match(_plain(m[1] if m[1] is not None else m[2])):
                found, stop = (_plain(m[1] if m[1] is not None else m[2]), _plain(m[3] or m[4] or m[5] or "")), m.end()
            else:
                m = _LABEL.match(x, i + 1)
                found = self.links.get(_label(m[1] if m and m[1] else x[start:i] if i - start < 1000 else ""))
                stop = m.end() if m and found else i + 1
        if not found or _BAD_LINK.match(found[0]):
            self.text("]", i)
            return i + 1
        self.pair(first)
        title = f' title="{escaped(found[1])}"' if found[1] else ""
        if image:
            alt = "".join(y.text for y in self.out[node + 1 :] if not y.markup)
            self.out[node:] = [Node(f'<img src="{escaped(found[0])}" alt="{escaped(alt)}"{title}>', markup=True)]
        else:
            self.out[node] = Node(f'<a href="{escaped(found[0])}"{title}>', markup=True)
            self.markup("</a>")
            self.no_links = len(self.brackets)
        return stop

    def bare(self, node: Node) -> Iterator[Node]:
        """A text with the URLs in it linked."""
        done = 0
        for m in _BARE.finditer(node.text):
            for a, z in ((done, m.start()), m.span()):
                part = Node(node.text[a:z], None if node.place is None else node.place + a)
                if a == m.start() and part.text:
                    target = m[0] if "://" in m[0] or m[0].lower().startswith("mailto:") else f"http://{m[0]}"
                    yield from (Node(f'<a href="{escaped(target)}">', markup=True), part, Node("</a>", markup=True))
                elif part.text:
                    yield part
            done = m.end()
        if done < len(node.text):
            yield Node(node.text[done:], None if node.place is None else node.place + done)


def text_tokens(source: str) -> list[tuple[str, int | None]]:
    """(text, place) of the texts of a page in order; code and what images show is no text."""
    return [(x.text, x.place) for x in Document(source).parts if not x.markup]


def render(source: str) -> str:
    """The page with each word of its texts in a span; texts are looked for in the source, each behind the one before."""
    out, at = [], 0
    for part in Document(source).parts:
        found = -1 if part.markup else source.find(part.text, at)
        if part.markup or found < 0:
            out.append(part.text if part.markup else escaped(part.text))
            continue
        at = found + len(part.text)
        for run in re.finditer(r"\s+|\S+", part.text):
            word = escaped(run[0])
            out.append(word if run[0].isspace() else f'<span data-orig-start="{found + run.start()}" data-orig-end="{found + run.end()}">{word}</span>')
    return "".join(out)


def rendered_markdown(text: Column) -> Column:
    @F.pandas_udf("string")
    def pages(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else render(x))

    return pages(text)


def markdown_tokens(text: Column) -> Column:
    """array<struct<text, start>>: texts of a page and where they begin in the source, null for texts that differ from it."""

    @F.pandas_udf("array<struct<text:string,start:int>>")
    def pages(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [{"text": t, "start": p} for t, p in text_tokens(x)] for x in texts], dtype=object)

    return pages(text)


def word_spans(source: str) -> list[tuple[int, int, int]]:
    """(number, start, end) of the words of a page's texts, found in turn in the source; for lectern.operators.words.spans()."""
    return place_spans(source, [t for t, _ in text_tokens(source)])


def markdown_words(text: Column) -> Column:
    """array<struct<word, start, end>> of the words of a page's texts, found in turn in the source."""

    @F.pandas_udf("array<struct<word:string,start:int,end:int>>")
    def pages(texts: pd.Series) -> pd.Series:
        rows = [None if x is None else place_tokens(x, [t for t, _ in text_tokens(x)]) for x in texts]
        return pd.Series([None if r is None else [dict(zip(("word", "start", "end"), w)) for w in r] for r in rows], dtype=object)

    return pages(text)
