"""Sanitised HTML with a map to its source, and words wrapped in spans that say where the read text has them.

A page is read once. Elements and attributes that are not allowed are left out while the tree of open elements is built: forms and
unknown elements leave their content, those of DROPPED take it along. What is written has every element closed and every text and value
escaped, so reading it again builds the same tree: sanitising twice changes nothing.

Edge cases (tests/test_markup.py): null gives null; a page may be empty, unclosed or closed wrongly; comments, doctypes and processing
instructions go; URLs are judged without the white space and control characters inside them; srcset is a list of URLs, all of which must
be allowed. Names that collide with document properties are not treated.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.operators.extraction import ENDS, VOID, _Text

# What may stay of a page, and what goes with all it holds.
ELEMENTS = frozenset("""
a abbr acronym address area article aside audio b bdi bdo big blink blockquote body br button canvas caption center cite code col colgroup
content data datalist dd decorator del details dfn dialog dir div dl dt element em fieldset figcaption figure font footer h1 h2 h3 h4 h5 h6
header hgroup hr html i img ins kbd label legend li main map mark marquee menu menuitem meter nav nobr ol optgroup option output p picture
pre progress q rp rt ruby s samp search section select shadow slot small source spacer span strike strong sub summary sup table tbody td
textarea tfoot th thead time tr track tt u ul var video wbr
""".split()) - {"body", "html"}  # fmt: skip
ATTRIBUTES = frozenset("""
accept action align alt autocapitalize autocomplete autopictureinpicture autoplay background bgcolor border capture cellpadding cellspacing
checked cite class clear color cols colspan controls controlslist coords crossorigin datetime decoding default dir disabled
disablepictureinpicture disableremoteplayback download draggable enctype enterkeyhint face for headers height hidden high href hreflang id
inputmode integrity ismap kind label lang list loading loop low max maxlength media method min minlength multiple muted name nonce noshade
novalidate nowrap open optimum pattern placeholder playsinline popover popovertarget popovertargetaction poster preload pubdate radiogroup
readonly rel required rev reversed role rows rowspan scope selected shape size sizes slot span spellcheck src srclang srcset start step
summary tabindex title translate type usemap valign value width
""".split())  # fmt: skip
DROPPED = frozenset("embed head iframe input math noembed noframes noscript object plaintext script style svg template title xmp".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
URLS = frozenset("action background cite href poster src".split())
SCHEMES = frozenset("http https ftp ftps mailto tel callto sms cid xmpp matrix".split())
WITH_DATA = frozenset("img video audio source track".split())
CONTROLS = frozenset("button select textarea option optgroup fieldset".split())
# End of fixed values
_IN_URLS = re.compile(r"[\x00-\x20\u00a0\u1680\u180e\u2000-\u2029\u205f\u3000]+")
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_OWN = re.compile(r"(?:data|aria)-[A-Za-z0-9_.-]+")


def safe_url(tag: str, url: str) -> bool:
    """Whether a URL is relative or of an allowed scheme; data URLs are allowed where they are shown, not followed."""
    scheme = _SCHEME.match(_IN_URLS.sub("", url))
    return scheme is None or scheme[1].lower() in SCHEMES or scheme[1].lower() == "data" and tag in WITH_DATA


def _safe(tag: str, name: str, value: str) -> bool:
    if name == "srcset":
        return all(safe_url(tag, x) for x in re.split(r",\s+", value))
    return name in ATTRIBUTES and (name not in URLS or safe_url(tag, value)) or bool(_OWN.fullmatch(name))


def _text(x: str) -> str:
    return x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\xa0", "&nbsp;")


def _tag(tag: str, attrs: list[tuple[str, str]]) -> str:
    return f"<{tag}{''.join(f' {k}=\"{_text(v).replace(chr(34), '&quot;')}\"' for k, v in attrs)}>"


class Sanitizer(HTMLParser):
    """Writes what is allowed of a page: `out`, and `places`, (start, end, source start, source end) of its tags and texts."""

    def __init__(self, inert: bool = False):
        super().__init__(convert_charrefs=True)
        self.out, self.length, self.places, self.tree, self.inert = [], 0, [], [], inert
        self.dropped, self.depth, self.opened = None, 0, Counter()

    def read(self, page: str) -> Sanitizer:
        self.starts = [0, *(m.end() for m in re.finditer("\n", page))]
        self.feed(page)
        self.close()
        self._ends(len(page))
        for tag in reversed(self.tree):
            self._write(f"</{tag}>")
        return self

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _ends(self, at: int) -> None:
        """The last part without an end in the source ends where the next token begins."""
        if self.places and self.places[-1][3] is None:
            self.places[-1] = *self.places[-1][:3], at

    def _write(self, x: str, at: int | None = None) -> None:
        if at is not None:
            self.places.append((self.length, self.length + len(x), at, None))
        self.out.append(x)
        self.length += len(x)

    def handle_starttag(self, tag, attrs):
        at = self._at()
        self._ends(at)
        if tag in RAW:
            self.set_cdata_mode(tag)
        if self.dropped:
            self.depth += tag == self.dropped
        elif tag in DROPPED:
            if tag not in VOID:
                self.dropped, self.depth = tag, 1
        elif tag in ELEMENTS:
            if self.tree and tag in ENDS.get(self.tree[-1], ()):
                self._write(f"</{self._closed()}>")
            kept = {}
            for k, v in attrs:
                if _safe(tag, k, v or ""):
                    kept.setdefault(k, v or "")
            if self.inert:
                if tag in CONTROLS:
                    kept |= {"disabled": "", "tabindex": "-1"}
                elif tag in ("video", "audio"):
                    kept.pop("controls", None)
                elif tag == "a" and "href" in kept:
                    kept["title"] = kept["href"]
            self._write(_tag(tag, list(kept.items())), at)
            if tag not in VOID:
                self.tree.append(tag)
                self.opened[tag] += 1

    def _closed(self) -> str:
        tag = self.tree.pop()
        self.opened[tag] -= 1
        return tag

    def handle_endtag(self, tag):
        at = self._at()
        self._ends(at)
        if self.dropped:
            self.depth -= tag == self.dropped
            if not self.depth:
                self.dropped = None
        elif self.opened[tag]:
            while (open_tag := self._closed()) != tag:
                self._write(f"</{open_tag}>")
            self._write(f"</{tag}>", at)

    def handle_data(self, data):
        at = self._at()
        self._ends(at)
        if not self.dropped:
            self._write(_text(entities.unescape(data) if self.cdata_elem == "textarea" else data), at)

    def _nothing(self, _):
        self._ends(self._at())

    handle_comment = handle_decl = handle_pi = unknown_decl = _nothing


class _Wrapped(_Text):
    """Sanitised markup with each word that is read in a span; spaces stay as they are."""

    def __init__(self):
        super().__init__()
        self.out = []

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        self.out.append(self.get_starttag_text())
        if tag == "textarea":
            self.set_cdata_mode(tag)

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if self.cdata_elem:
            data = entities.unescape(data)
        first = len(self.words)
        super().handle_data(data)
        words = iter(self.words[first:])
        for run in re.findall(r"\s+|\S+", data):
            if self.hidden or run.isspace() or self.cdata_elem:
                self.out.append(_text(run))
            else:
                _, start, end = next(words)
                self.out.append(f'<span data-orig-start="{start}" data-orig-end="{end}">{_text(run)}</span>')


def sanitize(page: str, inert: bool = False) -> str:
    return "".join(Sanitizer(inert).read(page).out)


def wrap_words(clean: str) -> str:
    """Sanitised markup whose words are spans with their places in the text that html_to_text() reads of it."""
    parser = _Wrapped()
    parser.feed(clean)
    parser.close()
    return "".join(parser.out)


def source_place(places: list[tuple[int, int, int, int]], at: int) -> tuple[int, int] | None:
    """The source range of the tag or text that holds a character of the output; None for end tags that were added."""
    k = bisect_right(places, (at, float("inf"))) - 1
    return places[k][2:] if k >= 0 and at < places[k][1] else None


def sanitized(page: Column, inert: bool = False) -> Column:
    """The markup that may stay of a page; with `inert`, controls are disabled, players have none, and links are titled with their target."""

    @F.pandas_udf("string")
    def clean(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: None if x is None else sanitize(x, inert))

    return clean(page)


def sanitized_with_places(page: Column) -> Column:
    """struct<html, places array<struct<start, end, source_start, source_end>>>"""

    @F.pandas_udf("html string, places array<struct<start:int,end:int,source_start:int,source_end:int>>")
    def clean(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for x in pages:
            found = None if x is None else Sanitizer().read(x)
            rows.append((None, None) if found is None else ("".join(found.out), [dict(zip(("start", "end", "source_start", "source_end"), p)) for p in found.places]))
        return pd.DataFrame(rows, columns=["html", "places"])

    return clean(page)


def words_wrapped(clean: Column) -> Column:
    @F.pandas_udf("string")
    def wrap(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: None if x is None else wrap_words(x))

    return wrap(clean)
