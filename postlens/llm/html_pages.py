"""Markup of web pages as tokens and blocks, tolerant of broken pages, linear in their length."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

# Element names of the HTML standard by how a reader treats them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
ENDS_ITEM = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
PARAGRAPH_SCOPE = frozenset("caption html table td th object template button".split())
HEAD_CONTENT = frozenset("base link meta noscript script style template title".split())
#: Elements that never hold the text of an article.
BOILERPLATE = frozenset(
    "aside button canvas dialog footer form head menu nav noscript select svg template audio "
    "video".split()
) | RAW
NEVER_BY_NAME = frozenset("html body main".split())
#: Names of what holds other people's articles.
OTHERS = frozenset(
    "comment comments commentlist disqus reply replies respond discussion related recommended "
    "sidebar".split()
)

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(
    r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE
)
_WORD_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^\W\d_]+")


def markup(page: str) -> Iterator[tuple[str | None, str, str]]:
    """``(None, text, "")`` and ``(tag name, "open" or "close", attributes)`` in page order.

    Comments, declarations and the insides of scripts, styles and the like are left out, and
    so is a tag that the end of the page cuts off. A ``<`` before no name is text.
    """
    at = done = 0
    unclosed: set[str] = set()
    while (at := page.find("<", at)) >= 0:
        named = _NAME.match(page, at + 1)
        if not named and page[at + 1 : at + 2] not in ("!", "?", "/"):
            at += 1
            continue
        if done < at:
            yield None, page[done:at], ""
        if not named:
            comment = page.startswith("<!--", at)
            end = page.find("-->" if comment else ">", at + (4 if comment else 2))
            if end < 0:
                return
            at = done = end + (3 if comment else 1)
            continue
        end = _tag_end(page, named.end(), unclosed)
        if end < 0:
            return
        name = named[1].lower()
        closing = page[at + 1] == "/"
        yield name, "close" if closing else "open", page[named.end() : end]
        at = done = end + 1
        if name in RAW and not closing:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if not stop:
                return
            at = done = stop.start()
    if done < len(page):
        yield None, page[done:], ""


def _tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where the tag closes, -1 if nowhere. Quotes hide what closes a tag, if they close."""
    while found := _TAG_END.search(page, at):
        quote = found[0][-1]
        if quote == ">":
            return found.start()
        at = found.end()
        if quote not in unclosed:
            end = page.find(quote, at)
            if end < 0:
                unclosed.add(quote)
            else:
                at = end + 1
    return -1


def attribute_names(attributes: str) -> list[str]:
    """The class names, the id and the role of a tag."""
    if "=" not in attributes:
        return []
    values = (m[2].strip("\"'") for m in _ATTRIBUTE.finditer(attributes))
    return [name for value in values for name in value.split()]


def words_of_name(name: str) -> list[str]:
    """``adSlot-top`` as ``ad, slot, top``."""
    return [w.lower() for w in _WORD_OF_NAME.findall(name)]


def _holds_others(element: Element) -> bool:
    by_tag = element.name in BOILERPLATE and element.name != "form"
    return by_tag or any(OTHERS.intersection(words_of_name(n)) for n in element.names)


@dataclass
class Element:
    name: str
    names: list[str]
    skipped: bool
    article: int
    main: bool
    outer: Element | None


@dataclass
class Token:
    """A tag (``name``) or a piece of text (``text``) and where it stands."""

    name: str | None
    text: str
    element: Element
    in_link: bool = False
    opens: bool = False


@dataclass
class Walk:
    """The tokens of a page with the elements that hold them.

    ``is_boilerplate(name, attribute names, within)`` says which elements to skip with all they
    hold; ``within`` is true inside an article or main element. ``articles`` counts the articles
    that are not within another or within skipped elements. The first article is not
    skipped because of a form or the class of an outer element, but for classes that
    name comments and the like.
    """

    is_boilerplate: Callable[[str, list[str], bool], bool]
    articles: int = 0
    stack: list[Element] = field(default_factory=lambda: [Element("", [], False, 0, False, None)])
    open: Counter = field(default_factory=Counter)

    def tokens(self, page: str) -> Iterator[Token]:
        for name, value, attributes in markup(page):
            if name is None:
                yield Token(None, html.unescape(value), self.stack[-1], self.open["a"] > 0)
            elif value == "close":
                yield Token(name, "", self.stack[-1])
                if self.open[name]:
                    while self._pop().name != name:
                        pass
            else:
                self._end_implied(name)
                element = self._element(name, attribute_names(attributes))
                yield Token(name, "", element, opens=True)
                if name not in VOID:
                    self.stack.append(element)
                    self.open[name] += 1

    def _pop(self) -> Element:
        element = self.stack.pop()
        self.open[element.name] -= 1
        return element

    def _end_implied(self, name: str) -> None:
        if self.open["head"] and name not in HEAD_CONTENT:
            self._end({"head"}, frozenset())
        if name in ENDS_PARAGRAPH and self.open["p"]:
            self._end({"p"}, PARAGRAPH_SCOPE)
        if name in ENDS_ITEM and any(self.open[n] for n in ENDS_ITEM[name][0]):
            self._end(*ENDS_ITEM[name])

    def _end(self, names: set[str], scope: frozenset[str] | set[str]) -> None:
        """Close the outermost open element of ``names`` within the scope, and all it holds."""
        found = 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name in scope:
                break
            if self.stack[i].name in names:
                found = i
                if names == {"p"}:
                    break
        while found and len(self.stack) > found:
            self._pop()

    def _element(self, name: str, names: list[str]) -> Element:
        outer = self.stack[-1]
        within = bool(outer.article) or outer.main
        skipped = outer.skipped or self.is_boilerplate(name, names, within)
        article = outer.article
        if name == "article" and not article:
            if skipped and not self.articles and not any(map(_holds_others, self.stack)):
                skipped = self.is_boilerplate(name, names, within)
            if not skipped:
                self.articles += 1
                article = self.articles
        main = outer.main or (name == "main" and not skipped)
        return Element(name, names, skipped, article, main, outer)
