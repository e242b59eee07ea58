"""Main text of web pages by scoring the tree of their elements.

A page is read once into a tree of its block elements and a list of text
blocks.  Every block passes points, for its length and its commas and less its
share of link text, to the elements around it: all to the nearest, half to the
next, less and less beyond.  The element with the most points is the article's
container (or the article or main element around it); a sibling of it is kept
too if all that is inside it is worth a fair part as much, or most of it reads
like prose (beside an article or main element: if it is another such).

Elements that are no part of an article (menus, page headers, footers, sidebars,
hidden parts, and those named as adverts, notices or reader comments) lend no
points and never give text.  A name that says this in part only ("related-work")
counts when links speak for it too, or, in the absence of prose, brevity; one
that stands for links or controls ("social") doesn't count against prose without
links in an article.  No name counts against an element that holds most of the
page below a main heading.  Forms and field sets go when they have little text
for their controls: one around the whole page stays.  Lists of links go outside
the container only; nothing else inside what is kept is dropped or cut.  Blocks
end where block elements begin or end: drawings, scripts, buttons and the like
inside a paragraph leave it whole, and a button without an end is nothing.

Defined cases: a null or empty page has the text ""; unclosed and stray tags
end where HTML ends them; a page without containers gives all its text; of
elements with equal points the first is best; other columns play no part, and
repeated rows are read each; a page of any length is read as a whole, in memory
of a small multiple of its size; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, and words in class and id names.
_INLINE = frozenset("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mphantom semantics a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg annotation annotation-xml noscript object canvas audio video select datalist button".split())
_NEVER = frozenset("nav footer aside dialog menu head".split())
#: Of the elements passed over, those that hold others; the rest end at the first end tag.
_NESTED = frozenset("template svg noscript object canvas audio video select".split())
_FORMS = frozenset("form fieldset".split())
_CONTROLS = frozenset("input select textarea button".split())
_KEEPERS = frozenset("html body article main".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
_STRONG = re.compile("ad|ads|adv|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promos|promotion|comment|comments|commentlist|commentary|disqus|replies|respond|nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|footer|sidebar|share|sharing|social|related|recommended|newsletter|subscribe|subscription|cookie|cookies|consent|gdpr|popup|modal|overlay|pagination|pager|outbrain|taboola|skip|toolbar|login|signup|search|notice|notices|notification|alert|paywall|disclaimer|copyright")
#: Of these, what stands for links and controls, not for prose.
_LINKS = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs share sharing social related recommended pagination pager skip toolbar login signup search".split())
_WEAK = re.compile("header|masthead|banner|widget|tags|aside|side|rail|topbar|legal")
_GOOD = frozenset("article body content entry main post story text page hentry column".split())
#: What may stand beside such a word in a name without changing its sense.
_FILLER = _GOOD | frozenset("area articles bar blog bottom box block button buttons center col container feed form global group icon icons inner item items js left like link links list may module more news outer panel posts primary right row secondary section site slot stories title top ui unit wrap wrapper you also".split())
_WITHOUT = frozenset("has with no without".split())
#: What ends an element left open: the names that close it, and the names that stop the search.
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "option": ("option", "select")}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
_CELLS = frozenset(("td", "th"))

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"<]*+"|'[^'<]*+')[^>"']*+)*+[^>]*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

_LEAST_SHARE = 0.2
_LINKED = 0.6
#: Link text from which on, and text up to which, a name that says it in part is believed.
_NAMED_LINKED, _NAMED_SHORT = 0.4, 140
#: Text for each control that a form has around an article.
_FORM_TEXT = 200
#: What an element's own tag says: nothing, no article part if links say so, if links or brevity do, if it isn't all prose, by its name, always.
_FINE, _IF_LINKED, _IF_SLIGHT, _UNLESS_PROSE, _NAMED, _ALWAYS = range(6)


def _said(name: str, attributes: str, in_article: bool) -> int:
    if name in _NEVER:
        return _ALWAYS
    if not attributes.strip() or name in ("html", "body"):
        return _FINE
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")) or found.get("role", "").lower() in _ROLES:
        return _ALWAYS
    said = _FINE
    for one in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [p.lower() for p in _NAME_PART.findall(one)]
        if _WITHOUT.intersection(parts):
            continue
        strong = [p for p in parts if _STRONG.fullmatch(p)]
        weak = [] if _GOOD.intersection(parts) else [p for p in parts if _WEAK.fullmatch(p)]
        if strong and not (name in _KEEPERS and _GOOD.intersection(parts)) or weak and name not in _KEEPERS:
            wholly = all(p in strong or p in weak or p in _FILLER or p.isdigit() for p in parts)
            named = _UNLESS_PROSE if in_article and _LINKS.issuperset(strong) else _NAMED
            said = max(said, _IF_LINKED if in_article and not strong else named if wholly else _IF_SLIGHT)
    return said


class _Tree:
    """Elements by number in page order: names, parents, what their tags say, and how many controls they hold themselves."""

    def __init__(self, page: str):
        self.names, self.parents, self.said, self.controls = [""], [-1], [_FINE], [0]
        #: Blocks: element, text, characters in links, links.
        self.blocks: list[tuple[int, str, int, int]] = []
        self._stack, self._text, self._in_link, self._links = [0], [], False, [0, 0]
        #: Elements passed over that end nowhere after here.
        self._endless: set[str] = set()
        at, low = 0, None
        while at < len(page):
            found = _TAG.search(page, at)
            self._add(page[at : found.start()] if found else page[at:])
            if not found:
                break
            at = found.end()
            name = (found[2] or "").lower()
            if not name:
                continue
            if name in _CONTROLS and not found[1] and "hidden" not in found[3]:
                self.controls[self._stack[-1]] += 1
            if found[1]:
                self._close(name)
            elif name in _RAW and not found[3].endswith("/"):
                low = low if low is not None else page.lower()
                end = len(page) if name in self._endless else _end(low, name, at)
                if end == len(page):
                    self._endless.add(name)
                at = at if end == len(page) and name == "button" else end
            else:
                self._open(name, found[3])
        self._flush()

    def _add(self, text: str) -> None:
        if text:
            self._text.append(text)
            if self._in_link:
                self._links[0] += len(text)

    def _flush(self) -> None:
        if self._text:
            text = "".join(self._text)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                self.blocks.append((self._stack[-1], text, min(len(text), self._links[0]), self._links[1]))
        self._text, self._links = [], [0, 0]

    def _open(self, name: str, attributes: str) -> None:
        if name == "br" or name in _CELLS:
            self._add(" ")
            return
        if name in _INLINE:
            if name == "a":
                self._in_link = True
                self._links[1] += 1
            return
        if name in _VOID:
            if name == "hr":
                self._flush()
            return
        self._flush()
        self._in_link = False
        if self.names[self._stack[-1]] == "p":
            self._stack.pop()
        if name in _ENDS:
            closed, fence = _ENDS[name]
            for k in range(len(self._stack) - 1, 0, -1):
                if self.names[self._stack[k]] in closed:
                    del self._stack[k:]
                    break
                if self.names[self._stack[k]] in fence:
                    break
        around = self._stack[-1]
        in_article = any(self.names[s] in ("article", "main") for s in self._stack)
        self.names.append(name)
        self.parents.append(around)
        self.said.append(_ALWAYS if name == "header" and not in_article else _said(name, attributes, in_article))
        self.controls.append(0)
        self._stack.append(len(self.names) - 1)

    def _close(self, name: str) -> None:
        if name in _CELLS:
            self._add(" ")
        elif name in _INLINE:
            if name == "a":
                self._in_link = False
        elif name not in _VOID:
            for k in range(len(self._stack) - 1, 0, -1):
                if self.names[self._stack[k]] == name:
                    self._flush()
                    self._in_link = False
                    del self._stack[k:]
                    break
            else:
                if name == "p":  # a paragraph of its own; other stray end tags are nothing
                    self._flush()


def _end(page: str, name: str, at: int) -> int:
    """Where the end tag of an element that is passed over begins; the page's end if there is none."""
    if name in _NESTED:
        depth = 1
        for found in re.compile(f"<(/?){name}(?=[\\s/>])[^>]*").finditer(page, at):
            depth += -1 if found[1] else not found[0].endswith("/")
            if not depth:
                return found.start()
    else:
        end = page.find(f"</{name}", at)
        if end >= 0:
            return end
    return len(page)


def _reads(text: str, in_links: int) -> bool:
    """Whether a block is prose: hardly any links, and long or ended like a sentence."""
    return in_links < 0.25 * len(text) and (len(text) > 80 or text[-1] in ".!?。…")


def _around(tree: _Tree, element: int) -> Iterator[int]:
    while element >= 0:
        yield element
        element = tree.parents[element]


def main_text(page: str | None) -> str:
    """The article's blocks, joined by blank lines."""
    if not page:
        return ""
    tree = _Tree(page)
    n = len(tree.names)
    size, linked, links, controls, core = [0] * n, [0] * n, [0] * n, list(tree.controls), [x in ("main", "h1") for x in tree.names]
    prose = [0] * n
    for element, text, in_links, many in tree.blocks:
        size[element] += len(text)
        prose[element] += len(text) if _reads(text, in_links) else 0
        linked[element] += in_links
        links[element] += many
    for e in range(n - 1, 0, -1):  # what is inside comes later in the page
        around = tree.parents[e]
        for sums in (size, linked, links, controls, prose):
            sums[around] += sums[e]
        core[around] = core[around] or core[e]
    unwanted = [False] * n
    for e in range(1, n):
        said, name = tree.said[e], tree.names[e]
        many_links = linked[e] >= _NAMED_LINKED * size[e]
        own = said == _NAMED or said == _UNLESS_PROSE and not (not links[e] and 2 * prose[e] >= size[e]) or said == _IF_SLIGHT and (many_links or not prose[e] and size[e] < _NAMED_SHORT)
        own = said == _ALWAYS or said == _IF_LINKED and many_links or own and not (core[e] and 2 * size[e] >= size[0])
        own = own or name == "form" and size[e] < _FORM_TEXT * max(1, controls[e]) or name == "fieldset" and size[e] < _FORM_TEXT * controls[e]
        unwanted[e] = unwanted[tree.parents[e]] or own
    menus = {e for e in range(n) if tree.names[e] in ("ul", "ol", "dl", "table", "div", "section") and links[e] >= 2 and linked[e] >= _LINKED * size[e]}
    blocks = [b for b in tree.blocks if not unwanted[b[0]]]
    points, inside, kept_size, kept_prose = [0.0] * n, [0.0] * n, [0] * n, [0] * n
    for element, text, in_links, _ in blocks:
        density = in_links / len(text)
        worth = (1 + text.count(",") + text.count("，") + min(3.0, len(text) / 100)) * (1 - density) * (1 if len(text) >= 25 else len(text) / 50)
        holder = tree.parents[element] if tree.names[element] in ("p", "pre", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "dd", "dt", "figcaption") else element
        for level, e in enumerate(_around(tree, holder)):
            points[e] += worth if level == 0 else worth / 2 if level == 1 else worth / (3 * level)
        for e in _around(tree, element):
            inside[e] += worth
            kept_size[e] += len(text)
            kept_prose[e] += len(text) if _reads(text, in_links) else 0
    best = max(range(n), key=points.__getitem__)
    if not points[best]:
        return "\n\n".join(b[1] for b in blocks if not menus.intersection(_around(tree, b[0])))
    for wanted in ("article", "main"):
        outer = [e for e in _around(tree, best) if tree.names[e] == wanted]
        if outer:
            best = outer[-1]
            break
    kept = {best}
    if tree.names[best] not in ("", "html", "body"):
        for e in range(n):
            if tree.parents[e] == tree.parents[best] and not unwanted[e] and e not in menus and kept_size[e]:
                fair = inside[e] >= _LEAST_SHARE * inside[best]
                if tree.names[best] in _KEEPERS:
                    fair = tree.names[e] in _KEEPERS and (fair or 2 * kept_prose[e] >= kept_size[e])
                else:
                    fair = fair or 2 * kept_prose[e] >= kept_size[e] or re.fullmatch("h[1-6]", tree.names[e])
                if fair:
                    kept.add(e)
    if tree.names[best] in ("", "html", "body"):  # no container was found
        blocks = [b for b in blocks if not menus.intersection(_around(tree, b[0]))]
    return "\n\n".join(b[1] for b in blocks if kept.intersection(_around(tree, b[0])))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p.as_py()) for p in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, pyarrow.compute.utf8_length(texts).cast(pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
