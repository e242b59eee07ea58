"""Main text of hand-made pages of several layouts, and of odd ones."""

from __future__ import annotations

import html as entities
import random

import pytest

from marlstone.llm import html

PROSE = [f"This is paragraph number {i}, which has commas, a verb, and some more words than a menu entry would have." for i in range(6)]
P = "".join(f"<p>{t}</p>" for t in PROSE)
TEXT = "\n\n".join(PROSE)
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li><li><a href=/c>Contact</a></li></ul>"

LAYOUTS = {
    "a form around the page": f"<body><form action=/x><input type=hidden name=v>{MENU}<div id=main><h1>T</h1>{P}</div><input name=q></form></body>",
    "class names": f"<body><div class='sidebar'>{MENU}<p>Side, with text, and commas, and more.</p></div><div class='content'><h1>T</h1>{P}</div><div id='comments'><p>Great, really, a very, very good post, thank you.</p></div></body>",
    "a layout class on the wrapper": f"<body><div class='page sidebar-right'><nav>{MENU}</nav><h1>T</h1>{P}</div></body>",
    "article and main": f"<body><header><h1>Site</h1>{MENU}</header><main><article><header><h1>T</h1></header>{P}</article></main><aside><p>Other, quite other, things, here.</p></aside><footer>(c) us</footer></body>",
    "tables for layout": f"<body><table><tr><td>{MENU}</td></tr></table><table><tr><td><h1>T</h1>{P}</td></tr></table></body>",
    "siblings of the container": f"<body>{MENU}<div><h1>T</h1></div><div><div><h1>T</h1>{P}</div></div></body>",
    "a header in the article": f"<body><article><div class=header><h1>T</h1></div>{P}</article></body>",
    "hidden parts": f"<body><div><h1>T</h1>{P}<p style='display: none'>no</p><div hidden>no</div><script>no</script><style>no</style></div></body>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    got = html.main_text(LAYOUTS[name])
    assert got in ("T\n\n" + TEXT, "T\n\nT\n\n" + TEXT), got


def test_what_is_in_the_article_stays():
    references = "<ul><li><a href=/1>First reference</a></li><li><a href=/2>Second reference</a></li><li><a href=/3>Third</a></li></ul>"
    got = html.main_text(f"<body><nav>{MENU}</nav><article><h1>T</h1>{P}<h2>Works cited</h2>{references}</article></body>")
    assert got == f"T\n\n{TEXT}\n\nWorks cited\n\nFirst reference\n\nSecond reference\n\nThird"
    related = f"<section class=related-work><h2>Related work</h2>{P}</section>"
    assert html.main_text(f"<body><article><h1>T</h1>{P}{related}</article></body>") == f"T\n\n{TEXT}\n\nRelated work\n\n{TEXT}"
    fields = "<fieldset><legend>Note</legend>A field set without any controls holds plain text.</fieldset>"
    assert html.main_text(f"<body><article>{P}{fields}</article></body>") == f"{TEXT}\n\nNote\n\nA field set without any controls holds plain text."
    sums = "<p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is, of course, the whole of it.</p>"
    assert html.main_text(f"<body><article>{P}{sums}</article></body>") == f"{TEXT}\n\nThe sum a+b is, of course, the whole of it."


def test_what_is_no_part_of_it_goes():
    for extra in (
        "<form><label>Your name, please</label><input name=a><input name=b><button>Send</button></form>",
        "<div class=related-posts><a href=/1>One post</a> <a href=/2>Another post</a></div>",
        "<div class=ad>Buy, buy, buy, now, and here, and get, at once, some more of it.</div>",
        "<section id=comments><p>First, I think, this is, all in all, a good, a very good text.</p></section>",
        "<div class='cookie-notice'><p>We use cookies, many, many of them, for you, and for us.</p></div>",
        "<div role=search>Search, and find, and search</div>",
    ):
        assert html.main_text(f"<body><article><h1>T</h1>{P}{extra}</article></body>") == f"T\n\n{TEXT}", extra
        assert html.main_text(f"<body><div><h1>T</h1>{P}</div>{extra}</body>") == f"T\n\n{TEXT}", extra


def test_random_articles_come_back_whole():
    """Any article of paragraphs, lists and headings, with references and inline marks, between boilerplate."""
    rng = random.Random(11)
    words = "some words & <others> with “quotes”, commas, and é or ü more".split()
    for _ in range(60):
        blocks, parts = [], []
        for _ in range(rng.randint(3, 12)):
            text = " ".join(rng.choice(words) for _ in range(rng.randint(8, 60))) + "."
            raw = entities.escape(text).replace(" ", rng.choice([" ", "\n  ", "\t"]))
            first = raw.split("&", 1)[0].split(" ", 1)[0]
            raw = raw.replace(first, f"<b>{first}</b>", 1) if rng.random() < 0.3 and first.isalpha() else raw
            blocks.append(text)
            parts.append(rng.choice(["<p>{}</p>", "<p>{}", "<ul><li>{}</ul>", "<blockquote><p>{}</p></blockquote>", "<div><p>{}</p></div>"]).format(raw))
        box = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>"])
        page = f"<html><body><nav>{MENU}</nav><div class=ad>Buy, now.</div>{box.format(''.join(parts))}<footer>us, and others, here</footer></body></html>"
        assert html.main_text(page) == "\n\n".join(blocks)


def test_odd_tables_of_pages(spark):
    rows = [(1, "u", LAYOUTS["class names"], "x"), (1, "u", LAYOUTS["class names"], "x"), (None, None, None, None), (3, "v", "", "y"), (4, "w", "<p>" + "word, " * 200_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extracted(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 3 + len(TEXT)), (1, 3 + len(TEXT)), (3, 0), (4, 6 * 200_000 - 1)]
    assert html.extracted(pages.limit(0)).count() == 0
    tied = "<div><p>One text, of a certain length, with commas.</p></div><section><p>Two text, of a certain length, with commas.</p></section>"
    assert html.main_text(f"<body>{tied}</body>") == "One text, of a certain length, with commas.\n\nTwo text, of a certain length, with commas."


LONG = "This paragraph is long, has commas, and says, at some length, what there is to say about its matter, so that it counts."


@pytest.mark.parametrize(
    "inside",
    ["<svg><path d='x'/></svg>", "<svg><svg></svg>no</svg>", "<script>no</script>", "<style>no</style>", "<noscript><img src=no></noscript>", "<button>no</button>", "<button>", "</svg>", "</div>", "<select><option>no</select>"],
)
def test_a_paragraph_with_inline_elements_is_one_block(inside):
    page = f"<body><article><h1>T</h1>{P}<p>Before the icon {inside} after the icon.</p></article></body>"
    assert html.main_text(page) == f"T\n\n{TEXT}\n\nBefore the icon after the icon."


def test_parts_of_a_container_at_any_depth():
    page = f"<body><div id=main><section><h2>One</h2>{P}</section><section><h2>Two</h2><div><div>{P}</div></div></section></div></body>"
    assert html.main_text(page) == f"One\n\n{TEXT}\n\nTwo\n\n{TEXT}"
    assert html.main_text(f"<body><article>{P}</article><article><div>{P}</div></article></body>") == f"{TEXT}\n\n{TEXT}"
    assert html.main_text(f"<body><main>{P}</main><div><p>{LONG}</p></div></body>") == TEXT


def test_names_that_say_it_in_part():
    assert html.main_text("<body><div class='search-engine-history'><h1>History</h1><p>A short article.</p></div></body>") == "History\n\nA short article."
    assert html.main_text("<body><div class='menu-of-the-day'><h1>Menu</h1><p>Soup and bread.</p></div></body>") == "Menu\n\nSoup and bread."
    assert html.main_text(f"<body><article>{P}<div class='related-work'><h2>Related work</h2><p>Others did it.</p></div></article></body>") == f"{TEXT}\n\nRelated work\n\nOthers did it."
    social = "Social matters are of great weight to all people, and to each. " * 4
    assert html.main_text(f"<body><article>{P}<div class=social><p>{social}</p></div></article></body>") == f"{TEXT}\n\n{social.strip()}"
    assert html.main_text(f"<body><article>{P}<div class=social><a href=/1>Share</a> <a href=/2>Send</a></div></article></body>") == TEXT
    for name in ("notice", "alert", "site-notice", "disclaimer"):
        assert html.main_text(f"<body><article>{P}<div class='{name}'><p>This site, as all others do, uses cookies.</p></div></article></body>") == TEXT
    assert html.main_text(f"<body><article>{P}<div class='post-share-count'>12 shares</div></article></body>") == TEXT


class Plain:
    """A second scorer for pages of nested div and section elements with p and a: by recursion, from the rules' wording."""

    def __init__(self, page):
        from html.parser import HTMLParser

        root, stack = {"name": "", "kids": []}, []
        stack.append(root)

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                node = {"name": tag, "kids": []}
                stack[-1]["kids"].append(node)
                stack.append(node)

            def handle_endtag(self, tag):
                stack.pop()

            def handle_data(self, data):
                stack[-1]["kids"].append(data)

        Reader().feed(page)
        self.root, self.points = root, {}

    def text(self, node, links=False):
        out = ""
        for kid in node["kids"]:
            out += kid if isinstance(kid, str) and (not links or node["name"] == "a") else self.text(kid, links) if isinstance(kid, dict) else ""
        return out

    def blocks(self, node, around=()):
        if node["name"] == "p":
            words = " ".join(self.text(node).split())
            return [(words, min(len(words), len(self.text(node, True))), around)] if words else []
        return [b for kid in node["kids"] if isinstance(kid, dict) for b in self.blocks(kid, (*around, node))]

    def main_text(self):
        points, inside, size, linked, prose, links = ({} for _ in range(6))
        blocks = self.blocks(self.root)
        for words, in_links, around in blocks:
            worth = (1 + words.count(",") + min(3, len(words) / 100)) * (1 - in_links / len(words)) * min(1, len(words) / 50 if len(words) < 25 else 1)
            for level, node in enumerate(reversed(around)):
                key = id(node)
                points[key] = points.get(key, 0) + worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
                inside[key], size[key], linked[key] = inside.get(key, 0) + worth, size.get(key, 0) + len(words), linked.get(key, 0) + in_links
                links[key] = links.get(key, 0) + (in_links > 0)
                prose[key] = prose.get(key, 0) + (len(words) if in_links < 0.25 * len(words) and (len(words) > 80 or words[-1] == ".") else 0)
        order = [self.root]
        for node in order:
            node.setdefault("up", None)
            for kid in node["kids"]:
                if isinstance(kid, dict):
                    kid["up"] = node
        walk = lambda node: [node, *(x for kid in node["kids"] if isinstance(kid, dict) and kid["name"] not in ("p", "a") for x in walk(kid))]
        nodes = walk(self.root)
        for node in nodes:
            for kid in node["kids"]:
                if isinstance(kid, dict):
                    kid["up"] = node
        best = max(nodes, key=lambda x: points.get(id(x), 0))
        menu = lambda x: links.get(id(x), 0) >= 2 and linked[id(x)] >= 0.6 * size[id(x)]
        if best["name"] in ("", "body"):
            return "\n\n".join(w for w, _, around in blocks if not any(menu(a) for a in around if a["name"] in ("div", "section")))
        kept = {id(best)}
        for kid in best["up"]["kids"]:
            if isinstance(kid, dict):
                found = self.blocks(kid, ())
                of = sum(len(b[0]) for b in found)
                reads = sum(len(w) for w, n, _ in found if n < 0.25 * len(w) and (len(w) > 80 or w[-1] == "."))
                if of and not (kid["name"] != "p" and menu(kid)) and (inside.get(id(kid), 0) >= 0.2 * inside[id(best)] and kid["name"] != "p" or 2 * reads >= of or kid["name"] == "p" and self.worth(found) >= 0.2 * inside[id(best)]):
                    kept.add(id(kid))
        self.kept = kept
        return "\n\n".join(self.chosen(self.root, False))

    def worth(self, found):
        return sum((1 + w.count(",") + min(3, len(w) / 100)) * (1 - n / len(w)) * min(1, len(w) / 50 if len(w) < 25 else 1) for w, n, _ in found)

    def chosen(self, node, inside):
        inside = inside or id(node) in self.kept
        if node["name"] == "p":
            words = " ".join(self.text(node).split())
            return [words] if inside and words else []
        return [w for kid in node["kids"] if isinstance(kid, dict) for w in self.chosen(kid, inside)]


def test_random_pages_against_a_second_scorer():
    rng = random.Random(11)

    def block():
        words = " ".join(rng.choice(["word", "other,", "thing", "and", "longer", "so,"]) for _ in range(rng.randint(1, 30)))
        kind = rng.random()
        return f"<p><a>{words}</a></p>" if kind < 0.25 else f"<p>{words} <a>see</a> it.</p>" if kind < 0.4 else f"<p>{words}.</p>"

    def element(depth):
        name = rng.choice(["div", "section"])
        return f"<{name}>" + "".join(element(depth + 1) if depth < 3 and rng.random() < 0.5 else block() for _ in range(rng.randint(1, 4))) + f"</{name}>"

    for _ in range(400):
        page = "<body>" + "".join(element(0) for _ in range(rng.randint(1, 4))) + "</body>"
        assert html.main_text(page) == Plain(page).main_text(), page
