"""Main text of web pages by scoring the tree.

Every paragraph earns points for its length and commas and passes them to its ancestors, less the further up they are;
a container keeps the share of its points that is not link text. The best container and the siblings that look like it
are the article; menus, forms, adverts and comments inside are left out. A class that names such a part is believed only
where enough text stands outside of it; otherwise it just lowers the score.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.llm.common import frame, text_of

# Elements that run along in a line of text; all others end a block of text where they begin and end.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter noscript "
                   "output picture progress q rp rt ruby s samp script small source span strike strong style sub sup svg "
                   "template textarea time track tt u var video audio canvas button input select option object embed math "
                   "wbr map area link meta base".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea input "
                    "iframe object embed svg canvas menu dialog audio video map".split())
# Names in class, id and role values that mark parts which are no article text.
MARKED = frozenset("ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors banner promo "
                   "promotion sidebar aside nav navbar navigation menu menubar breadcrumb breadcrumbs footer cookie cookies "
                   "consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup comment comments "
                   "commentlist disqus respond reply replies share sharing social related recommended recommendations widget "
                   "widgets masthead toolbar pagination pager login search searchbox complementary contentinfo".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
TOP = frozenset("header masthead siteheader topbar banner".split())
# Words beside such a name that say only where or what kind of box it is.
PLAIN = frozenset("area bar block body bottom box button buttons col column container form group header inner item items left "
                  "link links list main outer page panel policy post posts right section site slot text title top unit user wrap "
                  "wrapper wp".split())
OUTSIDE = 0.25  # share of a marked part's text that must stand outside of marked parts, else the part stays
DOUBT = 0.2  # weight of the score of a marked part that stays
HEADINGS = frozenset("h1 h2 h3".split())
# What closes a paragraph or an item that was left open.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 "
                   "h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div main aside nav header footer blockquote form".split())
LEAST = 25  # characters of a paragraph that earns points


def names(value: str, known: frozenset) -> frozenset:
    """The ``known`` names among the blank-separated tokens of ``value``.

    A token counts whole or as names and plain words only: ``post-comments`` is ``comments``, ``has-sidebar`` is nothing.
    """
    found: set[str] = set()
    for token in value.split():
        parts = re.findall(r"[a-z]+", re.sub(r"[0-9]+x[0-9]+", " ", re.sub(r"([a-z])([A-Z])", r"\1 \2", token)).lower())
        hit = known.intersection(parts)
        if hit and all(w in known or w in PLAIN for w in parts):
            found |= hit
    return frozenset(found)


class Tree(HTMLParser):
    """Nodes in page order (a parent comes before its children) and the text and block ends between them.

    The open elements are also kept by name, so no tag looks through all of them.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.words = ["#root"], [-1], [frozenset()]
        self.open, self.events = [0], []
        self.places: dict[str, list[int]] = {}  # where in ``open`` the elements of a name are
        self.boxes: list[int] = []  # where those are that are not running text

    def parse_comment(self, i, report=True):
        # A comment without an end reaches to the end of the page.
        if self.rawdata.find("-->", i + 4) < 0:
            return len(self.rawdata)
        return super().parse_comment(i, report)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close(("p",), SCOPES)
        if tag in ENDS_SELF:
            self._close(ENDS_SELF[tag], SCOPES if tag not in ("tr", "td", "th") else ("table",))
        node = len(self.tags)
        values = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.words.append(names(values, MARKED | TOP) if values else frozenset())
        if tag == "br":
            self.events.append((self.open[-1], " "))
        elif tag not in INLINE:
            self.events.append((node, None))
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            if tag not in INLINE:
                self.boxes.append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.events.append((self.open[-1], " "))
            return
        depth = self._last((tag,))
        # An end tag of running text does not reach out of the block it stands in.
        if depth and not (tag in INLINE and self.boxes and self.boxes[-1] > depth):
            self._cut(depth)

    def handle_data(self, data):
        self.events.append((self.open[-1], data))

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])

    def _last(self, tags):
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close(self, tags, scopes):
        depth = self._last(tags)
        if depth and depth >= self._last(scopes):
            self._cut(depth)

    def _cut(self, depth):
        while len(self.open) > depth:
            node = self.open.pop()
            self.places[self.tags[node]].pop()
            if self.tags[node] not in INLINE:
                self.boxes.pop()
                self.events.append((node, None))


def _blocks(tree: Tree, kept: list[bool]) -> list[tuple[int, str, int]]:
    """``(block element, text, characters of link text)`` of all kept text, white space made one blank."""
    linked, holder = [False], [0]
    for node in range(1, len(tree.tags)):
        up = tree.parents[node]
        linked.append(linked[up] or tree.tags[node] == "a")
        holder.append(holder[up] if tree.tags[node] in INLINE else node)
    out, parts, links, owner = [], [], 0, 0
    for node, data in [*tree.events, (0, None)]:
        if data is not None:
            if kept[node]:
                if not parts:
                    owner = holder[node]
                parts.append(data)
                links += len(data.strip()) if linked[node] else 0
        elif parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((owner, text, min(links, len(text))))
            parts, links = [], 0
    return out


def _parts(tree: Tree) -> tuple[list[bool], list[bool]]:
    """Per node: does it stay, and does its class name a part that is no article.

    Marked parts go where the text outside of all of them is a quarter of their own or more (comments: where a paragraph
    stands outside) and no unmarked article lies in them. Parts are judged from the root down; the text of one that stays
    counts as outside for those after it.
    """
    tags, parents, words = tree.tags, tree.parents, tree.words
    n = len(tags)
    inside, kept, marked, comment = [False] * n, [True] * n, [False] * n, [False] * n
    whole = [t in ("html", "body", "main", "#root") for t in tags]
    for i in range(1, n):
        up = parents[i]
        inside[i] = inside[up] or tags[i] in ("article", "main")
        kept[i] = kept[up] and tags[i] not in DROPPED and (inside[i] or tags[i] != "header")
        comment[i] = not whole[i] and bool(words[i] & COMMENTS)
        marked[i] = comment[i] or not whole[i] and tags[i] != "article" and (
            bool(words[i] & MARKED) or not inside[i] and bool(words[i] & TOP))
    if not any(marked):
        return kept, marked
    chars, outside, article = [0] * n, [0] * n, [False] * n
    for node, text, linked in _blocks(tree, kept):
        chars[node] += len(text) - linked
        outside[node] += len(text) - linked
    for i in range(n - 1, 0, -1):
        up = parents[i]
        chars[up] += chars[i]
        outside[up] += 0 if marked[i] else outside[i]
        article[i] = article[i] or not marked[i] and tags[i] in ("article", "main")
        article[up] = article[up] or article[i] and not marked[i]
    rest = outside[0]
    for i in range(1, n):
        kept[i] = kept[i] and kept[parents[i]]
        if kept[i] and marked[i]:
            enough = rest >= LEAST if comment[i] else rest >= OUTSIDE * chars[i]
            if enough and not article[i]:
                kept[i] = False
            else:
                rest += outside[i]
    return kept, marked


def main_text(html: str) -> str:
    """The article of a page: its blocks in page order with an empty line between them; empty if there is none."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    tags, parents, words = tree.tags, tree.parents, tree.words
    n = len(tags)
    kept, marked = _parts(tree)
    blocks = _blocks(tree, kept)
    if not blocks:
        return ""
    points, chars, links = [0.0] * n, [0] * n, [0] * n
    for node, text, linked in blocks:
        chars[node] += len(text)
        links[node] += linked
        if len(text) < LEAST:
            continue
        worth = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        at, share = (parents[node] if tags[node] in PARAGRAPHS and node else node), 1
        while at >= 0 and share <= 4:
            points[at] += worth / share
            at, share = parents[at], share * 2
    for i in range(n - 1, 0, -1):
        chars[parents[i]] += chars[i]
        links[parents[i]] += links[i]
    score = [points[i] * (1 - links[i] / chars[i]) * (DOUBT if marked[i] else 1) if chars[i] else 0.0 for i in range(n)]
    best = max(range(n), key=lambda i: (score[i], -i))
    if score[best] <= 0:  # short blocks only: the article element, else the page
        best = next((i for i in range(n) if tags[i] in ("article", "main") and chars[i]), 0)
    at = best
    while at > 0 and tags[at] not in ("article", "main"):
        at = parents[at]
    if at > 0:
        best = at
    ends = {}
    for node, text, linked in blocks:
        if tags[node] == "p" and not linked:
            ends[node] = text
    chosen = [False] * n
    chosen[best] = True
    bar = max(5.0, 0.2 * score[best])
    for i in range(1, n):
        if i == best or parents[i] != parents[best] or not kept[i] or tags[best] in ("main", "body", "html", "#root"):
            continue
        if tags[best] == "article":  # an article in parts
            chosen[i] = tags[i] == "article" and not marked[i] and score[i] > 0 and score[i] >= 0.2 * score[best]
            continue
        density = links[i] / chars[i] if chars[i] else 1.0
        if score[i] >= bar or tags[i] == "p" and density < 0.25 and chars[i] >= 80 or tags[i] in HEADINGS and i < best:
            chosen[i] = True
        elif i in ends and ends[i].rstrip("\"'»”’)")[-1:] in set(".!?…。"):
            chosen[i] = True  # a short paragraph that is a sentence
    for i in range(1, n):
        chosen[i] = kept[i] and (chosen[i] or chosen[parents[i]])
        # A list or box of links inside the article is a menu.
        if chosen[i] and i != best and tags[i] in ("ul", "ol", "div", "table", "section") and chars[i] and links[i] / chars[i] > 0.8 \
                and links[i] > 20:
            chosen[i] = False
            kept[i] = False
        elif not kept[parents[i]]:
            kept[i] = chosen[i] = False
    return "\n\n".join(text for _, text, _ in _blocks(tree, chosen))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text`` for every row, in place: whole pages are parsed and nothing is shuffled.

    A null page is the empty one and has the empty text, like any page without an article. Repeated rows are answered
    once each; other columns are left out.
    """
    rows = pages.select(F.col(id_col), F.col(url_col), text_of(html_col).alias("_html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        for batch in batches:
            yield frame({id_col: batch[id_col], url_col: batch[url_col], "text": [main_text(h) for h in batch["_html"]]})

    return rows.mapInPandas(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string")
