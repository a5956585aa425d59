"""Main text of web pages by deducing each host's template.

A page is a sequence of markup tokens, told apart by element, class or id, and the structure they stand in, and of blocks
of text. Over the pages of a host each token has an occurrence vector (how often it is on each page), kept as a pair of
sums of page hashes, so that it is counted in parallel. Tokens with equal vectors form an equivalence class. Classes on
most pages are the template, of them the tokens whose start and end are both in the class (as both are told apart by the
elements they stand in, pairs nest). Texts on most pages at one place are the template's own, wherever and however long.
Copies of a page tell nothing about a template: a token must be on several different pages.

The template's elements nest into a tree, and the text that the host's pages hold below each of them, less links, tells where
its main slot is: from the root on, the child that holds half of the text or more, until the text is spread over several
children, a heading stands among them, or an article or main element is reached.

Extraction takes the main slot, or, where the template has none, article and main elements, and drops the template's texts
from it (not short ones amid varying texts) and what elements, roles and names mark as chrome in it. Pages with neither
lose the slots of template elements whose text over the host is mostly links, and chrome by marks (fixed lists). Where a
host has too few pages, the template of all pages together serves.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays as A
from graphloom.llm.sparkio import materialise
from graphloom.llm.urlrules import host_of

SLICE_BYTES = 4_000_000
MIN_PAGES = 5  # a host's own template needs as many
MIN_SHARE = 0.9  # of the host's pages hold a template token
ALL = ""  # stands for all hosts
LINKS = 1 << 61  # flips a bit of an element's token: a slot of links
SENTENCE = 5  # words
LONG_PATH = 2000  # characters
NEUTRAL, START, END, TEXT = 0, 1, 2, 3
HEADING_MARK, MAIN_MARK = 1, 2
DOMINANT = 0.5  # of an element's text is in the child that the main slot is looked for in

# What elements and names mean.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "select", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSED_BY_PEER = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul", "p"}
CHROME = {"head", "nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "video", "audio", "canvas"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}
CHROME_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search", "share", "sharing", "social", "comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "related", "recommended", "pagination", "pager", "toolbar", "skip", "copyright", "legal"}
#: In an article these names, like all ids, may be a section's own: there they mark chrome only where most text is links.
IN_ARTICLE = {"header", "discussion", "legal", "related", "recommended", "notice", "notices", "alert", "banner", "navigation", "search", "menu", "aside", "copyright", "respond", "reply", "replies", "login", "signup", "consent", "promotion", "overlay", "widget", "cookie", "cookies", "gdpr"}
WRAPPERS = {"form", "fieldset"}  # chrome that may also hold a whole page
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_CUT = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_NAME = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


def _names(attributes: str) -> tuple[str, set[str], set[str], bool, bool]:
    """A token's class and id as text, the chrome names among its classes and ids, and if its role is one of chrome or it is hidden."""
    if not attributes or attributes.isspace():
        return "", set(), set(), False, False
    label, classes, ids, role, hidden = [], set(), set(), False, False
    for key, *values in _NAME.findall(attributes):
        value, key = "".join(values).strip().lower(), key.lower()
        if key == "role":
            role = value in CHROME_ROLES
        elif key in ("hidden", "aria-hidden"):
            hidden |= key == "hidden" or value == "true"
        elif value:
            label.append(f"{key}={value}")
            (classes if key == "class" else ids).update(CHROME_NAMES.intersection(value.split()))
    return " ".join(label), classes, ids, role, hidden


class Page:
    """A page's tokens and texts in order, each with the structure it stands in.

    events: (name, key, element, kind, path of the element that starts or ends) of a token, or ("#", text, element);
    elements are numbered as they start, 0 is the page. chrome: whether an element holds no main text; main: whether it is in an article or main element.
    """

    def __init__(self, html: str):
        self.events: list[tuple] = []
        # Of each element: its parent, name, the names and other marks of chrome, and the lengths of its text and of links.
        self.parent, self.names, self.marks, self.length, self.linked = [0], [""], [(set(), set(), False, False)], [0], [0]
        self.keys, self.tags = [""], [""]  # its token and the names of the elements it is in
        stack: list[tuple[str, str, int, bool]] = []  # name, path, element, hidden
        top = none = ("", "", 0, False)
        pos, in_link = 0, False
        add, find = self.events.append, _TOKEN.search
        opened: dict[str, int] = {}  # how many elements of each name are in the stack
        last = html.rfind(">") + 1  # no token but a comment that nothing ends goes on beyond

        def text(part: str) -> None:
            add(("#", part, top[2]))
            if not top[3]:
                n = len(part.strip())
                self.length[top[2]] += n
                self.linked[top[2]] += n * in_link

        def close(i: int) -> None:
            for name, *_ in stack[i:]:
                opened[name] -= 1
            del stack[i:]

        while m := find(html, pos, last):
            start, stop = m.span()
            if start > pos:
                text(html[pos:start])
            pos = stop
            if stop == last and html.startswith("<!--", start) and not html.startswith("-->", stop - 3):
                pos = len(html)
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if name is None:  # comment or declaration
                continue
            name = name.lower()
            if name == "a":
                in_link = not closing
            if closing:
                ended = None
                if name not in VOID and opened.get(name):
                    for i in range(len(stack) - 1, -1, -1) if name not in INLINE else range(len(stack) - 1, max(len(stack) - 2, -1), -1):
                        if stack[i][0] == name:
                            ended = stack[i][1]
                            close(i)
                            break
                path = top[1] if ended is None else ended
                add(("/" + name, f"{path} /{name}", top[2], NEUTRAL if name in INLINE or name in VOID else END, f"{path} /" if ended is None else path))
                top = stack[-1] if stack else none
                continue
            if name in ENDS_P:
                for i in range(len(stack) - 1, max(len(stack) - 4, -1), -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
            peers = CLOSED_BY_PEER.get(name)
            if peers and stack and stack[-1][0] in peers:
                close(len(stack) - 1)
            top = stack[-1] if stack else none
            label, classes, ids, role, hidden = _names(attributes)
            key = f"{top[1]} {name} {label}" if label else f"{top[1]} {name}"
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, pos)
                pos = end.end() if end else len(html)
                add((name, key, top[2], NEUTRAL, ""))
                continue
            marked = hidden or role or bool(classes or ids)
            if name in VOID or attributes.endswith("/") or name in INLINE and not marked:
                add((name, key, top[2], NEUTRAL, ""))
                continue
            self.parent.append(top[2]), self.names.append(name), self.marks.append((classes, ids, role, hidden)), self.length.append(0), self.linked.append(0)
            path = top[1] if name in INLINE else _short(f"{top[1]}/{name}.{label}" if label else f"{top[1]}/{name}")
            top = (name, path, len(self.parent) - 1, top[3] or hidden)
            self.keys.append(key), self.tags.append(_short(self.tags[self.parent[-1]] + ("" if name in INLINE else "/" + name)))
            stack.append(top)
            opened[name] = opened.get(name, 0) + 1
            add((name, key, top[2], NEUTRAL if name in INLINE else START, path))
        tail = _CUT.sub("", html[pos:])
        if tail:
            text(tail)
        self.judge()

    def judge(self, slot: int | None = None) -> None:
        """Which elements are main and which are chrome. slot: the token of the host's main slot, if it has one.

        Without a slot, or on a page that lacks it, article and main elements are main. A name does not mark what holds
        most of the main text, or most text of a page without any, as chrome.
        """
        n, parent = len(self.parent), self.parent
        self.main, self.chrome = [False] * n, [False] * n
        self.roots = [i for i in range(1, n) if _hash(self.keys[i]) == slot] if slot is not None else []
        self.roots = self.roots or [i for i in range(1, n) if self.names[i] in MAIN]
        for i in self.roots:
            self.main[i] = True
        for i in range(1, n):
            self.main[i] = self.main[i] or self.main[parent[i]]
        length, linked = self.length[:], self.linked[:]
        article = [x * m for x, m in zip(length, self.main)]
        for i in range(n - 1, 0, -1):
            length[parent[i]] += length[i]
            linked[parent[i]] += linked[i]
            article[parent[i]] += article[i]
        self.below = [a - b for a, b in zip(length, linked)]  # text in and below each element, less that of links
        for i in range(1, n):
            name, (classes, ids, role, hidden), within = self.names[i], self.marks[i], self.main[parent[i]]
            if self.chrome[parent[i]] or hidden:
                self.chrome[i] = True
                continue
            if within and i not in self.roots and name not in MAIN:
                holds, links = False, 2 * linked[i] > length[i]
                named = bool(classes - IN_ARTICLE) or links and bool(classes or ids)
            else:
                holds = 2 * article[i] >= article[0] if article[0] else 2 * length[i] > length[0] and 2 * linked[i] <= length[i]
                named = bool(classes or ids) and name not in ("html", "body")
            tag = role or name in CHROME and not (within and name == "header")
            self.chrome[i] = named and not holds or tag and not (holds and name in WRAPPERS)

    def blocks(self) -> list[tuple[int, list[str]]]:
        """The element and parts of each block that may be main text: in what is main where the page has that, else in no chrome."""
        self.has_main = any(not self.chrome[i] for i in self.roots)
        out, now, at = [], [], 0
        for e in self.events:
            if e[0] == "#":
                if not self.chrome[e[2]] and (self.main[e[2]] or not self.has_main):
                    at = at if now else e[2]
                    now.append(e[1])
            elif e[0] == "br":
                now.append(" ") if now else None
            elif now and e[0].lstrip("/") not in INLINE:
                out.append((at, now))
                now = []
        return out + [(at, now)] if now else out

    def place(self, element: int, text: str) -> int:
        """The token of a text: what it says and the names of the elements around it."""
        return _hash(f"{self.tags[element]} # {text}")

    def tokens(self) -> list[tuple[int, ...]]:
        """Token, kind, pair (equal for an element's start and end), and of a start: the lengths of its own text and of its
        links, of the text below it, the token of the element around it, and its mark."""
        out, none = [], (0, 0, 0, 0, 0)
        for e in self.events:
            if e[0] != "#":
                about = none
                if e[3] == START:
                    i = e[2]
                    mark = MAIN_MARK if e[0] in MAIN else HEADING_MARK if e[0] in HEADINGS else 0
                    about = (self.length[i], self.linked[i], self.below[i], _hash(self.keys[self.parent[i]]), mark)
                out.append((_hash(e[1]), e[3], _hash(e[4]) if e[4] else 0, *about))
        for at, parts in self.blocks():
            text = _plain("".join(parts))
            if text:
                out.append((self.place(at, text), TEXT, 0, *none))
            if len(parts) > 1:
                out.extend((self.place(at, t), TEXT, 0, *none) for t in map(_plain, parts) if " " in t)
        return out

    def text(self, template: set[int] | None, slot: int | None = None) -> str:
        """The blocks of main text, one a line, less the template's texts, whole or as parts, and its slots of links.

        In an article a constant text of fewer than SENTENCE words stays where its kind of element holds others that
        vary: articles of a host may share a heading or a short line.
        """
        if slot is not None:
            self.judge(slot)
        blocks = [(at, parts, _plain("".join(parts))) for at, parts in self.blocks()]
        if not template:
            return "\n".join(text for _, _, text in blocks if text)
        constant = [self.place(at, text) in template for at, _, text in blocks]
        varying = {self.keys[at] for (at, _, text), c in zip(blocks, constant) if text and not c}
        least = SENTENCE if self.has_main else 2
        out: list[str] = []
        for (at, parts, text), c in zip(blocks, constant):
            if c and not (self.has_main and self.keys[at] in varying and text.count(" ") + 1 < SENTENCE):
                continue
            if not self.has_main and _hash(self.keys[at]) ^ LINKS in template:
                continue
            if len(parts) > 1 and not c:
                text = _plain("".join(" " if (t := _plain(p)).count(" ") + 1 >= least and self.place(at, t) in template else p for p in parts))
            if text:
                out.append(text)
        return "\n".join(out)


def _short(path: str) -> str:
    """A path, or its hash if it is long, so that deep pages take no more than their length."""
    return path if len(path) <= LONG_PATH else f"#{_hash(path):x}"


def _plain(text: str) -> str:
    return " ".join(unescape(text).split())


def _hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key) >> 1


def main_slot(tokens: list[dict]) -> int | None:
    """The element token of a template in which most text of the pages lies; None where that is all of a page or nowhere.

    tokens: of elements that each page has once: token, parent, text (below it on all pages), length (its own) and mark.
    """
    known = {t["token"]: t for t in tokens}
    inside: dict[int, list[dict]] = {}
    for t in tokens:
        inside.setdefault(t["parent"] if t["parent"] in known and t["parent"] != t["token"] else 0, []).append(t)
    best = lambda x: max(inside.get(x, []), key=lambda t: (t["text"], -t["token"]), default=None)
    root = at = best(0)
    while at and at["mark"] != MAIN_MARK:
        child = best(at["token"])
        spread = child is None or child["text"] < DOMINANT * at["text"]
        if spread or 2 * child["length"] > child["text"] or any(t["mark"] == HEADING_MARK for t in inside[at["token"]]):
            break
        at = child
    return at["token"] if at and at["text"] and (at["text"] < 0.95 * root["text"] or at["mark"] == MAIN_MARK) else None


def deduce(pages: DataFrame) -> DataFrame:
    """Templates from page rows (host, html): host, template (hashes of the tokens of valid classes and of constant texts)
    and slot (the token of the element that holds the main text, if there is one).

    A null html is an empty page; an empty table, or hosts without a token on enough different pages, give no template.
    Ties between elements go to the smaller token. A very long page counts like any other.

    Only counts by host and token are shuffled, summed in each task first, so a host with most pages spreads. Different
    pages are told by a bit of 64 that each sets.
    """

    def count(batches):
        for b in A.slices(batches, "html", SLICE_BYTES):
            found: dict[tuple[str, int], list[int]] = {}
            for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                seen: dict[int, list[int]] = {0: [1, NEUTRAL, 0, 0, 0, 0, 0, 0]}  # the page itself
                for h, kind, pair, length, linked, below, around, mark in Page(html or "").tokens():
                    x = seen.get(h)
                    if x is None:
                        seen[h] = [1, kind, pair, length, linked, below, around, mark]
                    else:
                        x[0] += 1
                        x[3] += length
                        x[4] += linked
                        x[5] += below
                page = xxhash.xxh3_64_intdigest(html or "")
                bit = 1 << (page & 63)
                for h, (n, kind, pair, length, linked, below, around, mark) in seen.items():
                    v = xxhash.xxh3_64_intdigest(n.to_bytes(8, "little"), page)
                    for at in (host, ALL) if host else (ALL,):
                        x = found.setdefault((at, h), [0, 0, 0, 0, 0, 0, kind, pair, 0, 0, around, mark])
                        x[0] += v & 0x7FFFFFFF
                        x[1] += v >> 33
                        x[2] += 1
                        x[3] |= bit
                        x[4] += length
                        x[5] += linked
                        x[8] += below
                        x[9] += n
            for x in found.values():
                x[3] -= (x[3] >> 63) << 64
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()), *(pa.array([x[i] for x in found.values()], pa.int64()) for i in range(12))], ["host", "token", *names])

    names = ("v1", "v2", "pages", "bits", "length", "linked", "kind", "pair", "text", "times", "parent", "mark")
    counts = pages.mapInArrow(count, "host string, token long, " + ", ".join(f"{c} long" for c in names))
    sums = [F.sum(c).alias(c) for c in ("v1", "v2", "pages", "length", "linked", "text", "times")]
    counts = counts.groupBy("host", "token").agg(*sums, F.bit_or("bits").alias("bits"), *[F.min(c).alias(c) for c in ("kind", "pair", "parent", "mark")])
    several = (F.col("pages") >= MIN_PAGES) & (F.bit_count("bits") >= MIN_PAGES - 1)  # two of few pages may share a bit
    once = (F.col("kind") == START) & (F.col("times") == F.col("pages"))
    token = F.struct("token", "kind", "pair", ((F.col("kind") == START) & (2 * F.col("linked") > F.col("length"))).alias("links"), once.alias("once"), "parent", "text", "length", "mark")
    classes = counts.where(several).groupBy("host", "v1", "v2", "pages").agg(F.collect_set(token).alias("tokens"))

    def pairs(c, kind):
        return F.transform(F.filter(c["tokens"], lambda t: t["kind"] == kind), lambda t: t["pair"])

    def valid(c):
        both = F.array_intersect(pairs(c, START), pairs(c, END))
        return F.filter(c["tokens"], lambda t: (t["kind"] == TEXT) | (F.size(c["tokens"]) > 1) & ((t["kind"] == NEUTRAL) | F.array_contains(both, t["pair"])))

    by_host = classes.groupBy("host").agg(F.max("pages").alias("all"), F.collect_list(F.struct("pages", "tokens")).alias("classes"))
    most = F.filter("classes", lambda c: c["pages"] >= MIN_SHARE * F.col("all"))
    tokens = by_host.select("host", F.flatten(F.transform(most, valid)).alias("tokens"))
    links = F.transform(F.filter("tokens", lambda t: t["links"]), lambda t: t["token"].bitwiseXOR(F.lit(LINKS)))
    elements = F.transform(F.filter("tokens", lambda t: t["once"]), lambda t: F.struct(*[t[c].alias(c) for c in ("token", "parent", "text", "length", "mark")]))

    def choose(batches):
        for b in batches:
            slots = [main_slot(t or []) for t in b.column("elements").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("template"), pa.array(slots, pa.int64())], ["host", "template", "slot"])

    found = tokens.select("host", F.concat(F.transform("tokens", lambda t: t["token"]), links).alias("template"), elements.alias("elements"))
    return found.mapInArrow(choose, "host string, template array<long>, slot long")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every whole page.

    A null html is empty and gives an empty text. A page takes time and memory in proportion to its length, however long
    it is and however deep its elements nest. Pages of a null URL or one without a host use the template of all
    pages. Repeated rows give equal rows; null ids stay; other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    templates = materialise(deduce(rows.select("host", "html")), "templates")
    general = templates.where(F.col("host") == ALL).head()
    general = (set(general["template"]), general["slot"]) if general else (None, None)  # one page's tokens at most
    joined = rows.join(templates.where(F.col("host") != ALL), "host", "left").select("page_id", "url", "html", "host", "template", "slot")

    def run(batches):
        known: dict[str, tuple[set[int], int | None]] = {}
        for b in A.slices(batches, "html", SLICE_BYTES):
            texts = []
            for host, html, template, slot in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("template"), b.column("slot").to_pylist()):
                if not template.is_valid:
                    use = general
                else:
                    use = known.get(host)
                    if use is None:
                        if len(known) > 1000:
                            known.clear()
                        use = known[host] = (set(template.as_py()), slot)
                texts.append(Page(html or "").text(*use))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
