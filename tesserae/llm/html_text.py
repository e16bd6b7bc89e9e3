"""Main text of HTML pages by consensus paths of their hosts.

First pass: a page's containers are scored by the text they hold outside links and cut into regions: a container
with text of its own, or one that is marked as an article, is one region; one that only lays out others is cut
into these. Each page votes for the generalised tag-class paths of its regions with the share of its text that
each holds, and votes are averaged by host and path in Spark. Second pass: a page that has regions on several
paths takes the path that its host's pages and its own text speak for most, with what belongs to it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import sqrt

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import save

#: A tag without ``<`` in it and with ``<`` and ``>`` in no quoted value; others go by ``_ATTRIBUTES``. No pattern looks back.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_NAME_ONLY = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTES = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:([\"'])|([^\s>]*+)))?+)")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_COMMENT_END = re.compile(r"--!?>")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|\d+")
_DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Elements that never hold article text, and roles that mark such elements.
DROP = frozenset("head nav header footer aside menu dialog button select option datalist fieldset label legend input script style textarea title noscript iframe noembed noframes template svg math canvas audio video object".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Words in a class or id that cast doubt on an element wherever they stand in it, and, by kind, words that do so only where they
#: come first and no other words than those of ``CHROME`` follow.
SURE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager masthead footer sidebar sidenav comment comments disqus newsletter login popup modal toolbar promo consent gdpr commentlist".split())
FIRST_WORDS = {w: kind for kind, words in {
    "weak": "aside promotion widget widgets subscribe signup overlay share sharing social related recommended copyright skip more latest popular trending",
    "header": "header",
    "notice": "cookie cookies notice notices notification alert flash",
    "thread": "reply replies respond responses discussion discussions",
    "form": "form",
}.items() for w in words.split()}
CHROME = frozenset("area articles bar block blocks body bottom box button buttons container content count default field fields footer form group head header icons info inner items left line link links list main media menu message messages nav news outer panel post posts right row section site social story stories strip text thread title tools top widget widgets wrap wrapper".split())
#: Words before which a word of the second kind counts, too, and words after which a name says nothing of its element.
SITE_WORDS = frozenset("site top global blog mobile left right bottom page social".split())
STATE_WORDS = frozenset("has with no without not".split())
KEEP_CLASSES = frozenset("content main article post story entry-content post-content article-content article-body post-body story-body main-content page-content".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body center div main section td html".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose names count at all; those within a line and headings are text of what holds them.
NAMED_TAGS = frozenset("article body center div dl fieldset form html li main ol p section table tbody td tr ul".split())
#: Characters outside links from which on a block is prose, and words of a heading over what readers say.
PROSE, TALK = 80, re.compile(r"comment|repl(?:y|ies)|respon|discuss", re.I)
#: A start tag on the left ends an open element on the right, unless one of the bounds stands between.
ENDS = {t: ("p",) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()}
ENDS |= {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "body": ("head",)}
BOUNDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",)}
_P_BOUNDS = ("table", "td", "th", "caption", "button", "object", "html", "body")
_CELLS, _TABLE = ("td", "th", "table"), frozenset("table tr tbody thead tfoot body html".split())

#: How plainly an element says that it holds the article.
ARTICLE, MAIN, NAMED = 3, 2, 1


class Node:
    """An open or closed element. ``own`` is what stands in it outside inner containers; ``chars`` and ``score`` count all of it."""

    __slots__ = ("tag", "name", "key", "above", "drop", "kind", "holder", "own", "chars", "score", "h1", "inner", "kids", "region", "doubt")

    def __init__(self, tag: str, classes: tuple[str, ...], drop: bool, above: Node | None, holder: Node | None, kind: int):
        self.tag, self.drop, self.above, self.holder, self.kind = tag, drop, above, holder, kind
        self.name = _DIGITS.sub("#", ".".join([tag, *sorted(classes)])) if classes else tag
        # a path is known by a hash of its names, so that deep pages cost no long strings
        self.key = xxhash.xxh64_intdigest(self.name.encode("utf-8", "replace"), above.key if above else 0)
        self.own = self.chars = self.score = self.inner = 0
        self.h1, self.kids, self.region, self.doubt = False, [], None, False


def path_of(node: Node, most: int = 16) -> str:
    """The innermost names on the path of a node, for the reader."""
    names: list[str] = []
    while node.above is not None and len(names) < most:
        names.append(node.name)
        node = node.above
    return (">" if node.above is not None else "") + ">".join(reversed(names))


def _doubt_of(tag: str, classes: tuple[str, ...], ident: str, role: str) -> str:
    """What an element's names say against it: nothing, "drop" where its tag or role does, else a kind of doubt."""
    if tag in DROP or role in DROP_ROLES:
        return "drop"
    if tag in ("html", "body", "main", "article") or tag not in NAMED_TAGS or any(c.lower() in KEEP_CLASSES for c in (*classes, ident)):
        return ""
    found = "form" if tag == "form" or role == "form" else ""
    for name in (*classes, ident):
        parts = [w.lower() for w in _NAME.findall(name)]
        if not parts or not STATE_WORDS.isdisjoint(parts):
            continue
        if tag == "p":  # a paragraph in class market-share is about shares
            if len(parts) == 1 and parts[0] in SURE_WORDS:
                return "sure"
            continue
        if not SURE_WORDS.isdisjoint(parts):
            return "sure"
        while len(parts) > 1 and parts[0] in SITE_WORDS:
            parts = parts[1:]
        if parts[0] in FIRST_WORDS and CHROME.issuperset(p for p in parts[1:] if not p.isdigit() and p not in FIRST_WORDS):
            found = found or FIRST_WORDS[parts[0]]
    return found


class Doubt:
    """An element that its names speak against, with what its text says."""

    __slots__ = ("kind", "tag", "inside", "before", "chars", "links", "heading", "talk")

    def __init__(self, kind: str, tag: str, inside: bool, before: int):
        self.kind, self.tag, self.inside, self.before = kind, tag, inside, before
        self.chars = self.links = 0
        self.heading = self.talk = False


def settle(doubt: Doubt, plain: int) -> bool:
    """Whether a doubtful element stays, on a page of ``plain`` characters outside links.

    What holds over half of the page's text is the page's text, whatever its name. Mostly links, it goes. Then names decide
    by kind: sure ones go, forms and threads of readers go unless a section has a heading of its own; others stay
    inside an article or main element where they hold prose, notices only under a heading.
    """
    own = doubt.chars - doubt.links
    if 2 * own > plain:
        return True
    if doubt.kind in ("sure", "form") or 2 * doubt.links > doubt.chars:
        return False
    if doubt.kind == "thread":
        return doubt.tag == "section" and doubt.heading and not doubt.talk or doubt.before < own
    prose = doubt.inside and own >= PROSE
    return prose and (doubt.kind != "notice" or doubt.heading)


def _kind(tag: str, classes: tuple[str, ...], attributes: dict[str, str]) -> int:
    role = attributes.get("role", "").lower()
    if tag == "article" or role == "article" or "articlebody" in attributes.get("itemprop", "").lower().split():
        return ARTICLE
    if tag == "main" or role == "main":
        return MAIN
    return NAMED if any(c.lower() in KEEP_CLASSES for c in (*classes, attributes.get("id", ""))) else 0


def _slow_tag(page: str, at: int) -> tuple[int, dict[str, str]]:
    """The end of a tag whose attributes start at ``at``, and the attributes; -1 where the page ends in it."""
    attributes: dict[str, str] = {}
    while found := _ATTRIBUTES.match(page, at):
        at = found.end()
        if found[1]:
            return at, attributes
        value = found[4] or ""
        if quote := found[3]:
            end = page.find(quote, at)
            if end < 0:
                break
            value, at = page[at:end], end + 1
        attributes.setdefault(found[2].lower(), value)
    return -1, attributes


def parse(page: str) -> tuple[list[tuple[str, int, Node, bool]], list[Node]]:
    """Blocks of text outside boilerplate (text, characters in links, container, in a first heading), and all containers in page order.

    Elements whose tag or role is never the article's go at once. Those that only a name speaks against are kept apart with
    their text until the page has been read, and then stay or go by it (``settle``).

    Each character is looked at a bounded number of times, however deep, unclosed or unmatched the tags are: a
    tag, comment or quoted value that never ends ends the page, and open elements are found by their tag.
    """
    blocks: list[tuple[str, int, Node, bool, Doubt | None]] = []
    doubts: list[Doubt] = []  # the outermost open one first
    before = 0  # characters outside links so far
    root = Node("html", (), False, None, None, 0)
    containers, stack, holders, text = [root], [root], [root], []
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    dropped = 0  # open elements whose text goes
    links = in_link = 0
    kept_heading = False  # inside a heading of an article's header
    article_header = 0  # open headers of an article

    def flush() -> None:
        nonlocal links, before
        if text:
            joined = _SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            if joined:
                linked, heading = min(links, len(joined)), any(places.get(h) for h in HEADING)
                doubt = doubts[0] if doubts else None
                if doubt:
                    doubt.chars += len(joined)
                    doubt.links += linked
                    doubt.heading |= heading
                    doubt.talk |= heading and TALK.search(joined) is not None
                    if heading and doubt.kind == "header" and doubt.inside:
                        doubt = None  # a heading in the header of an article is the article's
                before += len(joined) - linked
                blocks.append((joined, linked, holders[-1], bool(places.get("h1")), doubt))
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        if piece and (not dropped or kept_heading and dropped == 1):
            decoded = entities.unescape(piece) if "&" in piece else piece
            text.append(decoded)
            if in_link:
                links += len(decoded)

    def close(to: int) -> None:
        nonlocal dropped, in_link, kept_heading, article_header
        while len(stack) > to:
            node = stack[-1]
            if node.tag in BLOCK:
                flush()
            stack.pop()
            places[node.tag].pop()
            if holders[-1] is node:
                holders.pop()
            dropped -= node.drop
            if node.doubt:
                doubts.pop()
            in_link -= node.tag == "a"
            if node.tag in HEADING:
                kept_heading = False
            elif node.tag == "header" and article_header:
                article_header -= 1

    def last(tag: str) -> int:
        found = places.get(tag)
        return found[-1] if found else 0

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        follows = page[start + 1 : start + 2]
        if not (follows.isalpha() and follows.isascii()) and follows not in ("/", "!", "?"):
            add(page[at : start + 1])
            at = start + 1
            continue
        add(page[at:start])
        if page.startswith("<!--", start):
            at = start + 4
            if page.startswith(">", at) or page.startswith("->", at):
                at = page.index(">", at) + 1
                continue
            end = _COMMENT_END.search(page, at)
            if not end:
                break
            at = end.end()
            continue
        attributes: dict[str, str] = {}
        found = _TAG.match(page, start)
        if found:
            at, raw = found.end(), found[3]
            if raw and ("class" in raw or "id" in raw or "role" in raw or "itemprop" in raw or not raw.islower()):
                for k, a, b, c in _ATTRIBUTE.findall(raw):
                    attributes.setdefault(k.lower(), a or b or c)
        elif found := _NAME_ONLY.match(page, start):
            at, attributes = _slow_tag(page, found.end())
            if at < 0:
                break
        else:  # a declaration, an instruction, or an end tag without a name
            end = page.find(">", start)
            if end < 0:
                break
            at = end + 1
            continue
        tag = found[2].lower()
        if found[1]:
            to = last(tag)
            if to and (tag in _TABLE or to >= max(map(last, _CELLS))):
                close(to)
            continue
        for ended in ENDS.get(tag, ()):
            to = last(ended)
            if to and to > max(map(last, BOUNDS.get(tag, ()) if ended != "p" else _P_BOUNDS), default=0):
                close(to)
        if tag == "html":
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in BLOCK:
            flush()
        elif tag == "br":
            add(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if not end:
                break
            at = end.end()
            continue
        classes = tuple(attributes.get("class", "").split())
        named = _doubt_of(tag, classes, attributes.get("id", ""), attributes.get("role", "").lower())
        drop = named == "drop"
        node = Node(tag, classes, drop, stack[-1], holders[-1], _kind(tag, classes, attributes) if tag in CONTAINER else 0)
        # a heading in the header of an article is the article's
        if tag in HEADING and dropped == 1 and article_header:
            kept_heading = True
        if tag == "header" and drop and (article_header or not dropped and (last("article") or last("main"))):
            article_header += 1
        if named and not drop:
            doubts.append(Doubt(named, tag, bool(last("article") or last("main")), before))
            node.doubt = True
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        dropped += drop
        in_link += tag == "a"
        if tag in CONTAINER and not dropped:
            containers.append(node)
            holders.append(node)
    close(1)
    flush()
    plain = sum(len(text) - linked for text, linked, *_ in blocks)
    settled: dict[int, bool] = {}
    for *_, doubt in blocks:
        if doubt is not None and id(doubt) not in settled:
            settled[id(doubt)] = settle(doubt, plain)
    return [b[:4] for b in blocks if b[4] is None or settled[id(b[4])]], containers


def regions_of(blocks: list[tuple[str, int, Node, bool]], containers: list[Node]) -> list[Node]:
    """The containers that the page is cut into, in page order; every block is in one of them, but for rows of links."""
    for text, links, holder, h1 in blocks:
        plain = len(text) - links
        holder.chars += len(text)
        holder.score += plain
        holder.own += plain if 2 * plain > len(text) else 0
        holder.h1 |= h1
    for node in reversed(containers):
        if (up := node.holder) is not None and node.chars:
            up.chars += node.chars
            up.score += node.score
            up.h1 |= node.h1
            up.inner = max(up.inner, node.inner, node.kind)
            up.kids.append(node)
    out, todo = [], [containers[0]] if containers[0].chars else []
    while todo:
        node = todo.pop()
        if node.kind == ARTICLE or node.own or not node.kids or node.kind > node.inner:
            out.append(node)
        else:
            todo += node.kids  # the first of them is the last in the list
    chosen = set(map(id, out))
    for node in containers:
        node.region = node if id(node) in chosen else node.holder.region if node.holder is not None else None
    return out


#: A region: path, path of what lays it out, share of the page's text on its path, whether it is the first on its path, whether
#: it holds a first heading, its kind, whether most of it is outside links, path to read, text.
REGION = ("key", "up", "share", "first", "h1", "kind", "prose", "path", "text")


def page_regions(page: str | None) -> list[tuple]:
    """The regions of a page in page order, as tuples of ``REGION``; none where there is no text."""
    blocks, containers = parse(page or "")
    found = regions_of(blocks, containers)
    texts: dict[int, list[str]] = {}
    for text, _, holder, _ in blocks:
        if holder.region is not None:
            texts.setdefault(id(holder.region), []).append(text)
    by_key: dict[int, float] = {}
    for node in found:
        by_key[node.key] = by_key.get(node.key, 0.0) + node.score + 1e-3 * node.chars  # of links alone, the longest
    total, seen, out = sum(by_key.values()), set(), []
    for node in found:
        up = node.holder.key if node.holder is not None else 0
        out.append((node.key, up, by_key[node.key] / total, node.key not in seen, node.h1, node.kind, 2 * node.score > node.chars, path_of(node), "\n\n".join(texts.get(id(node), []))))
        seen.add(node.key)
    return out


def choose(found: list[tuple], means: dict[int, float]) -> tuple[str, str]:
    """(text, path) of the regions that the page keeps, given the average share that each path holds on its host.

    The path with the highest average share times the square root of its share here leads, an article or main
    element counting twice. Beside it stay, where one element lays them out: a first heading before it if it has none,
    and, unless it is an article element, prose whose average share, and the geometric mean of it and the share here,
    are at least a quarter of its own.
    """
    if not found:
        return "", ""
    rank = lambda r: (means[r[0]] * sqrt(r[2]) * (2 if r[5] >= MAIN else 1), -order[r[0]])
    order: dict[int, int] = {}
    for i, r in enumerate(found):
        order.setdefault(r[0], i)
    best = max(found, key=rank)
    ups = {r[1] for r in found if r[0] == best[0]}
    headed = any(r[4] for r in found if r[0] == best[0])
    keep = []
    for i, r in enumerate(found):
        beside = r[1] in ups
        title = beside and r[4] and not headed and i < order[best[0]]
        usual = 4 * means[r[0]] >= means[best[0]] and 16 * means[r[0]] * r[2] >= means[best[0]] * best[2]
        part = beside and best[5] < ARTICLE and r[6] and usual
        if r[0] == best[0] or title or part:
            keep.append(r[8])
    return "\n\n".join(t for t in keep if t), best[7]


def extract(page: str | None, means: dict[int, float] | None = None) -> tuple[str, str]:
    """(text, path) of one page; shares of the page itself stand for paths that ``means`` lacks."""
    found = page_regions(page)
    return choose(found, {r[0]: (means or {}).get(r[0], r[2]) for r in found})


_REGION_TYPE = "array<struct<key: long, up: long, share: double, first: boolean, h1: boolean, kind: int, prose: boolean, path: string, text: string>>"


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for page in pdf["html"]:
            found = [(_signed(r[0]), _signed(r[1]), *r[2:]) for r in page_regions(page)]
            rows.append([dict(zip(REGION, r)) for r in found])
        yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "host": pdf["host"], "regions": rows})


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = []
        for found, means in zip(pdf["regions"], pdf["means"]):
            got.append(choose([tuple(r[k] for k in REGION) for r in found], {m["key"]: m["mean"] for m in means}))
        yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": [t for t, _ in got], "path": [p for _, p in got]})


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_means(scored: DataFrame) -> DataFrame:
    """(host, key, mean): the average share of a page's text on each path, over the host's pages that have it."""
    votes = scored.select("host", F.explode(F.filter("regions", lambda r: r["first"])).alias("r")).select("host", "r.key", "r.share")
    return votes.groupBy("host", "key").agg(F.avg("share").alias("mean"))


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, path.

    A null page is an empty one and gives an empty text. Pages without a host form one host. Of paths that are
    equally good the first on the page leads. Repeated rows are extracted each; an empty table gives no rows. A
    page is parsed once, in time that grows with its length whatever its tags are. Other columns are not read.

    Every page votes. A page whose regions are all on one path has nothing to choose from, so only the texts of
    the others meet the averages; these are joined by host and path on narrow rows, where Spark may split a host
    with many pages.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    scored = rows.mapInPandas(_score, f"page_id long, url string, host string, regions {_REGION_TYPE}")
    scored = save(scored.withColumn("row", F.monotonically_increasing_id()), "regions")
    several = F.size(F.filter("regions", lambda r: r["first"])) > 1
    joined = F.array_join(F.transform(F.filter("regions", lambda r: r["text"] != ""), lambda r: r["text"]), "\n\n")
    plain = scored.where(~several).select("page_id", "url", joined.alias("text"), F.coalesce(F.get("regions", F.lit(0))["path"], F.lit("")).alias("path"))
    asked = scored.where(several).select("row", "host", F.explode(F.filter("regions", lambda r: r["first"])).alias("r")).select("row", "host", "r.key")
    means = asked.join(host_means(scored), ["host", "key"]).groupBy("row").agg(F.collect_list(F.struct("key", "mean")).alias("means"))  # the paths of one page
    chosen = scored.where(several).join(means, "row").select("page_id", "url", "regions", "means").mapInPandas(_choose, "page_id long, url string, text string, path string")
    return plain.unionByName(chosen).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")
