"""A tolerant reading of one HTML page: blocks of text under the elements that hold them.

Tags that authors leave open are closed as browsers do (a paragraph by the next block, an item by the next item). Every
text stands under the path of its block elements; a path's key is a hash of the site and of each element's tag, class and
id, digits aside, so the same place of a site's pages has the same key. Work follows a page's length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import xxhash

#: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
#: Inline tags that authors often leave open; they neither hold blocks here nor close anything.
LOOSE = frozenset("abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small strike strong sub sup time tt u var".split())
#: What an opening tag closes, unless an element of the second set stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "a": ({"a"}, BLOCKS),
}
#: Elements that an end tag of another name doesn't close.
WALLS = frozenset("td th table body html article main".split())
#: Elements, roles, and words of classes and ids that mark what isn't an article's text.
NOISE_TAGS = frozenset(
    "nav footer aside form head noscript template object svg canvas audio video button select datalist dialog menu map "
    "fieldset legend label option optgroup search".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status tooltip".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adunit adbox leaderboard outbrain taboola sponsor sponsored promo promos promotion "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs crumbs toc topnav pagination pager skip skiplink "
    "masthead topbar toolbar logo footer bottombar copyright colophon sidebar aside rail widget widgets "
    "related recommended recommendations teaser teasers banner cookie cookies consent gdpr notice notices notification "
    "notifications alert alerts disclaimer popup modal overlay paywall newsletter subscribe subscription signup login "
    "register search searchbox searchform share sharing social follow comment comments commentlist respond replies reply "
    "disqus discussion feedback guestbook hidden "
    "werbung anzeige anzeigen kommentar kommentare seitenleiste fusszeile kopfzeile hinweis publicite commentaire "
    "commentaires pied entete avis publicidad anuncio anuncios comentario comentarios pie cabecera aviso avisos".split()
)
HEADER_WORDS = frozenset(["header", "head"])
NOISE_PARTS = re.compile("sidebar|cookie|comment|footer|advert|newsletter|breadcrumb|masthead|disqus|subscri|navbar|sponsor|popup|paywall")
#: A class with one of these words says something about another element.
ABOUT = frozenset("has with without no not is js".split())
NOISE_TYPES = re.compile(r"/(?:Comment|UserComments|WPAdBlock|WPFooter|WPHeader|WPSideBar|SiteNavigationElement)\b")
ROLES_OF_MAIN = {"main": "main", "article": "article"}
#: Tags whose elements stay in an article, however many pages repeat their text, unless a class or id sets them apart.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split())
#: Elements on a path, and elements open at once; deeper ones count as parts of the last.
DEPTH, NESTED = 24, 512

MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`]++)))?+""")
TOLD = re.compile(r"\b(?:class|id|role|hidden|aria-hidden|style|itemtype|itemprop)\b", re.IGNORECASE)


class Element(NamedTuple):
    tag: str
    label: str
    noise: int
    region: str
    apart: bool


class Block(NamedTuple):
    path: tuple[int, ...]
    region: int
    text: str
    linked: int


#: Regions, and what noise is: nothing, by a class word, by the element itself; a header counts outside articles only.
BODY, MAIN, ARTICLE, NOISY = 0, 1, 2, 3
NONE, HEADER, WORDS, SURE = 0, 1, 2, 3


def noise_of(names: list[str], container: bool) -> int:
    """What classes and ids say. Of an article or main part itself only a name's first word counts: further ones are of
    its topics or settings ("category-advertising", "comments-open")."""
    found = NONE
    for name in names:
        parts = [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_a-zA-Z]+", name)]
        if not ABOUT.isdisjoint(parts):
            continue
        if container:
            if parts and parts[0] in NOISE_WORDS and parts[-1] not in ("open", "closed"):
                return WORDS
            continue
        if not NOISE_WORDS.isdisjoint(parts) or NOISE_PARTS.search(name.lower()):
            return WORDS
        if not HEADER_WORDS.isdisjoint(parts):
            found = HEADER
    return found


@lru_cache(maxsize=1 << 14)
def element(tag: str, source: str) -> Element:
    """What an opening tag says of its element."""
    noise = SURE if tag in NOISE_TAGS else HEADER if tag == "header" else NONE
    region = tag if tag in ("article", "main") else ""
    names: list[str] = []
    if TOLD.search(source):
        told = {}
        for m in ATTRIBUTE.finditer(source):
            told.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        role = told.get("role", "").strip().lower()
        names = [*told.get("class", "").split(), *told.get("id", "").split()]
        region = ROLES_OF_MAIN.get(role, region) or ("article" if "articleBody" in told.get("itemprop", "") else "")
        style = told.get("style", "").replace(" ", "").lower()
        if role in NOISE_ROLES or "hidden" in told or told.get("aria-hidden", "").lower() == "true":
            noise = SURE
        if "display:none" in style or "visibility:hidden" in style or NOISE_TYPES.search(told.get("itemtype", "")):
            noise = SURE
        if tag not in ("body", "html"):
            noise = max(noise, noise_of(names, bool(region)))
    plain = sorted({re.sub(r"\d+", "", n) for n in names})[:6]
    return Element(tag, " ".join([tag, *plain]), noise, region, bool(names))


def told_noise(tag: str, source: str) -> bool:
    """Whether a loose inline element names itself as noise, so that it has to be followed to its end."""
    return bool(TOLD.search(source)) and element(tag, source).noise >= WORDS


def skipped(source: str, at: int, memory: dict[str, int]) -> int:
    """Behind a comment, declaration or the like at ``at``; what isn't closed takes the rest of the page."""
    if source.startswith("<!--", at):
        if source.startswith(("<!-->", "<!--->"), at):
            return source.index(">", at) + 1
        mark, width = "-->", 4
    else:
        mark, width = ">", 2
    if memory.get(mark, 0) < 0:
        return len(source)
    end = source.find(mark, at + width)
    memory[mark] = end
    return len(source) if end < 0 else end + len(mark)


class Reader:
    def __init__(self, site: str):
        self.root = xxhash.xxh3_64_intdigest(site.encode("utf-8", "replace"))
        self.stack: list[tuple[Element, int, int]] = []  # element, noise so far, region so far
        self.count: Counter[str] = Counter()  # open elements of each tag
        self.deeper = 0  # elements that are open beyond NESTED
        self.path: list[int] = []  # keys of the open block elements
        self.apart: dict[int, bool] = {}  # whether a key's element may be removed
        self.children: dict[int, list[str]] = {}  # labels of the elements below each key, runs as one
        self.buffer: list[str] = []
        self.linked = 0
        self.links = 0
        self.blocks: list[Block] = []
        self.articles = False

    def text(self, chunk: str) -> None:
        if self.stack and self.stack[-1][1] == SURE:
            return
        chunk = html.unescape(chunk) if "&" in chunk else chunk
        self.buffer.append(chunk)
        if self.links:
            self.linked += len(chunk.strip())

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                noise, region = self.stack[-1][1:] if self.stack else (NONE, BODY)
                where = region if noise < WORDS else NOISY
                if where != NOISY or region == ARTICLE:
                    self.blocks.append(Block(tuple(self.path[:DEPTH]), where, text, min(self.linked, len(text))))
            self.buffer = []
        self.linked = 0

    def open(self, tag: str, source: str) -> None:
        block = tag in BLOCKS
        if block:
            self.flush()
            if tag not in ("html", "body"):
                self.close_within({"p"}, WALLS | {"button"})
        if tag in CLOSES:
            self.close_within(*CLOSES[tag])
        if len(self.stack) == NESTED:
            self.deeper += 1
            return
        own = element(tag, source if tag != "a" or TOLD.search(source) else "")
        noise, region = self.stack[-1][1:] if self.stack else (NONE, BODY)
        mine = own.noise
        if mine == HEADER:
            mine = NONE if region != BODY else SURE if tag == "header" else WORDS
        if mine == WORDS and not block:
            mine = SURE
        if own.region == "article" and mine == NONE and noise == WORDS:
            region = ARTICLE  # kept apart, for pages that have nothing else
        elif own.region and max(mine, noise) == NONE:
            region = max(region, ARTICLE if own.region == "article" else MAIN)
            self.articles |= region == ARTICLE
        self.stack.append((own, max(noise, mine), region))
        self.count[tag] += 1
        self.links += tag == "a"
        if block and len(self.path) < DEPTH:
            above = self.path[-1] if self.path else self.root
            key = xxhash.xxh3_64_intdigest(own.label.encode("utf-8", "replace"), above) >> 1
            if max(noise, mine) == NONE:
                below = self.children.setdefault(above, [])
                if not below or below[-1] != own.label:
                    below.append(own.label)
                self.children.setdefault(key, [])
            free = not own.region and tag not in ("body", "html") and (region == BODY or own.apart or tag not in PLAIN)
            self.apart[key] = free
            self.path.append(key)
        elif block:
            self.path.append(self.path[-1])

    def pop(self) -> None:
        own = self.stack[-1][0]
        if own.tag in BLOCKS:
            self.flush()
            self.path.pop()
        self.links -= own.tag == "a"
        self.count[own.tag] -= 1
        self.stack.pop()

    def close_within(self, tags: set[str], walls: frozenset[str] | set[str]) -> None:
        """Close up to the innermost element of ``tags``, if no wall stands before it."""
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[k][0].tag
            if tag in tags:
                while len(self.stack) > k:
                    self.pop()
                return
            if tag in walls:
                return

    def end(self, tag: str) -> None:
        walls = WALLS if tag not in WALLS else {"html"}
        if tag in ("html", "body"):
            return
        if self.deeper:
            self.deeper -= 1
            if tag in BLOCKS:
                self.flush()
            return
        self.close_within({tag}, walls - {tag})


def read(source: str | None, site: str) -> Reader:
    """All blocks of a page and the elements above them; a null page has none."""
    reader, source, at, memory = Reader(site), source or "", 0, {}
    while at < len(source):
        found = MARKUP.search(source, at)
        if found is None:
            reader.text(source[at:])
            break
        start = found.start()
        if start > at:
            reader.text(source[at:start])
        tag = TAG.match(source, start)
        if tag is None:
            if source[start + 1] in "!?" or (source[start + 1] == "/" and not source[start + 2 : start + 3].isalpha()):
                at = skipped(source, start, memory)
                continue
            break  # a tag that doesn't end
        at, name = tag.end(), tag[2].lower()
        if tag[1]:
            if name == "br":
                reader.text(" ")
            elif name not in VOID and (name not in LOOSE or reader.count[name]):
                reader.end(name)
        elif name in RAW:
            key = f"</{name}"
            end = re.compile(rf"{re.escape(key)}[\s/>]", re.IGNORECASE).search(source, at) if memory.get(key, 0) >= 0 else None
            memory[key] = end.start() if end else -1
            at = len(source) if end is None else skipped(source, end.start(), memory)
        elif name == "br":
            reader.text(" ")
        elif name == "hr":
            reader.flush()
        elif name not in VOID and (name not in LOOSE or told_noise(name, tag[3])):
            reader.open(name, tag[3])
            if tag[3].endswith("/") and name in ("svg", "path", "circle", "rect", "use", "g"):
                reader.pop()
    reader.flush()
    return reader


def chosen(reader: Reader) -> list[Block]:
    """The blocks that may be an article's: those in articles if the page has any, else in its main part, else in its body.

    Articles inside of elements that only a class word marks as noise count for pages without any other text.
    """
    regions = [ARTICLE] if reader.articles else [MAIN] if any(b.region == MAIN for b in reader.blocks) else [BODY, MAIN]
    found = [b for b in reader.blocks if b.region in regions]
    return found or ([] if reader.articles else [b for b in reader.blocks if b.region == NOISY])


def text_of(blocks: list[Block], gone: set[int] | frozenset[int]) -> str:
    """Joined text without the branches of ``gone``; where these leave nothing, of all blocks."""
    kept = [b.text for b in blocks if gone.isdisjoint(b.path)] if gone else []
    return " ".join(kept or [b.text for b in blocks])


def site_of(url: str | None) -> str:
    """The host of a URL in lower case, without user and port; '' where there is none."""
    found = re.match(r"[a-zA-Z][\w+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""
