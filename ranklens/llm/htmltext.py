"""Main text of pages by equivalence-class template deduction.

A token is the path of an element, such as ``html/body/div.ad``, or a block of text in one. Its
occurrence vector tells how often it stands on each distinct page of a host. Tokens of a host with
equal vectors form an equivalence class; it is valid if it has several tokens and stands on enough pages.
Elements of valid classes that stand once on their pages are the frame of the template; they nest as the
elements do, and what they hold is a slot. The slots' text that differs from page to page is what the host
publishes: the innermost frame element that holds most of it, and is no text block itself, is the core. Its
blocks are the main text.

In a core that no name marks, a text that most holders of its element share is template and left out; so
it is on pages without a core, with elements made of links. Names are a prior beside this: a core inside an
``article`` or ``main`` is widened to it, such an element wins over a core elsewhere and keeps all its
text, and furniture by name (a menu, an advert, reader comments) is never main text.

Vectors are compared by a 64-bit signature that adds up over pages, so no host's pages are gathered.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklens.llm.common import stage

#: Least share of a host's pages on which a valid class occurs.
SUPPORT = 0.5
#: Least distinct pages of a host on which a text stands before it counts as unchanging: fewer compare nothing.
LEAST_PAGES = 2
#: Least share of a host's changing text in its core, and least tokens of a valid class.
CORE_SHARE, CLASS_TOKENS = 0.75, 2
#: Key of the core's path in a template.
CORE = "\v"
#: Elements nested deeper than this share the path of the last one named.
DEPTH = 40

# Element names by role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("script style template noscript a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
                    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml".split())
_RAW = frozenset("script style noscript template iframe textarea title svg select".split())
_ITEMS = frozenset("li dt dd tr td th option".split())
_LISTS = frozenset("ul ol dl table tbody thead tfoot tr select".split())
_FURNITURE = frozenset("head nav header footer aside form button input select option script style noscript template iframe textarea title svg dialog menu".split())
_ARTICLE = frozenset("article main".split())
_NEVER = frozenset("html body main article".split())
# Whole class names, ids and roles; what these miss is left to the deduction.
_PLACES = r"(?:(?:site|page|global|main|top|bottom|primary|secondary|left|right)[-_]?)?"
_FURNITURE_NAMES = re.compile(
    rf"(?:ads?|advert\w*|ads?[-_]?(?:slot|box|unit|banner|block|container|wrapper|0)|sponsor\w*|promos?|promotions?|{_PLACES}(?:nav|navbar|navigation|menu|footer|sidebar)|nav[-_]?(?:bar|menu)|menu[-_]?bar|"
    r"breadcrumbs?|banner|aside|complementary|contentinfo|widgets?|cookies?|cookie[-_]?(?:banner|bar|consent|notice)|consent|notice|notification|alert|popup|modal|newsletter(?:[-_]?signup)?|subscri\w+|signup|login|"
    r"share|sharing|social|(?:social[-_]?)?share[-_]?(?:bar|buttons?|links?)|social[-_]?(?:bar|buttons?|links?|share|sharing)|related(?:[-_]?(?:articles|posts|stories|links))?|recommend\w*|comments?|comment[-_]?(?:list|section|form)|comments[-_]?(?:area|list|section)|respond|replies|disqus(?:_thread)?)"
)
#: Names that hold the title when they stand inside the article.
_HEADER_NAMES = re.compile(rf"{_PLACES}(?:header|masthead)")
_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>|<[!?][^>]*>", re.S
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


@lru_cache(maxsize=50_000)
def _key(name: str, attributes: str) -> str:
    """Element name with its role, id and class names; digits in them are written as 0."""
    found = {k.lower(): v.strip("\"'") for k, v in _NAMED.findall(attributes)} if attributes else {}
    words = [w for k in ("role", "id", "class") for w in found.get(k, "").lower().split()]
    return ".".join([name, *dict.fromkeys(re.sub(r"\d+", "0", w).replace("/", "-") for w in words)])


@lru_cache(maxsize=50_000)
def is_furniture(key: str, in_article: bool = False) -> bool:
    """Whether an element is furniture by its name, or by a whole class name, id or role."""
    name, *words = key.split(".")
    if name in _FURNITURE and not (name == "header" and in_article):
        return True
    if name in _NEVER or is_article(key) or name == "header":
        return False
    return any(_FURNITURE_NAMES.fullmatch(w) or not in_article and _HEADER_NAMES.fullmatch(w) for w in words)


@lru_cache(maxsize=50_000)
def is_article(key: str) -> bool:
    name, _, rest = key.partition(".")
    return name in _ARTICLE or "main" in rest.split(".")


class Place:
    """An open element: its path, and whether the article or a link is around it.

    Whether furniture is around it is known once the page is read to its end (``events``).
    """

    __slots__ = ("name", "key", "path", "depth", "furniture", "article", "link", "above", "block", "chars")

    def __init__(self, name: str, key: str, above: Place | None):
        self.name, self.key, self.above = name, key, above
        self.depth = above.depth + 1 if above else 0
        self.path = f"{above.path}/{key}" if above and self.depth < DEPTH else (above.path if above else key)
        self.block = above.block if above and name in _INLINE else self
        self.furniture, self.chars = False, 0
        self.article = is_article(key) or (above is not None and above.article)
        self.link = name == "a" or (above is not None and above.link)

    def around(self) -> Iterator[Place]:
        """This place and those around it, innermost first."""
        at: Place | None = self
        while at is not None:
            yield at
            at = at.above


ROOT = ("#page", "#page")


def walk(page: str | None) -> Iterator[tuple[str, Place, str]]:
    """Events of a whole page: ("open", place, ""), ("text", place, decoded text), ("break", place, "").

    Unclosed paragraphs and list items end where HTML ends them; end tags without a start are
    passed over; whatever stays open at the end of a cut-off page ends there.
    """
    page = page or ""
    here = Place(*ROOT, None)
    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None or m.start() > at:
            yield "text", here, entities.unescape(page[at : m.start() if m else size])
        if m is None:
            return
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        block = name not in _INLINE
        if m[1]:
            place = here
            while place.above is not None and place.name != name:
                place = place.above
            if place.above is not None:
                here = place.above
            if block:
                yield "break", here, ""
            continue
        if block:
            here = _ended_by(name, here)
            yield "break", here, ""
        place = Place(name, _key(name, m[3]), here)
        yield "open", place, ""
        if name in _VOID or m[3].endswith("/") and name in _RAW:
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        here = place


def _ended_by(name: str, here: Place) -> Place:
    """Where a block element opens: after the paragraph it ends, or after the item of its list."""
    place = here
    while place.above is not None:
        if place.name == "p" or name in _ITEMS and place.name == name:
            return place.above
        if place.name in _LISTS or place.name not in _INLINE and name not in _ITEMS:
            return here
        place = place.above
    return here


def events(page: str | None) -> list[tuple[str, Place, str]]:
    """Events of a whole page, each place marked if furniture is around it.

    An element around the article is no furniture: if all articles of a page stand in furniture, the
    one with the most text is taken out of it. On a page without one, a form that holds more than
    half of the text is no furniture.
    """
    out = list(walk(page))
    places = [place for kind, place, _ in out if kind == "open"]
    _mark(places, frozenset())
    if not any(p.furniture for p in places) or any(p.article and not p.furniture for p in places):
        return out
    for kind, place, text in out:
        if kind == "text":
            place.chars += sum(map(len, text.split()))
    for p in reversed(places):
        p.above.chars += p.chars
    articles = [p for p in places if p.article and not p.above.article and not any(is_furniture(x.key) for x in p.around() if x.article)]
    if articles:
        chosen = max(articles, key=lambda p: p.chars)
        _mark(places, frozenset(map(id, chosen.around())))
    elif forms := [p for p in places if p.name == "form" and 2 * p.chars > places[0].above.chars]:
        _mark(places, frozenset(map(id, forms)))
    return out


def _mark(places: list[Place], spared: frozenset[int]) -> None:
    for p in places:
        own = id(p) not in spared and is_furniture(p.key, p.above.article)
        p.furniture = own or p.above.furniture


def content(out: list[tuple[str, Place, str]]) -> int:
    """Hash of a page's text outside furniture: rows with equal ones are copies of one page."""
    text = hashlib.blake2b(digest_size=8)
    for kind, place, words in out:
        if kind == "text" and not place.furniture:
            for word in words.split():
                text.update(word.encode("utf-8", "surrogatepass") + b" ")
    return int.from_bytes(text.digest(), "big", signed=True)


def text_token(path: str, text: str) -> str:
    """Token of a block of text in an element."""
    return f"{path}\t{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"


def blocks_of(out: list[tuple[str, Place, str]]) -> Iterator[tuple[int, Place, str]]:
    """Blocks of a page's text outside furniture: first event, block element it stands in, text."""
    now: list[str] = []
    first, at = 0, None
    for k, (kind, place, text) in enumerate([*out, ("break", None, "")]):
        if kind == "text" and not place.furniture:
            if not now:
                first, at = k, place.block
            now.append(text)
        elif kind == "break" and now:
            if joined := " ".join("".join(now).split()):
                yield first, at, joined
            now = []


def observed(page: str | None) -> tuple[int, dict[str, list]]:
    """Content of a page, and per token: occurrences, characters, characters of link text, hash of the text, flags.

    Tokens are element paths and blocks of text in their element. An element's text is that of its
    inline elements too; they have their own besides.
    """
    read = events(page)
    out: dict[str, list] = {ROOT[0]: [1, 0, 0, 0, False, False]} if read else {}
    for kind, place, text in read:
        if kind == "open":
            seen = out.setdefault(place.path, [0, 0, 0, 0, place.article and not place.furniture, place.furniture])
            seen[0] += 1
        elif kind == "text" and not place.furniture and (words := text.split()):
            n, line = sum(map(len, words)), " ".join(words).encode("utf-8", "surrogatepass")
            for path in {place.path, place.block.path}:
                if (seen := out.get(path)) is not None:
                    seen[1] += n
                    seen[2] += n if place.link else 0
                    seen[3] = zlib.crc32(line, seen[3])
    for _, place, text in blocks_of(read):
        seen = out.setdefault(text_token(place.path, text), [0, len(text), 0, 0, place.article, False])
        seen[0] += 1
    return content(read), out


def core_of(template: dict[str, str]) -> tuple[str, bool]:
    """Path of the host's core, and whether it is an article by name; no core: empty.

    An article by name around the innermost element is the core; else it is widened as deduced.
    """
    if CORE not in template:
        return "", False
    path, depth = template[CORE].rsplit("\t", 1)
    keys = path.split("/")
    for k, key in enumerate(keys):
        if is_article(key):
            return "/".join(keys[: k + 1]), True
    return "/".join(keys[: int(depth)]), False


def main_text(page: str | None, template: dict[str, str]) -> str:
    """Main text of a page; ``template`` gives the core and each template token's slot: side or open.

    An article by name has all its blocks. Otherwise the core has those that are not template; on pages
    without either, all blocks count that do not stand in a side slot and are not template. Template
    texts stay if there is no other text.
    """
    read = events(page)
    core, _ = core_of(template)
    article: list[str] = []
    inside: list[tuple[str, str]] = []
    spare: list[tuple[str, str]] = []
    fixed: list[int] = []
    own: list[int] = []
    for _, place, text in blocks_of(read):
        shared = template.get(text_token(place.path, text)) == "side"
        if place.article:
            article.append(text)
        elif core and any(p.path == core for p in place.around()):
            own += [len(inside)] if shared else []
            inside.append((place.path, text))
        elif shared:
            fixed.append(len(spare))
            spare.append((place.path, text))
        elif _slot(place, template) == "open":
            spare.append((place.path, text))
    return "\n".join(article or _varying(inside, own) or _varying(spare, fixed))


def _varying(blocks: list[tuple[str, str]], fixed: list[int]) -> list[str]:
    """Texts without the unchanging ones at ``fixed``.

    They stay where they are the larger part of a path (or of the article) that has others too: versions
    of one text share most of it. They all stay if there is no other text: then the pages are equal.
    """
    sizes: dict[str, list[int]] = {}
    out = set(fixed)
    for k, (path, text) in enumerate(blocks):
        sizes.setdefault(path, [0, 0])[k in out] += len(text)
    left = [text for k, (path, text) in enumerate(blocks) if k not in out or 0 < sizes[path][0] < sizes[path][1]]
    return left or [text for _, text in blocks]


def _slot(place: Place, template: dict[str, str]) -> str:
    """Slot of the innermost template token around a place."""
    at: Place | None = place
    while at is not None:
        slot = template.get(at.path)
        if slot is not None:
            return slot
        at = at.above
    return "open"


_TOKENS = {"host": ("string", pa.string()), "page": ("long", pa.int64()), "path": ("string", pa.string()), "n": ("long", pa.int64()), "chars": ("long", pa.int64()),
           "link_chars": ("long", pa.int64()), "text_hash": ("long", pa.int64()), "article": ("boolean", pa.bool_()), "furniture": ("boolean", pa.bool_())}


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [t for _, t in _TOKENS.values()]
    for batch in batches:
        out: list[tuple] = []
        for host, html in zip(batch.column("host"), batch.column("html")):
            page, tokens = observed(html.as_py())
            out += [(host.as_py(), page, token, *seen) for token, seen in tokens.items()]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=list(_TOKENS))
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=list(_TOKENS))


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the template tokens of each host as one string of lines ``slot<tab>token``.

    Pages count once per content, so copies of a page prove nothing; pages without text or element
    do not count.
    """
    own = pages.filter(F.length("html") > 0).select(host_of(F.col("url")).alias("host"), "html")
    seen = own.mapInArrow(_tokens, ", ".join(f"{c} {t}" for c, (t, _) in _TOKENS.items()))
    # one row per token and content: copies of a page fall together
    seen = seen.groupBy("host", "path", "page").agg(*[F.max(c).alias(c) for c in _TOKENS if c not in ("host", "path", "page")])
    tokens = seen.groupBy("host", "path").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count(F.lit(1)).alias("on"), F.sum("chars").alias("chars"), F.sum("link_chars").alias("link_chars"),
        F.min("text_hash").alias("low"), F.max("text_hash").alias("high"), F.max("article").alias("article"), F.max("furniture").alias("furniture"),
        F.sum("n").alias("times"),
    )
    text = F.instr("path", "\t") > 0
    tokens = stage(tokens.withColumn("text", text).filter(~text | (F.col("on") >= LEAST_PAGES)), "tokens")
    total = tokens.filter(F.col("path") == ROOT[0]).select("host", F.col("on").alias("pages"))
    often = tokens.join(total, "host").filter(F.col("on") >= SUPPORT * F.col("pages"))
    valid = often.filter(~F.col("text"))
    fixed = (F.col("on") >= LEAST_PAGES) & (F.col("low") == F.col("high")) & (F.col("chars") > 0)
    links = (F.col("chars") > 0) & (2 * F.col("link_chars") > F.col("chars"))
    slot = F.when(F.col("furniture") | fixed | links, "side").otherwise("open")
    # a text is unchanging if most pages that hold its element hold it
    held = valid.select(F.col("host").alias("h"), F.col("path").alias("element"), F.col("on").alias("held"))
    texts = tokens.filter(F.col("text") & ~F.col("article")).withColumn("element", F.substring_index("path", "\t", 1))
    texts = texts.join(held, (F.col("host") == F.col("h")) & (texts["element"] == held["element"])).filter(F.col("on") >= SUPPORT * F.col("held"))
    lines = valid.select("host", F.concat_ws("\t", slot, F.col("path")).alias("line"))
    lines = lines.unionByName(texts.select("host", F.concat_ws("\t", F.lit("side"), F.col("path")).alias("line")))
    lines = lines.unionByName(_cores(tokens, often, fixed | links).select("host", F.concat_ws("\t", F.lit("core"), F.col("path")).alias("line")))
    return lines.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("template"))


def _cores(tokens: DataFrame, often: DataFrame, unchanging) -> DataFrame:
    """(host, path): the core of each host that has one, as the innermost element's path and the depth it is widened to.

    Text counts for the block element it stands in and all elements around that one. The frame elements
    that hold most of the changing text lie in each other; from the innermost the core is widened as far
    as no unchanging text and no links come in, so a title beside the paragraphs belongs to it.
    """
    keys = F.split("path", "/")
    inline = F.substring_index(F.element_at(keys, -1), ".", 1).isin(sorted(_INLINE))
    blocks = tokens.filter(~F.col("text") & ~F.col("furniture") & ~inline & (F.col("chars") > 0))
    around = F.transform(F.sequence(F.lit(1), F.size(keys)), lambda k: F.array_join(F.slice(keys, F.lit(1), k), "/"))
    each = blocks.select("host", "chars", (~unchanging).alias("changing"), F.col("path").alias("block"), F.explode(around).alias("path"))
    total = lambda test: F.sum(F.when(test, F.col("chars")).otherwise(0))
    held = each.groupBy("host", "path").agg(
        total(F.col("changing")).alias("held"), total(~F.col("changing")).alias("other"), total(F.col("changing") & (F.col("block") == F.col("path"))).alias("bare"))
    whole = held.filter(F.col("path") == ROOT[0]).select("host", F.col("held").alias("whole"))
    classes = often.groupBy("host", "vector", "on").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= CLASS_TOKENS)
    frame = often.filter(~F.col("text") & ~F.col("furniture") & (F.col("times") == F.col("on")) & (F.col("on") >= LEAST_PAGES) & (F.col("path") != ROOT[0]))
    frame = frame.join(classes.select("host", "vector", "on"), ["host", "vector", "on"], "left_semi").select("host", "path")
    cores = frame.join(held, ["host", "path"]).join(whole, "host")
    cores = cores.filter((F.col("held") > 0) & (F.col("held") >= CORE_SHARE * F.col("whole")) & (2 * F.col("bare") <= F.col("held")))
    # one chain of nested elements per host, at most DEPTH long
    chain = cores.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(F.size(keys).alias("depth"), "path", "other"))).alias("chain"))
    pure = F.filter("chain", lambda e: e["other"] == F.element_at(F.col("chain"), -1)["other"])
    return chain.select("host", F.concat_ws("\t", F.element_at(F.col("chain"), -1)["path"], F.element_at(pure, 1)["depth"]).alias("path"))


def _extract(texts: pa.Array, chosen: pa.Array) -> pa.Array:
    return pa.array([main_text(t.as_py(), _read(c.as_py())) for t, c in zip(texts, chosen)], pa.string())


@lru_cache(maxsize=1000)
def _read(lines: str | None) -> dict[str, str]:
    """Slot by token, and the core's path under ``CORE``."""
    pairs = [x.split("\t", 1) for x in (lines or "").split("\n") if x]
    return {CORE if slot == "core" else path: path if slot == "core" else slot for slot, path in pairs}


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null html is an empty page with an empty text, and no page of its host for the template. On a host
    with one distinct page nothing can be compared: the article by name or all text not named furniture is
    kept. From two on, the core and the template texts are deduced; an article by name keeps all its text. A page whose url names no host is taken with all
    others of that kind. Repeated rows are each extracted; a null page_id is kept. Templates are
    written to a table first: while it is small it reaches the pages without moving them, otherwise
    by a join on the host that can split a host with many pages. Other columns are ignored.
    """
    deduced = stage(templates(pages), "templates")
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = own.join(deduced, "host", "left")
    text = F.arrow_udf(_extract, "string")(F.col("html"), F.col("template"))
    out = joined.select("page_id", "url", text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
