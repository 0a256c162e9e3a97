"""Main text of web pages by equivalence classes of template tokens.

A page is a stream of tokens: tags with their place in the tree of block elements, and
text with its place. Over the different pages of a host every token has an occurrence
vector, its count on each page. Tokens with one vector form an equivalence class. A class
is valid if it is large and frequent: `MIN_SIZE` tokens or more, a tag among them, on
`MIN_PAGES` different pages or more and at least `SUPPORT` of the host's, so each page type
of a host has classes of its own.

Valid classes nest into the page's template. On a page the tokens of a class must come in
the class's order, once or as often as its vector says, instance after instance; that of
the largest support is the root, and each further class stands in the gaps that those
before it left. What is between two neighbouring tokens is a slot, and all text of the
page lies in one. Slots are then ranked, never the page read past them:

* text in an element for menus, headers, footers, sidebars, notices, adverts, forms or
  comments is out;
* if there is text in <article>, <main> or the like, that alone is the article's, but for teasers,
  which are small linked articles beside a large one;
* but within an <article>, a list or a block by itself is out if most of its text are links;
* the template's own words are no slot's, wherever they stand: a text token of a class that is on
  `CONSTANT` of the pages that have the element it stands in (of the host's pages, if that
  is no template's) is out. A heading stays if a slot's text comes next: it says what that is.

A page that would keep hardly any text for the template's words keeps those: they are one
story at many addresses.
A page without a valid class (a host of few pages, a rare type) has its own tags that occur
once for a skeleton.

Occurrence vectors are compared by an order-free hash (the exclusive or of a hash for
each page and count) over different page contents: copies of a page count once. They are
combined before shuffles, and a class holds the tokens of one page at most, so no group
grows with a host. Templates have at most (tokens of a page) / `SUPPORT` tokens a host.

Text: character references decoded, white space (as Unicode has it) inside a block to
one space, trimmed, blocks in page order joined by two line feeds. Defined cases: null
or empty html has no text; very long pages are read whole, one at a time; pages without a
host are a host of their own; repeated rows keep a row each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html as html_entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove_table, scratch

MIN_PAGES, MIN_SIZE = 3, 3
SUPPORT = 0.02
#: Text on this share of the pages that have its element, and on so many pages, is the template's own.
CONSTANT, CONSTANT_PAGES = 0.8, 5
#: A page whose own text would be a smaller share than this of all that is not out otherwise keeps it all: a story at many addresses.
LEAST_OWN = 0.1
#: An <article> with links is a teaser if it has less than this share of the largest one's text.
TEASER = 0.25
#: Templates of up to so many tokens (24 bytes each) are sent to executors whole; beyond that
#: they lie in buckets of about `BUCKET_TOKENS`, of which a task holds one at a time.
BROADCAST_TOKENS, BUCKET_TOKENS = 1_000_000, 200_000
#: Pages of a host that one part of a bucket takes, about.
HOST_PAGES = 1 << 16

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr option".split())
#: Elements whose open tag ends those of the same kind that are still open.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ASIDE = frozenset("nav header footer aside form fieldset button select dialog menu search svg math object canvas audio video".split()) | RAW
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LISTS = frozenset(("ul", "ol", "dl", "menu", "dir"))
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status note".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion promotions "
    "menu menus nav navbar navigation navigations breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form forms search searchform "
    "social share sharing related recommended recommendations comment comments commentlist disqus respond replies reply widget widgets pagination pager skiplink".split()
)
#: Words that say how an element looks or what it holds, not what it is: "sidebar-left" is a sidebar, "alert-study" no alert.
FORM_NAMES = frozenset(
    "area bar block body bottom box col column container content default end footer frame group header holder inner item items label left line link links "
    "list main module outer panel primary right row secondary section site slot small start text title top unit widget wrap wrapper".split()
)
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*>", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


class Element:
    __slots__ = ("tag", "path", "aside", "main", "article", "heading_ok", "list")

    def __init__(self, tag: str, path: str, aside: bool, main: int, article: int, heading_ok: bool, list_: int = 0):
        self.tag, self.path, self.aside, self.main, self.article, self.heading_ok, self.list = tag, path, aside, main, article, heading_ok, list_


def attributes(raw: str) -> dict[str, str]:
    if "=" not in raw and "hidden" not in raw:
        return {}
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    return out


def is_aside(tag: str, attrs: dict[str, str]) -> bool:
    if tag in ASIDE or attrs.get("role", "").lower() in ASIDE_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style", "")):
        return True
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":  # of an article only whole names count: "has-sidebar" says nothing of it
        return not ASIDE_NAMES.isdisjoint(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split())
    return any(named_aside(n) for n in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split())


def named_aside(name: str) -> bool:
    """Whether a class or id names an aside: as a whole, by its last part, or by a part beside words of form only."""
    if name in ASIDE_NAMES:
        return True
    parts = [x for x in re.split(r"[_-]+", name) if x and not x.isdigit()]
    if len(parts) < 2:
        return bool(parts) and parts[0] in ASIDE_NAMES
    return parts[-1] in ASIDE_NAMES or any(x in ASIDE_NAMES for x in parts) and all(x in ASIDE_NAMES or x in FORM_NAMES for x in parts)


class Block:
    """Text of one block, its number, how many tags stand before it, and what its place says about it."""

    __slots__ = ("text", "path", "number", "at", "aside", "main", "article", "linked", "list", "heading")

    def __init__(self, text: str, top: Element, number: int, at: int, linked: int):
        self.text, self.path, self.number, self.at, self.linked = text, top.path, number, at, linked
        self.aside, self.main, self.article, self.list, self.heading = top.aside, top.main, top.article, top.list, top.tag in HEADINGS


def past(page: str, tag: str, at: int) -> int:
    """Where the inline element `tag`, opened before `at`, ends; `at` if it is never closed."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else not m[0].endswith("/>")
        if not depth:
            return m.end()
    return at


def parse(page: str) -> tuple[list[str], list[Block]]:
    """(tags with their places in order, blocks in order) of a page; broken markup is taken as it comes."""
    root = Element("", "", False, 0, 0, False)
    stack, tags, blocks = [root], [], []
    parts: list[str] = []
    linked, in_link, at, articles, lists = 0, 0, 0, 0, 0

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, stack[-1], len(blocks), len(tags), linked))
        parts.clear()
        linked = 0

    def data(chunk: str):
        nonlocal linked
        if chunk:
            text = html_entities.unescape(chunk) if "&" in chunk else chunk
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def close(tag: str):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                del stack[k:]
                return

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        data(page[at : m.start()])
        at = m.end()
        token = m[0]
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                data(token[9:].removesuffix("]]>"))
            continue
        end = token[1] == "/"
        tag = re.match(r"[^\s/>]+", token[2:] if end else token[1:])[0].lower()
        if end:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCKS:
                flush()
                if tag == "p" and not any(e.tag == "p" for e in stack):
                    continue
                tags.append(f"{stack[-1].path}/{tag}")
                close(tag)
            continue
        attrs = attributes(token)
        if tag in RAW or tag == "svg":
            finish = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = finish.end() if finish else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        if tag == "a" and not token.endswith("/>"):
            in_link += 1
        if tag not in BLOCKS:
            if tag not in VOID and is_aside(tag, attrs) and not token.endswith("/>"):
                at = past(page, tag, at)
            continue
        flush()
        if stack[-1].tag == "p":
            stack.pop()
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k].tag not in PARAGRAPHS:
                    break
        top = stack[-1]
        name = tag + "".join(f".{c}" for c in sorted(attrs.get("class", "").split())[:3])
        path = f"{top.path}>{name}"
        tags.append(path)
        if tag in VOID:
            continue
        within = 2 if tag == "article" or "articlebody" in attrs.get("itemprop", "").lower() else 1 if tag == "main" or attrs.get("role", "").lower() == "main" else 0
        main = max(top.main, within)
        aside = is_aside(tag, attrs)
        heading_ok = top.main > 0 and (tag == "header" or "header" in attrs.get("class", "").lower())  # an article's own header: its headings are text
        article = top.article
        if within == 2 and not article:
            articles += 1
            article = articles
        of = top.list
        if tag in LISTS and not of:
            lists += 1
            of = lists
        if tag in HEADINGS and top.heading_ok:
            stack.append(Element(tag, path, False, main, article, False, of))
        else:
            stack.append(Element(tag, path, aside or top.aside, main, article, heading_ok or top.heading_ok and not aside, of))
    data(page[at:])
    flush()
    return tags, blocks


def digest(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)


def tag_token(tag: str) -> int:
    return digest("tag", tag)


def text_token(b: Block) -> int:
    return digest("text", b.path, b.text)


def page_tokens(page: str) -> dict[int, tuple[int, int, bool]]:
    """token -> (count, place of the first, whether it is text) of a page."""
    tags, blocks = parse(page)
    out: dict[int, tuple[int, int, bool]] = {}
    for k, t in enumerate(map(tag_token, tags)):
        n, first, _ = out.get(t, (0, k, False))
        out[t] = (n + 1, first, False)
    for b in blocks:
        t = text_token(b)
        n, first, _ = out.get(t, (0, b.at, True))
        out[t] = (n + 1, first, True)
    return out


TOKENS = "host long, content long, token long, text boolean, n int, first int"


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT, min_size: int = MIN_SIZE) -> DataFrame:
    """host, vector, pages, all, once, tokens (place, token, text; in order): the valid classes of every host, which has `all` pages.

    `pages` has host and content (numbers that stand for them) and html. `once` says
    whether all tokens of the class occur once on each of its pages.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for key, text in {(h, c): t for h, c, t in zip(*(b.column(x).to_pylist() for x in ("host", "content", "html")))}.items():
                found = page_tokens(text)
                out[0].extend([key[0]] * len(found))
                out[1].extend([key[1]] * len(found))
                out[2].extend(found)
                for column, values in zip((out[4], out[5], out[3]), zip(*found.values())):
                    column.extend(values)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[x.split()[0] for x in TOKENS.split(", ")])

    narrow = pages.select("host", "content")
    sizes = narrow.distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all")).filter(F.col("all") >= min_pages)
    seen = pages.select("host", "content", "html").mapInArrow(count, TOKENS)
    each = seen.groupBy("host", "token", "content").agg(F.max("n").alias("n"), F.max("first").alias("first"), F.max("text").alias("text"))
    vector = F.bit_xor(F.xxhash64("content", "n")).alias("vector")
    vectors = each.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), vector, F.max("n").alias("most"), F.avg("first").alias("place"), F.max("text").alias("text"))
    frequent = vectors.filter(F.col("pages") >= min_pages).join(sizes, "host").filter(F.col("pages") >= support * F.col("all"))
    tokens = F.sort_array(F.collect_list(F.struct("place", "token", "text"))).alias("tokens")  # of one page at most
    classes = frequent.groupBy("host", "vector").agg(F.max("pages").alias("pages"), F.max("all").alias("all"), (F.max("most") == 1).alias("once"), tokens)
    return classes.filter((F.size("tokens") >= min_size) & F.exists("tokens", lambda t: ~t["text"]))


class Template:
    """The valid classes of a host: for each the pages that it is on, its tags in order and its texts."""

    def __init__(self, classes: list[tuple[int, list[int], list[int]]], pages: int = 0):
        self.pages = pages
        self.classes = sorted(classes, key=lambda c: (-c[0], c[1]))  # the same however they come
        self.of = {t: k for k, (_, tags, _) in enumerate(self.classes) for t in tags}
        self.texts = {t: k for k, (_, _, texts) in enumerate(self.classes) for t in texts}

    @classmethod
    def read(cls, rows) -> Template:
        classes = [(r["pages"], [t["token"] for t in r["tokens"] if not t["text"]], [t["token"] for t in r["tokens"] if t["text"]]) for r in rows]
        return cls(classes, max((r["all"] for r in rows), default=0))

    def constant(self, b: Block) -> bool:
        """Whether a block's text is the template's own."""
        said, place = self.texts.get(text_token(b)), self.of.get(tag_token(b.path))
        if said is None:
            return False
        return self.classes[said][0] >= max(CONSTANT_PAGES, CONSTANT * (self.pages if place is None else self.classes[place][0]))

    def nested(self, tags: list[int]) -> tuple[list[int], list[int]]:
        """(places of the template's tags on a page, level of each)."""
        found: dict[int, list[int]] = defaultdict(list)
        for at, t in enumerate(tags):
            if t in self.of:
                found[self.of[t]].append(at)
        places: list[int] = []
        levels: list[int] = []
        for k in sorted(found):  # largest support first
            own, at = self.classes[k][1], found[k]
            if len(at) % len(own) or any(tags[x] != own[i % len(own)] for i, x in enumerate(at)):
                continue  # not in the class's order: the page is of another make
            above = [max(levels[i - 1] if i else -1, levels[i] if i < len(levels) else -1) for i in (bisect_right(places, x) for x in at)]
            both = sorted([*zip(places, levels), *((x, n + 1) for x, n in zip(at, above))])
            places, levels = [x for x, _ in both], [n for _, n in both]
        return places, levels


NOTHING = Template([])


def slots(page: str, template: Template = NOTHING) -> tuple[list[list[Block]], int]:
    """The blocks of each slot of a page, in order, and the number of the template's levels.

    A block of the template's own words is by itself; `choose` says which blocks are the article's.
    """
    tags, blocks = parse(page)
    tokens = [tag_token(t) for t in tags]
    places, levels = template.nested(tokens)
    if not places:  # no template: the page's own tags that occur once
        times = defaultdict(int)
        for t in tokens:
            times[t] += 1
        places = [k for k, t in enumerate(tokens) if times[t] == 1]
    cut: dict[tuple[int, int], list[Block]] = {}
    after = 0  # the template's words part slots as its tags do
    for b in blocks:
        own = template.constant(b)
        after += own
        cut.setdefault((bisect_right(places, b.at - 1), after), []).append(b)
        after += own
    return list(cut.values()), 1 + max(levels, default=-1)


def choose(found: list[list[Block]], template: Template = NOTHING) -> tuple[list[Block], int]:
    """(the article's blocks in page order, number of those left out for the template's words) of a page's slots."""
    chars = lambda s: sum(len(b.text) for b in s)
    blocks = sorted((b for s in found for b in s if not b.aside), key=lambda b: b.number)
    if any(b.main for b in blocks):
        size: dict[int, int] = defaultdict(int)
        links: dict[int, int] = defaultdict(int)
        blocks = [b for b in blocks if b.main]
        for b in blocks:
            size[b.article] += len(b.text)
            links[b.article] += b.linked
        largest = max((n for a, n in size.items() if a), default=0)
        blocks = [b for b in blocks if not b.article or size[b.article] >= TEASER * largest or not links[b.article]]
    listed: dict[int, list[Block]] = defaultdict(list)
    for b in blocks:
        listed[b.list].append(b)
    mostly = {k for k, s in listed.items() if k and 2 * sum(b.linked for b in s) > chars(s)}
    data = [b for b in blocks if b.article or not (b.list in mostly or not b.list and 2 * b.linked > len(b.text))]
    slot = {b.number: k for k, s in enumerate(found) for b in s}
    constant = {k for k, s in enumerate(found) if all(map(template.constant, s))}
    own, heads = [], []
    for b in data:
        if slot[b.number] not in constant:
            own += [*heads, b]
            heads = []
        elif b.heading:
            heads.append(b)  # stays if text of a slot comes before another of the template's words
        else:
            heads = []
    if chars(own) < LEAST_OWN * chars(data) or not own:
        return data, 0
    return own, len(data) - len(own)


class Article:
    """The texts of a page's article, how many blocks were left out, how many of them for the template's words, levels of the template."""

    __slots__ = ("texts", "left", "constant", "levels")

    def __init__(self, page: str, template: Template = NOTHING):
        found, self.levels = slots(page, template)
        kept, self.constant = choose(found, template)
        self.texts = [b.text for b in kept]
        self.left = sum(map(len, found)) - len(kept)


RESULT = "page_id long, url string, text string, n_chars long, n_dropped_blocks long, n_template_blocks long, template_levels int"


def read_templates(folder: str, bucket: int) -> dict[int, Template]:
    """The templates of the hosts of one bucket, from the shared folder."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    by_host: dict[int, list] = defaultdict(list)
    if fs.get_file_info(f"{path}/bucket={bucket}").type == pyarrow.fs.FileType.Directory:
        for r in pq.read_table(f"{path}/bucket={bucket}", filesystem=fs, columns=["host", "pages", "all", "tokens"], partitioning=None).to_pylist():
            by_host[r["host"]].append(r)
    return {h: Template.read(found) for h, found in by_host.items()}


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """One row for each page with its main text, the blocks that were left out, those of them that are the template's own words, and its levels."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.xxhash64(host_of(F.col("url"))).alias("host"), F.xxhash64(html).alias("content"))
    each = materialise(templates(rows, min_pages, support), "templates")
    size = each.agg(F.sum(F.size("tokens"))).first()[0] or 0
    if size <= BROADCAST_TOKENS:
        by_host: dict[int, list] = defaultdict(list)
        for r in each.collect():  # BROADCAST_TOKENS at most
            by_host[r["host"]].append(r)
        sent, folder = pages.sparkSession.sparkContext.broadcast({h: Template.read(found) for h, found in by_host.items()}), None
        dealt = rows.select("page_id", "url", "html", "host", F.lit(0).alias("bucket"))
    else:
        sent, buckets = None, -(-size // BUCKET_TOKENS)
        bucket = F.pmod(F.xxhash64("host"), F.lit(buckets)).cast("int").alias("bucket")
        folder = scratch(pages.sparkSession, "template-buckets")
        each.select("host", "pages", "all", "tokens", bucket).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        large = pages.sparkSession.read.parquet(folder).groupBy("host").agg(F.max("all").alias("all")).filter(F.col("all") > HOST_PAGES).select("host", F.ceil(F.col("all") / HOST_PAGES).cast("long").alias("parts"))
        part = F.pmod(F.xxhash64("content", "page_id"), F.coalesce("parts", F.lit(1).cast("long")))
        dealt = rows.join(large, "host", "left").select("page_id", "url", "html", "host", bucket, part.alias("part"))
        dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket").drop("part")
    remove_table(each)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, holds = ({}, None) if sent is None else (sent.value, 0)
        for b in it:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for host, page, at in zip(*(b.column(c).to_pylist() for c in ("host", "html", "bucket"))):
                if at != holds:
                    held, holds = read_templates(folder, at), at
                found = Article(page, held.get(host, NOTHING))
                text = "\n\n".join(found.texts)
                for column, v in zip(columns, (text, len(text), found.left, found.constant, found.levels)):
                    column.append(v)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *(pa.array(c, t) for c, t in zip(columns, types))], names=[x.split()[0] for x in RESULT.split(", ")])

    return dealt.mapInArrow(read, RESULT)
