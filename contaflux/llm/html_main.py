"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: tags, told apart by their path from the root (a hash of the
parent's and the name), and text chunks. Tokens of one host that occur equally often on every one of its pages have the
same occurrence vector and form an equivalence class. A class is valid when enough pages
have it and it has more than one token; valid classes that a path nests into one another
are the host's template. What lies between template tokens are slots. Slots whose text is
the same on all pages, and slots inside elements that say what they are (menus, adverts,
notices, forms ...), are no main text. Where a page marks its article, the slots inside are
the main text; elsewhere the slot of the template, or the element of the page, with the most
words outside links is. A page's own marking is evidence against the template, so text inside
a marked article needs more pages to count as template than text elsewhere; a marked article
that is nothing but template is a copy of others and stays whole.

Occurrence vectors are compared by a sum of hashes of (page, count), so that Spark adds
them up with partial aggregation however many pages a host has.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contaflux.llm.common import Scratch, pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A token belongs to a host's template when this share of its pages, and so many, have it.
SUPPORT, LEAST_PAGES = 0.5, 4
#: Within a marked article, text belongs to the template when so many pages have it besides.
MARKED_PAGES = 2 * LEAST_PAGES
#: Template chunks up to this number are broadcast (16 bytes each), else joined by a shuffle.
MOST_BROADCAST = 2_000_000

#: A tag ends before the next < outside quotes, so that a page of unclosed tags is read once.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|textarea|title|iframe|object|math|canvas|select|button)\b[^<>]*(?:/>|>.*?(?:</\1\s*>|$))|<[!?][^<>]*>|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'<>])*)>|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never main text.
ASIDE = frozenset("nav header footer aside form head menu dialog fieldset label".split())
_SAYS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notice|notices|alert|popup|modal|newsletter|subscribe|signup|login|nav(?:bar|igation)?|menus?|breadcrumbs?|header|masthead|footer|sidebar|side-bar|widget|related|recommended|share(?:-?(?:bar|buttons?|links?|icons?|tools?|this|box))?(?![\w-])|sharing|social|comments?|comment-?list|respond|replies|disqus|pagination|pager|toolbar|skip-?link|copyright)(?:$|[\s_-]|\d)", re.I)
#: Said by the classes of articles that are not the first of their page, and (whole names only) of the first.
_CARDS = re.compile(r"(?:^|[\s_-])(?:teasers?|cards?|reply|promoted)(?:$|[\s_-]|\d)", re.I)
_NO_ARTICLE = frozenset("comment comments teaser reply".split())
#: A class that says that an element is content outweighs others of its classes.
_CONTENT = frozenset("content main-content article article-body entry entry-content post post-content".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_MAIN = frozenset(["article", "main"])
_SPACE = re.compile(r"\s+")


class Path:
    """An element's place: the names from the root on, held as a link to the parent and a hash."""

    __slots__ = ("depth", "hash", "key", "name", "parent")

    def __init__(self, name: str, parent: Path | None):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.key = f"{parent.hash if parent else 0:x}/{name}"
        self.hash = digest(self.key)


class Page:
    """blocks: (text, inside an article, place, words inside links) in page order; tags: the hashes
    of the places of tags; articles: how many stand on their own. Work and memory grow with the
    page alone, however deep it nests: an element knows its parent and a hash, not its whole path."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, Path, int]] = []
        self.tags: list[int] = []
        root = Path("", None)
        places: dict[tuple[int, str], Path] = {}
        stack: list[tuple[str, bool, bool, Path, Path]] = []  # name, aside, article, place with and without inline elements
        open_: dict[str, list[int]] = {}  # where in the stack the elements of a name are
        holders: list[int] = []
        run: list[str] = []
        linked = articles = mains = asides = inside = 0

        def place(parent: Path, name: str) -> Path:
            found = places.get((id(parent), name))
            if found is None:
                found = places[id(parent), name] = Path(name, parent)
            return found

        def close() -> None:
            nonlocal linked
            text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
            if text:
                self.blocks.append((text, inside > 0, stack[-1][4] if stack else root, linked))
            run.clear()
            linked = 0

        def pop(name: str) -> None:
            nonlocal asides, inside
            if not open_.get(name):
                return
            at = open_[name][-1]
            if name not in _HOLDS and holders and holders[-1] > at:
                return
            while len(stack) > at:
                gone, aside, article, _, _ = stack.pop()
                open_[gone].pop()
                if gone in _HOLDS:
                    holders.pop()
                asides -= aside
                inside -= article

        for m in _TOKEN.finditer(source):
            name = m[3]
            if name is None:
                piece = m[0]
                if (piece[0] != "<" or piece == "<") and not asides:
                    run.append(piece)
                    linked += len(piece.split()) if open_.get("a") else 0
                continue
            name = name.lower()
            if name in BLOCK:
                close()
            elif name in ("br", "img"):
                run.append(" ")
            if m[2]:
                pop(name)
                continue
            for ended in _ENDS.get(name, ()):  # what an open paragraph, item, row or cell gives way to
                if open_.get(ended):
                    pop(ended)
            attributes = m[4] or ""
            says = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(attributes)} if attributes else {}
            article = name in _MAIN or says.get("role", "").lower() == "main"
            kind, ident = says.get("class", ""), says.get("id", "")
            if name == "article":  # the first is the page's own unless its class says otherwise; nested and later ones are tested like any element
                told = bool(_NO_ARTICLE.intersection(kind.lower().split())) if not articles else any(r.search(x) for r in (_SAYS, _CARDS) for x in (kind, ident))
                articles += not told and not asides
            elif article:
                told = mains > 0 and bool(_SAYS.search(kind) or _SAYS.search(ident))
                mains += 1
            else:
                told = name not in ("html", "body") and not _CONTENT.intersection(kind.lower().split()) and bool(_SAYS.search(kind) or _SAYS.search(ident))
            aside = (
                name in ASIDE and not (name == "header" and inside)  # an article's own header has its headline
                or says.get("role", "").lower() in _ROLES
                or "hidden" in says
                or says.get("aria-hidden") == "true"
                or "display:none" in says.get("style", "").replace(" ", "").lower()
                or told
            )
            here = place(stack[-1][3] if stack else root, name)
            self.tags.append(here.hash)
            if name not in VOID and not attributes.endswith("/"):
                outer = stack[-1][4] if stack else root
                stack.append((name, aside, article, here, outer if name in INLINE else place(outer, name)))
                open_.setdefault(name, []).append(len(stack) - 1)
                if name in _HOLDS:
                    holders.append(len(stack) - 1)
                asides += aside
                inside += article
        close()
        self.articles = articles if not mains else 0


INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var".split())
_HOLDS = frozenset("article aside blockquote body div footer form header html main nav section table td th ul ol dl".split())
_CLOSES_P = tuple(BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"})
_ENDS = {name: ("p",) for name in _CLOSES_P} | {"li": ("p", "li"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)", 1))


def digest(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token)


def template(pages: DataFrame) -> DataFrame:
    """(host, token, class, pages): tokens of every host's template, token and class being
    hashes, and how many pages have the token.

    A token's class is its occurrence vector over all pages of the host.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("page"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 2 << 20):
            where, tokens, counts = [], [], []
            for i, source in enumerate(batch.column(2).to_pylist()):
                page = Page(source)
                seen, n = np.unique(np.array(page.tags + [token(b) for b in page.blocks], np.uint64), return_counts=True)
                where.append(np.full(len(seen), i))
                tokens.append(seen)
                counts.append(n)
            at = np.concatenate(where)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int32))],
                names=["host", "page", "token", "n"],
            )

    occurrences = rows.mapInArrow(run, "host string, page long, token long, n int")
    vectors = occurrences.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum(F.shiftright(F.xxhash64("page", "n"), 24)).alias("class")).where(F.col("pages") >= LEAST_PAGES)
    sizes = rows.groupBy("host").agg(F.count("*").alias("all"))
    often = vectors.join(sizes, "host").where(F.col("pages") >= SUPPORT * F.col("all")).select("host", "token", "class", "pages")
    valid = often.groupBy("host", "class").agg(F.count("*").alias("size")).where("size > 1")
    return often.join(valid.select("host", "class"), ["host", "class"])


def token(block: tuple) -> int:
    """The template token of a block: its text at its place."""
    return digest(f"{block[2].hash:x}={block[0]}")


def slot_text(slots: list[tuple]) -> list[tuple]:
    """Of the slots that a template leaves, those of the deepest element that still has nearly all
    the words outside links. What is mostly links goes at its ends, not in its middle."""
    weight: dict[int, list] = {}
    for text, _, path, linked in slots:
        entry = weight.setdefault(id(path), [path, 0])
        entry[1] += len(text.split()) - 2 * linked
    todo = sorted((e[0] for e in weight.values()), key=lambda p: -p.depth)
    at = 0
    while at < len(todo):  # deepest first: an element's words count for its parent too
        path = todo[at]
        at += 1
        parent = path.parent
        if parent is None:
            continue
        if id(parent) not in weight:
            weight[id(parent)] = [parent, 0]
            lo, hi = at, len(todo)
            while lo < hi:
                middle = (lo + hi) // 2
                lo, hi = (middle + 1, hi) if todo[middle].depth >= parent.depth else (lo, middle)
            todo.insert(lo, parent)
        weight[id(parent)][1] += weight[id(path)][1]
    whole = max((w for _, w in weight.values()), default=0)
    best = max((p for p, w in weight.values() if w >= 0.8 * whole), key=lambda p: (p.depth, p.key), default=None)
    if best is None:
        return []
    if best.name in ("p", "li", "h1", "h2", "h3") and best.parent is not None:
        best = best.parent
    under: dict[int, bool] = {id(best): True}

    def below(path: Path) -> bool:
        chain = []
        while path is not None and id(path) not in under:
            chain.append(path)
            path = path.parent
        found = path is not None and under[id(path)]
        for p in chain:
            under[id(p)] = found
        return found

    kept = [b for b in slots if below(b[2])]
    prose = [i for i, b in enumerate(kept) if 2 * b[3] <= len(b[0].split())]
    return kept[prose[0] : prose[-1] + 1] if prose else []


def main_text(source: str, fixed: set[int], firm: set[int] = frozenset()) -> str:
    """The main text of a page; fixed: the tokens of its host's template; firm: those of them
    that MARKED_PAGES pages have."""
    page = Page(source)
    inside = [b for b in page.blocks if b[1]]
    if inside:
        inside = [b for b in inside if token(b) not in firm] or inside
    if not inside or page.articles > 1:
        found = slot_text([b for b in page.blocks if token(b) not in fixed])
        words = lambda blocks: sum(len(b[0].split()) for b in blocks)
        # Several short articles beside a long text are teasers, not the page's article.
        if not inside or words(found) > 3 * words(inside):
            inside = found
    return "\n\n".join(b[0] for b in inside)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages.

    A null or empty html gives an empty text; a null url counts as a host without a name,
    its url stays null; hosts of under LEAST_PAGES pages have no template, and those of under
    MARKED_PAGES none inside marked articles; repeated rows stay; other columns are left out.
    """
    found = template(pages).groupBy("host").agg(F.collect_list("token").alias("fixed"), F.collect_list(F.when(F.col("pages") >= MARKED_PAGES, F.col("token"))).alias("firm"))  # no longer than twice a page
    found = Scratch(pages.sparkSession, "template").keep(found)  # read twice below
    size = found.agg(F.sum(F.size("fixed"))).first()[0] or 0
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.join(F.broadcast(found) if size <= MOST_BROADCAST else found, "host", "left").select("page_id", "url", "html", "fixed", "firm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 2 << 20):
            texts = []
            for source, *tokens in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                texts.append(main_text(source, *({t & (2**64 - 1) for t in known.as_py() or ()} for known in tokens)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
