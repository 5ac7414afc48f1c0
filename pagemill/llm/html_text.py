"""Main text of web pages by equivalence classes of tokens across the pages of a host.

A page is a sequence of tokens: block tags and words, each told apart by its role, which is the path of block elements
around it. The occurrence vector of a token says how often each page of the host has it. Tokens with the same vector
form an equivalence class (Arasu and Garcia-Molina, 2003). Classes that are large (MIN_SIZE tokens) and frequent (at least MIN_PAGES
pages and MIN_SHARE of the host's) come from the template. On a page a class is valid if its tokens stand there in
the order they have on the host, over and over; valid classes are nested into one template, larger ones outside, smaller
ones broken up by the gaps they stand in. Tokens are 64-bit hashes, and a vector is a 64-bit signature, the exclusive or over pages
of a hash of page and count, so that vectors are compared by an aggregation with partial results.

Copies are no evidence for a template: pages of a host that give the same text by roles alone are folded into one before
anything is counted, the one of the least digest, so no page enters a signature twice. A task passes a page on only if its digest
is less than that of the copies it has seen, so a text with very many copies does not meet in one task.

Pages are counted in groups: a host of up to CHUNK pages is one, and is settled there; a larger one is dealt by hash over as many
groups as it needs. Of a group of SURE pages and more, tokens on less than LEAST of its pages are not passed on: a token on MIN_SHARE of
the host's pages falls below that in such a group with a probability under 1e-17, less than that of two tokens sharing a hash.

What lies between template tokens are the slots: a block with a word that is not the template's is taken whole, and blocks
of template words alone are the template's own text and are dropped, inside of an article element too. Roles are a filter
on the slots: one is extracted unless its role says that it is not the article: navigation, footers, sidebars, adverts,
notices, forms, comments and the like, by element, ARIA role, class or id. If the page marks an article or main element,
slots outside of it are dropped. Hosts with too few pages have no template; roles alone decide there.

Defined results: null and empty html give an empty text, and an empty table no rows; character references are decoded; a page that
breaks off keeps what it has; urls without a host share one template; null ids and repeated rows come out as they are, and a repeated row
changes no template; very long pages and deep nesting cost time and memory in proportion to the page; columns other than the three
named are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm._spark import Scratch, short_batches, sorted_groups

MIN_PAGES, MIN_SHARE, MIN_SIZE = 4, 0.6, 3
#: Pages of a group; the most hosts that are dealt over several; pages that make a share in a group telling, and that share.
CHUNK, HOSTS, SURE, LEAST = 512, 100_000, 128, 0.2
#: Copies of texts that a task remembers; what it forgets costs a row more, no more.
COPIES = 500_000
#: Templates up to this size in all are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CLASS = re.compile(r"""\bclass\s*=\s*["']?([\w-]+)""")
_RAW = {name: re.compile(rf"</{name}\s*>|\Z", re.I) for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}

# Elements that begin a block, that have no content, and that are no part of an article.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - set("html head body td th tr tbody thead tfoot caption".split())
APART = set("aside audio button canvas datalist dialog fieldset footer form head iframe input label menu nav noembed noframes noscript object option script select style svg template textarea title video xmp".split())
MAIN = {"article", "main"}
#: What an element of these ends if it stands directly inside of it.
SIBLINGS = {"li": {"li"}, "tr": {"tr"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Words of a class, an id or a role that mark what is no part of an article.
NAMES = set("""ad ads adv advert adverts advertisement advertising alert announcement aside banner breadcrumb breadcrumbs byline comment commentlist
comments complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus donate feedback footer gdpr header hidden
login masthead menu menus message modal nav navbar navigation navlinks newsletter notice notices notification overlay pager pagination paywall popular popup
privacy promo promoted promotion recommended related replies reply respond responses rss search share sharing sidebar signup skip skyscraper
social sponsor sponsored subscribe subscription tagcloud teaser toolbar topbar trending warning widget widgets""".split())


# Words after which, or before which, a name says how the page is laid out, and words for places.
BEFORE = set("has have no non not with without".split())
AFTER = set("active allowed closed disabled enabled free inactive off on open".split())
PLACES = set("area bar bottom box block button buttons center col column container group holder icon inner item items left line lines link links list outer panel primary right row secondary section slot top unit wrap wrapper zone".split())


class Block(NamedTuple):
    text: str
    apart: bool
    main: bool


class Page(NamedTuple):
    words: list[str]  # and marks of block tags, in page order
    runs: list[tuple[int, int]]  # role and number of these
    blocks: list[tuple[Block, int, int]]  # with their span in words

    def tokens(self) -> np.ndarray:
        """Hashes of block tags and words by role."""
        n = len(self.runs)
        roles = np.repeat(np.fromiter((r for r, _ in self.runs), np.uint64, n), np.fromiter((k for _, k in self.runs), np.int64, n))
        return mixed(np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words)), roles)

    def digest(self) -> bytes:
        return hashlib.blake2b("\n".join([*self.words, *map(str, self.runs)]).encode("utf-8", "surrogatepass"), digest_size=16).digest()


@lru_cache(4096)
def _named(value: str, inside_main: bool) -> int:
    """What the words of a class, an id or a role say: 2, no part of an article; 1, perhaps none; 0, nothing."""
    found = 0
    for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
        words = [w for w in re.split(r"[_-]+", token) if w]
        if inside_main and {*words} & {"header", "byline"}:
            return 0
        words = words[: next((i for i, w in enumerate(words) if w in BEFORE), len(words))]
        names = [w in NAMES and not (i + 1 < len(words) and words[i + 1] in AFTER) for i, w in enumerate(words)]
        while words and len(words) > 1 and (words[-1] in PLACES or words[-1].isdigit()):
            words.pop()
        if any(names):
            found = max(found, 2 if names[len(words) - 1] else 1)
    return found


def _apart(name: str, attributes: str, inside_main: bool) -> tuple[bool, int]:
    """Whether the element is no part of an article, and what its names say."""
    if name in APART or name == "header" and not inside_main:
        return True, 0
    if not attributes:
        return False, 0
    named = 0
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role"):
            named = max(named, _named(value, inside_main))
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, 0
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, 0
    return False, 0 if name in ("html", "body") else named


class Element(NamedTuple):
    name: str
    role: int  # hash of the path of elements, each with its class
    apart: bool
    main: bool  # inside an article or main element
    article: bool  # inside an article
    mark: int  # the innermost name around it that may cut it off, as a place in the list of them
    holder: int  # the innermost main element, likewise


class Mark(NamedTuple):
    sure: bool
    outer: int  # the next mark around it, or -1


def _chain(marks: list[Mark], k: int) -> Iterator[int]:
    while k >= 0:
        yield k
        k = marks[k].outer


def _cutting(marks: list[Mark], blocks: list[tuple[int, int]], articles: list[tuple[int, bool]], mains: list[list]) -> list[bool]:
    """For each mark whether it, or one around it, cuts off what it stands on. ``blocks``: mark and words, of those that no element sets apart.

    A name that only may be meant so cuts off no more than half of the words; no name cuts off the page's only articles.
    """
    total, held = sum(n for _, n in blocks), [0] * len(marks)
    for k, n in blocks:
        if k >= 0:
            held[k] += n
    for k in range(len(marks) - 1, -1, -1):  # a mark stands behind those around it
        if marks[k].outer >= 0:
            held[marks[k].outer] += held[k]
    cutting = [mark.sure or 2 * n <= total for mark, n in zip(marks, held)]
    found = [k for k, own in articles if not own] + [k for k, holds in mains if not holds] or [k for k, _ in articles]
    if found:
        left = [[j for j in _chain(marks, k) if cutting[j]] for k in found]
        least = min(map(len, left))
        for chain in left:
            if len(chain) == least:
                for j in chain:
                    cutting[j] = False
    for k, mark in enumerate(marks):
        cutting[k] = cutting[k] or mark.outer >= 0 and cutting[mark.outer]
    return cutting


#: Stand for a block's beginning and end among the words of a page; no word holds a space.
OPEN, CLOSE = "< ", "> "


def mixed(words: np.ndarray, roles: np.ndarray) -> np.ndarray:
    """Hashes of tokens from those of words and roles."""
    x = (words ^ roles) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)).view(np.int64)


def parse(source: str) -> Page:
    words: list[str] = []
    runs: list[tuple[int, int]] = []  # role and number of words
    blocks: list[tuple[str, Element, int, int]] = []
    outside = Element("", 0, False, False, False, -1, -1)
    stack: list[Element] = []
    open_: Counter[str] = Counter()
    marks: list[Mark] = []
    articles: list[tuple[int, bool]] = []  # mark, and whether it is its own; none inside another or set apart
    mains: list[list] = []  # mark, and whether an article is inside
    pending: list[str] = []
    inline: list[tuple[str, int]] = []  # open elements without a block of their own from one that is no part of an article; blocks around each

    def flush() -> None:
        found = "".join(pending).split()
        pending.clear()
        if found:
            around = stack[-1] if stack else outside
            at = len(words)
            words.extend(found)
            runs.append((around.role, len(found)))
            blocks.append((" ".join(found), around, at, len(words)))

    def leave(to: int) -> None:
        for element in stack[to:]:
            open_[element.name] -= 1
        del stack[to:]
        while inline and inline[-1][1] > to:
            inline.pop()

    at, end = 0, len(source)
    match = _TOKEN.match
    while at < end:
        m = match(source, at)
        at = m.end()
        close, name, attributes = m.group(1, 2, 3)
        if name is None:
            if not inline:
                text = m.group(0)
                if not text.startswith(("<!", "<?")):
                    pending.append(htmllib.unescape(text) if "&" in text else text)
            continue
        name = name.lower()
        if not close and name in _RAW:
            at = _RAW[name].search(source, at).end()
            pending.append(" ")
            continue
        if name == "br":
            pending.append(" ")
        if name in BLOCKS:
            flush()
            if close:
                if open_[name] > 0:
                    found = len(stack) - 1
                    while stack[found].name != name:
                        found -= 1
                    words.append(CLOSE)
                    runs.append((stack[-1].role, 1))
                    leave(found)
            else:
                if stack and stack[-1].name == "p" and name in CLOSES_P:
                    leave(len(stack) - 1)
                if stack and stack[-1].name in SIBLINGS.get(name, ()):
                    leave(len(stack) - 1)
                if name not in VOID:
                    around = stack[-1] if stack else outside
                    label = _CLASS.search(attributes) if attributes else None
                    apart, named = _apart(name, attributes, around.main)
                    apart = apart or around.apart
                    mark, holder = around.mark, around.holder
                    if named:
                        marks.append(Mark(named == 2, mark))
                        mark = len(marks) - 1
                    if name == "article" and not apart and not around.article:
                        articles.append((mark, bool(named)))
                        if holder >= 0 and not named:
                            mains[holder][1] = True
                    elif name == "main" and not apart:
                        holder = len(mains)
                        mains.append([mark, False])
                    role = xxhash.xxh64_intdigest(f"{name}.{label.group(1)}" if label else name, around.role)
                    stack.append(Element(name, role, apart, around.main or name in MAIN, around.article or name == "article", mark, holder))
                    open_[name] += 1
                    words.append(OPEN)
                    runs.append((role, 1))
        elif name not in VOID:
            # such elements cut no text, but some hold no part of the article; one that is left open ends with the block around it
            if not close:
                if inline or any(_apart(name, attributes, True)):
                    inline.append((name, len(stack)))
            elif inline:
                for k in range(len(inline) - 1, -1, -1):
                    if inline[k][0] == name:
                        del inline[k:]
                        break
    flush()
    cutting = _cutting(marks, [(e.mark, b - a) for _, e, a, b in blocks if not e.apart], articles, mains) if marks else []
    return Page(words, runs, [(Block(text, e.apart or e.mark >= 0 and cutting[e.mark], e.main), a, b) for text, e, a, b in blocks])


def host_of(url):
    """The host of a url as a column; without one, an empty text."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page whose digest is the least so far of its copies: its host, digests of the text that roles alone give and of its tokens, the page compressed."""
    packed, least = zstandard.ZstdCompressor(3).compress, {}
    for batch in batches:
        rows = []
        for host, source in zip(*(batch.column(i).to_pylist() for i in range(2))):
            page = parse(source or "")
            text = hashlib.blake2b(main_text(page, []).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            whole = page.digest()
            if len(least) >= COPIES:
                least.clear()
            if whole < least.get((host, text), b"\xff" * 17):
                least[host, text] = whole
                rows.append((host, text, whole, packed((source or "").encode("utf-8", "surrogatepass"))))
        kinds = pa.string(), *[pa.binary()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], ["host", "article", "whole", "page"])


def vectors(pages: list[tuple[bytes, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """From (digest, tokens) of pages: the distinct tokens; pages, signature of the occurrence vector and sum of ranks by first place of each."""
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0

    def reduced() -> tuple[np.ndarray, ...]:
        tokens, n, marks, ranks = map(np.concatenate, zip(*parts))
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        return tokens[starts], np.add.reduceat(n[order], starts), np.bitwise_xor.reduceat(marks[order], starts), np.add.reduceat(ranks[order], starts)

    for digest, tokens in pages:
        if not len(tokens):
            continue
        distinct, first, counts = np.unique(tokens, return_index=True, return_counts=True)
        ranks = np.empty(len(first), np.int64)
        ranks[np.argsort(first)] = np.arange(len(first))
        own = np.full(len(distinct), int.from_bytes(digest[:8], "little"), np.uint64)
        parts.append((distinct, np.ones(len(distinct), np.int64), mixed(counts.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), own), ranks))
        held += len(distinct)
        if held > 2_000_000:
            parts = [reduced()]
            held = len(parts[0][0])
    return reduced() if parts else (np.zeros(0, np.int64),) * 4


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token of each group: pages, signature, sum of ranks. A null token counts the pages."""
    unpacked = zstandard.ZstdDecompressor().decompress
    for (host, _, buckets), group in sorted_groups(batches, ["host", "bucket", "buckets"]):
        least: dict[bytes, tuple[bytes, int]] = {}
        for k, (article, whole) in enumerate(zip(group.column("article").to_pylist(), group.column("whole").to_pylist())):
            if article not in least or whole < least[article][0]:
                least[article] = whole, k
        sources = group.column("page")
        tokens, pages, marks, places = vectors([(whole, parse(unpacked(sources[k].as_py()).decode("utf-8", "surrogatepass")).tokens()) for whole, k in least.values()])
        n = len(least)
        keep = pages >= (max(MIN_PAGES, MIN_SHARE * n) if buckets == 1 else LEAST * n if n >= SURE else 1)
        columns = [np.append(x[keep], y) for x, y in ((tokens, 0), (pages, n), (marks, 0), (places, 0))]
        null = np.zeros(len(columns[0]), bool)
        null[-1] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array([host] * len(null), pa.string()), pa.array(columns[0], pa.int64(), mask=null), *(pa.array(c, pa.int64()) for c in columns[1:])],
            ["host", "token", "pages", "signature", "places"],
        )


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, and its template: classes of tokens (hashes) in order of their mean place, larger classes first. Hosts without a template are absent.

    A host's template has at most 1 / MIN_SHARE times as many tokens as its pages have on average.
    """
    # HOSTS rows at most; if more hosts are larger than CHUNK, the smaller of them are one group each
    large = scratch.save(
        pages.groupBy("host").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CHUNK).orderBy(F.desc("_n"), "host").limit(HOSTS)
        .select("host", F.ceil(F.col("_n") / CHUNK).cast("long").alias("buckets"))
    )
    dealt = (
        pages.mapInArrow(_folded, "host string, article binary, whole binary, page binary").join(F.broadcast(large), "host", "left")
        .withColumn("buckets", F.coalesce("buckets", F.lit(1))).withColumn("bucket", F.pmod(F.xxhash64("article"), "buckets"))
    )
    group = ["host", "bucket", "buckets"]
    tokens = scratch.save(
        dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_vectors, "host string, token long, pages long, signature long, places long")
        .groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.bit_xor("signature").alias("signature"), F.sum("places").alias("places"))
        .where(F.col("token").isNull() | (F.col("pages") >= MIN_PAGES))
    )
    size = tokens.where("token is null").select("host", F.col("pages").alias("all"))
    frequent = tokens.where("token is not null").join(size, "host").where(F.col("pages") >= MIN_SHARE * F.col("all"))
    large_classes = frequent.groupBy("host", "signature", "pages").agg(F.collect_list(F.struct((F.col("places") / F.col("pages")).alias("place"), "token")).alias("members")).where(F.size("members") >= MIN_SIZE)
    # larger classes first, then by place, so that the order is the same in every run
    ranked = large_classes.select("host", F.struct((-F.size("members")).alias("size"), F.array_sort("members").alias("members")).alias("class"))
    template = F.transform(F.array_sort(F.collect_list("class")), lambda c: c["members"]["token"])
    return ranked.groupBy("host").agg(template.alias("template"))


def nested_places(tokens: list, classes: list[list]) -> set[int]:
    """Where on this page the tokens of its template stand: the valid classes, nested into one another.

    A class is valid if its tokens stand here in the class's order, over and over. Larger classes come first. A smaller one is
    broken up where tokens of the template stand between its own; a token of it belongs to the template if all its
    occurrences stand in the same gap, between the same two tokens of the same class or part.
    """
    wanted = {t for members in classes for t in members}
    where: dict = {}
    for at, t in enumerate(tokens):
        if t in wanted:
            where.setdefault(t, []).append(at)
    places: list[int] = []  # of the template so far, ascending
    gaps: list[tuple | None] = []  # the gap that begins behind each
    parts = 0
    for members in sorted(classes, key=len, reverse=True):
        spots = [where.get(t, ()) for t in members]
        n = len(spots[0])
        if not n or any(len(s) != n for s in spots):
            continue
        flat = [s[r] for r in range(n) for s in spots]
        if any(a >= b for a, b in zip(flat, flat[1:])):
            continue
        ranks = [[bisect_left(places, at) for at in s] for s in spots]
        around = [{gaps[r - 1] if r else None for r in s} for s in ranks]
        new: list[tuple[int, tuple | None]] = []
        i = 0
        while i < len(members):
            j = i + 1
            if len(around[i]) == 1:
                while j < len(members) and ranks[j] == ranks[i]:
                    j += 1
                (outer,) = around[i]
                for k in range(i, j):
                    gap = outer if k == j - 1 else (parts, k)
                    new += [(at, gap) for at in spots[k]]
                parts += 1
            i = j
        if new:
            both = sorted([*zip(places, gaps), *new], key=lambda x: x[0])
            places, gaps = [x[0] for x in both], [x[1] for x in both]
    return {*places}


def valid_tokens(tokens: list, classes: list[list]) -> set:
    """The tokens of the page's nested template."""
    return {tokens[at] for at in nested_places(tokens, classes)}


def main_text(source: str | Page | None, classes: list[list[int]]) -> str:
    page = source if isinstance(source, Page) else parse(source or "")
    template = nested_places(page.tokens().tolist(), classes) if classes else set()
    marked = any(b.main and not b.apart for b, _, _ in page.blocks)
    # slots first: blocks with a word that is not the template's; roles then say which slots are the article
    slots = [block for block, a, b in page.blocks if not (template and template.issuperset(range(a, b)))]
    return "\n\n".join(block.text for block in slots if not block.apart and (block.main or not marked))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list] = {}
    for batch in batches:
        texts = []
        hosts, sources, found = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
        for i, (host, source) in enumerate(zip(hosts, sources)):
            if host not in known:
                if len(known) >= 1000:
                    known.clear()
                known[host] = found[i].as_py() or []
            texts.append(main_text(source, known[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["_id", "_url", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: the id, the url, text and n_chars."""
    short_batches(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "html-text")
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("_html"))
    found = scratch.save(templates(rows.select("host", "_html"), scratch))
    weight = found.agg(F.sum(F.size(F.flatten("template")) * 8 + 100)).first()[0] or 0
    joined = rows.join(F.broadcast(found) if weight <= BROADCAST_BYTES else found, "host", "left").select("_id", "_url", "host", "_html", "template")
    texts = joined.mapInArrow(_extract, f"_id {kind}, _url string, text string")
    return texts.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
