"""Main text of web pages with the site's template removed.

A page is read into its elements. Every element is hashed with all it holds; Spark counts
on how many different pages of a host each hash stands, copies of one page counting once.
Subtrees that recur on many pages of their host are template and are deleted; inside an
article only those on nearly all pages of the host are. Around an article that holds most of
a page's text, subtrees are also hashed by their shape: place under the root, tags, class and
id names without digits, no words. A named shape that stands on most of those pages of the host is
template whatever its words are (adverts, notices), unless it holds a main heading.
Beside this, elements whose name, class or role says that they are no content (menus,
footers, adverts, forms, scripts, comments of readers, ...) are deleted wherever they stand,
as small hosts have nothing that recurs; class and id count by whole tokens, and not where an
article stands inside. ``deletions`` counts the blocks each rule deletes.

Pages are read twice, once to count and once to extract; the text of pages is only shuffled
where the list of pages with template is too large to broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from scorefold.llm.common import bounded, filled, table
from scorefold.llm.registry import query
from scorefold.session import cut_lineage

MIN_PAGES = 5  # different pages of a host on which a template subtree stands
SHAPE_SHARE = 0.8  # of the pages of a host whose article holds most of the text, for template shapes around it
ARTICLE_SHARE = 0.8  # of the pages of a host on which a template subtree inside articles stands
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|svg|iframe|object|select)(?=[\s/>])[^>]*(?<!/)>.*?</\2\s*>"
    r"|<[/!?]?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<",
    re.S | re.I,
)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(.*)>\Z", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
CLOSED_BY_BLOCK = {"p"}
CLOSED_BY_SAME = {"li", "dt", "dd", "tr", "td", "th", "option"}
MAIN = {"article", "main"}
UNTESTED = {"html", "body", *MAIN}  # their class says how the page is laid out
DROPPED_TAGS = set("nav footer aside form button dialog menu".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
DROPPED_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe "
    "subscription signup login comment comments commentlist disqus replies share sharing social related recommended widget toolbar "
    "pagination pager hidden adsbygoogle".split()
)
DOUBTFUL_WORDS = {"menu", "social"}  # may name content of an article when they stand alone
HEADER_WORDS = {"header", "topbar"}
#: Parts of a class token or id that leave the role of the rest as it is: site-footer, ad-slot, comment-list.
ROLE_PARTS = set("site page main top bottom global primary secondary area bar block box container inner item items link links list outer section slot unit wrap wrapper reader readers user users post posts thread button buttons form left right".split())
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


SMALL_THEN_CAPITAL = re.compile(r"(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"\d+")


def _role_like(token: str, roles: set[str]) -> bool:
    """Whether the token names one of the roles, alone or with parts that say nothing else."""
    parts = [x for x in re.split(r"[_-]+", token) if x]
    return token in roles or any(x in roles for x in parts) and all(x in roles or x in ROLE_PARTS for x in parts)


def _names(attributes: str) -> str:
    """The class and id names of an element in order, digits left out."""
    if "class" not in attributes.lower() and "id" not in attributes.lower():
        return ""
    found = [v.strip("\"'").lower().split() for n, v in ATTRIBUTE.findall(attributes) if n.lower() in ("class", "id")]
    return " ".join(sorted({DIGITS.sub("", x) for names in found for x in names}))


def _unwanted(tag: str, attributes: str, in_main: bool) -> str:
    """Why an element is no content: "sure", by "words" of its class or id, or "" if it may be content."""
    if tag in DROPPED_TAGS or tag == "header" and not in_main:
        return "sure"
    why = ""
    for name, value in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), value.strip("\"'")
        lower = value.lower()
        if name == "hidden" or name == "aria-hidden" and lower == "true":
            return "sure"
        if name == "style" and "display:none" in lower.replace(" ", ""):
            return "sure"
        if name == "role" and lower in DROPPED_ROLES:
            return "sure"
        if name in ("class", "id") and tag not in UNTESTED:
            roles = DROPPED_WORDS if in_main else DROPPED_WORDS | HEADER_WORDS
            for token in value.split():
                if in_main and token.lower() in DOUBTFUL_WORDS:
                    continue
                if _role_like(token.lower(), roles) or _role_like(SMALL_THEN_CAPITAL.sub("-", token).lower(), roles):
                    why = "words"
    return why


class Element:
    """An open or closed element.

    ``key`` is the hash of all it holds, ``inside`` tells whether it is part of an article.
    Of those around articles, ``place`` is the hash of tags and names from the root, ``below`` the
    hashes of tags and names it holds, and ``named`` tells whether it or what is around it has a
    class, an id or a tag that says its role and it holds neither an article nor a main heading.
    """

    __slots__ = ("key", "inside", "place", "below", "named")

    def __init__(self, key: int, inside: bool, place: int, named: bool):
        self.key, self.inside, self.place, self.named, self.below = key, inside, place, named, set()

    def signed(self) -> int:
        """The key as a signed number, odd inside an article, the second bit clear."""
        return _signed(self.key & ~3 | self.inside)

    def shape(self) -> int:
        """The hash of place and tags as a signed even number, the second bit set."""
        below = ",".join(map(str, sorted(self.below)))
        return _signed(xxhash.xxh64_intdigest(f"{self.place}:{below}") & ~3 | 2)


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


ARTICLE_PAGE = 2  # stands among the keys of a page whose article holds most of its text


def read_page(html: str, names: bool = True) -> tuple[list[tuple[str, list[int]]], list[int]]:
    """Blocks of kept text with the keys of the elements around them, and all keys of the page; without ``names`` no class or id drops."""
    blocks, keys = read_blocks(html, names)
    return [(text, around) for text, around, why in blocks if not why], keys


def read_blocks(html: str, names: bool = True, everything: bool = False) -> tuple[list[tuple[str, list[int], str]], list[int]]:
    """Blocks of text with the keys around them and the mark that drops them ("tag", "name" or ""), and all keys of the page.

    Blocks that a tag or role drops are only there with ``everything``.
    """
    # Tag, wanted, in the article, element, and the elements around that their class or id drops
    # unless an article or main text starts in them: [True] while dropped.
    stack: list[tuple[str, bool, bool, Element | None, tuple[list[bool], ...]]] = []
    elements: list[Element] = []
    blocks: list[tuple[str, list[Element], tuple[list[bool], ...], bool, bool]] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                main = bool(stack) and stack[-1][2]
                # Of an article only parts can be template, not what holds it.
                around = [e for _, _, _, e, _ in stack if e is not None and e.inside == main]
                blocks.append((text, around, stack[-1][4] if stack else (), main, not stack or stack[-1][1]))

    def holds() -> bool:
        """Whether text is held here: where it is wanted, or in a whole dropped block on demand."""
        return not stack or stack[-1][1] or everything and next(tag for tag, wanted, *_ in stack if not wanted) not in INLINE

    def close(tag: str) -> None:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == tag:
                del stack[depth:]
                return

    for token in TOKEN.finditer(html):
        text = token.group()
        if text[0] == "<" and len(text) > 1:
            if token.group(1) or token.group(2) or text[1] in "!?":
                continue
            parts = TAG.match(text)
            if not parts:
                continue
            shut, tag, rest = parts.group(1), parts.group(2).lower(), parts.group(3)
            if tag == "head":  # what may stand in a head is void or has been skipped; all else is of the body
                continue
            inline = tag in INLINE
            if tag == "br":
                held.append(" ") if holds() else None
                continue
            if not inline:
                flush()
            if tag in VOID:
                continue
            if shut:
                close(tag)
                continue
            if not inline and any(s[0] in CLOSED_BY_BLOCK for s in stack[-8:]):
                close("p")
            if tag in CLOSED_BY_SAME and stack and stack[-1][0] == tag:
                stack.pop()
            _, wanted, in_main, _, doubts = stack[-1] if stack else ("", True, False, None, ())
            inside = in_main
            why = _unwanted(tag, rest, in_main) if wanted else ""
            if why == "sure":
                wanted = False
            elif why and names:
                doubts = (*doubts, [True])
            if wanted and tag in MAIN:
                if not in_main:
                    for doubt in doubts:
                        doubt[0] = False
                if not any(d[0] for d in doubts):
                    in_main = True
            around = [e for _, _, _, e, _ in stack if e is not None and not e.inside] if not inside else []
            if not inline and (in_main or tag == "h1"):
                for e in around:
                    e.named = None
            element = None
            if not inline and tag not in ("html", "body") and in_main == inside:
                element = Element(xxhash.xxh64_intdigest(tag), inside, 0, None if tag == "h1" else False)
                if not inside:
                    own = _names(rest) if rest.strip() else ""
                    mark = xxhash.xxh64_intdigest(f"{tag} {own}")
                    element.place = xxhash.xxh64_intdigest(f"{around[-1].place if around else 0} {mark}")
                    if element.named is False:
                        element.named = bool(own or tag in DROPPED_TAGS or tag == "header" or around and around[-1].named)
                    for e in around:
                        e.below.add(mark)
                elements.append(element)
            for _, _, _, e, _ in stack:
                if e is not None:
                    e.key = (e.key * 0x100000001B3 + xxhash.xxh64_intdigest(tag)) & 0xFFFFFFFFFFFFFFFF
            if rest.endswith("/") and not inline:
                continue
            stack.append((tag, wanted, in_main, element, doubts))
        else:
            if holds():
                held.append(text)
            if stack and not text.isspace():
                mark = xxhash.xxh64_intdigest(" ".join(text.split()))
                for _, _, _, e, _ in stack:
                    if e is not None:
                        e.key = (e.key * 0x100000001B3 + mark) & 0xFFFFFFFFFFFFFFFF
    flush()
    out = []
    sizes = [0, 0]
    for text, around, doubts, main, wanted in blocks:
        why = "tag" if not wanted else "name" if any(d[0] for d in doubts) else ""
        out.append((text, [e.signed() for e in around], why))
        sizes[main] += len(text) * (wanted and (main or not why))
    keys = {e.signed() for e in elements}
    if sizes[True] > sizes[False]:
        keys |= {e.shape() for e in elements if e.named} | {ARTICLE_PAGE}
        for (_, found, _), (_, around, _, _, _) in zip(out, blocks):
            found += [e.shape() for e in around if e.named]
    return out, sorted(keys)


def parsed(
    df: DataFrame, html: str, url: str, keep: list[str], with_blocks: bool, names: bool = True, everything: bool = False
) -> DataFrame:
    """The kept columns with host, a hash of the whole page, and its blocks, or the keys around blocks and of all elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("keys", pa.list_(pa.int64())), ("why", pa.string())]))
        for batch in bounded(batches, "html", 2 << 20):
            blocks, keys, rows = [], [], []
            for page in batch.column("html").to_pylist():
                found, all_keys = read_blocks(page, names, everything)
                found = found if everything else [x for x in found if not x[2]]
                around = sorted({k for _, ks, _ in found for k in ks})
                whole = [{"text": t, "keys": k, "why": w} for t, k, w in found]
                blocks.append(whole if with_blocks else [{"text": None, "keys": around, "why": None}])
                keys.append([] if with_blocks else all_keys)
                rows.append(xxhash.xxh64_intdigest(page.encode("utf-8", "replace")) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(rows, pa.int64()), pa.array(blocks, kind), pa.array(keys, pa.list_(pa.int64()))],
                [*batch.schema.names[:-1], "page_hash", "blocks", "keys"],
            )

    host = F.lower(F.regexp_extract(filled(url), HOST, 1))
    rows = df.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), filled(html).alias("html"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, ddl + ", page_hash long, blocks array<struct<text:string,keys:array<long>,why:string>>, keys array<long>")


def subtrees(df: DataFrame, html: str = "html", url: str = "url", names: bool = True, everything: bool = False) -> DataFrame:
    """(host, page_hash, key, held) of the subtrees of different pages; held tells whether one holds a block that may be kept."""
    held = lambda k: F.struct(k.alias("key"), F.array_contains(F.col("blocks")[0]["keys"], k).alias("held"))
    rows = parsed(df, html, url, [], False, names, everything).select("host", "page_hash", F.explode(F.transform("keys", held)).alias("x"))
    return rows.select("host", "page_hash", "x.key", "x.held").distinct()


def templates(seen: DataFrame, least: int = MIN_PAGES, share: float = ARTICLE_SHARE, shape_share: float = SHAPE_SHARE) -> DataFrame:
    """(host, key) of the subtrees that are template.

    They stand on at least ``least`` different pages of the host. Inside an article they
    also stand on at least ``share`` of its different pages that have elements; those known by
    their shape on at least ``shape_share`` of its different pages whose article holds most of
    the text.
    """
    counted = seen.groupBy("host", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    page = F.col("key") == ARTICLE_PAGE
    pages = seen.groupBy("host", "page_hash").agg(F.max(page.cast("int")).alias("article"))
    hosts = pages.groupBy("host").agg(F.count("*").alias("all_pages"), F.sum("article").alias("article_pages"))
    bit = lambda b: F.col("key").bitwiseAND(F.lit(b)) != 0
    needed = F.when(bit(2), F.col("article_pages") * shape_share).when(bit(1), F.col("all_pages") * share).otherwise(0)
    return counted.where(~page).join(hosts, "host").where(F.col("pages") >= needed).select("host", "key")


def _with_hits(df: DataFrame, html: str, url: str, keep: list[str], least: int, names: bool, everything: bool = False) -> DataFrame:
    """The kept columns, host and blocks of each page, and the template keys around its blocks as ``gone``."""
    seen = cut_lineage(subtrees(df, html, url, names, everything), "subtrees")
    found = cut_lineage(templates(seen, least), "templates")
    hits = cut_lineage(
        seen.where("held").join(found, ["host", "key"]).groupBy("host", "page_hash").agg(F.collect_set("key").alias("gone")), "hits",
    )
    rows = parsed(df, html, url, keep, True, names, everything).join(hits, ["host", "page_hash"], "left")
    return rows.withColumn("gone", F.coalesce("gone", F.array().cast("array<long>")))


def extract(
    df: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", least: int = MIN_PAGES, names: bool = True
) -> DataFrame:
    """One row per page: key, url, text (empty if none), n_chars in code points.

    White space inside a block is one space; blocks are joined by line feeds in page
    order. Null html is an empty page, a null url the host without a name. Pages
    that repeat stay rows of their own and count once for the template. Without
    ``names`` no class or id drops an element, only recurrence, tags and roles do. Other
    columns are not read; an empty table gives an empty table.
    """
    keep = list(dict.fromkeys([key, url]))
    rows = _with_hits(df, html, url, keep, least, names)
    stay = F.filter("blocks", lambda b: ~F.arrays_overlap(b["keys"], F.col("gone")))
    text = F.array_join(F.transform(stay, lambda b: b["text"]), "\n")
    return rows.select(*[F.col(f"`{c}`") for c in keep], text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def deletions(df: DataFrame, html: str = "html", url: str = "url", least: int = MIN_PAGES) -> DataFrame:
    """(host, rule, blocks): how many blocks of text each rule deletes, the first that applies counting.

    The rules are, in this order, "words" (recurring subtrees), "shape" (recurring
    shapes around articles), "tag" and "name" (marks of elements); "" are the blocks that stay.
    """
    rows = _with_hits(df, html, url, [], least, True, True).select("host", "gone", F.explode("blocks").alias("b"))
    shapes = F.filter("gone", lambda k: k.bitwiseAND(F.lit(2)) != 0)
    words = F.filter("gone", lambda k: k.bitwiseAND(F.lit(2)) == 0)
    rule = F.when(F.arrays_overlap("b.keys", words), "words").when(F.arrays_overlap("b.keys", shapes), "shape").otherwise(F.col("b.why"))
    return rows.groupBy("host", rule.alias("rule")).agg(F.count("*").alias("blocks"))


@query("op4_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
