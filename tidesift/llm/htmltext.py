"""Main text of web pages by a site style tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stash

#: Attributes up to the tag's end: only after an equals sign does a quote hide a >. Each character is read once.
ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"?+|'[^']*+'?+)?+)*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)\b[^>]*+(?<=/)>"
    rf"|<(?P<raw>script|style|noscript|template|iframe|textarea|title|xmp|svg|math)\b{ATTRS}(?:>|\Z).*?(?:</(?P=raw)\s*+>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{ATTRS})(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Elements by what they do in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset("head nav header footer aside button select option menu dialog object audio video canvas map fieldset legend datalist".split())
MAIN = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements nested deeper are taken for siblings, as browsers limit nesting too; so a page takes time in proportion to its length.
DEPTH = 256
NOISE_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice banner ad ads advert adverts advertisement "
    "sponsor sponsored promo promotion comment comments disqus reply replies share sharing social related recommended newsletter subscribe signup login search popup modal "
    "overlay pagination pager skip toolbar contentinfo complementary".split()
)
#: Last parts of names that leave what stands before them its role (share-buttons), and first parts that name a state of
#: something larger (has-sidebar).
PLAIN_PARTS = frozenset("area articles bar block box button buttons container form inner item items left links list main outer panel posts right section slot stories top bottom unit wrap wrapper".split())
STATES = frozenset("has is no with without".split())


def names_noise(name: str) -> bool:
    """Whether a class, id or role names an element that isn't content: as a whole or by its last telling part."""
    parts = [x for x in re.split(r"[-_]+", name) if x and not x.isdigit()]
    if name in NOISE_NAMES:
        return True
    if not parts or parts[0] in STATES:
        return False
    while len(parts) > 1 and parts[-1] in PLAIN_PARTS:
        parts.pop()
    return parts[-1] in NOISE_NAMES


@dataclass(frozen=True)
class Block:
    """A block of text: nodes and names of its branch from the root, and what its elements are.

    noise is 2 in an element that is noise by its tag or, in an article, by its name, 1 in one that is so by name alone outside of
    articles, else 0. main is -1 in a main element, the number of the outermost article in one, else 0.
    """

    nodes: tuple[int, ...]
    name: str
    noise: int
    main: int
    form: bool
    text: str


@dataclass(slots=True)
class _Open:
    tag: str
    name: str
    node: int
    noise: int
    main: int
    form: bool
    header: bool


def blocks(page: str) -> Iterator[Block]:
    """The blocks of text in page order, their white space evened and references decoded."""
    stack: list[_Open] = []
    open_: Counter = Counter()
    articles = 0
    parts: list[str] = []

    def pop() -> None:
        open_[stack.pop().tag] -= 1

    def flush() -> Iterator[Block]:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                own = [x for x in stack if x.tag not in INLINE]
                top = stack[-1] if stack else _Open("", "", 0, 0, 0, False, False)
                yield Block(tuple(x.node for x in own), own[-1].name if own else "", top.noise, top.main, top.form, text)

    for m in TOKEN.finditer(page):
        if m["text"] is not None:
            parts.append(m["text"])
            continue
        if m["tag"] is None:
            if m["raw"] is not None and m["raw"].lower() not in ("svg", "math"):
                yield from flush()
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag in INLINE:
                # an inline end closes its own element only within the block
                k = len(stack) - 1
                while open_[tag] and k >= 0 and stack[k].tag in INLINE and stack[k].tag != tag:
                    k -= 1
                if open_[tag] and k >= 0 and stack[k].tag == tag:
                    del stack[k]
                    open_[tag] -= 1
                continue
            yield from flush()
            if open_[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag not in INLINE:
            yield from flush()
            while stack and stack[-1].tag in INLINE:
                pop()
            if stack and stack[-1].tag == "p" and tag != "br":
                pop()
            if tag in ("li", "dt", "dd", "tr", "td", "th") and stack and (stack[-1].tag == tag or {stack[-1].tag, tag} <= {"dt", "dd"} or {stack[-1].tag, tag} <= {"td", "th"}):
                pop()
        if tag in VOID:
            continue
        if len(stack) >= DEPTH:
            if tag in INLINE:
                continue
            pop()
        words = [w for found in NAMES.findall(m["attrs"] or "") for w in " ".join(found).lower().split()]
        above = stack[-1] if stack else _Open("", "", 0, 0, 0, False, False)
        role = 2 if tag in NOISE else 0
        if not role and tag not in MAIN and tag not in ("html", "body") and any(map(names_noise, words)):
            role = 2 if above.main else 1
        # an article's own header holds its title
        header = above.header or bool(role and above.main and not above.noise and (tag == "header" or any(w.endswith("header") for w in words)))
        noise = 0 if above.header and tag in HEADINGS else max(above.noise, role)
        articles += tag == "article"
        name = ".".join([tag, *sorted(re.sub(r"\d+", "0", w) for w in words)])
        node = above.node if tag in INLINE else _code(str(above.node), name)
        stack.append(_Open(tag, name, node, noise, above.main or (articles if tag == "article" else -1 if tag == "main" else 0), (above.form or tag == "form") and tag not in MAIN, header and tag not in HEADINGS))
        open_[tag] += 1
    yield from flush()


def _code(*parts: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\x00".join(parts)) - 2**63


def host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def style_tree(pages: DataFrame, gamma: float = 0.9) -> DataFrame:
    """host, node, pages, importance: the nodes of each host's merged tree.

    A leaf's content importance is 1 less the mean entropy of its texts over the host's pages, to the base of its
    pages: a text on all of them has 1, one on a single page 0. Above leaves, gamma weighs the importance of what is below
    against a node's own, the entropy of the shapes (child sequences) it takes. Texts and shapes of a node are summed up in each
    task before they move and before they meet its pages, so a host with a third of all pages is no task of its own.
    """

    def each(batches):
        for batch in batches:
            rows: list[tuple[str, int, int, int]] = []
            for at, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                found: set[tuple[int, int, int]] = set()
                children: dict[int, list[int]] = {}
                for block in blocks(page.as_py()):
                    nodes = block.nodes
                    for k, node in enumerate(nodes[:-1]):
                        below = children.setdefault(node, [])
                        if not below or below[-1] != nodes[k + 1]:
                            below.append(nodes[k + 1])
                    if nodes:
                        found.add((0, nodes[-1], _code(block.text)))
                        found.update((2, node, nodes[-1]) for node in nodes)
                found.update((1, node, _code(*map(str, below))) for node, below in children.items())
                rows += [(at, *x) for x in found]
            c = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, (pa.string(), pa.int8(), pa.int64(), pa.int64()), strict=True)], names=["host", "kind", "node", "value"])

    seen = pages.mapInArrow(each, "host string, kind byte, node long, value long").groupBy("host", "kind", "node", "value").agg(F.count("*").alias("n"))
    seen = stash(seen)
    n = F.col("n")
    size = seen.where("kind = 2").groupBy("host", "node").agg(F.max("n").alias("pages"))
    leaf = seen.where("kind = 0").groupBy("host", "node").agg(F.avg(F.log("n")).alias("content"))
    shape = seen.where("kind = 1").groupBy("host", "node").agg(F.sum(n * F.log("n")).alias("a"), F.sum("n").alias("b"))
    base, pages_ = F.log(F.greatest("pages", F.lit(2))), F.col("pages")
    leaf = leaf.join(size, ["host", "node"]).select("host", F.col("node").alias("leaf"), (1 - F.col("content") / base).alias("content"))
    below = seen.where("kind = 2").select("host", "node", F.col("value").alias("leaf"), "n").join(leaf, ["host", "leaf"])
    below = below.groupBy("host", "node").agg((F.sum(n * F.col("content")) / F.sum("n")).alias("content"))
    out = size.join(below, ["host", "node"], "left").join(shape, ["host", "node"], "left")
    entropy = (F.col("b") * F.log("pages") - F.col("a")) / pages_ / base
    own = F.when(pages_ > 1, F.least(entropy, F.lit(1.0))).otherwise(F.lit(1.0))
    importance = F.when(F.col("a").isNull(), F.col("content")).otherwise((1 - gamma) * own + gamma * F.coalesce("content", F.lit(1.0)))
    return out.select("host", "node", "pages", importance.alias("importance"))


def _length(found: list[Block]) -> int:
    return sum(len(x.text) for x in found)


def main_text(page: str, low: frozenset[int] | set[int]) -> str:
    """The text of a page less branches that play no part in its content.

    Branches go that are navigation, headers, footers, sidebars, notices, adverts, forms or comments by element or name,
    and those of low importance on their host. With an article or main element only what is in it counts, unless that is a
    teaser beside a text four times as long; plain paragraphs and headings there stand, also where a host's pages are
    copies, as do headings of an article's own header. What would leave nothing isn't applied.
    A name takes no main element with it, nor the only article of a page, as such elements are the page's layout; of
    several articles those below names (comments, teasers) go, unless nothing is left. A form around an article or most of a
    page's text is layout too.
    """
    all_ = [x for x in blocks(page) if x.noise < 2]
    inside = [x for x in all_ if x.form and not x.noise]
    if _length(inside) <= max(400, 2 * _length([x for x in all_ if not x.form and not x.noise])):
        all_ = [x for x in all_ if not x.form]
    found = [x for x in all_ if not x.noise]
    named = [x for x in all_ if x.noise and x.main]
    if any(x.main for x in found):
        within = [x for x in found if x.main]
        found = within if 4 * _length(within) >= _length(found) - _length(within) else found
    elif any(x.main < 0 for x in named):
        found = [x for x in named if x.main < 0]
    elif len({x.main for x in named}) == 1:
        found = named
    elif not found:
        found = named or all_
    if low:
        kept = [x for x in found if (x.main and re.fullmatch("article|main|p|h[1-6]|li|blockquote|pre|td|th|dd|dt", x.name)) or low.isdisjoint(x.nodes)]
        found = kept or found
    return " ".join(x.text for x in found)


def extract(pages: DataFrame, least_pages: int = 2, least_importance: float = 0.2, broadcast_rows: int = 200_000) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html).

    The whole html is read, in time proportional to its length however it is nested or broken. Null and empty pages give an
    empty text, a null or odd url the host without a name; repeated rows count as pages of their own; other columns aren't read,
    whatever their names; an empty table gives no rows. Only nodes of low importance come back to the pages, a list for each
    host, which is as long as its template has such branches; it is broadcast if it was counted to be small.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("host", host())
    low = style_tree(own.select("host", "html")).where((F.col("pages") >= least_pages) & (F.col("importance") < least_importance))
    low = stash(low.groupBy("host").agg(F.collect_set("node").alias("low")).withColumnRenamed("host", "_host"))
    small = (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= broadcast_rows
    rows = own.join(F.broadcast(low) if small else low, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "low")

    def each(batches):
        for batch in batches:
            texts = [main_text(p.as_py(), frozenset(l.as_py() or ())) for p, l in zip(batch.column("html"), batch.column("low"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = own.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"page_id {kind}, url string, text string, n_chars long")
