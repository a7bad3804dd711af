"""The main text of web pages, by removing site templates.

The subtrees of a page's elements are hashed (names, classes and text, white space folded), over the whole page: navigation,
headers and footers as well as the paragraphs and headings of articles. Spark counts on how many pages of a host each hash
occurs; subtrees that occur on many of them are the site's template and are deleted. Lists of links, whose words may change
from page to page, are counted by their shape as well: names and classes without the text, of equal entries in a row one. `n_template` says how many
subtrees were deleted.

What marks itself as no part of the article goes too, so that pages of hosts with few pages are cleaned as well, and adverts
that change from page to page: by element (navigation, headers and footers outside the article, asides, forms and so on),
role, or words in class and id (menus, sidebars, notices, adverts, comments). Inside an article or main element one class or id
marks only if it has no word of another kind: `share` and `share-buttons` do, `share-price` does not.

A page's article elements, and paragraphs that stand beside them, are read alone if the articles hold half of its text or
more, else its main element if that does, else the whole page; what is marked or template does not count.

Text is cut into blocks at block elements. Character references are decoded, white space inside a block becomes one
space, blocks are trimmed, empty ones are left out, and the others are joined in page order by a newline. A line break
inside a block is white space.

A subtree is template of a host, or of one section of it (the first part of the url's path, if more follows), when it
occurs on at least LEAST_PAGES pages of the host or section and on at least a share of them: SHARE, and more for prose, which is headings and, within an article or main element, paragraphs, list items and the like, for a
passage that many articles quote is part of each of them. Prose is template on PROSE_SHARE of the pages, or on EDGE_SHARE
of them where it is among the first or last EDGE pieces of prose of its article, as notices are. A shape is template on
EDGE_SHARE of the pages of a host; it is that of an element that holds two links or more and most of whose text is linked. In a section, where fewer pages
meet by chance, what is no box needs EDGE_SHARE, and prose PROSE_SHARE and twice LEAST_PAGES. Whatever the share, a box
is template on MANY_PAGES pages of the host: an element other than prose and lone paragraphs, list items and table rows that
holds a link or several pieces of prose. Subtrees of any length are candidates; inline elements are not. Pages of one whole
main text count as one page (copies of an article are no template).

Defined cases: a null or empty page gives an empty text; a null or odd url is a host of its own, ''. Pages of any length and
depth are read whole, in time that grows with their length. Repeated rows each give a row. An empty table gives an empty
table; extra columns are ignored. Nothing is dropped by length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mapped, small, table
from .htmltree import Node, parse

#: A subtree on so many pages of a host, and on this share of its pages, is template.
LEAST_PAGES = 5
SHARE = 0.3
#: Shares for prose: anywhere, and among so many pieces of prose from either end of the article.
PROSE_SHARE = 0.8
EDGE_SHARE = 0.5
EDGE = 2
#: Kinds of subtrees, kept in the lowest bits of their hashes.
PLAIN, BOX, PROSE, AT_EDGE, SHAPE = range(5)
KINDS = 7
#: Stands for every page itself among the hashes.
PAGE = 0
#: A box on so many pages of a host is template whatever their share.
MANY_PAGES = 100
#: Article or main elements are read alone if they hold this share of the page's text.
SHARE_OF_PAGE = 0.5
#: The templates of all hosts are broadcast up to this size, and joined by a shuffle beyond it.
BROADCAST_BYTES = 16 << 20

#: Elements that are not shown as text of the page, and no part of what is counted.
UNSEEN = frozenset("head script style noscript template svg math canvas object embed applet iframe audio video map title meta link xmp noembed noframes plaintext".split())
#: Elements that are never main text.
NEVER = UNSEEN | frozenset("nav aside footer form button input select textarea option datalist dialog menu".split())
#: Elements at whose edges a block ends.
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Whole words in class or id that mark what is no part of an article.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner banners breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr login masthead menu menus nav navbar navigation newsletter notice notices alert pagination pager popup modal "
    "promo promoted promotion related replies respond rss search share sharing sidebar sidebars signin signup skip social sponsor sponsored subscribe "
    "subscription teaser toolbar topbar widget widgets".split()
)
#: Words that say nothing about what an element is.
LAYOUT = frozenset(
    "a aria area articles article bar block body bottom box btn button buttons card cards center col column container content count entry fixed form global group header heading "
    "icon icons image img inner inline item items js label large left line link links list main mobile module nd new outer page panel post posts reader right row section "
    "secondary site slot small story stories text title top ui unit user users view wrap wrapper x".split()
)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def marked(node: Node, inside: bool, titled: set[int]) -> bool:
    """Whether the element says of itself that it is no part of an article. inside: whether it stands in an article or main
    element; titled: what holds a page's title or main part, where a word such as `with-sidebar` is about the layout."""
    if node.name in NEVER:
        return True
    if not node.rest or node.name in ("html", "body", "main"):
        return False
    a = node.attributes
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or _HIDDEN.search(a.get("style", "")):
        return True
    if id(node) in titled:
        return False
    names = [_WORDS.findall(_CAMEL.sub(" ", n).lower()) for n in (*a.get("class", "").split(), a.get("id", ""))]
    return any(any(w in MARKED for w in words) and (not inside or all(w in MARKED or w in LAYOUT for w in words)) for words in names)


def title_holders(root: Node) -> set[int]:
    """id() of the elements that hold a page's title or main part."""
    out: set[int] = set()
    rest: list[tuple[Node, bool]] = [(root, False)]
    while rest:
        node, done = rest.pop()
        if done:  # after its children
            if any(not isinstance(c, str) and (c.name in ("h1", "main") or id(c) in out) for c in node.children):
                out.add(id(node))
        else:
            rest.append((node, True))
            rest += [(c, False) for c in node.children if not isinstance(c, str)]
    return out


def seen(html: str) -> Node:
    """The tree of a page without what is not shown."""
    root = parse(html)
    rest = [root]
    while rest:
        node = rest.pop()
        node.children = [c for c in node.children if isinstance(c, str) or c.name not in UNSEEN]
        rest += [c for c in node.children if not isinstance(c, str)]
    return root


def unmarked(root: Node) -> Node:
    """The same tree, now without what is marked."""
    titled = title_holders(root)
    rest = [(root, False)]
    while rest:
        node, inside = rest.pop()
        inside = inside or node.name == "article" or is_main(node)
        node.children = [c for c in node.children if isinstance(c, str) or not marked(c, inside, titled)]
        rest += [(c, inside) for c in node.children if not isinstance(c, str)]
    return root


def without(root: Node, gone: set[int]) -> int:
    """Delete the elements whose id() is in `gone`; how many, not counting what they hold."""
    n, rest = 0, [root]
    while rest:
        node = rest.pop()
        kept = [c for c in node.children if isinstance(c, str) or id(c) not in gone]
        n += len(node.children) - len(kept)
        node.children = kept
        rest += [c for c in kept if not isinstance(c, str)]
    return n


def is_main(node: Node) -> bool:
    return node.name == "main" or bool(node.rest) and node.attributes.get("role") == "main"


def outer_header(node: Node, inside: bool) -> bool:
    """Whether it is a header of the site, not `inside` an article or main element, or one without a heading."""
    return node.name == "header" and not (inside and any(not isinstance(c, str) and c.name in _HEADINGS for c in node.children))


def text_size(root: Node, but: set[int] | frozenset[int] = frozenset()) -> int:
    """Characters of text, without white space at the edges, outside the elements whose id() is in `but`."""
    total, rest = 0, [(root, root.name != "")]
    while rest:
        node, inside = rest.pop()
        inside = inside or node.name == "article" or is_main(node)
        for child in node.children:
            if isinstance(child, str):
                total += len(child.strip())
            elif not (id(child) in but or outer_header(child, inside)):
                rest.append((child, inside))
    return total


def main_roots(root: Node) -> list[Node]:
    """The outermost article elements, with the paragraphs beside them and beside what holds them, if the articles hold
    SHARE_OF_PAGE of the page's text; else main elements likewise; else the page."""
    for name in ("article", "main"):
        found, above, rest = [], set(), [(root, ())]
        while rest:
            node, path = rest.pop()
            if node.name == "article" if name == "article" else is_main(node):
                found.append(node)
                while path and id(path[0]) not in above:
                    above.add(id(path[0]))
                    path = path[1]
            else:
                rest += [(c, (node, path)) for c in reversed(node.children) if not isinstance(c, str)]
        sizes = {id(n): text_size(n) for n in found}
        if inside := sum(sizes.values()):
            outside = text_size(root, set(sizes))
            if inside >= SHARE_OF_PAGE * (inside + outside):
                out, rest = [], [root]
                while rest:
                    node = rest.pop()
                    if id(node) in above:
                        rest += [c for c in reversed(node.children) if not isinstance(c, str)]
                    elif sizes.get(id(node)) or node.name in _BESIDE:
                        out.append(node)
                return out
    return [root]


def folded(text: str) -> str:
    return " ".join(text.split())


def subtrees(root: Node) -> list[tuple[Node, int]]:
    """The elements that may be template, with a hash of each subtree and its kind; prose at an edge comes as both kinds."""
    import xxhash

    out: list[tuple[Node, int]] = []
    # children before parents
    order: list[tuple[Node, int]] = []
    rest = [(root, 0)]
    while rest:
        node, article = rest.pop()
        order.append((node, article))
        article = article or (id(node) if node.name in ("article", "main") else 0)
        rest += [(c, article) for c in reversed(node.children) if not isinstance(c, str)]
    hashed = lambda parts: xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))
    # hash, hash of the shape, characters, characters in links, links, pieces of prose (a link counts as two)
    keys: dict[int, tuple[int, int, int, int, int, int]] = {}
    prose: dict[int, list[tuple[Node, int]]] = {}
    for node, article in reversed(order):
        name = f"{node.name}|{' '.join(sorted(node.attributes.get('class', '').split())) if node.rest else ''}"
        size, linked, links, pieces, parts, shape = 0, 0, int(node.name == "a"), 2 * (node.name == "a"), [name], [name]
        for child in node.children:
            if isinstance(child, str):
                if t := folded(child):
                    size += len(t)
                    parts += ["=", t]
            else:
                key, form, n, in_links, n_links, held = keys[id(child)]
                size, linked, links, pieces = size + n, linked + in_links, links + n_links, pieces + held
                parts.append(f"<{key}")
                if shape[-1] != f"<{form}":  # however many entries
                    shape.append(f"<{form}")
        key = hashed(parts)
        lone = node.name in _HEADINGS or node.name in _PROSE
        keys[id(node)] = key, hashed(shape), size, size if node.name == "a" else linked, links, pieces or int(lone and size > 0)
        if not size or node.name in ("", "html", "body", "article", "main") or node.name in _INLINE:
            continue
        if links > 1 and 2 * linked > size:
            out.append((node, of_kind(keys[id(node)][1], SHAPE)))
        if node.name in _HEADINGS or article and node.name in _PROSE:
            prose.setdefault(article, []).append((node, key))
        else:
            out.append((node, of_kind(key, BOX if pieces > 1 and not lone else PLAIN)))
    for found in prose.values():
        for k, (node, key) in enumerate(found):
            out.append((node, of_kind(key, PROSE)))
            if k < EDGE or k >= len(found) - EDGE:
                out.append((node, of_kind(key, AT_EDGE)))
    return out


def of_kind(key: int, kind: int) -> int:
    """A hash as a signed number with the kind in its lowest bits."""
    key = key & ~KINDS | kind
    return key - (1 << 64) if key >= 1 << 63 else key


_BESIDE = frozenset("p blockquote pre h1".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_PROSE = frozenset("p li blockquote pre dd dt td th tr figcaption".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())


def blocks(roots: list[Node]) -> list[str]:
    """Texts of the blocks in page order."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        if t := folded("".join(held)):
            out.append(t)
        held.clear()

    for root in roots:
        rest: list = [(root, root.name != "")]
        while rest:
            node, inside = rest.pop()
            if isinstance(node, str):
                held.append(node)
            elif inside is None:  # after it
                end()
            elif node.name == "br":
                held.append(" ")
            elif node is root or not outer_header(node, inside):
                if node.name in BLOCKS:
                    end()
                    rest.append((node, None))
                inside = inside or node.name == "article" or is_main(node)
                rest += [(c, inside) for c in reversed(node.children)]
        end()
    return out


def candidates(html: str | None) -> tuple[list[int], int]:
    """Distinct hashes of the subtrees of a page that may be template, and a hash of its whole main text."""
    import xxhash

    if not html:
        return [], 0
    root = seen(html)
    hashes = sorted({h for _, h in subtrees(root)})
    whole = "\n".join(blocks(main_roots(unmarked(root))))
    return hashes, xxhash.xxh3_64_intdigest(whole.encode("utf-8", "surrogatepass")) >> 1


def cleaned(html: str | None, template: frozenset[int] | set[int] = frozenset()) -> tuple[str, int]:
    """The main text of a page, given the hashes of its host's template, and how many subtrees were deleted as template."""
    if not html:
        return "", 0
    root = seen(html)
    n = without(root, {id(node) for node, h in subtrees(root) if h in template}) if template else 0
    return "\n".join(blocks(main_roots(unmarked(root)))), n


def main_text(html: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    return cleaned(html, template)[0]


def host(url):
    """The host of a url in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def section(url):
    """The first part of a url's path, if more follows; else ''."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/+([^/?#]+)/", 1)


def templates(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(host, section, hash) of the subtrees that recur: on `least` pages of the host or more, and `share` of them or more;
    prose on the shares of prose, boxes on MANY_PAGES; or in the same way of a section. section is null for the whole host.

    Pages of one main text count as one page. Counts are summed in each task before the shuffle.
    """

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [candidates(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([w for _, w in found], pa.int64()), pa.array([[PAGE, *h] for h, _ in found], pa.list_(pa.int64()))], ["host", "section", "whole", "hashes"])

    seen = mapped(pages.select(host(pages["url"]).alias("host"), section(pages["url"]).alias("section"), pages["html"]), rows, "host string, section string, whole bigint, hashes array<bigint>")
    once = cut(seen.groupBy("host", "whole").agg(F.min(F.struct("section", "hashes")).alias("page")).select("host", "page.*"))
    counted = once.select("host", "section", F.explode("hashes").alias("hash")).groupBy("host", "section", "hash").agg(F.count(F.lit(1)).alias("n"))
    of_host = counted.groupBy("host", "hash").agg(F.sum("n").alias("n")).select("host", F.lit(None).cast("string").alias("section"), "hash", "n")
    # few hashes recur so often; the number of pages is that of PAGE
    often = cut(of_host.unionByName(counted.filter(F.col("section") != "")).filter(F.col("n") >= least))
    sizes = often.filter(F.col("hash") == PAGE).select(F.col("host").alias("its_host"), F.col("section").alias("its_section"), F.col("n").alias("n_pages"))
    same = (F.col("host") == F.col("its_host")) & F.col("section").eqNullSafe(F.col("its_section"))
    kind = F.col("hash").bitwiseAND(KINDS)
    enough = F.col("n") >= F.col("n_pages") * needed(share)
    many = (kind == BOX) & (F.col("n") >= MANY_PAGES)
    sure = F.when(kind == BOX, enough).when(kind == PLAIN, F.col("n") >= F.col("n_pages") * max(share, EDGE_SHARE)).otherwise((kind == PROSE) & enough & (F.col("n") >= 2 * least))
    found = often.filter(F.col("hash") != PAGE).join(small(sizes, 100, BROADCAST_BYTES), same).filter(F.when(F.col("section").isNull(), enough | many).otherwise(sure))
    return found.select("host", "section", "hash")


def needed(share: float):
    """The share of pages that makes a subtree template, by the kind in its hash."""
    kind = F.col("hash").bitwiseAND(KINDS)
    return F.when(kind == PROSE, PROSE_SHARE).when(kind.isin(AT_EDGE, SHAPE), EDGE_SHARE).otherwise(share)


def extract(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """For every page: page_id, url, text, n_chars, n_template (subtrees deleted as template)."""
    # few hashes recur on so many pages; a host's and a section's lists are what their pages need
    lists = cut(templates(pages, least, share).groupBy("host", "section").agg(F.sort_array(F.collect_set("hash")).alias("template")))
    of_host = lists.filter(F.col("section").isNull()).select("host", "template")
    of_section = lists.filter(F.col("section").isNotNull()).select("host", "section", F.col("template").alias("more"))

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [cleaned(h.as_py(), frozenset(t.as_py() or ()).union(m.as_py() or ())) for h, t, m in zip(*batch.columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["page_id", "url", "text", "n_template"])

    known = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], pages["html"], host(pages["url"]).alias("host"), section(pages["url"]).alias("section"))
    # a checked size decides whether the pages have to be shuffled
    size = lists.agg(F.sum(F.size("template") * 8 + F.octet_length("host") + F.coalesce(F.octet_length("section"), F.lit(0)) + 64)).first()[0] or 0
    marked_small = F.broadcast if size <= BROADCAST_BYTES else lambda frame: frame
    joined = known.join(marked_small(of_host), "host", "left").join(marked_small(of_section), ["host", "section"], "left").select("page_id", "url", "html", "template", "more")
    return mapped(joined, rows, "page_id bigint, url string, text string, n_template bigint").select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
