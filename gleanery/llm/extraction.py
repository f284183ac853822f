"""Main text of web pages by wrapper induction over pages of one host."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import map_rows

CANDIDATES = 64  # pages of a host that its references are picked from: those with the least hashes of content
BUCKET_PAGES = 64  # a host is not split below so many pages
REFERENCES = 4  # pages that each page is aligned with
TABLE_CELLS = 40000  # longer lists are split before they are aligned
AGREE = 3  # references that must show a text unchanged before it counts as template

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("head nav footer aside form script style template noscript iframe button select option input textarea svg math object canvas audio video dialog menu title".split())
CLOSES = {"p": frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
SCOPES = frozenset("html body article main section div table td th ul ol dl blockquote aside nav footer header form".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
# Words in class and id names of page furniture; those that follow may also name a topic of the text.
ASIDE_WORDS = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|sidebar\w*|nav|navbar|menu\w*|breadcrumbs?|masthead|footer|cookies?|gdpr|popup|modal|comments?|commentlist|disqus\w*|share|sharing|newsletter|subscri\w*|signup|login|searchform|widgets?|toolbar|pager|pagination", re.I,
)
TOPIC_WORDS = re.compile(r"banner|navigation|consent|notices?|overlay|respond|responses?|replies|social\w*|related\w*|recommend\w*|search|skip|copyright", re.I)
# Words that say nothing of the topic; beside one of the above they leave a name what it is.
PLAIN_WORDS = frozenset("""area article articles bar block body bottom box button buttons col collapse column container content count cta desktop dialog dropdown fixed floating form global google group header holder icon icons inline inner item
items js label left link links list lower main message mobile module native note outer page panel post posts primary reader responsive right row secondary section sidebar site slot small sticky stories story text thread title top unit upper
user widget wp wrap wrapper zone""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("p pre table thead tbody tfoot tr td th caption blockquote figure figcaption li dl dt dd code".split())
SURE, MAYBE = 1, 2  # furniture by name; only if its text is template or links, too
SHORT = 80  # a line of furniture that a host of two or three pages repeats is no longer than this
# Names that also stand for parts of an article: they only count outside of article and main elements.
SIDE_NAMES = re.compile(r"(?:site|page|top|global|main)?[-_]?header|head|foot|side|side[-_]?(?:nav|menu|col\w*|panel|rail)|(?:left|right)[-_]?(?:side|bar|col\w*|rail)|alert|form|tags|legal|reply", re.I)
ARTICLE_NAMES = re.compile(r"(?:entry|article|post|story|content)[-_]?(?:header|head|title|content|body|text|main)", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "label", "aside", "children", "text", "links", "parent", "fixed", "key", "heavy")

    def __init__(self, tag: str, parent: Node | None, label: str = "", aside: int = 0):
        self.tag, self.parent, self.label, self.aside = tag, parent, label or tag, aside
        self.children: list[Node] = []
        self.text, self.links, self.fixed, self.heavy = "", 0, 0, 0


def name_says(name: str, alone: bool) -> int:
    """Whether a class or id name is that of page furniture: 0, SURE or MAYBE.  ``alone``: a word that may be a topic is sure by itself."""
    words = [w for w in re.split(r"[-_]+", name.lower()) if w and not w.isdigit()]
    sure, topic = [w for w in words if ASIDE_WORDS.fullmatch(w)], [w for w in words if TOPIC_WORDS.fullmatch(w)]
    if not sure and not topic:
        return 0
    plain = all(w in PLAIN_WORDS or ASIDE_WORDS.fullmatch(w) or TOPIC_WORDS.fullmatch(w) for w in words)
    return SURE if plain and (sure or alone and len(words) == 1) else MAYBE


def named_aside(tag: str, classes: list[str], ident: str, within: bool) -> int:
    """Whether an element's names mark page furniture: 0, SURE or MAYBE.

    Ids of headings and of blocks of text are slugs of what they say and never
    count; within an article or main element neither do the classes of such blocks.
    """
    if tag in HEADINGS or any(ARTICLE_NAMES.fullmatch(n) for n in (*classes, ident)):
        return 0
    if tag in BLOCKS:
        classes, ident = [] if within else classes, ""
    if not within and any(SIDE_NAMES.fullmatch(n) for n in (*classes, ident)):
        return SURE
    said = {name_says(n, True) for n in classes} | {name_says(ident, False)}
    return SURE if SURE in said else MAYBE if MAYBE in said else 0


def element(tag: str, raw: str, parent: Node, within: bool = False) -> Node:
    """A node with its label (tag and class) and whether its name marks page furniture."""
    aside, label = SURE if tag in NEVER else 0, tag
    if raw and ("class" in raw or "id" in raw or "role" in raw or "hidden" in raw or "style" in raw):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}
        label = f"{tag}.{found.get('class', '')}"
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
        if hidden or found.get("role", "").lower() in ASIDE_ROLES:
            aside = SURE
        elif not aside and tag not in ("body", "html", "article", "main"):
            aside = named_aside(tag, found.get("class", "").split(), found.get("id", "").strip(), within)
    return Node(tag, parent, label, aside)


def parse(page: str) -> Node:
    """A tree of block elements; each run of inline content is a ``#text`` leaf.

    Forgiving as browsers are: optional end tags, unclosed and stray tags.
    Inline elements are not nodes; link text is counted in its leaf.
    """
    root = Node("#root", None)
    here, buffer, linked, anchors, at = root, [], 0, 0, 0
    n = len(page)
    opened: Counter[str] = Counter()  # open elements by tag: what is not open need not be looked for
    ending = 0  # of them, those whose end tag may be left out

    def leave(up: Node) -> None:
        nonlocal here, ending
        while here is not up:
            opened[here.tag] -= 1
            ending -= here.tag in CLOSES
            here = here.parent

    def flush() -> None:
        nonlocal buffer, linked
        if buffer:
            text = SPACES.sub(" ", entities.unescape("".join(buffer))).strip()
            if text:
                leaf = Node("#text", here)
                leaf.text, leaf.links = text, linked
                here.children.append(leaf)
            buffer, linked = [], 0

    while at < n:
        m = TOKEN.search(page, at)
        upto = m.start() if m else n
        if upto > at:
            piece = page[at:upto]
            buffer.append(piece)
            if anchors:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        closing, tag, raw = m[1], m[2], m[3]
        if tag:
            tag = tag.lower()
            if tag in INLINE:
                if tag == "br":
                    buffer.append(" ")
                elif tag == "a":
                    anchors = 1
                continue
            flush()
            anchors = 0
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*(?:>|\Z)|</{tag}\s[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
                continue
            up = here  # an open element that this one ends
            while ending and up is not root and up.tag not in SCOPES and tag not in CLOSES.get(up.tag, ()):
                up = up.parent
            if ending and tag in CLOSES.get(up.tag, ()):
                leave(up.parent)
            node = element(tag, raw, here, opened["article"] + opened["main"] > 0)
            here.children.append(node)
            if tag not in VOID and not raw.rstrip().endswith("/"):
                here = node
                opened[tag] += 1
                ending += tag in CLOSES
        elif closing:
            closing = closing.lower()
            if closing in INLINE:
                if closing == "a":
                    anchors = 0
                continue
            flush()
            up = here
            while opened[closing] and up is not root and up.tag != closing and not (up.tag in SCOPES and closing not in SCOPES):
                up = up.parent
            if up is not root and up.tag == closing:
                leave(up.parent)
    flush()
    return root


def best_scores(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """The weight of the best alignment of all of ``a`` with each head of ``b``."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for code, weight in zip(a, wa):
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + np.where(b == code, np.minimum(wb, weight), 0)))
    return row


def matched(a: list, b: list, wa: list[int], wb: list[int]) -> list[tuple[int, int]]:
    """Order-preserving pairs of equal elements with most weight (a pair's is the lesser one).

    Exact for lists of any length: those too long for a table are split where
    the best alignment is (Hirschberg), so memory is linear in them.
    """
    common = set(a) & set(b)
    if not common:
        return []
    at, bt = [i for i, x in enumerate(a) if x in common], [j for j, y in enumerate(b) if y in common]
    numbers = {x: k for k, x in enumerate(common)}
    xs, ys = np.array([numbers[a[i]] for i in at], dtype=np.int64), np.array([numbers[b[j]] for j in bt], dtype=np.int64)
    vs, ws = np.array([wa[i] for i in at], dtype=np.int64), np.array([wb[j] for j in bt], dtype=np.int64)
    out, stack = [], [(0, len(at), 0, len(bt))]
    while stack:
        lo, hi, left, right = stack.pop()
        n, m = hi - lo, right - left
        if not n or not m:
            continue
        if n > 1 and n * m > TABLE_CELLS:
            mid = (lo + hi) // 2
            ahead = best_scores(xs[lo:mid], ys[left:right], vs[lo:mid], ws[left:right])
            behind = best_scores(xs[mid:hi][::-1], ys[left:right][::-1], vs[mid:hi][::-1], ws[left:right][::-1])[::-1]
            cut = left + int(np.argmax(ahead + behind))
            stack += [(lo, mid, left, cut), (mid, hi, cut, right)]
            continue
        x, y, v, w = xs[lo:hi].tolist(), ys[left:right].tolist(), vs[lo:hi].tolist(), ws[left:right].tolist()
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for j in range(m - 1, -1, -1):
                keep = below[j + 1] + min(v[i], w[j]) if x[i] == y[j] else 0
                row[j] = max(keep, below[j], row[j + 1])
        i = j = 0
        while i < n and j < m:
            if x[i] == y[j] and best[i][j] == best[i + 1][j + 1] + min(v[i], w[j]):
                out.append((at[lo + i], bt[left + j]))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
    return sorted(out)


def align(a: Node, b: Node) -> None:
    """Simple tree matching; texts of ``a`` that its partner in ``b`` repeats are marked as fixed.

    Children that are equal with all under them match first, in order and with
    most nodes.  Between two of them children match if their labels are equal;
    again the order-preserving matches with most nodes are taken, where equal
    heads and tails of the label lists are matched outright.
    """
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if x.tag == "#text":
            x.fixed += x.text == y.text
            continue
        xs, ys = x.children, y.children
        same = matched([c.key for c in xs], [c.key for c in ys], [c.heavy for c in xs], [c.heavy for c in ys])
        i = j = 0
        for p, q in [*same, (len(xs), len(ys))]:
            pair_up(xs[i:p], ys[j:q], stack)
            if p < len(xs):
                stack.append((xs[p], ys[q]))
            i, j = p + 1, q + 1


def pair_up(xs: list[Node], ys: list[Node], stack: list[tuple[Node, Node]]) -> None:
    """Add the pairs of two lists of children that match by label."""
    lo, hi = 0, 0
    while lo < min(len(xs), len(ys)) and xs[lo].label == ys[lo].label:
        stack.append((xs[lo], ys[lo]))
        lo += 1
    while hi < min(len(xs), len(ys)) - lo and xs[-1 - hi].label == ys[-1 - hi].label:
        stack.append((xs[-1 - hi], ys[-1 - hi]))
        hi += 1
    xs, ys = xs[lo : len(xs) - hi], ys[lo : len(ys) - hi]
    if xs and ys:
        pairs = matched([c.label for c in xs], [c.label for c in ys], [c.heavy for c in xs], [c.heavy for c in ys])
        stack += [(xs[p], ys[q]) for p, q in pairs]


def weigh(node: Node) -> int:
    """Set ``heavy``, the number of nodes under each node, and ``key``, equal for equal subtrees, without recursion."""
    order, stack = [], [node]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += x.children
    for x in reversed(order):
        x.heavy = 1 + sum(c.heavy for c in x.children)
        x.key = hash((x.label, x.text, *(c.key for c in x.children)))
    return node.heavy


def leaves(node: Node) -> list[tuple[Node, bool]]:
    """Texts in page order, each with whether it lies in page furniture."""
    out, stack = [], [(node, False)]
    while stack:
        x, aside = stack.pop()
        aside = aside or x.aside
        if x.tag == "#text":
            out.append((x, aside))
        stack += [(c, aside) for c in reversed(x.children)]
    return out


def main_nodes(root: Node, texts: list[Node]) -> list[Node]:
    """Where the article is, given the texts that vary.

    The outermost article and main elements, all that hold such text, if
    together they have at least half of it (else they are teasers); without them
    the smallest node that holds all of it: nothing that varies is left outside.
    """
    own = {id(x): max(0, len(x.text) - x.links) for x in texts}
    size: dict[int, int] = {}
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += x.children
    for x in reversed(order):
        size[id(x)] = own.get(id(x), 0) + sum(size[id(c)] for c in x.children)
    named, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.tag in ("article", "main") and size[id(x)]:
            named.append(x)
        else:
            stack += [c for c in x.children if size[id(c)]]
    if named and 2 * sum(size[id(x)] for x in named) >= size[id(root)]:
        return named
    here = root
    while below := [c for c in here.children if c.children and size[id(c)] == size[id(here)] > 0]:
        here = below[0]
    return [here]


def settle_names(root: Node, template: set[int]) -> None:
    """Elements whose names may mark furniture are furniture if four fifths of their text are template or links."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += x.children
    size: dict[int, tuple[int, int]] = {}
    for x in reversed(order):
        if x.tag == "#text":
            n = len(x.text)
            size[id(x)] = n, n if id(x) in template else min(n, x.links)
        else:
            size[id(x)] = tuple(map(sum, zip(*(size[id(c)] for c in x.children)))) or (0, 0)
        if x.aside == MAYBE:
            x.aside = SURE if 5 * size[id(x)][1] >= 4 * size[id(x)][0] else 0


def in_article(x: Node) -> bool:
    while x is not None and x.tag not in ("article", "main"):
        x = x.parent
    return x is not None


def is_template(x: Node, references: int) -> bool:
    """Whether enough references repeat a text; where a host has few, all must, and only short lines outside of an article count."""
    if references >= AGREE:
        return x.fixed >= AGREE and x.fixed * 10 >= 6 * references
    return 0 < references == x.fixed and len(x.text) <= SHORT and not in_article(x)


def extract(root: Node, references: int) -> str:
    """The content slots of an aligned page, block by block."""
    template = {id(x) for x, _ in leaves(root) if is_template(x, references)}
    settle_names(root, template)
    varying = [(x, aside) for x, aside in leaves(root) if id(x) not in template]
    tops = main_nodes(root, [x for x, aside in varying if not aside])
    # headings and bylines of <header> inside the article belong to it
    held = {id(x): top for top in tops for x, _ in leaves(top)}
    kept = []
    for x, aside in varying:
        if aside or id(x) not in held:
            continue
        mostly_links = x.links > 0.8 * len(x.text) and held[id(x)].tag not in ("article", "main")
        if not mostly_links:
            kept.append(x.text)
    return "\n".join(kept)


def host_of(column: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(column).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def longest_text(tree: Node) -> str:
    return max((x.text for x, _ in leaves(tree)), key=len, default="")


def pick_references(pages: Iterable[str]) -> list[int]:
    """Which pages differ most plainly: no two share their longest block or first heading."""
    out, seen = [], set()
    for k, page in enumerate(pages):
        texts = [x.text for x, _ in leaves(parse(page))]
        if texts:
            marks = {max(texts, key=len), *texts[-1:]} if len(texts) < 3 else {max(texts, key=len)}
            if not marks & seen:
                seen |= marks
                out.append(k)
        if len(out) > REFERENCES:
            break
    return out


def references_of(pages: list[str]) -> list[tuple[Node, str]]:
    """Reference pages as weighed trees, each with its longest text."""
    trees = [parse(p) for p in pages]
    for t in trees:
        weigh(t)
    return [(t, longest_text(t)) for t in trees]


def extract_page(page: str, references: list[tuple[Node, str]]) -> str:
    """Main text of a page, aligned with the references of its host that tell other things."""
    tree = parse(page)
    weigh(tree)
    longest = longest_text(tree)
    others = [r for r, text in references if text != longest][:REFERENCES]
    for r in others:
        align(tree, r)
    return extract(tree, len(others))


def extract_block(pages: list[str]) -> list[str]:
    """Main texts of pages of one host, with references among themselves."""
    references = references_of([pages[k] for k in pick_references(pages)])
    return [extract_page(p, references) for p in pages]


SCHEMA = "page_id long, url string, text string, n_chars long"
OUT = ["page_id", "url", "text", "n_chars"]
WRITE_PAGES = 64  # rows of a result batch


def split_references(rows: DataFrame, split: DataFrame, n: int) -> DataFrame:
    """host, rank, html: the references of the hosts in ``split``, picked once for each host."""
    contents = rows.join(F.broadcast(split), "host", "left_semi").select("host", "content").distinct()
    least = contents.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("content"))).filter(F.col("n") <= CANDIDATES)
    upto = least.groupBy("host").agg(F.max("content").alias("upto"))
    found = rows.join(F.broadcast(upto), "host").filter(F.col("content") <= F.col("upto")).groupBy("host", "content").agg(F.min("html").alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = ((host, html) for batch in batches for host, html in zip(batch["host"], batch["html"]))
        for host, group in groupby(every, key=lambda r: r[0]):
            pages = [html for _, html in group]
            picked = pick_references(pages)
            yield pd.DataFrame({"host": [host] * len(picked), "rank": range(len(picked)), "html": [pages[k] for k in picked]})

    return found.repartition(n, "host").sortWithinPartitions("host", "content").select("host", "html").mapInPandas(run, "host string, rank long, html string")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    Every page is aligned with the references of its host, which depend on the
    host's pages only: among the ``CANDIDATES`` different contents with the least
    hashes, the first that differ plainly.  How pages are dealt does not matter.

    A host with more than a quarter of a task's share is split into buckets of
    that size; its references are picked beforehand and go to each bucket, at
    most 8 a task.  Other hosts are one bucket, sorted by content, so that their
    candidates come first.  Buckets are dealt by ranges, which Spark cuts from a
    sample; a bucket is never cut.  A task holds the candidates of a host and the
    ids of their copies.

    A null page is an empty one, with empty text.  A page without any other of
    its host, or only copies of itself, keeps what the element names tell.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host_of(url_col).alias("host"))
    rows = rows.withColumn("content", F.xxhash64("html"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(BUCKET_PAGES, rows.count() // (4 * n))
    split = rows.groupBy("host").count().filter(F.col("count") > share).select("host", F.ceil(F.col("count") / share).alias("parts"))  # at most 4 * n hosts
    dealt = rows.join(F.broadcast(split), "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.select("page_id", "url", "html", "host", F.pmod(F.xxhash64("page_id", "url"), "parts").alias("part"), "parts", F.lit(1).alias("kind"), "content")
    shared = split_references(rows, split, n).join(F.broadcast(split), "host").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    shared = shared.select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), "html", "host", "part", "parts", F.lit(0).alias("kind"), F.col("rank").alias("content"))
    every = dealt.unionByName(shared).repartitionByRange(n, "host", "part").sortWithinPartitions("host", "part", "kind", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ("page_id", "url", "html", "host", "part", "parts", "kind")
        stream = (row for batch in batches for row in zip(*(batch[c] for c in columns)))
        for (_, _, parts), bucket in groupby(stream, key=lambda r: r[3:6]):
            given, held, contents = [], [], []
            for row in bucket:  # the references of a split host, or the candidates of another with their copies
                if row[6] == 0:
                    given.append(row[2])
                    continue
                if parts == 1 and (not contents or row[2] != contents[-1]):
                    contents.append(row[2])
                held.append((*row[:2], contents[-1] if parts == 1 else row[2]))
                if parts > 1 or len(contents) > CANDIDATES:
                    break
            if parts == 1:
                given = [contents[k] for k in pick_references(contents[:CANDIDATES])]
            references = references_of(given)
            done, last, text = [], None, ""
            for row in chain(held, bucket):
                if row[2] != last:
                    last, text = row[2], extract_page(row[2], references)
                done.append((row[0], row[1], text, len(text)))
                if len(done) == WRITE_PAGES:
                    yield pd.DataFrame(done, columns=OUT)
                    done = []
            if done:
                yield pd.DataFrame(done, columns=OUT)

    return map_rows(every, run, SCHEMA, ("page_id",))
