"""Main text of web pages, with the containers that the pages of a host agree on.

A page is read once into a flat tree (``read``).  Its containers are scored by the text
below them that is neither boilerplate nor link, and the best gives one vote: the chain
of tags and classes from the root, generalised by dropping ids and replacing digits.
Votes are counted by host in Spark; a path with a fifth of a host's votes, five at most,
wins.  Every page is then read again and its text taken from the nodes of a winning path:
its own best path if that won, else the first winner the page has text at, else its own.

Boilerplate is told by tag (nav, footer, aside, form, script, ...), by role and by words
of class and id.  A header within the container keeps its headings.  Text is cut into
blocks by block-level tags; a line break or a table cell is a space.  White space is what
Unicode calls so, a no-break space included.  Character references are those of HTML.

Defined results: a null or empty page and one without text outside boilerplate give an
empty text; repeated rows and null ids are rows like others, and each page of a group of
copies votes; a null url and one without ``://`` belong to the host ''; winners that tie
go by votes, summed score and path.  A page is read in time linear in its length; nesting
of any depth is no recursion.  An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.urls import host_of
from citeloom.operators.joins import row_bound
from citeloom.session import materialize

#: Share of a host's votes that wins, and paths of a host that win at most.
SHARE, WINNERS = 0.2, 5
#: Pages of one output batch, and buckets a host's pages are salted into by a shuffle.
OUT_ROWS, SALTS = 256, 64
#: Part of a container's text that one child must hold to be the container instead.
HOLDS = 0.85

# Elements by the HTML standard, and words that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav "
    "ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
CELL = frozenset(["td", "th"])
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("body html caption tbody tfoot thead tr option optgroup legend".split())
#: What a start tag ends, unless one of the second list lies between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
}
SCOPE = frozenset("html table td th caption button object template".split())
NO_TEXT = frozenset(
    "head script style noscript template title textarea select option button input datalist iframe object "
    "embed noembed noframes canvas svg math audio video map xmp progress meter".split()
)
NOISE_TAG = frozenset("nav footer aside form menu dialog search header".split())
NOISE_ROLE = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split()
)
NOISE_WORD = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager skip sidebar widget widgets aside "
    "footer masthead topbar toolbar copyright ad ads advert adverts advertisement advertisements advertising adsense "
    "adsbygoogle sponsor sponsored sponsors promo promos promotion banner taboola outbrain cookie cookies consent "
    "gdpr notice notices popup modal overlay toast newsletter subscribe subscription signup login comment comments "
    "commentlist disqus replies reply respond share sharing social related recommended recommendations header".split()
)
CONTAINER = frozenset("body article main section div td blockquote center details".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|$)""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$)")
_MARK = re.compile(r"<(?=[a-zA-Z/!?])")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"[0-9]+")


class Page:
    """Flat tree of a page: for each node its parent, tag, step and kind; text parts in
    order, each with its node, and breaks between blocks (node -1)."""

    __slots__ = ("kind", "parent", "parts", "step", "tag")

    def __init__(self) -> None:
        self.parent = [-1]
        self.tag = ["html"]
        self.step = ["html"]
        self.kind = [""]
        self.parts: list[tuple[int, str]] = []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def step_of(tag: str, given: dict[str, str]) -> str:
    """Tag and sorted classes, digits generalised; ids are left out."""
    names = sorted({_DIGITS.sub("#", c) for c in given.get("class", "").split()})
    return ".".join([tag, *names])


def kind_of(tag: str, given: dict[str, str]) -> str:
    """``drop`` for what never is text, ``noise`` for boilerplate, ``header``, or ''."""
    if tag in NO_TEXT:
        return "drop"
    if tag == "header":
        return "header"
    if tag in NOISE_TAG or given.get("role", "").lower() in NOISE_ROLE:
        return "noise"
    if given and tag not in ("html", "body"):
        marked = {w.lower() for name in ("class", "id") for w in _WORDS.findall(given.get(name, ""))} & NOISE_WORD
        if marked:
            return "header" if marked == {"header"} else "noise"
    return ""


def read(source: str) -> Page:
    """The tree of a page, by the rules of the HTML standard that shape text."""
    page = Page()
    parent, tags, steps, kinds, parts = page.parent, page.tag, page.step, page.kind, page.parts
    stack = [0]
    places: dict[str, list[int]] = defaultdict(list)  # places in the stack of open tags
    blocks, scopes = [0], [0]

    def pop(to: int) -> None:
        """Close all from this place of the stack on."""
        while len(stack) > to:
            node = stack.pop()
            name = tags[node]
            places[name].pop()
            if blocks[-1] == len(stack):
                blocks.pop()
                parts.append((-1, ""))
            if scopes[-1] == len(stack):
                scopes.pop()

    def top(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    at, size, pattern = 0, len(source), _TAG
    while at < size:
        mark = _MARK.search(source, at)
        to = mark.start() if mark else size
        if to > at:
            parts.append((stack[-1], source[at:to]))
        if not mark:
            break
        if source.startswith("<!--", to):
            end = source.find("-->", to + 2)
            at = size if end < 0 else end + 3
            continue
        found = pattern.match(source, to)
        if not found and source[to + 1] not in "!?" and (source[to + 1] != "/" or source[to + 2 : to + 3].isalpha()):
            # A quote that nothing closes: no later one has a partner either.
            pattern = _PLAIN_TAG
            found = pattern.match(source, to)
        if not found:
            if source[to + 1] == "/" and source[to + 2 : to + 3] == "":
                parts.append((stack[-1], source[to:]))
                break
            end = source.find(">", to)
            at = size if end < 0 else end + 1
            continue
        at = found.end()
        name = found[2].lower()
        if found[1]:
            if name == "br":
                parts.append((stack[-1], " "))
            elif places.get(name):
                place = places[name][-1]
                if place > (blocks[-1] if name not in BLOCK and name not in CELL else -1) and (
                    place >= scopes[-1] or name in SCOPE or name in ("tr", "tbody", "thead", "tfoot")
                ):
                    pop(place)
            continue
        if name in ("html", "body") and (name == "html" or places.get("body")):
            continue
        if name in ENDS_P and places.get("p") and places["p"][-1] > scopes[-1]:
            pop(places["p"][-1])
        if name in ENDS:
            closing, barriers = ENDS[name]
            while (place := top(closing)) > top(barriers):
                pop(place)
        if name == "br":
            parts.append((stack[-1], " "))
            continue
        if name in CELL:
            parts.append((stack[-1], " "))
        if name in BLOCK:
            parts.append((-1, ""))
        if name in VOID:
            continue
        given = _attributes(found[3]) if found[3] else {}
        node = len(parent)
        parent.append(stack[-1])
        tags.append(name)
        steps.append(step_of(name, given))
        kind = kind_of(name, given)
        if not kind and (given.get("role") == "main" or given.get("itemprop") == "articleBody"):
            kind = "body"
        kinds.append(kind)
        if name in RAW:
            end = _RAW_END[name].search(source, at)
            stop = end.start() if end else size
            at = source.find(">", stop) + 1 if end else size
            at = size if at == 0 else at
            continue
        if found[3].endswith("/") and name in ("svg", "path"):
            continue
        places[name].append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        if name in SCOPE:
            scopes.append(len(stack))
        stack.append(node)
    return page


class Scores:
    """Text below each node: ``good`` counts what is not boilerplate nor a link, and
    ``out`` tells whether a node is boilerplate or lies in some."""

    def __init__(self, page: Page):
        n = len(page.parent)
        parent, tag, kind = page.parent, page.tag, page.kind
        own, linked = [0] * n, [0] * n
        in_link = [False] * n
        never = [False] * n
        for v in range(1, n):
            u = parent[v]
            in_link[v] = in_link[u] or tag[v] == "a"
            never[v] = never[u] or kind[v] == "drop"
        for v, text in page.parts:
            if v >= 0 and not never[v]:
                size = len(text) - text.count(" ")
                own[v] += size
                if in_link[v]:
                    linked[v] += size
        whole = [a - b for a, b in zip(own, linked, strict=True)]
        main = [int(k == "body" or t == "main") for k, t in zip(kind, tag, strict=True)]
        articles = [int(t == "article" and k == "") for k, t in zip(kind, tag, strict=True)]
        titles = [int(t == "h1") for t in tag]
        for v in range(n - 1, 0, -1):
            u = parent[v]
            whole[u] += whole[v]
            main[u] += main[v]
            articles[u] += articles[v]
            # A title in a header or menu is the site's.
            titles[u] += titles[v] if kind[v] not in ("noise", "header") or tag[v] not in NOISE_TAG else 0
        self.page = page
        self.titles = titles
        out = [False] * n
        for v in range(1, n):
            # What wraps the article is no boilerplate, whatever it is called.
            half = 2 * whole[v] > whole[0]
            wraps = main[v] > 0 or (half and (articles[v] > 0 or (titles[v] > 0 and tag[v] not in NOISE_TAG)))
            noisy = kind[v] == "drop" or (kind[v] in ("noise", "header") and not wraps)
            out[v] = out[parent[v]] or noisy
        self.out = out
        good = [0 if o else a - b for o, a, b in zip(out, own, linked, strict=True)]
        # A little for links, so that a page of nothing else has a container too.
        good = [10 * g + (0 if o else b) for g, o, b in zip(good, out, linked, strict=True)]
        for v in range(n - 1, 0, -1):
            good[parent[v]] += good[v]
        self.good = good

    def best(self) -> int:
        """The node that holds the article; -1 if the page has no text."""
        page, good, out = self.page, self.good, self.out
        if good[0] <= 0:
            return -1
        n = len(good)
        children: dict[int, int] = {}
        for v in range(1, n):
            u = page.parent[v]
            if not out[v] and (u not in children or good[v] > good[children[u]]):
                children[u] = v
        named = [
            v for v in range(1, n)
            if not out[v] and 4 * good[v] >= good[0] and (page.tag[v] in ("article", "main") or page.kind[v] == "body")
        ]
        at = container = 0
        if named:
            at = container = max(named, key=lambda v: (page.tag[v] == "article", good[v], v))
            if page.tag[at] == "article":
                return at
        while at in children:
            child = children[at]
            if good[child] < HOLDS * good[at] or (self.titles[at] and not self.titles[child]):
                break
            at = child
            if page.tag[at] in CONTAINER:
                container = at
        return container


def keys(page: Page) -> list[int]:
    """A 64-bit key of each node's path."""
    out = [0] * len(page.parent)
    for v in range(len(out)):
        above = out[page.parent[v]] if v else 0
        out[v] = xxhash.xxh64_intdigest(page.step[v].encode("utf-8", "surrogatepass"), seed=above)
    return out


def path_of(page: Page, node: int) -> str:
    """The last steps of a node's path, for people."""
    steps = []
    while node >= 0 and len(steps) < 8:
        steps.append(page.step[node])
        node = page.parent[node]
    return "/".join(reversed(steps))


def text_at(scores: Scores, nodes: set[int]) -> str:
    """Blocks of text below the nodes, without boilerplate."""
    page = scores.page
    n = len(page.parent)
    # 0 outside, 1 inside, 2 in a header, where only headings count, 3 never again.
    state = [0] * n
    for v in range(n):
        above = state[page.parent[v]] if v else 0
        if v in nodes and above != 3:
            state[v] = 1
        elif above in (1, 2):
            kind = page.kind[v]
            if kind == "header" and scores.out[v]:
                state[v] = 2
            elif kind == "drop" or (kind == "noise" and scores.out[v]):
                state[v] = 3
            else:
                state[v] = 1 if above == 2 and page.tag[v] in HEADING else above
        else:
            state[v] = above
    blocks, held = [], []
    for v, text in page.parts:
        if v >= 0:
            if state[v] == 1:
                held.append(text)
        elif held:
            blocks.append("".join(held))
            held = []
    blocks.append("".join(held))
    found = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in found if b)


def vote(source: str | None) -> tuple[int, str, int] | None:
    """Key and path of a page's best container, and its score."""
    if not source:
        return None
    page = read(source)
    scores = Scores(page)
    node = scores.best()
    return None if node < 0 else (keys(page)[node], path_of(page, node), scores.good[node])


def extract(source: str | None, winners: list[int]) -> tuple[str, str, bool]:
    """Text of a page, the path it was taken from, and whether that path won."""
    if not source:
        return "", "", False
    page = read(source)
    scores = Scores(page)
    node = scores.best()
    if node < 0:
        return "", "", False
    own = keys(page)
    chosen = own[node]
    if chosen not in winners:
        below: dict[int, int] = defaultdict(int)
        for v, key in enumerate(own):
            if not scores.out[v]:
                below[key] += scores.good[v]
        chosen = next((w for w in winners if below.get(w, 0) > 0), chosen)
    nodes = {v for v, key in enumerate(own) if key == chosen and not scores.out[v]} or {node}
    return text_at(scores, nodes), path_of(page, min(nodes)), chosen in winners


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(h, *v) for h, s in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True) if (v := vote(s.as_py()))]
        yield pa.RecordBatch.from_pylist(
            [{"host": h, "key": _signed(k), "path": p, "score": g} for h, k, p, g in rows],
            schema=pa.schema([("host", pa.string()), ("key", pa.int64()), ("path", pa.string()), ("score", pa.int64())]),
        )


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(at, OUT_ROWS)
            texts, paths, won = [], [], []
            for source, winners in zip(part.column("html"), part.column("winners").to_pylist(), strict=True):
                text, path, agreed = extract(source.as_py(), [k % (1 << 64) for k in winners or ()])
                texts.append(text.encode("utf-8", "replace").decode())
                paths.append(path)
                won.append(agreed)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()), pa.array(paths, pa.string()), pa.array(won, pa.bool_()),
                ],
                names=["page_id", "url", "text", "n_chars", "path", "agreed"],
            )


def host_paths(pages: DataFrame, share: float = SHARE, most: int = WINNERS) -> DataFrame:
    """``host, winners``: keys of each host's winning paths, the most votes first."""
    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    votes = votes.mapInArrow(_votes, "host string, key long, path string, score long")
    counted = votes.groupBy("host", "key").agg(
        F.count("*").alias("votes"), F.sum(F.col("score").cast("decimal(38,0)")).alias("score"), F.min("path").alias("path")
    )
    counted = materialize(counted, "page-votes")
    # Distinct paths of a host, not its pages; the rank is cut before the shuffle.
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path", "key")
    first = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    cast = counted.groupBy("host").agg(F.sum("votes").alias("cast"))
    won = first.join(cast, "host").filter((F.col("rank") == 1) | (F.col("votes") >= share * F.col("cast")))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "key")))
    return won.groupBy("host").agg(F.transform(ranked, lambda r: r["key"]).alias("winners"))


def _with_winners(pages: DataFrame, winners: DataFrame, key: Callable[[], Column]) -> DataFrame:
    """Winners beside the pages: broadcast below a checked size, else joined by host
    and a salt of the page, so that a hot host is spread."""
    if row_bound(winners) is not None:
        return pages.join(F.broadcast(winners), "host", "left")
    salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", key()).join(salted, ["host", "salt"], "left")


def main_texts(pages: DataFrame, share: float = SHARE, most: int = WINNERS) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, the path used and whether it won."""
    winners = materialize(host_paths(pages, share, most), "page-winners")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"),
    )
    joined = _with_winners(rows, winners, lambda: F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return joined.select("page_id", "url", "html", "winners").mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long, path string, agreed boolean"
    )
