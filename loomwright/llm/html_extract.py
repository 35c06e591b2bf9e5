"""Main text of web pages by equivalence-class template deduction.

Pages are parsed into elements and blocks of text. The tokens are each block element
under its path and each block's text under its path; a token's occurrence vector holds how often
it is on each page of its host, kept as a commutative sum of page marks, so that
no host's pages ever meet in one task. Tokens that share a vector form an equivalence class; a
class is valid if its tokens are once on each page that it covers, cover MIN_PAGES pages and
MIN_SHARE of the host, hold an element, and nest: all lie in one slot of the classes around.
Valid classes, the larger cover first, are the template; its elements bound the slots.
From the root on, the slot that holds more than half of the text that is neither the
template's own nor linked is entered, as long as it has blocks inside: that slot is the article.
Of it the template's own text and nested slots of links go. Element names decide on what is nested
in the article, and on pages whose host shows no template.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import cut

#: Fewest pages of a host, and least share of them, that a template token must be on.
MIN_PAGES = 4
MIN_SHARE = 0.5
#: Share of linked text from which a slot is a list of links.
LINKS = 0.8
#: Groups over which what goes back to all pages of a host is spread: one may hold a third of all.
SALTS = 64

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br body html head option select title caption tbody td tfoot th thead tr".split())
FURNITURE = frozenset("nav header footer aside form head script style noscript iframe button select option input textarea template svg math dialog menu title xmp noembed noframes object canvas audio video search".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu menubar nav navbar navigation newsletter notice notices notification pagination popup promo promoted related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MAIN_WORDS = frozenset("article articlebody article-body article-content content entry entry-content main main-content maincontent post post-body post-content story story-body text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.S)
_SPACE = re.compile(r"\s+")


class _Node:
    """An open element; chars and links count the unlinked and linked text of what is inside, once it is closed."""

    __slots__ = ("name", "id", "up", "furniture", "main", "block", "link", "inside", "below", "chars", "links", "holds")

    def __init__(self, name: str, id_: int, up: _Node | None):
        self.name, self.id, self.up = name, id_, up
        self.furniture, self.main, self.block, self.link, self.inside, self.below = False, 0, True, False, False, False
        self.chars = self.links = 0
        self.holds = False


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for k, a, b, c in _ATTRIBUTE.findall(text) if "=" in text or "hidden" in text else ():
        found.setdefault(k.lower(), html.unescape(a or b or c))
    return found


def _open(name: str, attributes: str, up: _Node, plan: Plan) -> _Node:
    found = _attributes(attributes)
    names = set((found.get("class", "") + " " + found.get("id", "")).lower().split()) if found else set()
    label = name + "".join("." + n for n in sorted(names) if not any(c.isdigit() for c in n))
    node = _Node(name, xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), up.id & _MASK) - (1 << 63), up)
    parts = {p for n in names for p in re.split(r"[-_]+", n)} | names
    role = found.get("role", "").lower()
    own = (
        name in FURNITURE
        or role in FURNITURE_ROLES
        or "hidden" in found
        or found.get("aria-hidden") == "true"
        or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
        or (name not in ("body", "html", "main", "article") and bool(parts & FURNITURE_WORDS))
    )
    # a header inside an article holds its headline
    headline = name == "header" and not parts & FURNITURE_WORDS and not role
    named = own and not (headline and up.main)
    node.main = up.main
    if not up.furniture and not named:
        if name == "article" or found.get("itemprop", "").lower() == "articlebody":
            node.main = max(node.main, 3)
        elif name == "main" or role in ("main", "article"):
            node.main = max(node.main, 2)
        elif names & MAIN_WORDS:
            node.main = max(node.main, 1)
    node.furniture = up.furniture or named
    node.block = name in BLOCK
    node.link = up.link or name == "a"
    node.inside = up.inside or node.id == plan.main
    node.below = up.inside and (up.below or node.id in plan.lists or (own and not headline))
    return node


_MASK = (1 << 64) - 1


class Plan:
    """What a host's template says: the article's element, lists of links in it, and the template's own texts."""

    __slots__ = ("main", "lists", "texts")

    def __init__(self, main: int | None = None, lists=(), texts=()):
        self.main, self.lists, self.texts = main, frozenset(lists), frozenset(texts)


class Block:
    __slots__ = ("text", "node")

    def __init__(self, text: str, node: _Node):
        self.text, self.node = text, node

    @property
    def token(self) -> int:
        return xxhash.xxh64_intdigest(self.text.encode("utf-8", "surrogatepass"), self.node.id & _MASK) - (1 << 63)


def parse(page: str, plan: Plan = Plan()) -> tuple[list[Block], list[_Node]]:
    """The page's blocks of text in order, and its block elements, all closed, the root last."""
    root = _Node("", 0, None)
    stack, out, closed, parts = [root], [], [], []
    opened: dict[str, int] = defaultdict(int)
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            at = next(n for n in reversed(stack) if n.block)
            links = min(len(text), linked)
            at.links += links
            at.chars += len(text) - links
            out.append(Block(text, at))
        linked = 0

    def close(n: int) -> None:
        for node in reversed(stack[n:]):
            node.up.chars += node.chars
            node.up.links += node.links
            opened[node.name] -= 1
            if node.block:
                closed.append(node)
        del stack[n:]

    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if piece.startswith("<![CDATA["):
                piece = piece[9:].removesuffix("]]>")
            elif piece.startswith("<") and len(piece) > 1:
                continue
            top = stack[-1]
            if not top.furniture or top.name not in RAW:
                # furniture inside a line (a button, an inline form) adds nothing to the block
                if not top.furniture or next(n for n in reversed(stack) if n.block).furniture:
                    parts.append(html.unescape(piece))
                    if top.link:
                        linked += len(piece.strip())
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                flush()
            if opened[name]:
                close(next(n for n in range(len(stack) - 1, 0, -1) if stack[n].name == name))
            continue
        if name in BLOCK:
            flush()
        if name in CLOSES_P:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].name == "p":
                    close(n)
                    break
                if stack[n].block:
                    break
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            stop = {"li": ("ul", "ol", "menu"), "tr": ("table", "tbody", "thead", "tfoot"), "option": ("select",)}.get(name, ("dl", "table", "tr"))
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].name in same:
                    close(n)
                    break
                if stack[n].name in stop:
                    break
        if name in VOID:
            continue
        if name in BLOCK:
            stack[-1].holds = True
        node = _open(name, m[3], stack[-1], plan)
        if m[3].rstrip().endswith("/") and name in ("svg", "math", "iframe"):
            continue
        stack.append(node)
        opened[name] += 1
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, pos)
            pos = end.start() if end else size
    flush()
    close(1)
    return out, [*closed, root]


def token_vectors(pages: DataFrame) -> DataFrame:
    """Rows (host, token, text, up, pages, once, chars, links, holds, vector) of the tokens on MIN_PAGES pages of a host or more."""

    def run(batches):
        for pdf in batches:
            rows: dict[tuple, list] = {}
            for host, key, page in zip(pdf["host"], pdf["key"], pdf["page"], strict=True):
                mark = xxhash.xxh64_intdigest(str(key)) >> 24
                found, elements = parse(page or "")
                seen: dict[tuple, list] = {}
                for e in elements:
                    own = seen.setdefault((e.id, False, e.up.id if e.up else 0), [0, 0, 0, False])
                    own[0] += 1
                    own[1] += e.chars
                    own[2] += e.links
                    own[3] |= e.holds
                for b in found:
                    own = seen.setdefault((b.token, True, b.node.id), [0, 0, 0, False])
                    own[0] += 1
                    own[1] += len(b.text)
                for token, (n, chars, links, holds) in seen.items():
                    row = rows.setdefault((host, *token), [0, 0, 0, 0, False, 0])
                    row[0] += 1
                    row[1] += n == 1
                    row[2] += chars
                    row[3] += links
                    row[4] |= holds
                    row[5] += mark * n
            yield pd.DataFrame([(*k, *r[:5], str(r[5])) for k, r in rows.items()], columns=_COLUMNS)

    found = pages.select("host", "key", "page").mapInPandas(
        run, "host string, token long, text boolean, up long, pages long, once long, chars long, links long, holds boolean, vector string"
    )
    # counts of a text on very many pages go beyond 64 bits
    summed = found.groupBy("host", "token", "text", "up").agg(
        *[F.sum(c).alias(c) for c in ("pages", "once", "chars", "links")], F.max("holds").alias("holds"), F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector")
    )
    return summed.where(F.col("pages") >= MIN_PAGES)


_COLUMNS = ["host", "token", "text", "up", "pages", "once", "chars", "links", "holds", "vector"]


def templates(pages: DataFrame) -> DataFrame:
    """Rows (host, main, lists, texts): the hosts' templates, where they show the article's element.

    A host's tokens on MIN_SHARE of its pages are at most twice as many as those of a page on average.
    """
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES)
    sizes = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tokens = token_vectors(pages).withColumn("_salt", F.pmod("token", F.lit(SALTS)).cast("int"))
    tokens = tokens.join(sizes, ["host", "_salt"]).where(F.col("pages") >= F.col("n") * MIN_SHARE)
    listed = tokens.groupBy("host").agg(F.collect_list(F.struct(*[c for c in _COLUMNS[1:-1]], F.col("vector").cast("string").alias("vector"))).alias("tokens"))

    def run(batches):
        for pdf in batches:
            rows = []
            for host, found in zip(pdf["host"], pdf["tokens"], strict=True):
                plan = deduce([r.asDict() if hasattr(r, "asDict") else dict(r) for r in found])
                if plan.main is not None:
                    rows.append((host, plan.main, sorted(plan.lists), sorted(plan.texts)))
            yield pd.DataFrame(rows, columns=["host", "main", "lists", "texts"])

    return listed.mapInPandas(run, "host string, main long, lists array<long>, texts array<long>")


def deduce(tokens: list[dict]) -> Plan:
    """The template of one host from its frequent tokens."""
    up = {t["token"]: t["up"] for t in tokens if not t["text"]}
    element = {t["token"]: t for t in tokens if not t["text"]}
    classes: dict[str, list[dict]] = defaultdict(list)
    for t in tokens:
        if t["once"] == t["pages"]:
            classes[t["vector"]].append(t)
    frame: dict[int, str] = {}

    def around(at: int, own: str | None = None) -> int | None:
        """The nearest template element that holds element `at`, not of the class `own`."""
        while at in up and at != 0:
            at = up[at]
            if at in frame and frame[at] != own:
                return at
        return None

    for vector, members in sorted(classes.items(), key=lambda c: (-c[1][0]["pages"], c[0])):
        inside = [t["token"] for t in members if not t["text"]]
        for t in inside:
            frame[t] = vector
        if not inside or len({around(t, vector) for t in inside}) > 1:
            for t in inside:
                del frame[t]
    if 0 not in frame:
        return Plan()

    def holder(text: dict) -> int | None:
        return text["up"] if text["up"] in frame else around(text["up"])

    texts = [t for t in tokens if t["text"] and t["once"] == t["pages"] and frame.get(holder(t)) == t["vector"]]
    weight = {f: element[f]["chars"] for f in frame}
    fixed = dict.fromkeys(frame, 0)
    for t in texts:
        at = holder(t)
        while at is not None:
            fixed[at] += t["chars"]
            weight[at] -= t["chars"]
            at = around(at)
    children = defaultdict(list)
    for f in frame:
        if f != 0:
            children[around(f)].append(f)
    main = 0
    while True:
        inner = [c for c in children[main] if element[c]["holds"]]
        best = max(inner, key=lambda c: (weight[c], -c), default=None)
        if best is None or 2 * weight[best] <= weight[main]:
            break
        main = best
    if main == 0:
        return Plan()
    # text that makes up half of the article and more is that of copies
    own = () if 2 * fixed[main] > element[main]["chars"] else [t["token"] for t in texts]
    nested, todo = [], list(children[main])
    while todo:
        at = todo.pop()
        todo += children[at]
        if element[at]["holds"] and element[at]["links"] >= LINKS * (element[at]["chars"] + element[at]["links"]) > 0:
            nested.append(at)
    return Plan(main, nested, own)


def main_text(page: str, plan: Plan = Plan()) -> str:
    """The blocks of the article's slot without template texts and what is nested for other ends, joined by newlines;
    where the page has no such slot, the blocks of the best main rank that are not furniture."""
    found = parse(page, plan)[0]
    slot = [b for b in found if b.node.inside]
    if slot:
        return "\n".join(b.text for b in slot if not b.node.below and b.token not in plan.texts)
    rest = [b for b in found if not b.node.furniture]
    best = max((b.node.main for b in rest), default=0)
    return "\n".join(b.text for b in rest if b.node.main == best)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of pages.

    A page of a host with a template gives what is left in the article's slot. Pages of hosts
    with fewer than MIN_PAGES pages, or without such a slot, give the blocks inside article
    elements (else main elements, else elements named as content, else all) that are not furniture
    by their elements. Defined cases: null or empty html gives the empty text; a null
    url has the empty host; repeated rows count as pages of their own; pages of any length and depth are
    read whole; unclosed elements end with their parents, an unclosed comment or script
    with the page; an empty table gives no rows; further columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^[^:/?#]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("page"),
        F.concat_ws(" ", F.col(id_col).cast("string"), F.col(url_col)).alias("key"),
    )
    plans = cut(templates(rows), "templates")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    spread = plans.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.join(spread, ["host", "_salt"], "left").select("page_id", "url", "page", F.concat(F.array("main"), "lists").alias("slots"), "texts")

    def run(batches):
        for pdf in batches:
            texts = [
                main_text(p or "", Plan() if slots is None else Plan(slots[0], slots[1:], own))
                for p, slots, own in zip(pdf["page"], pdf["slots"], pdf["texts"], strict=True)
            ]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    id_type = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"page_id {id_type}, url string, text string, n_chars long")
