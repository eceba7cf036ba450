"""Main text of web pages, through templates deduced from equivalence classes of tokens.

Tokens are a page's tags and its blocks' texts, told apart by their place (the path of tags above them, as a hash of its last tag and the path before it). Over the distinct
pages of a host (copies of one page's source count once), each token has an occurrence vector: how often it occurs on each page. Tokens with equal vectors form a class. A
class is valid if it is large (LEAST tokens), frequent (SUPPORT pages and SHARE of the host's) and nests: all its tokens lie
in one place of the class around it. Valid classes make the host's template; what a page has between the template's
elements are its slots.

Vectors are never built: a vector's fingerprint is the sum of hashes of (page, count), which partial aggregation merges, so
a host of any size is spread over all tasks. Copies are taken out before, by the hash of their source, token by token, so that no
source is shuffled. The same sums tell how much text outside links stands under each element of the template, and
how much of that varies from page to page.

* A text of a valid class is the template's if the class also holds an element around it. A passage that many
  articles quote has a vector of its own, without such an element, and stays.
* The article's slot is found by descent from the page's root: to the element of the template that holds nearly all (HOLD)
  of the text that varies over the host's pages, as far as an article element or the last such container. So a page with a short article
  next to a long advert is read as the host's other pages tell. Varying headings and paragraphs beside the way down belong to it.
* Inside the slot the template's texts go, but for headings, and unless nearly all of the slot's text on the host's
  pages is the template's: then the pages are copies of an article.
* Markup breaks ties: where no element holds nearly all, article and main elements are taken. Elements and roles that are
  never an article's (nav, footer, aside, form and so on, and containers whose whole class is a name such as "ad" or "comments") are left out.
  Parts of class names and ids decide nothing.
* A host with fewer than SUPPORT distinct pages has no template. There a page is read alone: its article and main elements, or
  else the container that holds nearly all of its own text.

Defined results: null and empty pages and pages without text outside such elements have the text ""; a null url is a host of its own;
an empty table gives an empty result; each repeated row gets its text. Columns other than those named, also of clashing names,
are ignored. Nothing is cut off, however long, and a page takes time and memory in proportion to its length, however deep its elements nest.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint, extended, map_columns, table

SUPPORT, SHARE, LEAST = 10, 0.25, 3
#: An element that holds so much of the text around it holds nearly all.
HOLD = 0.8
#: Templates are broadcast up to so many bytes, and else joined by host.
BROADCAST = 8 << 20

# Elements by kind, roles, and whole class names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template iframe textarea noembed noframes xmp title svg object canvas audio video select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav header footer aside form dialog search button fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset("ad ads advert adverts advertisement comments cookie-banner cookie-notice cookie-consent newsletter".split())
CONTAINERS = frozenset("html body div section main article center details figure table tbody ul ol menu dl".split())
SECTIONS = frozenset("article main section".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
HEADS = TITLES | frozenset("caption dt legend summary th".split())
CLOSES_P = BLOCKS - {"option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "title"}
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/>])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""", re.IGNORECASE)
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m[1].lower() if m else url


@dataclass
class Element:
    tag: str
    #: hash of the label and the path above
    path: int
    above: int
    #: not the article's by element, role, name or state
    chrome: bool
    #: a link
    link: bool = False
    #: tag and classes
    label: str = ""


@dataclass
class Block:
    element: int
    text: str
    #: characters inside links
    linked: int


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def parse(source: str | None) -> Page:
    """Elements in order of their start tags, and blocks of text with white space made single spaces."""
    page = Page([Element("", 0, -1, False)])
    stack, parts, linked, at, text = [0], [], 0, 0, source or ""
    links = 0
    open_: dict[str, list[int]] = defaultdict(list)  # by tag, where its open elements are in the stack

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            t = " ".join("".join(parts).split())
            if t:
                page.blocks.append(Block(stack[-1], t, linked))
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = _html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if links:
                linked += len(raw.strip())

    def close_to(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            tag = page.elements[stack[-1]].tag
            if tag in BLOCKS:
                flush()
            links -= tag == "a"
            stack.pop()
            open_[tag].pop()

    def last(tags: set | frozenset) -> int:
        return max((open_[t][-1] for t in tags if open_.get(t)), default=0)

    def find(tags: set, stops: frozenset | set) -> int | None:
        """The innermost open element of some tags, where none of stops is inside it."""
        k = last(tags)
        return k if k > last(stops) else None

    while at < len(text):
        m = _TAG.search(text, at)
        if not m:
            break
        add(text[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if (k := find({tag}, frozenset())) is not None:
                close_to(k)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag in BLOCKS:
            if tag in CLOSES_P and (k := find({"p"}, frozenset({"td", "th", "table", "button", "caption", "object"}))) is not None:
                close_to(k)
            if tag in SIBLINGS and (k := find(SIBLINGS[tag], SCOPES[tag])) is not None:
                close_to(k)
            flush()
        if tag in VOID:
            continue
        attrs = {}
        for a in _ATTR.finditer(m[3] or m[6] or ""):
            attrs.setdefault(a[1].lower(), _html.unescape(a[2] or a[3] or a[4] or ""))
        above = page.elements[stack[-1]]
        classes = attrs.get("class", "").split()
        label = f"{tag}.{'.'.join(classes)}" if classes else tag
        hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.IGNORECASE))
        # a header inside an article or section holds its title
        fixed = tag in CHROME and not (tag == "header" and last(SECTIONS))
        named = tag in CONTAINERS and tag not in ("html", "body", "main", "article") and not NAMES.isdisjoint(x.lower() for x in classes)
        chrome = hidden or fixed or named or attrs.get("role", "").lower() in ROLES
        page.elements.append(Element(tag, _hash(f"{above.path}/{label}"), stack[-1], chrome, tag == "a", label))
        open_[tag].append(len(stack))
        stack.append(len(page.elements) - 1)
        links += tag == "a"
    add(text[at:])
    close_to(1)
    flush()
    return page


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def tag_token(path: int) -> int:
    return _hash(f"<{path}")


def text_token(path: int, text: str) -> int:
    return _hash(f"{path}\0{text}")


def weights(page: Page) -> tuple[list[int], list[int], list[int]]:
    """For each element the characters of its blocks outside links and inside links, and its links."""
    n = len(page.elements)
    free, linked, links = [0] * n, [0] * n, [0] * n
    for b in page.blocks:
        linked[b.element] += min(b.linked, len(b.text))
        free[b.element] += max(0, len(b.text) - b.linked)
    for k in range(n - 1, 0, -1):  # elements come after those around them
        x = page.elements[k]
        links[k] += x.link
        free[x.above] += free[k]
        linked[x.above] += linked[k]
        links[x.above] += links[k]
    return free, linked, links


def tokens_of(page: Page) -> dict[int, list]:
    """token: [path, whether text, count, place of the first, characters outside links, path above, label]; token 0 stands for the page itself.

    Of a text, both paths are that of its element."""
    out: dict[int, list] = {0: [0, False, 1, -1, 0, 0, ""]}
    free = weights(page)[0]
    for place, e in enumerate(page.elements[1:]):
        key = tag_token(e.path)
        if key in out:
            out[key][2] += 1
            out[key][4] += free[place + 1]
        else:
            out[key] = [e.path, False, 1, place, free[place + 1], page.elements[e.above].path, e.label]
    for k, b in enumerate(page.blocks):
        path = page.elements[b.element].path
        key = text_token(path, b.text)
        own = max(0, len(b.text) - b.linked)
        if key in out:
            out[key][2] += 1
            out[key][4] += own
        else:
            out[key] = [path, True, 1, k, own, path, page.elements[b.element].label]
    return out


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A row for each host with a template: host, and its tokens as structs in the template's order.

    class and parent number the host's valid classes (parent -1: none); pages are the distinct pages that hold the
    token, everywhere whether each page has it once; fixed tells the template's texts; for elements, mass is the varying text under one occurrence in
    characters, stable that of the template's texts, rest the varying text outside of the template's elements below it. A
    template is bounded: each of its tokens is on a SHARE of the host's pages, so it holds at most 1 / SHARE times an average
    page's tokens.
    """
    base = pages.select(F.col(url).alias("__url"), F.col(html).alias("__html"))

    def f(cols):
        out = {n: [] for n in ("host", "token", "path", "is_text", "n", "place", "free", "above", "label", "mark")}
        for host, x in dict.fromkeys((host_of(u), x or "") for u, x in zip(cols["__url"], cols["__html"], strict=True)):
            mark = _hash(x)
            for token, row in tokens_of(parse(x)).items():
                for name, v in zip(out, (host, token, *row, mark), strict=True):
                    out[name].append(v)
        return out

    rows = map_columns(base, lambda: f, "host string, token long, path long, is_text boolean, n long, place long, free long, above long, label string, mark long").distinct()
    h = F.xxhash64("mark", "n")
    rows = rows.withColumns({"h1": F.shiftrightunsigned(h, 33), "h2": h.bitwiseAND(F.lit(0x7FFFFFFF))})
    tokens = rows.groupBy("host", "token", "path", "is_text", "above", "label").agg(
        F.count("*").alias("pages"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"), F.sum("n").alias("times"), F.max("n").alias("most"), F.sum("free").alias("free"), F.avg("place").alias("place")
    )
    frequent = checkpoint(tokens.filter(F.col("pages") >= SUPPORT))
    whole = frequent.filter("token = 0").select(F.col("host").alias("__host"), F.col("pages").alias("all_pages"))
    x = frequent.filter("token != 0").join(whole, F.col("host").eqNullSafe(F.col("__host"))).filter(F.col("pages") >= SHARE * F.col("all_pages")).drop("__host")
    by = Window.partitionBy("host", "pages", "h1", "h2")
    # elements of small classes only tell what is above what
    x = x.withColumn("large", F.count("*").over(by) >= LEAST).filter(F.col("large") | ~F.col("is_text"))
    x = x.withColumn("everywhere", (F.col("pages") == F.col("all_pages")) & (F.col("most") == 1))
    entry = F.struct("is_text", "place", "token", "path", "pages", "h1", "h2", "times", "free", "everywhere", "above", "label", "large")
    grouped = x.groupBy("host").agg(F.sort_array(F.collect_list(entry)).alias("__t"))
    schema = "template array<struct<token:long,path:long,above:long,label:string,is_text:boolean,class:int,parent:int,pages:long,everywhere:boolean,fixed:boolean,mass:double,stable:double,rest:double>>"

    def make():
        return lambda cols: cols | {"template": [nested(rows) for rows in cols.pop("__t")]}

    return map_columns(grouped, make, extended(grouped.drop("__t"), schema))


def _descent(rows: list, above: dict[int, int], holds: Callable[[int], bool]) -> Iterator[tuple]:
    """The rows, an element's after those of the elements around it, each with the nearest of these that holds (0: none)."""
    nearest = {0: 0}
    for r in rows:
        way, p = [], r["path"] if r["is_text"] else r["above"]
        while p not in nearest:
            way.append(p)
            p = above[p]
        for q in reversed(way):
            nearest[q] = q if holds(q) else nearest[above[q]]
        yield r, nearest[r["path"] if r["is_text"] else r["above"]]


def nested(rows: list) -> list[dict]:
    """The template of one host: its large and frequent classes' tokens, of the classes that nest.

    An element that is frequent is below frequent ones only, so rows hold the way up from each. Each row is looked at a fixed number of times.
    """
    above = {r["path"]: r["above"] for r in rows if not r["is_text"]}
    rows = [r for r in rows if r["large"]]
    number: dict[tuple, int] = {}
    of = [number.setdefault((r["pages"], r["h1"], r["h2"]), len(number)) for r in rows]
    holder = {r["path"]: c for r, c in zip(rows, of, strict=True) if not r["is_text"]}
    # by element and class: the outermost element of the class on the way to the element; told from the nearest element of the template, as ways share their beginnings
    up = {r["path"]: near for r, near in _descent([r for r in rows if not r["is_text"]], above, holder.__contains__)}
    below: dict[int, list[int]] = defaultdict(list)
    for p, q in up.items():
        below[q].append(p)
    texts: dict[int, list[int]] = defaultdict(list)
    for k, (_, near) in enumerate(_descent(rows, above, holder.__contains__)):
        texts[near].append(k)
    held, places = [False] * len(rows), {}
    way: list[int] = []  # the elements of the template on the way, and by class where the first of its own is
    first: dict[int, int] = {}
    todo: list[tuple[int, bool]] = [(0, True)]
    while todo:
        p, enters = todo.pop()
        if not enters:
            if first.get(holder[p]) == len(way) - 1:
                del first[holder[p]]
            way.pop()
            continue
        if p:
            first.setdefault(holder[p], len(way))
            way.append(p)
            todo.append((p, False))
        for k in texts[p]:
            c = of[k]
            held[k] = c in first
            # the nearest element of another class that this class doesn't hold in turn
            n = first.get(c, len(way))
            places.setdefault(c, set()).add(way[n - 1] if n else 0)
        todo += [(q, True) for q in below[p]]
    # a class is in one place of the class around it; what lies above the outermost class is no place
    valid = {c for c, p in places.items() if len(p) == 1}
    parent = {c: holder.get(next(iter(places[c])), -1) for c in valid}
    kept = [(r, c, h) for r, c, h in zip(rows, of, held, strict=True) if c in valid]
    elements = {r["path"]: r for r, _, _ in kept if not r["is_text"]}
    around = [near for _, near in _descent([r for r, _, _ in kept], above, elements.__contains__)]
    stable, order = dict.fromkeys(elements, 0), []
    for (r, _, h), near in zip(kept, around, strict=True):
        if r["is_text"] and h and near:
            stable[near] += r["free"]
        elif not r["is_text"]:
            order.append((r["path"], near))
    kids: dict[int, list[int]] = defaultdict(list)
    for p, near in order:
        kids[near].append(p)
    turn = [0]
    for p in turn:  # grows as it runs: what is around comes first
        turn += kids[p]
    higher = dict(order)
    for p in reversed(turn[1:]):
        if higher[p]:
            stable[higher[p]] += stable[p]
    rest = {p: r["free"] - stable[p] for p, r in elements.items()}
    for p, r in elements.items():
        if higher[p]:
            rest[higher[p]] -= r["free"] - stable[p]
    out = []
    for r, c, h in kept:
        row = {n: r[n] for n in ("token", "path", "above", "label", "is_text", "pages", "everywhere")}
        row |= {"class": c, "parent": parent[c] if parent[c] in valid else -1, "fixed": r["is_text"] and h, "mass": 0.0, "stable": 0.0, "rest": 0.0}
        if not r["is_text"]:
            p, times = r["path"], max(1, r["times"])
            row |= {"mass": (r["free"] - stable[p]) / times, "stable": stable[p] / times, "rest": max(0, rest[p]) / times}
        out.append(row)
    return out


def _below(page: Page, roots: list[int]) -> list[bool]:
    """Whether an element is one of the roots or inside one."""
    out, of = [False] * len(page.elements), set(roots)
    out[0] = 0 in of
    for k in range(1, len(out)):
        out[k] = out[page.elements[k].above] or k in of
    return out


def _by_markup(page: Page, closed: list[bool], under: list[int]) -> list[int]:
    """The outermost open article elements under some, and main elements without one inside, with the main headings around them."""
    e, n = page.elements, len(page.elements)
    nested_, holds, ok = [False] * n, [False] * n, _below(page, under)
    for k in range(1, n):
        up = e[k].above
        nested_[k] = nested_[up] or e[up].tag == "article"
        if e[k].tag == "article" and not closed[k]:
            while up > 0 and not holds[up]:
                holds[up] = True
                up = e[up].above
    open_ = [k for k in range(1, n) if ok[k] and not closed[k]]
    roots = [k for k in open_ if not nested_[k] and (e[k].tag == "article" or (e[k].tag == "main" and not holds[k]))]
    if not roots:
        return []
    taken, around = _below(page, roots), _below(page, [k for k in open_ if e[k].tag == "main" and holds[k]])
    if not any(taken[k] and e[k].tag == "h1" for k in open_):
        roots += [k for k in open_ if e[k].tag == "h1" and around[k] and not taken[k]]
    return roots


def _by_template(page: Page, closed: list[bool], slots: dict[int, tuple[float, float, float]]) -> tuple[list[int], int]:
    """The roots of the article's slot as the host's other pages tell, and the template's element that the descent ends in."""
    e = page.elements
    known: dict[int, tuple | None] = {}
    at, kids = [0] * len(e), {0: []}  # the nearest element of the template
    figures: dict[int, tuple] = {0: (0.0, 0.0, 0.0)}
    articles = [False] * len(e)
    for k in range(1, len(e)):
        path = e[k].path
        if path not in known:
            known[path] = slots.get(tag_token(path))
        at[k] = at[e[k].above]
        if known[path] is not None and not closed[k]:
            kids[at[k]].append(k)
            figures[k], kids[k], at[k] = known[path], [], k
    for k in range(len(e) - 1, 0, -1):
        articles[k] = articles[k] or (e[k].tag == "article" and not closed[k])
        articles[e[k].above] = articles[e[k].above] or articles[k]
    top, beside, marks = 0, [], True
    while e[top].tag != "article" and (e[top].tag != "main" or articles[top]):
        times = Counter(e[k].path for k in kids[top])
        varying = sum(figures[k][0] for k in kids[top]) + figures[top][2]
        ways = [k for k in kids[top] if e[k].tag in CONTAINERS and times[e[k].path] == 1]
        best = max(ways, key=lambda k: figures[k][0], default=None)
        largest = max(ways, key=lambda k: figures[k][0] + figures[k][1], default=None)
        clear = best is not None and varying > 0 and figures[best][0] >= HOLD * varying
        if not clear or best != largest:
            if marks and (marked := _by_markup(page, closed, [top])):
                return [*beside, *marked], top
            marks = False  # nor is any further down
            if not clear:
                break
        beside += [k for k in kids[top] if e[k].tag not in CONTAINERS and figures[k][0] > 0]
        top = best
    return [*beside, top], top


def _alone(page: Page, closed: list[bool]) -> list[int]:
    """The root of the container that holds nearly all of a page's own open text."""
    e = page.elements
    own = [0] * len(e)
    for b in page.blocks:
        if not closed[b.element]:
            own[b.element] += max(0, len(b.text) - b.linked)
    for k in range(len(e) - 1, 0, -1):
        own[e[k].above] += own[k]
    below: dict[int, list[int]] = {}
    for k in range(1, len(e)):
        if not closed[k] and e[k].tag in CONTAINERS | {"tr", "td"}:
            below.setdefault(e[k].above, []).append(k)
    top = 0
    while (best := max(below.get(top, []), key=own.__getitem__, default=None)) is not None and own[best] >= max(1, HOLD * own[0]):
        top = best
    return [top]


def main_text(page: Page, fixed: set[int] | frozenset = frozenset(), slots: dict[int, tuple[float, float, float]] | None = None) -> str:
    """The article's blocks; fixed are the template's texts, slots its elements' (mass, stable, rest) by token."""
    e = page.elements
    n = len(e)
    free, linked, links = weights(page)
    article = [x.tag in ("article", "main") for x in e]
    for k in range(n - 1, 0, -1):
        article[e[k].above] = article[e[k].above] or article[k]  # holds an article, or is one
    closed, head = [False] * n, [False] * n
    for k in range(1, n):
        x = e[k]
        closed[k] = closed[x.above] or (x.chrome and not (x.tag == "form" and article[k]))  # a form around a whole page is a frame
        head[k] = head[x.above] or x.tag in HEADS
    top = 0
    if slots:
        roots, top = _by_template(page, closed, slots)
    else:
        roots = _by_markup(page, closed, [0]) or _alone(page, closed)
    inside, safe = _below(page, roots), _below(page, [k for k in range(1, n) if e[k].tag in ("article", "main")])
    # outside articles, a container of nothing but links is a menu
    menu = [False] * n
    for k in range(1, n):
        own = e[k].tag in CONTAINERS and links[k] > 1 and linked[k] >= HOLD * (linked[k] + free[k])
        menu[k] = menu[e[k].above] or (own and not safe[k] and k not in roots)
    blocks = [b for b in page.blocks if inside[b.element] and not closed[b.element] and not menu[b.element]]
    if slots and fixed:
        of = [x for k in roots if (x := slots.get(tag_token(e[k].path)))] or [slots.get(tag_token(e[top].path), (1.0, 0.0, 0.0))]
        mass, stable = sum(x[0] for x in of), sum(x[1] for x in of)
        if stable < HOLD * (mass + stable):  # else the host's pages are copies
            blocks = [b for b in blocks if head[b.element] or text_token(e[b.element].path, b.text) not in fixed]
    return "\n\n".join(b.text for b in blocks)


def extract(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """keep's columns and text, the main text."""
    found = checkpoint(templates(pages, url, html))
    texts = F.filter("template", lambda t: t["fixed"])
    elements = F.filter("template", lambda t: ~t["is_text"])
    held = found.select(
        F.col("host").alias("__h"), F.transform(texts, lambda t: t["token"]).alias("__fixed"),
        F.transform(elements, lambda t: F.struct(t["token"].alias("token"), t["mass"].alias("mass"), t["stable"].alias("stable"), t["rest"].alias("rest"))).alias("__slots"),
    )
    size = held.agg(F.sum(64 + 8 * F.size("__fixed") + 48 * F.size("__slots") + F.coalesce(F.octet_length("__h"), F.lit(0)))).first()[0] or 0
    base = pages.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(url).alias("__url"), F.col(html).alias("__html")).withColumn("__host", _host(F.col("__url")))
    joined = base.join(F.broadcast(held) if size <= BROADCAST else held.hint("merge"), F.col("__host").eqNullSafe(F.col("__h")), "left")
    joined = joined.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.col("__html"), F.col("__fixed"), F.col("__slots"))

    def g(cols):
        sources, fixed, slots = cols.pop("__html"), cols.pop("__fixed"), cols.pop("__slots")
        own = [{s["token"]: (s["mass"], s["stable"], s["rest"]) for s in x or ()} for x in slots]
        return cols | {"text": [main_text(parse(x), set(a or ()), b) for x, a, b in zip(sources, fixed, own, strict=True)]}

    return map_columns(joined, lambda: g, extended(joined.drop("__html", "__fixed", "__slots"), "text string"))


def _host(url):
    """host_of as a column."""
    m = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
    return F.when(url.rlike(m), F.lower(F.regexp_extract(url, m, 1))).otherwise(url)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of pages, each repeated row included; "" for null and empty pages, null urls share a host."""
    text = extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
