"""Main text of web pages by wrapper induction.

A page becomes a tree of its block elements, in which neighbours of one signature are one repeated node.  The trees of a
host are aligned with simple tree matching: nodes match if their signatures agree, and children are aligned in order so
that most nodes below match.  The aligned tree counts, for each text slot, on how many pages each value came, how long
its texts are and how much of them is in links.  Values that nearly all pages have are template, wherever in a slot
they stand; what varies is content unless most of it is links.

Where the article is follows from the same tree: from the root down, the child that holds most of the varying text
is taken, with headings before it and other long varying parts beside it, until no child (or one that is text itself)
stands out.  So menus, adverts, sidebars and footers go by their place and form, whatever their classes are.  Forms,
hidden parts, asides and reader comments are told by their marks.  Hosts of fewer than PAGES different pages have no
template; there the lists of tags and words below decide, and a marked article.

Trees merge, so every task aligns the pages it reads into one tree per host, and the trees of a host
are merged in two steps; a hot host costs one small tree per task.  The pages themselves are never
shuffled while the rules of all hosts stay under a checked size; beyond it pages and rules are joined by
host, with hot hosts salted.
"""

from __future__ import annotations

import bisect
import html as _html
import json
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.cluster import FAN, written

#: Counters of a slot's values: one that comes more often than once in VALUES is never lost (Misra-Gries).
VALUES = 4096
#: A value is constant if this share of a slot's pages have it, on so many pages and this share of the host's at least.
CONSTANT, PAGES, PRESENT = 0.9, 5, 0.3
#: Share of the varying text at which a child is taken alone; a part beside it stays if it has so many varying characters a
#: page and is made of paragraphs, or else has this share too.
MOST, BESIDE, LONG = 0.8, 0.05, 150
#: Nodes in fewer than one of RARE pages leave a tree of more than NODES nodes; their text goes by the node above.
NODES, RARE = 3000, 50
#: Levels of nodes; deeper elements belong to the last level (their text stays, block by block).
DEPTH = 100
#: Pairs of children up to which they are aligned by weight; beyond it by the longest common order of their signatures.
WORK = 1 << 16
#: Bytes of all rules up to which they are broadcast.
WRAPPERS = 16 << 20

# fixed values
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul button label svg object canvas video audio".split()
)
CLOSES_P = BLOCK - set("td th tr tbody thead tfoot caption option optgroup html body head legend label button svg object canvas video audio".split())
SCOPE = set("table td th article section aside nav main body html div ul ol form".split())
_P = {"p"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOT_ARTICLE = set("nav header footer aside form button select label svg object canvas dialog menu fieldset legend video audio".split())
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments reply replies respond "
    "discussion disqus share sharing social related recommended recommendations widget pagination pager toolbar search footer paywall alert toast disclaimer".split()
)
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())

HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXT = HEADINGS | set("p pre blockquote li dd dt td th figcaption caption".split())
ASIDE = set("form aside button select label svg object canvas dialog fieldset legend video audio".split())
REMARKS = set("comment comments reply replies respond discussion disqus".split())

_TAG = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))""")
_STOP = re.compile(r"""=\s*(["'])|>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPLIT = re.compile(r"[^a-z]+")


_seen: dict[tuple[str, str], tuple[int, str]] = {}
#: Flags of text: out by the lists, in a marked article, in the head, out on every host, in a link.
LISTED, ARTICLE, HEAD, OUT, LINK = 1, 2, 4, 8, 16
#: What attributes of inline elements must hold to matter.
_TELLING = re.compile(r"class|id|role|hidden|style|aria", re.I)


def _known(name: str, attributes: str) -> tuple[int, str]:
    """_marked() with a bounded memo."""
    if name not in BLOCK and name != "section" and not _TELLING.search(attributes):
        return LINK if name == "a" else 0, name
    key = (name, attributes)
    if len(attributes) > 1000:
        return _marked(name, attributes)
    if key not in _seen:
        if len(_seen) > 20_000:
            _seen.clear()
        _seen[key] = _marked(name, attributes)
    return _seen[key]


def _marked(name: str, attributes: str) -> tuple[int, str]:
    """Flags that an element's tag and attributes give its text, and its signature."""
    link = LINK if name == "a" else 0
    if not attributes or attributes.isspace():
        return (LISTED if name in NOT_ARTICLE else 0) | (OUT if name in ASIDE else 0) | (ARTICLE if name in ("article", "main") else 0) | link, name
    found = {a.lower(): _html.unescape(b or c or d) for a, b, c, d in _ATTRIBUTE.findall(attributes)}
    classes, id, role = found.get("class", ""), found.get("id", ""), found.get("role", "").lower()
    key = name + "".join(f".{re.sub(r'[0-9]+', '', c)}" for c in classes.split()[:1]) + (f"#{re.sub('[0-9]+', '', id)}" if id else "")
    marks = {m for c in (classes + " " + id).lower().split() for m in _SPLIT.split(c)}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    whole = name in ("html", "body")
    never = name in NOT_ARTICLE or role in ROLES or hidden
    article = name in ("article", "main") or role == "main" or role == "article" or found.get("itemprop", "").lower() == "articlebody"
    out = not whole and (hidden or name in ASIDE or role in ("search", "form", "dialog", "alertdialog") or bool(marks & REMARKS))
    if not whole and not never:
        if article:
            never = bool(marks & {"comment", "comments", "reply", "related", "promo", "ad", "advert", "sponsored"})
        else:
            never = bool(marks & MARKS) or "header" in marks and not marks & {"post", "entry", "article", "content"}
    return (LISTED if never else 0) | (OUT if out else 0) | (ARTICLE if article and not never else 0) | link, key


#: What a decided node is: not content, on the way to it, content.
NO, WAY, CONTENT = 0, 1, 2


class Node:
    """A node of a host's tree: pages, children; a slot (key ``#``) has characters, those in links, and values (pages, characters)."""

    __slots__ = ("key", "n", "runs", "values", "chars", "links", "into", "keep")

    def __init__(self, key: str):
        self.key, self.n, self.runs, self.values, self.chars, self.links, self.into, self.keep = key, 1, [], None, 0, 0, None, NO


class Element:
    """An element of a page, or one of its texts (key ``#``) with flags; ``node`` is its node in the page's folded tree."""

    __slots__ = ("key", "children", "text", "flags", "node")

    def __init__(self, key: str):
        self.key, self.children, self.text, self.flags, self.node = key, [], None, 0, None


def _tag_end(page: str, at: int, open_: set[str]) -> int:
    """The place after a tag's ``>``, past quoted values; -1 if there is none.  ``open_`` remembers quotes that never end."""
    while m := _STOP.search(page, at):
        if not m[1]:
            return m.end()
        at = m.end()
        if m[1] not in open_:
            end = page.find(m[1], at)
            if end < 0:
                open_.add(m[1])
            else:
                at = end + 1
    return -1


def parse(page: str) -> Element:
    """The tree of a page's block elements; texts carry flags."""
    root = Element("html")
    stack = [("", root, 0, 0)]  # name, element that text goes to, flags, level
    names: Counter[str] = Counter()  # of open elements
    pieces: list[str] = []
    linked = [0, 0]  # characters of the text at hand: in links, all
    ends: set[str] = set()

    def flush() -> None:
        if pieces:
            _, element, flags, _ = stack[-1]
            text = "".join(pieces)
            pieces.clear()
            text = " ".join((_html.unescape(text) if "&" in text else text).split())
            if text and not flags & HEAD:
                leaf = Element("#")
                leaf.text, leaf.flags = text, flags & ~LINK | (LINK if 2 * linked[0] > linked[1] else 0)
                element.children.append(leaf)
            linked[:] = 0, 0

    def add(text: str) -> None:
        pieces.append(text)
        n = len(text) - text.count(" ")
        linked[1] += n
        if stack[-1][2] & LINK:
            linked[0] += n

    def close(upto: int) -> None:
        if any(x[0] in BLOCK for x in stack[upto:]) or (stack[upto - 1][2] ^ stack[-1][2]) & ~LINK:
            flush()
        names.subtract(x[0] for x in stack[upto:])
        del stack[upto:]

    def find(wanted: set[str], bounds: set[str]) -> int:
        if any(names[x] for x in wanted):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in wanted:
                    return k
                if stack[k][0] in bounds:
                    break
        return 0

    at, n, lowered, match = 0, len(page), None, _TAG.match
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        m = match(page, lt)
        if m is None:
            gt = page.find(">", lt) if page[lt + 1 : lt + 2] == "/" else -1
            if gt < 0:
                add("<")
                at = lt + 1
            else:
                at = gt + 1
            continue
        if m[1] or m[2]:
            end = page.find("-->", lt + 4) if m[1] else page.find(">", lt)
            at = n if end < 0 else end + (3 if m[1] else 1)
            continue
        at, name = _tag_end(page, m.end(), ends), m[4].lower()
        if at < 0:  # the page ends inside a tag
            break
        attributes = page[m.end() : at - 1]
        if name == "head" and not m[3] and (end := page.find("</head>", at)) >= 0:
            at = end + 7
            continue
        if m[3]:
            if name == "br":
                pieces.append(" ")
            elif k := find({name}, SCOPE if name not in BLOCK else set()):
                close(k)
            continue
        if name in RAW:
            lowered = page.lower() if lowered is None else lowered
            if len(lowered) == n:
                end = lowered.find("</" + name, at)
            else:
                found = re.compile("</" + name, re.I).search(page, at)
                end = found.start() if found else -1
            gt = page.find(">", end) if end >= 0 else -1
            at = n if gt < 0 else gt + 1
            continue
        if name in VOID:
            if name in ("br", "hr"):
                pieces.append(" ")
            continue
        if name in CLOSES_P and (k := find(_P, SCOPE)):
            close(k)
        if name in IMPLIED and (k := find(IMPLIED[name], {"ul", "ol", "dl", "table", "select"})):
            close(k)
        if name == "body" and (k := find({"head"}, set())):
            close(k)
        _, element, flags, level = stack[-1]
        if name in ("html", "body") and names[name]:
            continue
        marks, key = _known(name, attributes)
        own = flags | marks | (HEAD if name == "head" else 0)
        if name in BLOCK or (own ^ flags) & (LISTED | OUT) or name == "section":
            flush()
            if level < DEPTH:
                child = Element(key)
                element.children.append(child)
                element, level = child, level + 1
        stack.append((name, element, own, level))
        names[name] += 1
    flush()
    return root


def _score(a: Node, b: Node, memo: dict) -> int:
    """Nodes matched by simple tree matching."""
    if a.key != b.key:
        return 0
    if not a.runs or not b.runs:
        return 1
    at = (id(a), id(b))
    if at not in memo:
        pairs = align(a.runs, b.runs, memo)
        memo[at] = 1 + sum(_score(a.runs[i], b.runs[j], memo) for i, j in pairs)
    return memo[at]


def align(x: list[Node], y: list[Node], memo: dict) -> list[tuple[int, int]]:
    """Pairs of places of aligned children, in order, so that most nodes match."""
    if len(x) == len(y) and all(a.key == b.key for a, b in zip(x, y, strict=True)):
        return [(i, i) for i in range(len(x))]
    common = {a.key for a in x} & {b.key for b in y}
    left, right = [i for i, a in enumerate(x) if a.key in common], [j for j, b in enumerate(y) if b.key in common]
    if len(left) * len(right) > WORK:
        return _in_order(x, y, left, right)
    best = [[0] * (len(right) + 1)]
    for i in left:
        row, last = [0], best[-1]
        for k, j in enumerate(right):
            row.append(max(last[k + 1], row[k], last[k] + _score(x[i], y[j], memo)))
        best.append(row)
    i, j, out = len(left), len(right), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((left[i], right[j]))
    return out[::-1]


def _in_order(x: list[Node], y: list[Node], left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """The longest common order of children, the k-th of a signature matching the k-th only."""
    seen: Counter[str] = Counter()
    place = {}
    for j in right:
        place[y[j].key, seen[y[j].key]] = j
        seen[y[j].key] += 1
    seen.clear()
    pairs = []
    for i in left:
        j = place.get((x[i].key, seen[x[i].key]))
        seen[x[i].key] += 1
        if j is not None:
            pairs.append((i, j))
    ends, chain, before = [], [], {}
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(ends, j)
        before[k] = chain[at - 1] if at else None
        ends[at:at + 1], chain[at:at + 1] = [j], [k]
    out, k = [], chain[-1] if chain else None
    while k is not None:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def merge(a: Node, b: Node, memo: dict | None = None, same_page: bool = False) -> None:
    """Aligns tree b with tree a and adds its counts and unmatched parts to a."""
    memo = {} if memo is None else memo
    b.into = a
    a.n = a.n if same_page else a.n + b.n
    a.chars, a.links = a.chars + b.chars, a.links + b.links
    if b.values is not None:
        values = a.values
        for k, (n, chars) in b.values.items():
            values[k] = (1 if same_page else values[k][0] + n if k in values else n, chars)
        if len(values) > 2 * VALUES and not same_page:
            least = sorted((n for n, _ in values.values()), reverse=True)[VALUES]
            a.values = {k: (n - least, chars) for k, (n, chars) in values.items() if n > least}
        return
    pairs, runs, i, j = align(a.runs, b.runs, memo), [], 0, 0
    for p, q in [*pairs, (len(a.runs), len(b.runs))]:
        runs += a.runs[i:p]
        runs += b.runs[j:q]
        if p < len(a.runs):
            merge(a.runs[p], b.runs[q], memo, same_page)
            runs.append(a.runs[p])
        i, j = p + 1, q + 1
    a.runs = runs


def folded(element: Element) -> Node:
    """The tree of one page, with neighbours of one signature as one node."""
    out = element.node = Node(element.key)
    if element.text is not None:
        out.chars, out.values = len(element.text), {zlib.crc32(element.text.encode("utf-8", "replace")): (1, len(element.text))}
        out.links = out.chars if element.flags & LINK else 0
        return out
    for child in element.children:
        if child.flags & OUT:
            continue
        node = folded(child)
        if node.values is None and not node.runs:
            continue
        if out.runs and out.runs[-1].key == node.key:
            merge(out.runs[-1], node, same_page=True)
        else:
            out.runs.append(node)
    return out


def _plain(node: Node) -> list:
    values = [[k, n, c] for k, (n, c) in node.values.items()] if node.values is not None else None
    return [node.key, node.n, node.chars, node.links, [_plain(x) for x in node.runs], values]


def _shrunk(node: Node, n: int) -> None:
    node.runs = [x for x in node.runs if x.n * RARE >= n]
    for x in node.runs:
        _shrunk(x, n)


def dump(tree: Node) -> bytes:
    out = json.dumps(_plain(tree), separators=(",", ":"))
    if out.count('["') > NODES:
        _shrunk(tree, tree.n)
        out = json.dumps(_plain(tree), separators=(",", ":"))
    return zlib.compress(out.encode(), 1)


def load(stored: bytes) -> Node:
    def node(x: list) -> Node:
        out = Node(x[0])
        _, out.n, out.chars, out.links, runs, values = x
        out.runs = [node(k) for k in runs]
        out.values = {k: (n, c) for k, n, c in values} if values is not None else None
        return out

    return node(json.loads(zlib.decompress(stored)))


def decide(tree: Node) -> None:
    """Marks the nodes that hold the host's content (keep) and leaves slots only their constant values."""
    least, amount = max(PAGES, PRESENT * tree.n), {}

    def weigh(node: Node) -> int:
        if node.values is not None:
            node.values = {k: v for k, v in node.values.items() if node.n >= least and v[0] >= CONSTANT * node.n}
            varying = node.chars - sum(n * chars for n, chars in node.values.values())
            amount[id(node)] = max(0, varying) if 2 * node.links <= node.chars else 0
        else:
            amount[id(node)] = sum(weigh(x) for x in node.runs)
        return amount[id(node)]

    def keep(node: Node) -> None:
        node.keep = CONTENT if amount[id(node)] > 0 else NO
        for x in node.runs if node.keep else ():
            keep(x)

    def best(node: Node) -> Node | None:
        """The child with nearly all of the varying text, unless it is text itself."""
        top = max(node.runs, key=lambda x: amount[id(x)], default=None)
        if top is None or top.values is not None or top.key.split(".")[0].split("#")[0] in TEXT or amount[id(top)] < MOST * amount[id(node)]:
            return None
        inner = max(top.runs, key=lambda x: amount[id(x)])
        return None if inner.values is not None else top

    whole, at = weigh(tree), tree
    while whole and (top := best(at)) is not None:
        before = True
        for x in at.runs:
            if x is top:
                before = False
            elif before and x.key.split(".")[0].split("#")[0] in HEADINGS or amount[id(x)] >= LONG * x.n and (amount[id(x)] >= BESIDE * whole or x.key == "p" or any(y.key == "p" for y in x.runs)):
                keep(x)
        at.keep, at = WAY, top
    keep(at)


def rules(tree: Node) -> list:
    """What extract() needs of a decided tree: [key, keep, children, constant values]."""
    return [tree.key, tree.keep, [rules(x) for x in tree.runs], list(tree.values or ())]


def opened(rule: list) -> Node:
    out = Node(rule[0])
    out.keep, out.runs = rule[1], [opened(x) for x in rule[2]]
    out.values = dict.fromkeys(rule[3], (1, 0)) if rule[0] == "#" else None
    return out


def extract(page: Element, wrapper: Node | None) -> tuple[str, str]:
    """The page's content, in page order, and what decided: the host's tree (template), or without one marks alone."""
    out: list[tuple[str, int]] = []
    if wrapper is None:
        like: dict[int, Node] = {}
    else:
        own, like = folded(page), {}

        def match(a: Node, b: Node, memo: dict) -> None:
            like[id(a)] = b
            for i, j in align(a.runs, b.runs, memo):
                match(a.runs[i], b.runs[j], memo)

        match(own, wrapper, {})

    def walk(element: Element, above: Node | None) -> None:
        for child in element.children:
            node = child.node
            while node is not None and node.into is not None:
                node = node.into
            known = like.get(id(node)) if node is not None else None
            if child.text is None:
                walk(child, known or above)
            elif wrapper is None:
                if not child.flags & LISTED:
                    out.append((child.text, child.flags))
            elif child.flags & OUT:
                continue
            elif known is not None:
                if known.keep and zlib.crc32(child.text.encode("utf-8", "replace")) not in known.values:
                    out.append((child.text, child.flags))
            elif above.keep == CONTENT and not child.flags & LINK:  # hardly another page has it
                out.append((child.text, child.flags))

    walk(page, wrapper)
    if wrapper is not None and not out:  # a page unlike the others of its host
        return extract(page, None)
    article = [text for text, flags in out if flags & ARTICLE] if wrapper is None else []
    return " ".join(article or [text for text, _ in out]), "marks" if wrapper is None else "template"


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def wrappers(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """Rules of each host of PAGES different pages at least (host, rules binary), from its tree of all of them.

    Pages of a host that differ in scripts and comments only are aligned once.  Trees of tasks merge
    in two steps, so that no task gathers more than the trees of a share of the tasks.
    """
    content = F.xxhash64(F.regexp_replace(html, r"(?s)<script.*?</script>|<!--.*?-->", ""))
    keyed = pages.select(F.col(host).alias("host"), F.col(html).alias("html"), content.alias("content"), F.col("__id").alias("own")).filter("html is not null")
    twins = written(keyed.groupBy("host", "content").agg(F.min("own").alias("first"), F.count("*").alias("n")).filter("n > 1"), "html-twins")
    if not twins.isEmpty():
        # a page without an id among twins is aligned again only if none of them has one
        keyed = keyed.join(F.broadcast(twins) if twins.count() <= 200_000 else twins, ["host", "content"], "left").filter("first is null or own = first")

    def learn(batches):
        part, trees = TaskContext.get().partitionId() // FAN, {}
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = folded(parse(text))
                if at in trees:
                    merge(trees[at], tree)
                else:
                    trees[at] = tree
            if len(trees) > 5000:
                yield rows(trees, part)
                trees = {}
        if trees:
            yield rows(trees, part)

    def rows(trees: dict, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(trees), pa.string()), pa.array([part] * len(trees), pa.int32()), pa.array([dump(t) for t in trees.values()], pa.binary())], ["host", "part", "tree"])

    def joined(group: pa.Table) -> Node:
        stored = sorted(group["tree"].to_pylist())
        tree = load(stored[0])
        for x in stored[1:]:
            merge(tree, load(x))
        return tree

    def join(group: pa.Table) -> pa.Table:
        return pa.table([group["host"][:1], group["part"][:1], pa.array([dump(joined(group))], pa.binary())], ["host", "part", "tree"])

    def finish(group: pa.Table) -> pa.Table:
        tree = joined(group)
        decide(tree)
        made = [zlib.compress(json.dumps(rules(tree), separators=(",", ":")).encode(), 1)] if tree.n >= PAGES and tree.keep else []
        return pa.table([group["host"][: len(made)].combine_chunks(), pa.array(made, pa.binary())], ["host", "rules"])

    schema = "host string, part int, tree binary"
    partial = keyed.select("host", "html").mapInArrow(learn, schema)
    return partial.groupBy("host", "part").applyInArrow(join, schema).groupBy("host").applyInArrow(finish, "host string, rules binary")


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", salt: int = 16) -> DataFrame:
    """Main text of every page: id, url, text (empty if none), n_chars (code points), decided (by template or marks).

    Null html gives an empty text (decided by marks).  Pages without a host in their url (null urls too) form one
    host.  Pages of a host with fewer than ``PAGES`` different pages, and those that share no content node with
    the others of their host, go by marks.  Repeated rows stay; other columns of pages are not read.
    """
    chosen = pages.select(F.col(id).alias("__id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"), F.coalesce(F.nullif(F.regexp_extract(url, _HOST, 1), F.lit("")), F.lit("-")).alias("host"))
    found = written(wrappers(chosen), "html-rules")
    size = found.agg(F.coalesce(F.sum(F.length("rules")), F.lit(0))).first()[0]
    kind = chosen.schema["__id"].dataType.simpleString()
    schema = f"id {kind}, url string, text string, n_chars long, decided string"
    spark = pages.sparkSession
    held = spark.sparkContext.broadcast({r["host"]: bytes(r["rules"]) for r in found.toLocalIterator()}) if size <= WRAPPERS else None

    def read(batches):
        loaded: dict = {}
        for batch in batches:
            texts, by = [], []
            hosts = batch.column(3).to_pylist()
            own = batch.column(4).to_pylist() if batch.num_columns > 4 else [held.value.get(h) for h in hosts]
            for page, host, stored in zip(batch.column(2).to_pylist(), hosts, own, strict=True):
                if host not in loaded:
                    if len(loaded) > 2000:
                        loaded.clear()
                    loaded[host] = opened(json.loads(zlib.decompress(stored))) if stored is not None else None
                text, how = extract(parse(page), loaded[host]) if page is not None else ("", "marks")
                texts.append(text.encode("utf-8", "replace").decode())
                by.append(how)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(by, pa.string())], ["id", "url", "text", "n_chars", "decided"])

    if held is None:
        chosen = chosen.withColumn("salt", F.pmod(F.xxhash64("__id"), F.lit(salt)))
        found = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
        chosen = chosen.join(found, ["host", "salt"], "left").select("__id", "url", "html", "host", "rules")
    return chosen.mapInArrow(read, schema).withColumnRenamed("id", id)
