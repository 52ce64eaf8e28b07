"""Main-text extraction from HTML by tree scoring.

A forgiving tokenizer builds the tree, boilerplate subtrees are cut, each
paragraph passes points for its length and its commas to its parent and, at
falling shares, to the ancestors above, containers are discounted by their link
density, and the best container is kept with the siblings that score close to
it. All remaining blocks of what is kept come out in page order.

Defined results: a null or empty page, and a page without text, give an empty
text; broken markup (unclosed or stray tags, a cut tail) never raises; a very
long or deeply nested page takes work in proportion to its length; of
containers with equal scores the first to hold text wins; repeated rows are
extracted one by one; a null page_id or url is kept; an empty table gives an
empty result; other columns than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# Element and attribute words of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math object select".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CUT = frozenset("nav footer aside form script style noscript template iframe svg math object select button textarea dialog menu head title input search".split())
CUT_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar side comment comments commentlist disqus reply replies respond nav navbar navigation menu breadcrumb breadcrumbs footer header masthead "
    "popup modal overlay newsletter subscribe subscription signup login related recommended recommendations share sharing social widget toolbar pagination pager skip".split()
)
REPLY_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
KEEP_WORDS = frozenset("article body content entry main page post story text".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "button"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
FENCES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
SCOPE = frozenset("table td th caption button object html body article".split())

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|![^>]*(?:>|\Z)|\?[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)(?:>|\Z)|/[^a-zA-Z>][^>]*>|/>)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_COMMAS = re.compile("[,，、،､﹐︐⹁⸴⸲]")

# Fixed weights of the scoring.
POINT_CHARS, MOST_LENGTH_POINTS, SIBLING_SHARE = 100, 3, 0.2
#: Levels above a paragraph's container that still get points (the last one about a fiftieth), so that work is linear in depth.
SCORE_LEVELS = 16


class _Node:
    __slots__ = ("attrs", "children", "cut", "inside", "kept", "most", "parent", "score", "tag")

    def __init__(self, tag: str, parent: _Node | None, attrs: str = "") -> None:
        self.tag, self.parent, self.attrs, self.children, self.score, self.cut = tag, parent, attrs, [], 0.0, False
        self.most, self.kept = False, None
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))


def _words(attrs: str) -> tuple[set[str], dict[str, str]]:
    found = {k.lower(): _html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(attrs)}
    named = " ".join(found.get(k, "") for k in ("class", "id"))
    return {w.lower() for w in _WORD.findall(named)}, found


def _weigh(root: _Node) -> None:
    """Mark the nodes that hold most of the page's text outside links and furniture, and most of its articles' text (else of main)."""
    order, skip, inside = [root], [False], [""]
    text: dict[int, list[int]] = {}
    for k, node in enumerate(order):  # grows meanwhile; parents come first
        off = skip[k] or node.tag == "a" or (node.tag in CUT and node.tag != "form")
        place = node.tag if node.tag == "article" or (node.tag == "main" and not inside[k]) else inside[k]
        own = 0
        for x in node.children:
            if isinstance(x, str):
                own += 0 if off else len(x.strip())
            else:
                order.append(x)
                skip.append(off)
                inside.append(place)
        text[id(node)] = [own, own * (place == "article"), own * (place == "main")]
    for node in reversed(order):
        if node.parent is not None:
            up = text[id(node.parent)]
            for j, n in enumerate(text[id(node)]):
                up[j] += n
    total = text[id(root)]
    told = 1 if total[1] else 2 if total[2] else 0
    for node in order:
        own = text[id(node)]
        node.most = 2 * own[0] > total[0] and 2 * own[told] > total[told]


def _is_cut(node: _Node) -> bool:
    tag = node.tag
    if tag in CUT and not (tag == "form" and node.most):
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    if tag == "header":
        # a header inside the article holds its title; elsewhere it is page furniture
        if not node.inside:
            return True
    if not node.attrs:
        return False
    words, attrs = _words(node.attrs)
    if attrs.get("role", "").lower() in CUT_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    # whole names only: a part of one, as in no-sidebar, says little; what is not cut here is left to the scores
    tokens = set(" ".join(attrs.get(k, "") for k in ("class", "id")).lower().split())
    return bool(tokens & CUT_WORDS) and not words & KEEP_WORDS and (not node.most or bool(tokens & REPLY_WORDS))


def parse(page: str) -> _Node:
    """Tree of a page; text nodes are strings among the children."""
    root = _Node("#root", None)
    at = root
    pos, n = 0, len(page)
    find = _TAG.search
    open_: Counter[str] = Counter()  # how many elements of each tag are open: a stray end tag need not look for one

    def close(to: _Node) -> _Node:
        """Closes the elements from the current one up to, and without, `to`."""
        up = at
        while up is not to:
            open_[up.tag] -= 1
            up = up.parent
        return to

    while pos < n:
        m = find(page, pos)
        if m is None:
            at.children.append(_html.unescape(page[pos:]))
            break
        if m.start() > pos:
            at.children.append(_html.unescape(page[pos : m.start()]))
        pos = m.end()
        name = m[2]
        if not name:
            continue
        tag = name.lower()
        if m[1]:
            if tag in VOID:
                if tag == "br":
                    at.children.append(_Node("br", at))
                continue
            if not open_[tag]:
                continue
            up = at
            while up is not root and up.tag != tag:
                if up.tag in SCOPE and tag not in ("html", "body", "article", "table") and tag not in BLOCK:
                    up = root
                    break
                up = up.parent
            if up is not root:
                at = close(up.parent)
            continue
        if tag in CLOSES_P and open_["p"]:
            up = at
            while up is not root and up.tag != "p" and up.tag not in SCOPE and (up.tag not in BLOCK or up.tag == "p"):
                up = up.parent
            if up.tag == "p":
                at = close(up.parent)
        if tag in SAME and any(open_[x] for x in SAME[tag]):
            up, fence = at, FENCES[tag]
            last = None
            while up is not root and up.tag not in fence:
                if up.tag in SAME[tag]:
                    last = up
                up = up.parent
            if last is not None:
                at = close(last.parent)
        node = _Node(tag, at, m[3])
        at.children.append(node)
        if tag in VOID or (m[4] and tag in RAW):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        at = node
        open_[tag] += 1
    return root


class _Block:
    __slots__ = ("link", "node", "parts")

    def __init__(self, node: _Node) -> None:
        self.node, self.parts, self.link = node, [], 0


def _blocks(root: _Node) -> list[_Block]:
    """Runs of text between block boundaries, in page order, without the cut subtrees."""
    out: list[_Block] = []
    at = _Block(root)
    stack: list[tuple] = [(root, 0, root, False)]
    while stack:
        node, k, owner, link = stack.pop()
        children = node.children
        while k < len(children):
            x = children[k]
            k += 1
            if isinstance(x, str):
                at.parts.append(x)
                if link:
                    at.link += len(x.strip())
                continue
            if x.tag == "br":
                at.parts.append(" ")
                continue
            if x.tag in VOID and x.tag != "hr":
                continue
            if x.tag in RAW or _is_cut(x):
                if x.tag in BLOCK and at.parts:
                    out.append(at)
                    at = _Block(owner)
                x.cut = True
                continue
            block = x.tag in BLOCK
            stack.append((node, k, owner, link))
            if block:
                if at.parts:
                    out.append(at)
                at = _Block(x)
                stack.append((x, 0, x, link))
            else:
                stack.append((x, 0, owner, link or x.tag == "a"))
            break
        else:
            if node is owner or node.tag in BLOCK:
                if at.parts:
                    out.append(at)
                at = _Block(stack[-1][2] if stack else root)
    if at.parts:
        out.append(at)
    return out


def _share(level: int) -> float:
    """The share of a paragraph's points that the container `level` levels above its own gets."""
    return 1.0 if level == 0 else 0.5 if level == 1 else 1 / (3 * level)


def _from_leaves(holders: dict[int, _Node], root: _Node) -> list[_Node]:
    """The nodes that hold text, each before its ancestors."""
    seen: dict[int, _Node] = {}
    children: dict[int, list[_Node]] = {}
    for node in holders.values():
        while node is not None and id(node) not in seen:
            seen[id(node)] = node
            if node.parent is not None:
                children.setdefault(id(node.parent), []).append(node)
            node = node.parent
    order = [root]
    for node in order:  # grows meanwhile
        order += children.get(id(node), ())
    return order[::-1]


def extract(page: str | None) -> str:
    """The main text of one page, one line per block."""
    if not page:
        return ""
    root = parse(page)
    _weigh(root)
    texts: list[tuple[_Block, str]] = []
    for b in _blocks(root):
        text = _SPACE.sub(" ", "".join(b.parts)).strip()
        if text:
            texts.append((b, text))
    if not texts:
        return ""
    chars: dict[int, list[int]] = {}  # characters, and those in links, of each node that holds text: of its own first
    own: dict[int, float] = {}  # points that paragraphs pass to their container
    holders: dict[int, _Node] = {}
    for b, text in texts:
        node, points = b.node, 1 + len(_COMMAS.findall(text)) + min(len(text) // POINT_CHARS, MOST_LENGTH_POINTS)
        points *= 1 - min(1.0, b.link / len(text))
        heading = node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        total = chars.setdefault(id(node), [0, 0])
        total[0] += len(text)
        total[1] += min(len(text), b.link)
        holders[id(node)] = node
        if not heading:
            up = node if node.tag != "p" else node.parent
            own[id(up)] = own.get(id(up), 0.0) + points
            holders[id(up)] = up
    # one walk gives every node's number before its ancestors', so that totals pass upwards once; points fall with the levels
    order = _from_leaves(holders, root)
    scored: dict[int, _Node] = {}
    passed: dict[int, list[float]] = {}
    for node in order:
        total = chars.setdefault(id(node), [0, 0])
        at = [own.get(id(node), 0.0), *passed.pop(id(node), [])][:SCORE_LEVELS]
        if node.tag != "#root":
            node.score = sum(x * _share(k) for k, x in enumerate(at))
            if any(at):
                scored[id(node)] = node
        if node.parent is not None:
            above = chars.setdefault(id(node.parent), [0, 0])
            above[0] += total[0]
            above[1] += total[1]
            told = passed.setdefault(id(node.parent), [0.0] * SCORE_LEVELS)
            for k, x in enumerate(at):
                if k < SCORE_LEVELS:
                    told[k] += x

    def rank(x: _Node) -> float:
        total, link = chars[id(x)]
        bonus = 25.0 if x.tag in ("article", "main") else 0.0
        if x.attrs and x.tag not in ("html", "body"):
            bonus += 5.0 * bool(_words(x.attrs)[0] & KEEP_WORDS)
        if x.tag in ("html", "body"):
            bonus -= 5.0
        return (x.score + bonus) * (1 - link / max(1, total))

    if not scored:
        return "\n".join(t for _, t in texts)
    best = max(scored.values(), key=rank)
    # the article that holds the best container is the whole of it
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
        up = up.parent
    kept = {id(best)}
    if best.parent is not None and best.tag not in ("body", "html", "article", "main"):
        least = max(10.0, SIBLING_SHARE * rank(best))
        for x in best.parent.children:
            if isinstance(x, str) or x is best or id(x) not in chars:
                continue
            total, link = chars[id(x)]
            density = link / max(1, total)
            if (id(x) in scored and rank(x) >= least) or (x.tag in ("p", "h1", "h2", "h3", "blockquote", "pre", "ul", "ol", "table") and density < 0.25):
                kept.add(id(x))
    elif best.tag in ("article", "main") and best.parent is not None:
        kept |= {id(x) for x in best.parent.children if not isinstance(x, str) and x.tag == best.tag and id(x) in scored and rank(x) >= SIBLING_SHARE * rank(best)}
    out = []
    for b, text in texts:
        path, up = [], b.node
        while up is not None and up.kept is None:  # the answer is noted on the way
            if id(up) in kept:
                up.kept = True
                break
            path.append(up)
            up = up.parent
        found = up is not None and up.kept
        for x in path:
            x.kept = found
        if found:
            out.append(text)
    return "\n".join(out)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):  # bounds the Python strings alive at once
            part = batch.slice(k, 256)
            texts = [extract(x.as_py()) for x in part.column("html")]
            yield pa.record_batch([part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=_SCHEMA)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page; one pass, no shuffle."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
