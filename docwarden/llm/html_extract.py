"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text nodes, each with its tag path (the names of its open elements, root
to leaf) and its container, the innermost element around it that can hold paragraphs; paths of different
containers are different, though their names are the same. Per path are summed: characters, characters
inside links, punctuation marks, and nodes. Two ratios, characters and punctuation per node, are smoothed
over neighbouring paths of the page (1-2-1) and fused (the sum of their logarithms). Paths are content
whose fused ratio reaches a share of the page's largest, before and after smoothing, and that are not
mostly links. The page's text is that of the blocks on content paths, and of other blocks that are not
mostly links: in the same container element as content, or between content or after a heading before it
in an element around it, or in an element of the same tag path between those that hold it.

Elements whose names, classes or roles say that they are something else (menus, notices, adverts, forms,
comments and the like) are left out first, however much text they hold. Only where no sentence stands
outside of such elements is a name overruled, and only a name that layouts use too (``_innermost``).
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docwarden.llm.words import record_batch

#: Shares of the largest fused ratio that a content path reaches smoothed and by itself (fixed values).
SMOOTHED, ALONE = 0.5, 0.4
#: Element names and name parts of classes, ids and roles (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - {"br", "html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
}
NEVER = frozenset("canvas head iframe input noscript object script select style svg template textarea title".split())
ELSEWHERE = frozenset("aside button dialog footer form label menu nav".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that belong to the text around them, and those that hold paragraphs.
PARTS = frozenset("blockquote caption center dd details dl dt fieldset figcaption figure header hr li menu ol optgroup option p pre summary table tbody td tfoot th thead tr ul br address".split()) | HEADINGS
CONTAINERS = BLOCKS - PARTS | {"td", "th", "li", "blockquote"}
#: Parts of names that say it wherever they stand.
ELSEWHERE_PARTS = frozenset(
    "adsense advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "nav navbar navigation newsletter pagination popup promo promoted replies respond sidebar signup sponsored subscribe complementary contentinfo".split()
)
#: Parts that say it alone or with parts that only tell a box's shape or place.
COMMON_PARTS = frozenset(
    "ad ads alert banner dialog login menu modal notice pager related search share sharing social sponsor toolbar widget".split()
)
SHAPES = frozenset(
    "area bar block bottom box btn button buttons card cards col column container content form group header icons inner item items left link links list "
    "main outer page panel post posts articles stories right row section site slot tools top unit wrap wrapper".split()
)
#: Of these, those that are never overruled: layouts are not named after them.
FIRM_PARTS = frozenset(
    "ad ads adsense advert adverts advertisement advertising comment comments consent cookie cookies disqus footer gdpr nav navbar navigation "
    "replies respond complementary contentinfo".split()
)
HEADS = frozenset(("header", "masthead"))

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(script|style|textarea|title|iframe|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)>",
    re.IGNORECASE | re.DOTALL,
)
_NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_PART = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，]")

_EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_paths", pa.int64()), ("n_content_paths", pa.int64())])
_EXTRACTED_DDL = "page_id long, url string, text string, n_chars long, n_paths long, n_content_paths long"


def _elsewhere(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element says that it is not the page's text, and whether nothing overrules that.
    ``inside``: of an article or main."""
    if name in ("html", "body", "article", "main") or name in HEADINGS:
        return False, False
    if name in ELSEWHERE or (name == "header" and not inside):
        return True, name != "form"  # some sites put the whole page into a form
    said = firm = False
    for kind, *values in _NAMED.findall(attributes):
        # A class attribute holds several names; an id or a role is one.
        for one in "".join(values).split() if kind.lower() == "class" else ["".join(values)]:
            parts = {p.lower() for p in _PART.split(one) if p and not p.isdigit()}
            plain = ELSEWHERE_PARTS if inside else ELSEWHERE_PARTS | HEADS
            told = parts & (plain | COMMON_PARTS)
            # Ids are often made of headings ("related-work"), so all their parts must say it.
            if told and (parts <= told | SHAPES or kind.lower() != "id" and parts & plain):
                said, firm = True, firm or bool(told & FIRM_PARTS)
    return said, firm


class _Element:
    """An open or closed element. ``path`` is the number of its tag path in the page; ``elsewhere`` the innermost
    element, itself or around it, that says it is not the page's text."""

    __slots__ = ("name", "above", "path", "heading", "never", "elsewhere", "firm", "inside", "link", "block", "container", "scope", "parts", "sentences", "below")

    def __init__(self, name: str, attributes: str, above: _Element | None, paths: dict):
        self.name, self.above = name, above
        self.path = paths.setdefault((above.path if above else -1, name), len(paths))
        self.heading = bool(above) and (above.heading or name in HEADINGS)
        self.inside = bool(above) and (above.inside or above.name in ("article", "main"))
        self.never = bool(above) and (above.never or name in NEVER or bool(attributes and _HIDDEN.search(attributes)))
        said, self.firm = _elsewhere(name, attributes, self.inside) if above else (True, False)
        self.elsewhere = self if said else above.elsewhere
        self.link = bool(above) and (above.link or name == "a")
        self.block = self if not above or name in BLOCKS else above.block
        self.container = self if not above or name in CONTAINERS else above.container
        # Where its text stands: the innermost container that is not itself a part, as a list's item is.
        self.scope = self if not above or name in CONTAINERS and name not in PARTS else above.scope
        # Of an element that says it: those that say it below it, and characters of sentences in it, and in all of them.
        self.parts: list[_Element] = []
        self.sentences = self.below = 0


def _innermost(root: _Element, said: list[_Element]) -> set[_Element]:
    """The elements whose own text is the page's: the root, and where no sentence stands outside of elements
    that say they are something else, the one of these with most, and so on inwards."""
    for e in reversed(said):
        e.below += e.sentences
        if not e.firm:
            e.above.elsewhere.parts.append(e)
            e.above.elsewhere.below += e.below
    taken, at = {root}, root
    while not at.sentences and any(p.below for p in at.parts):
        at = max(reversed(at.parts), key=lambda p: p.below)
        taken.add(at)
    return taken


def _nodes(page: str) -> list[tuple[_Element, str, int, bool]]:
    """Text nodes in page order: innermost element, text, its characters, and whether a block border
    stands before it."""
    found: list[tuple] = []
    paths: dict[tuple, int] = {}
    root = _Element("", "", None, paths)
    stack, said, open_names = [root], [], Counter()
    border, at = True, 0

    def text(upto: int) -> None:
        nonlocal border
        if upto > at:
            raw = page[at:upto]
            raw = entities.unescape(raw) if "&" in raw else raw
            found.append((stack[-1], raw, len(raw.strip()), border))
            border = False

    def close(names: set[str], until: set[str]) -> None:
        if not any(open_names[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                open_names.subtract(e.name for e in stack[k:])
                del stack[k:]
                return
            if stack[k].name in until:
                return

    for m in _TOKEN.finditer(page):
        text(m.start())
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1]:
                border = border or m[1].lower() in BLOCKS
            continue
        border = border or name in BLOCKS
        if m[2] or m[5]:
            close({name}, set())
        else:
            if name in CLOSES_P:
                close({"p"}, {"td", "th", "table", "button", "object", "body", "article", "section", "div", "li", "blockquote"})
            if name in SIBLINGS:
                close(*SIBLINGS[name])
            if name not in VOID:
                stack.append(_Element(name, m[4] if m[3] else m[7], stack[-1], paths))
                open_names[name] += 1
                if stack[-1].elsewhere is stack[-1]:
                    said.append(stack[-1])
    text(len(page))
    for element, content, size, _ in found:
        if not (element.never or element.link or element.heading) and _PUNCTUATION.search(content):
            element.elsewhere.sentences += size
    own = _innermost(root, said)
    left, pending = [], False
    for element, content, size, border in found:
        pending = pending or border
        if not element.never and element.elsewhere in own:
            left.append((element, content, size, pending))
            pending = False
    return left


def _content_paths(nodes: list[tuple]) -> tuple[set, int]:
    """Paths, with their containers, whose fused ratios pass; and the number of paths."""
    sums: dict[tuple, list] = defaultdict(lambda: [0, 0, 0, 0])
    for element, text, size, _ in nodes:
        if size:
            s = sums[element.container, element.path]
            s[0] += size
            s[1] += size if element.link else 0
            s[2] += len(_PUNCTUATION.findall(text))
            s[3] += 1
    paths = list(sums)  # in order of first appearance
    if not paths:
        return set(), 0
    ratios = [(s[0] / s[3], s[2] / s[3]) for s in sums.values()]
    alone = [sum(map(math.log1p, r)) for r in ratios]
    fused = []
    for k in range(len(paths)):
        near = [(ratios[j], 2 if j == k else 1) for j in (k - 1, k, k + 1) if 0 <= j < len(paths)]
        weight = sum(w for _, w in near)
        fused.append(sum(math.log1p(sum(r[f] * w for r, w in near) / weight) for f in (0, 1)))
    text = [k for k, p in enumerate(paths) if 2 * sums[p][1] <= sums[p][0]]
    if not text:
        return set(), len(paths)
    # Of the paths that are not mostly links the largest; their mean would cut the shorter half of a page that is all text.
    most, most_alone = max(fused[k] for k in text), max(alone[k] for k in text)
    return {paths[k] for k in text if fused[k] >= SMOOTHED * most and alone[k] >= ALONE * most_alone}, len(paths)


def extract_text(page: str) -> tuple[str, int, int]:
    """The text of a page, its number of paths, and of content paths."""
    nodes = _nodes(page)
    content, paths = _content_paths(nodes)
    # Blocks: runs of nodes with the same block element and no border between them.
    runs: list[list] = []
    for node in nodes:
        if not runs or node[3] or runs[-1][0][0].block is not node[0].block:
            runs.append([])
        runs[-1].append(node)
    taken, sparse = [], []
    for run in runs:
        size = sum(n[2] for n in run)
        sparse.append(2 * sum(n[2] for n in run if n[0].link) <= size)
        taken.append(sparse[-1] and any(n[2] and (n[0].container, n[0].path) in content for n in run))
    # For each container around content: its first and last content.
    scopes = [run[0][0].scope for run in runs]
    spans: dict[_Element, list[int]] = {}
    ends: dict[_Element, int] = {}
    for held, order in ((spans, range(len(runs))), (ends, reversed(range(len(runs))))):
        for k in order:
            element = scopes[k] if taken[k] else None
            while element and element not in held:
                held[element] = [k, k] if held is spans else k
                element = element.above and element.above.scope
    for element, k in ends.items():
        spans[element][1] = k
    for k, run in enumerate(runs):
        if scopes[k] in spans and sparse[k] and run[0][0].heading:
            spans[scopes[k]][0] = min(spans[scopes[k]][0], k)
    own = {scopes[k] for k in range(len(runs)) if taken[k]}
    shapes = {(scopes[k].above and scopes[k].above.scope, runs[k][0][0].path) for k in range(len(runs)) if taken[k]}

    def beside(k: int) -> bool:
        """Whether a block that is not content belongs to the content around it."""
        scope = scopes[k]
        if scope in own:
            return True
        if scope not in spans:  # an element like its neighbours, which are content
            scope = scope.above and scope.above.scope
            if (scope, runs[k][0][0].path) not in shapes:
                return False
        return spans[scope][0] <= k <= spans[scope][1]

    parts: list[str] = []
    pending = False
    for k, run in enumerate(runs):
        pending = pending or run[0][3]
        if taken[k] or sparse[k] and beside(k):
            parts.extend([" " if pending else "", *(text for _, text, _, _ in run)])
            pending = False
    return " ".join("".join(parts).split()), paths, len(content)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, pages = (batch.column(k).to_pylist() for k in range(3))
        for low in range(0, len(ids), 256):
            found = [extract_text(p or "") for p in pages[low : low + 256]]
            yield record_batch(
                _EXTRACTED, ids[low : low + 256], urls[low : low + 256], [f[0] for f in found], [len(f[0]) for f in found],
                [f[1] for f in found], [f[2] for f in found],
            )


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html; other columns are ignored): page_id, url, text,
    n_chars (code points), and the numbers of paths and content paths. Null and empty pages, and pages
    without text, give an empty text. Rows are independent, so repeated rows give repeated results."""
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, _EXTRACTED_DDL)
