"""Main text of web pages by union-free regular-expression inference over the pages of a host.

A page becomes a stream of block tags and texts, made well-formed (inline markup is transparent). The streams of a host
are aligned one after another into its wrapper. Elements equal in tags and texts on both sides are its constants and anchor
the alignment; between two anchors adjacent equal stretches fold into repeated groups, tags that only one side has become
optional, and texts that differ become slots. Aligning is associative enough to be a tree: every task aligns the pages of
a host that it reads, then salted groups of the tasks' wrappers are aligned, then one per host. So a host with a third of
all pages costs each task one wrapper.

The wrapper's slots are then judged once per host: slots inside article regions and outside navigation, notices,
adverts, forms, comments and the like are its content. Class words and forms around an article or main element do not hide
it. Each page takes the regions of its own layout: those named as the article, else the heaviest one it has. Where a host
has no region, it is the element whose own paragraphs hold the most text that varies between pages. A constant of all pages of a
region (three at least, of which the greater part varies, as it would not among copies) is template inside it too, whatever its
class says, unless it is a heading or one part of a list or table. Pages are matched against their host's content slots and constants, pages to which these
give nothing against their own wrapper; the join of pages and wrappers is by host, and Spark splits a skewed host.

Text rules: character references are decoded, white space inside a block becomes one blank, blocks are trimmed and
joined by a line feed. Defined results: null or empty html and pages without content give an empty text; a page without a
url belongs to the empty host; repeated rows are extracted each.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilohour.llm.common import decoded, sized_batches, stored

# Names of the markup language, by how the parser treats them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|textarea|title|svg|annotation-xml|annotation|object"
INLINE = set(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var
    math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup
    mtable mtd mtext mtr munder munderover semantics""".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
CLOSES_LIMIT = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "html"}
# Elements, roles and words of class or id that mark what is not main text.
ASIDE = set("head nav header footer aside form script style noscript template iframe button select textarea menu dialog fieldset".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ASIDE_WORDS = set(
    """ad ads adv advert adverts advertisement advertisements adsense banner sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr
    notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register share sharing social follow related
    recommended recommendations trending popular sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager
    footer masthead topbar toolbar comment comments commentlist disqus respond reply replies discussion feedback form search skip""".split()
)
# Words that mark blocks beside the main text, not its surroundings.
COMMENT_WORDS = set("comment comments commentlist disqus respond reply replies discussion".split())
BLOCK_WORDS = set("related recommended recommendations trending popular nav navbar navigation breadcrumb breadcrumbs pagination pager".split())
INSIDE_WORDS = set("discussion popular".split())  # usual names of an article's own sections
NOT_ARTICLE = set("comment comments reply ad ads advert sponsored related".split())
MAIN_WORDS = set("article post entry story content main maincontent articlebody postcontent entrycontent".split())
# Headings, which an article's sections may share from page to page, and parts of lists and tables.
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PARTS = set("li dt dd tr td th thead tbody tfoot caption figcaption summary".split())
LEAST_PAGES = 3
# Trees are as deep as pages nest; frames of Python functions lie on the heap, so only this number would stop their walks.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1 << 30))

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>?|</[^>]*>?",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """("open", key), ("close", name), ("break", "") and ("text", decoded text), tags made well-formed."""
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # where each name is open in the stack
    at = 0

    def shut(upto: int) -> Iterator[tuple[str, str]]:
        while len(stack) > upto:
            places[stack[-1]].pop()
            yield "close", stack.pop()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1]:
                yield "break", ""
            continue
        if name in INLINE:
            continue
        if name in VOID:
            yield ("text", " ") if name in ("br", "wbr") else ("break", "")
        elif m[2]:
            if places.get(name):
                yield from shut(places[name][-1])
            else:
                yield "break", ""
        else:
            if places.get("p"):
                yield from shut(places["p"][-1])
            if name in CLOSES:
                limit = max(places[x][-1] if places.get(x) else -1 for x in CLOSES_LIMIT)
                lowest = [places[x][k] for x in CLOSES[name] if x in places and (k := bisect_right(places[x], limit)) < len(places[x])]
                yield from shut(min(lowest, default=len(stack)))
            if name in ("html", "body") and places.get(name):
                yield "break", ""
            else:
                places.setdefault(name, []).append(len(stack))
                stack.append(name)
                yield "open", _key(name, m[4])
    if at < len(page):
        yield "text", html.unescape(page[at:])
    yield from shut(0)


def _key(name: str, attributes: str) -> str:
    """Tag name with its class, id and role; digits count as equal."""
    found = sorted({(a.lower(), re.sub(r"\d+", "0", " ".join(sorted((x or y or z).lower().split())))) for a, x, y, z in _ATTRIBUTE.findall(attributes)}) if attributes.strip() else []
    return name + "".join(f"|{a}={v}" for a, v in found if v)


# -- wrappers: an element is [key, items, sign, pages], its sign a digest of all tags and texts in it, None once they vary; an
# item is [node, optional, repeated]; a text is ["#", digest or None, letters, pages]; a group of several items is ["()", items, None, 0]


def digested(*parts: str | None) -> str | None:
    return None if None in parts else hashlib.sha1("\0".join(parts).encode("utf-8", "replace")).hexdigest()[:16]


def sign(node: list) -> str | None:
    return node[1] if node[0] == "#" else node[2]


def tree(page: str, fold: bool = True) -> list:
    """The page's own wrapper, with repeats folded unless constants are still to be found."""
    root: list = ["", [], None, 1]
    stack = [root]
    for kind, value in tokens(page):
        if kind == "open":
            node: list = [value, [], None, 1]
            stack[-1][1].append([node, False, False])
            stack.append(node)
        elif kind == "close":
            done = stack.pop()
            done[2] = digested(done[0], *[sign(n) for n, _, _ in done[1]])
            if fold:
                done[1] = folded(done[1])
        elif kind == "text" and (text := " ".join(value.split())):
            items = stack[-1][1]
            if items and items[-1][0][0] == "#":
                items[-1][0][1], items[-1][0][2] = digested(items[-1][0][1], text), items[-1][0][2] + len(text)
            else:
                items.append([["#", digested(text), len(text), 1], False, False])
    if fold:
        root[1] = folded(root[1])
    return root


def name_of(node: list) -> str:
    return "(" + " ".join(name_of(i[0]) for i in node[1]) + ")" if node[0] == "()" else node[0]


def folded(items: list) -> list:
    """Adjacent equal stretches of up to four items become one repeated item or group."""
    for width in (1, 2, 3, 4):
        out: list = []
        names: list[str] = []
        for item in items:
            out.append(item)
            names.append(name_of(item[0]))
            while len(out) >= 2 * width and names[-width:] == names[-2 * width : -width] and (width > 1 or names[-1] != "#"):
                last, before = out[-width:], out[-2 * width : -width]
                joint = [merged(a, b, False) for a, b in zip(before, last, strict=True)]
                del out[-2 * width :], names[-2 * width :]
                if width == 1:
                    out.append([joint[0][0], joint[0][1], True])
                else:
                    out.append([["()", joint, None, 0], False, True])
                names.append(name_of(out[-1][0]))
            if width > 1 and len(out) > width and out[-width - 1][0][0] == "()" and name_of(out[-width - 1][0]) == "(" + " ".join(names[-width:]) + ")":
                group = out[-width - 1]
                group[0][1] = [merged(a, b, False) for a, b in zip(group[0][1], out[-width:], strict=True)]
                group[2] = True
                del out[-width:], names[-width:]
        items = out
    return items


def merged(a: list, b: list, across: bool = True) -> list:
    """Two items of one name as one, of different pages or of the same."""
    x, y = a[0], b[0]
    same = sign(x) if sign(x) == sign(y) else None
    pages = x[3] + y[3] if across else max(x[3], y[3])
    node = ["#", same, x[2] + y[2], pages] if x[0] == "#" else [x[0], aligned(x[1], y[1], across), same, pages]
    return [node, a[1] or b[1], a[2] or b[2]]


def aligned(left: list, right: list, across: bool = True) -> list:
    """One sequence that both match: constants that both have, in order, and what is between them aligned by name."""
    a, b = [sign(i[0]) for i in left], [sign(i[0]) for i in right]
    both = (set(a) & set(b)) - {None}
    at, to = [k for k, x in enumerate(a) if x in both], [k for k, x in enumerate(b) if x in both]
    out, i, j = [], 0, 0
    for p, q in [*((at[m], to[n]) for m, n in _common([a[k] for k in at], [b[k] for k in to])), (len(a), len(b))]:
        out += _by_name(folded(left[i:p]), folded(right[j:q]), across)
        if p < len(a):
            out.append(merged(left[p], right[q], across))
        i, j = p + 1, q + 1
    return out


def _by_name(left: list, right: list, across: bool) -> list:
    """One sequence that both match: common items in order, the others optional."""
    left, right = _grouped(left, right), _grouped(right, left)
    a, b = [name_of(i[0]) for i in left], [name_of(i[0]) for i in right]
    out, i, j = [], 0, 0
    for p, q in [*_common(a, b), (len(a), len(b))]:
        out += [[n, True, r] for n, _, r in left[i:p]] + [[n, True, r] for n, _, r in right[j:q]]
        if p < len(a):
            out.append(merged(left[p], right[q], across))
        i, j = p + 1, q + 1
    return folded(out)


def _grouped(items: list, other: list) -> list:
    """Stretches that the other side knows as a group become that group with one turn."""
    for node, _, _ in other:
        if node[0] != "()":
            continue
        names, width, k, out = [name_of(i[0]) for i in node[1]], len(node[1]), 0, []
        have = [name_of(i[0]) for i in items]
        while k < len(items):
            if have[k : k + width] == names:
                out.append([["()", items[k : k + width], None, 0], False, False])
                k += width
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence; long sequences are halved where both halves' lengths add up to most."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    if start:
        return [(k, k) for k in range(start)] + [(i + start, j + start) for i, j in _common(a[start:], b[start:])]
    if len(a) * len(b) > 1_000_000:
        if len(a) == 1:
            return [(0, b.index(a[0]))] if a[0] in b else []
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _common(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _common(a[half:], b[cut:])]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b``: a row of the table is one number, whose
    zero bits are the steps."""
    at: dict[str, list[int]] = {}
    for j, name in enumerate(b):
        at.setdefault(name, []).append(j)
    masks = {}  # of the frequent names, so that all masks together stay small
    for name in at.keys() & set(a):
        if len(at[name]) > 8:
            bits = np.zeros(len(b), np.uint8)
            bits[at[name]] = 1
            masks[name] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    row = full = (1 << len(b)) - 1
    for name in a:
        if name in at:
            met = row & (masks[name] if name in masks else sum(1 << j for j in at[name]))
            row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def join(a: list | None, b: list) -> list:
    return b if a is None else [a[0], aligned(a[1], b[1]), None, a[3] + b[3]]


def dumped(wrapper: list) -> str:
    """The wrapper as JSON without nesting: nodes in page order, each with its number of items, optional and repeated."""
    out, todo = [], [[wrapper, False, False]]
    while todo:
        node, optional, repeated = todo.pop()
        if node[0] == "#":
            out.append([*node, optional, repeated])
        else:
            out.append([node[0], len(node[1]), *node[2:], optional, repeated])
            todo += reversed(node[1])
    return json.dumps(out)


def loaded(text: str) -> list:
    top: list = []
    open_ = [(top, 1)]
    for *node, optional, repeated in json.loads(text):
        while len(open_[-1][0]) == open_[-1][1]:
            open_.pop()
        items, wanted = open_[-1]
        if node[0] == "#":
            items.append([node, optional, repeated])
        else:
            items.append([[node[0], [], *node[2:]], optional, repeated])
            open_.append((items[-1][0][1], node[1]))
    return top[0][0]


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression, for reading."""
    if node[0] == "#":
        return "#" if node[1] is None else f"'{node[1]}'"
    inner = " ".join(expression(n) + ("*" if o and r else "?" if o else "+" if r else "") for n, o, r in node[1])
    return f"({inner})" if node[0] == "()" else inner if node[0] == "" else f"<{node[0]} {inner}>"


# -- which slots are content


def _parts(key: str) -> tuple[str, dict[str, str]]:
    name, *rest = key.split("|")
    return name, dict(r.split("=", 1) for r in rest)


def _words(values: dict[str, str]) -> set[str]:
    """Words of class and id; a name such as has-sidebar says what is elsewhere."""
    names = f"{values.get('class', '')} {values.get('id', '')}".split()
    return {w for n in names if not re.match(r"(?:has|no|with|without)[-_]", n) for w in re.split(r"[^a-z]+", n)}


def is_aside(key: str, in_region: bool) -> bool:
    """Whether an element holds no main text. A header inside an article is the article's own."""
    name, values = _parts(key)
    if name == "header" and in_region:
        return False
    words = _words(values) - (INSIDE_WORDS if in_region else set())
    return name in ASIDE or values.get("role") in ASIDE_ROLES or (name not in ("html", "body", "article", "main") and bool(words & ASIDE_WORDS)) or (
        name == "article" and bool(words & NOT_ARTICLE)
    )


def is_region(key: str) -> bool:
    name, values = _parts(key)
    return name in ("article", "main") or values.get("role") in ("main", "article") or (name in ("div", "section", "td") and bool(_words(values) & MAIN_WORDS))


def is_named(key: str) -> bool:
    """Whether an element is named as the main text, by its tag or role."""
    name, values = _parts(key)
    return (name in ("article", "main") or values.get("role") in ("main", "article")) and name not in ASIDE and not _words(values) & NOT_ARTICLE


def severity(key: str, in_region: bool, wide: bool) -> int:
    """How strongly an element hides what is in it. 0: not, as words and forms of an element that holds most of the text are
    its layout's; 1: a form, or words within longer names; 2: related or navigation words on most of the text; 3: a block."""
    if not is_aside(key, in_region):
        return 0
    name, values = _parts(key)
    words = _words(values) - (INSIDE_WORDS if in_region else set())
    if name in ASIDE - {"form"} or values.get("role") in ASIDE_ROLES - {"form"} or name == "article" or words & COMMENT_WORDS:
        return 3
    if words & BLOCK_WORDS:
        return 2 if wide else 3
    exact = set(f"{values.get('class', '')} {values.get('id', '')}".split())
    return 0 if wide else 3 if exact & ASIDE_WORDS else 1


@lru_cache(1 << 16)
def path_id(parent: str, key: str) -> str:
    return hashlib.sha1(f"{parent} {key}".encode("utf-8", "replace")).hexdigest()[:20]


NAMED, HEAVIEST, SURROUNDED, UNNAMED = range(4)


def content_slots(wrapper: list, pages: int) -> list[str]:
    """Rank, region and path of the text slots that are content, and path and sign of constants in them that are not (rank ``-``).

    A page takes the first rank that gives it text. NAMED: regions named as the article. HEAVIEST: regions by class or inside a
    form or the like, of which a page takes the one that holds most. SURROUNDED: named ones inside related or navigation words
    that hold most of the text. UNNAMED: the element whose own paragraphs hold the most text that varies, if no region has any.
    """
    keys, parents, known, seen = [""], [0], {}, [pages]
    slots: list[tuple[int, list]] = []
    constants: list[tuple[int, list, list[int]]] = []  # path, node, and the slots in it from and to
    todo: list[tuple] = [(wrapper, 0, False)]
    while todo:
        node, at, inside = todo.pop()
        if at is None:
            constants[node][2].append(len(slots))
            continue
        if not inside and node[0] not in ("", "()") and node[2] is not None and node[3] >= LEAST_PAGES:
            todo.append((len(constants), None, False))
            constants.append((at, node, [len(slots)]))
            inside = True
        children = []
        for child, _, _ in node[1]:
            if child[0] == "#":
                slots.append((at, child))
            elif child[0] == "()":
                children.append((child, at, inside))
            else:
                k = known.setdefault((at, child[0]), len(keys))
                if k == len(keys):
                    keys.append(child[0])
                    parents.append(at)
                    seen.append(0)
                seen[k] = min(pages, seen[k] + child[3])
                children.append((child, k, inside))
        todo += children
    letters = [0] * len(keys)
    for at, slot in slots:
        letters[at] += slot[2]
    for k in range(len(keys) - 1, 0, -1):
        letters[parents[k]] += letters[k]
    ids, depth, hidden, region, rank = [""], [0], [0], [0], [UNNAMED]
    named = False
    for k in range(1, len(keys)):
        p, key = parents[k], keys[k]
        ids.append(path_id(ids[p], key))
        depth.append(depth[p] + 1)
        region.append(region[p])
        rank.append(rank[p])
        own = severity(key, bool(region[p]), 2 * letters[k] > letters[region[p]])
        if not region[p]:
            if is_named(key) and hidden[p] < 3:
                rank[k] = (NAMED, HEAVIEST, SURROUNDED)[hidden[p]]
                named = True
            elif is_region(key) and not own and not is_aside(key, True) and not hidden[p]:
                rank[k] = HEAVIEST
            if rank[k] != UNNAMED:
                region[k] = k
        hidden.append(0 if region[k] == k else max(hidden[p], own))
    if any(region[at] for at, _ in slots) or named and pages == 1:
        kept = {at for at, _ in slots if region[at] and not hidden[at]}
        within = region
    else:
        outside = [(at, s) for at, s in slots if not hidden[at]] or [(at, s) for at, s in slots if hidden[at] < 2]
        varying = [(at, s) for at, s in outside if pages == 1 or s[1] is None or s[3] < pages] or outside
        own_text: dict[int, int] = {}
        for at, slot in varying:
            parent = parents[at] if _parts(keys[at])[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre") else at
            own_text[parent] = own_text.get(parent, 0) + slot[2]
        top = max(own_text, key=lambda k: (own_text[k], -depth[k]), default=0)
        inside_top = [k == top for k in range(len(keys))]
        for k in range(1, len(keys)):
            inside_top[k] |= inside_top[parents[k]]
        kept = {at for at, _ in varying if inside_top[at]}
        within = [top if x else -1 for x in inside_top]
    return sorted(f"{rank[k]} {ids[region[k]] or '-'} {ids[k] or '-'}" for k in kept) + sorted(
        f"- {ids[k]} {s}" for k, s in _template(constants, slots, kept, within, keys, seen)
    )


def _template(constants: list, slots: list, kept: set[int], within: list[int], keys: list[str], seen: list[int]) -> set[tuple[int, str]]:
    """Path and sign of the constants that all pages of their region have, where the greater part of its text varies."""
    all_letters: dict[int, int] = {}
    for at, slot in slots:
        if at in kept:
            all_letters[within[at]] = all_letters.get(within[at], 0) + slot[2]
    found: dict[int, dict[tuple[int, str], list[int]]] = {}
    for at, node, (start, stop) in constants:
        held = [(k, s) for k, s in slots[start:stop] if k in kept and _parts(keys[k])[0] not in HEADINGS]
        if held and _parts(keys[at])[0] not in PARTS and at != within[at] and node[3] >= seen[max(within[at], 0)]:
            size = found.setdefault(within[held[0][0]], {}).setdefault((at, node[2]), [0])
            size[0] += sum(s[2] for k, s in slots[start:stop] if k in kept)
    return {c for region, some in found.items() if 2 * sum(n for n, in some.values()) < all_letters[region] for c in some}


def signs(page: str) -> list[str | None]:
    """The signs of the page's elements, in the order in which they open."""
    out, todo = [], [tree(page, False)]
    while todo:
        node = todo.pop()
        out.append(node[2])
        todo += [n for n, _, _ in reversed(node[1]) if n[0] != "#"]
    return out[1:]


def extract(page: str, slots: list[str]) -> str:
    """Blocks whose slot is content and that are none of its constants, in page order."""
    places, constants = {}, set()
    for rank, region, slot in map(str.split, slots):
        if rank == "-":
            constants.add((region, slot))
        else:
            places[slot] = (int(rank), region)
    met = iter(signs(page)) if constants else None
    skipped = 0  # the depth of the constant that the page is in
    path = [""]
    blocks: list[tuple[tuple[int, str], str]] = []
    held: list[str] = []
    place = places.get("-")

    def flush() -> None:
        if held and (text := " ".join("".join(held).split())):
            blocks.append((place, text))
        held.clear()

    for kind, value in tokens(page):
        if kind == "text":
            if place and not skipped:
                held.append(value)
            continue
        flush()
        if kind == "open":
            path.append(path_id(path[-1], value))
            if met and (path[-1], next(met)) in constants and not skipped:
                skipped = len(path)
        elif kind == "close":
            if skipped == len(path):
                skipped = 0
            path.pop()
        place = places.get(path[-1] or "-")
    flush()
    first = min((rank for (rank, _), _ in blocks), default=NAMED)
    sizes: dict[tuple[int, str], int] = {}
    for where, text in blocks:
        sizes[where] = sizes.get(where, 0) + len(text)
    best = max((w for w in sizes if w[0] == first), key=sizes.__getitem__, default=None)
    return "\n".join(text for where, text in blocks if where == best or where[0] == first != HEAVIEST)


def page_text(page: str, slots: list[str]) -> str:
    """Text of a page by its host's slots; a page of a layout of its own, to which they give nothing, is read by its own wrapper."""
    return extract(page, slots) or extract(page, content_slots(tree(page), 1))


HOSTS_HELD = 2000


def wrappers(pages: DataFrame) -> DataFrame:
    """host, pages, wrapper (JSON) and slots (see ``content_slots``) of every host."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([dumped(w) for _, w in held.values()], pa.string())],
                ["host", "pages", "wrapper"],
            )
            held.clear()
            return out

        for batch in sized_batches(batches, "html"):
            for host, page in zip(batch.column("host").to_pylist(), decoded(batch.column("html")), strict=True):
                n, so_far = held.get(host, (0, None))
                held[host] = (n + 1, join(so_far, tree(page, False)))
            if len(held) > HOSTS_HELD:
                yield flush()
        yield flush()

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        so_far = None
        for w in group["wrapper"].sort_values():
            so_far = join(so_far, loaded(w))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "pages": [group["pages"].sum()], "wrapper": [dumped(so_far)]})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [content_slots(loaded(w), n) for w, n in zip(batch.column("wrapper").to_pylist(), batch.column("pages").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slots, pa.list_(pa.string()))], ["host", "pages", "wrapper", "slots"])

    kind = "host string, pages long, wrapper string"
    found = pages.mapInArrow(infer, kind).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(32)))
    for keys in (("host", "salt"), ("host",)):
        found = found.groupBy(*keys).applyInPandas(combine, kind)
        found = found.withColumn("salt", F.lit(0)) if len(keys) == 2 else found
    return found.mapInArrow(judge, f"{kind}, slots array<string>")


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    rows = with_host(pages)
    learned = stored(wrappers(rows.select("host", "html")))
    joined = rows.join(learned.select("host", "slots"), "host").select("page_id", "url", "html", "slots")
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "html"):
            texts = [page_text(p, s) for p, s in zip(decoded(batch.column("html")), batch.column("slots").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
