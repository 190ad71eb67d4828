"""Page wrappers: a host's template as a union-free regular expression.

A page is a sequence of nodes: containers opening and closing, and texts (with
the leaf element they stand in; inline markup belongs to the text).  Runs of
equal groups fold into one *repeated* group.  Two sequences are aligned level by
level, a container and its content as one item, by their longest common parts;
what only one has becomes *optional* (its count stays below the wrapper's number
of pages), what is a group here and its repetition there becomes repeated, an
irregular stretch becomes a repeated group of optional parts, and texts that
differ become *slots*.  The result covers both, so pages can be folded in any
order and partial wrappers merged; its size follows the number of different
containers and leaves, not the number of pages.

A node is a list ``[key, pages, payload]``: key ``o tag names`` / ``c tag`` for
containers, ``x leaf`` for texts with payload ``[characters, linked characters,
constant text's hash or 0]``, ``r first-key`` for repeated groups with the
group's nodes as payload, ``r *`` for irregular stretches.  Texts of a single page carry their positions as a
fourth payload element, to get from wrapper to page again.
"""

from __future__ import annotations

import difflib
import functools
import html
import re
import zlib
from collections.abc import Iterator

# Elements by their part in a page.
CONTAINERS = set("html head body nav header footer main article section aside div form fieldset ul ol dl table thead "
                 "tbody tfoot blockquote figure details dialog menu button select label noscript template svg object "
                 "address center".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd tr pre figcaption summary caption hr option legend title".split())
#: Their content is not text of the page.
RAW = set("script style textarea iframe noembed xmp".split())
REPEATING = {"p", "li", "tr", "dt", "dd", "option"}
SPACED = {"br", "td", "th", "img"}
BOILER_TAGS = set("head nav footer aside form button select dialog menu noscript template svg label fieldset object".split())
MAIN_TAGS = {"article", "main"}
#: Names (class, id, role) of what surrounds an article, whole or as the beginning of a longer name.
BOILER_NAMES = set("nav ad ads menu header footer sidebar side banner bar cookie cookies consent notice popup modal "
                   "share social related reply replies crumbs widget login signin search tags meta byline skip "
                   "legal copyright masthead toolbar tracking teaser hidden".split())
BOILER_STEMS = ("navi", "advert", "sponsor", "promo", "comment", "breadcrumb", "pagina", "subscri", "newsletter",
                "recommend", "disclaim", "disqus", "gdpr", "alert", "complementary", "contentinfo", "outbrain", "taboola")
MAIN_NAMES = set("content main article post entry story body text page".split())
#: Fewer pages than this do not tell a constant text from the article's.
TELLING = 8
#: A key of one irregular stretch stands at most this often before the stretch becomes one group.
SPREAD = 3
#: Containers nested deeper are aligned node by node.
DEPTH = 60
#: The group of an irregular stretch.
ANY = "r *"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _names(attributes: str) -> str:
    """Words of class, id and role; ``hidden`` if the element is."""
    words = []
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" \
                or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            words.append("hidden")
        elif name in ("class", "id", "role"):
            words += _NAME.findall(_CAMEL.sub(" ", value).lower())
    return " ".join(dict.fromkeys(words))


def parse(page: str) -> Iterator[tuple[str, str, int]]:
    """``(key, text, linked characters)`` of every node; text is empty but for ``x`` nodes."""
    at, leaf, linked, in_link = 0, "", 0, False
    parts: list[str] = []

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        out = (f"x {leaf}", text, min(linked, len(text)))
        linked = 0
        return out

    def add(raw: str):
        nonlocal linked
        if raw:
            parts.append(raw)
            linked += len(raw) if in_link else 0

    while True:
        m = _TOKEN.search(page, at)
        add(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        closing = bool(m.group(1))
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag in CONTAINERS or tag in LEAVES:
            if parts:
                got = flush()
                if got[1]:
                    yield got
            leaf, in_link = "", False
            if tag in LEAVES:
                leaf = "" if closing else tag
            elif closing:
                yield f"c {tag}", "", 0
            else:
                yield f"o {tag} {_names(m.group(3) or '')}".rstrip(), "", 0
        elif tag in SPACED:
            add(" ")
        elif tag == "a":
            in_link = not closing
    if parts:
        got = flush()
        if got[1]:
            yield got


def _joined(a: list, b: list, pages: bool, depth: int = 0) -> list:
    """One node from two with the same key; ``pages``: of different pages, so counts add up."""
    key, n = a[0], a[1] + b[1] if pages else max(a[1], b[1])
    if key[0] == "x":
        p, q = a[2], b[2]
        payload = [p[0] + q[0], p[1] + q[1], p[2] if p[2] == q[2] else 0]
        if not pages and len(p) == len(q) == 4:
            payload.append(p[3] + q[3])
        return [key, n, payload]
    if key == ANY:
        return [key, n, _flat(_by_key(_items(a[2], depth) + _items(b[2], depth), pages, depth).values())]
    if key[0] == "r":
        return [key, n, merge(a[2], b[2], pages, depth + 1)]
    return [key, n, None]


def _repeated(group: list) -> list:
    return [f"r {group[0][0]}", max(n[1] for n in group), group]


def _balanced(keys: list[str]) -> bool:
    return sum(k[0] == "o" for k in keys) == sum(k[0] == "c" for k in keys)


def _fold(nodes: list) -> list:
    """Replace runs of equal groups by one repeated group, inner ones first."""
    while True:
        keys = [n[0] for n in nodes]
        out, i, changed = [], 0, False
        while i < len(nodes):
            for size in range(1, 9):
                group = keys[i:i + size]
                if keys[i + size:i + 2 * size] != group or size == 1 and group[0][0] in "oc" or not _balanced(group):
                    continue
                end = i + size
                body = nodes[i:end]
                while keys[end:end + size] == group:
                    body = [_joined(a, b, False) for a, b in zip(body, nodes[end:end + size])]
                    end += size
                out.append(body[0] if size == 1 and group[0][0] == "r" else _repeated(body))
                i, changed = end, True
                break
            else:
                out.append(nodes[i])
                i += 1
        if not changed:
            return out
        nodes = out


def page_wrapper(parsed: list[tuple[str, str, int]]) -> list:
    """The wrapper of one page; texts keep their numbers in page order."""
    nodes = []
    for i, (key, text, linked) in enumerate(parsed):
        if key[0] == "x":
            node = [key, 1, [len(text), linked, zlib.crc32(text.encode("utf-8", "surrogatepass")) or 1, [i]]]
            if key[2:] not in REPEATING:
                nodes.append(node)
            elif nodes and nodes[-1][0] == "r " + key:
                x = nodes[-1][2][0][2]  # the same element again
                x[0], x[1] = x[0] + len(text), x[1] + linked
                x[2] *= x[2] == node[2][2]
                x[3].append(i)
            else:
                nodes.append(_repeated([node]))
        else:
            nodes.append([key, 1, None])
    return _fold(nodes)


def _flat(items) -> list:
    return [node for item in items for node in item]


def _items(nodes: list, depth: int) -> list[list]:
    """What stands side by side: a container with everything up to its end is one item."""
    if depth > DEPTH:
        return [[n] for n in nodes]
    end, inside = {}, []
    for i, node in enumerate(nodes):
        kind, _, rest = node[0].partition(" ")
        if kind == "o":
            inside.append((rest.partition(" ")[0], i))
        elif kind == "c":
            # as in _texts: an end without its beginning ends nothing, one that skips others ends them too
            for k in range(len(inside) - 1, -1, -1):
                if inside[k][0] == rest:
                    end.update({at: i for _, at in inside[k + 1:]})
                    end[inside[k][1]] = i + 1
                    del inside[k:]
                    break
    out, i = [], 0
    while i < len(nodes):
        to = end.get(i, len(nodes)) if nodes[i][0][0] == "o" else i + 1
        out.append(nodes[i:to])
        i = to
    return out


def _inner(item: list) -> tuple[list, list]:
    """A container's nodes and its end, if it has one."""
    closed = len(item) > 1 and item[-1][0] == "c " + item[0][0].split(" ")[1]
    return (item[1:-1], item[-1:]) if closed else (item[1:], [])


def _both(a: list, b: list, pages: bool, depth: int) -> list:
    """One item from two with the same key."""
    first = [_joined(a[0], b[0], pages, depth)]
    if len(a) == len(b) == 1:
        return first
    (x, x_end), (y, y_end) = _inner(a), _inner(b)
    last = [_joined(x_end[0], y_end[0], pages)] if x_end and y_end else x_end or y_end
    return first + merge(x, y, pages, depth + 1) + last


def _by_key(items: list[list], pages: bool, depth: int) -> dict[str, list]:
    found: dict[str, list] = {}
    for item in items:
        key = item[0][0]
        found[key] = _both(found[key], item, pages, depth) if key in found else item
    return found


def _parts(item: list, depth: int) -> list[list]:
    """The items that a repeated group repeats; any other item is its own."""
    return [p for i in _items(item[0][2], depth) for p in _parts(i, depth)] if item[0][0][0] == "r" else [item]


def _settled(items: list[list], depth: int) -> list[list]:
    """Resolve irregular stretches, so that a wrapper stops growing.

    A key that some pages lack and that stands more than ``SPREAD`` times makes
    everything from its first to its last place one group of optional parts in
    any number and order: ``(a? b? c?)*``.  Optional items that such a group
    has already become part of it.
    """
    places: dict[str, list[int]] = {}
    for i, item in enumerate(items):
        places.setdefault(item[0][0].removeprefix("r "), []).append(i)
    groups = places.pop("*", [])
    known = {p[0][0] for i in groups for p in _items(items[i][0][2], depth)}
    reach = groups[:1] + groups[-1:]
    absorbed = set()
    for key, at in places.items():
        if key[0] == "c" or depth > DEPTH:
            continue
        most = max(items[i][0][1] for i in at + groups)
        if len(at) > SPREAD and any(items[i][0][1] < most for i in at):
            reach += [at[0], at[-1]]
        elif known:
            absorbed.update(i for i in at if items[i][0][1] < most and all(p[0][0] in known for p in _parts(items[i], depth)))
    if not reach or len(groups) == 1 and min(reach) == max(reach) and not absorbed:
        return items
    first, last = min(reach), max(reach)
    absorbed.update(range(first, last + 1))
    members = [p for i in sorted(absorbed) for p in _parts(items[i], depth)]
    group = [[ANY, max(items[i][0][1] for i in absorbed), _flat(_by_key(members, False, depth).values())]]
    return [*(item for i, item in enumerate(items[:first]) if i not in absorbed), group,
            *(item for i, item in enumerate(items[last + 1:], last + 1) if i not in absorbed)]


def _like(items: list[list], keys: list[str]) -> list[list]:
    """``items`` with the run that a repeated group's ``keys`` name made a repetition of one."""
    for i in range(len(items) - len(keys) + 1):
        if [item[0][0] for item in items[i:i + len(keys)]] == keys:
            return items[:i] + [[_repeated(_flat(items[i:i + len(keys)]))]] + items[i + len(keys):]
    return items


def _alike(a: list[list], b: list[list], depth: int) -> tuple[list[list], list[list]]:
    """Both, with a group that stands once on one side made a repetition if the other side repeats it."""
    for _ in range(2):
        known = {item[0][0] for item in b}
        for item in a:
            if item[0][0][0] == "r" and item[0][0] != ANY and item[0][0] not in known:
                b = _like(b, [i[0][0] for i in _items(item[0][2], depth)])
        a, b = b, a
    return a, b


def _codes(a: list[list], b: list[list]):
    x, y = [i[0][0] for i in a], [i[0][0] for i in b]
    if x == y:
        return [("equal", 0, len(x), 0, len(y))]
    return difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()


def merge(a: list, b: list, pages: bool = True, depth: int = 0) -> list:
    """The wrapper that covers both."""
    if [n[0] for n in a] == [n[0] for n in b]:
        return [_joined(x, y, pages, depth) for x, y in zip(a, b)]
    x, y = _alike(_items(a, depth), _items(b, depth), depth)
    out = []
    for kind, i1, i2, j1, j2 in _codes(x, y):
        if kind == "equal":
            out += [_both(p, q, pages, depth) for p, q in zip(x[i1:i2], y[j1:j2])]
        else:
            # what only one of them has is optional from now on: its count lags behind
            out += x[i1:i2] + y[j1:j2]
    return _flat(_settled(out, depth))


def without_positions(nodes: list) -> list:
    return [[k, n, p[:3] if k[0] == "x" else without_positions(p) if k[0] == "r" else None] for k, n, p in nodes]


def _is_boiler(tag: str, names: str, inside_main: bool) -> bool:
    words = set(names.split())
    if "hidden" in words:
        return True
    if tag in MAIN_TAGS or tag in ("html", "body"):
        return False
    if tag in BOILER_TAGS or tag == "header" and not inside_main:
        return True
    if inside_main:
        words -= {"header", "meta", "side", "bar", "tags", "page"}
    if words & MAIN_NAMES and not words & {"ad", "ads", "comments", "sidebar", "nav", "menu", "footer"}:
        return False
    return bool(words & BOILER_NAMES) or any(w.startswith(BOILER_STEMS) for w in words)


def _texts(nodes: list, stack: list) -> Iterator[tuple[list, tuple, bool, bool]]:
    """``(text node, path, is boilerplate, is inside an article)`` in order."""
    for node in nodes:
        kind, _, rest = node[0].partition(" ")
        if kind == "o":
            tag, _, names = rest.partition(" ")
            inside = bool(stack) and stack[-1][3] or tag in MAIN_TAGS or "main" in names.split() and tag != "body"
            boiler = bool(stack) and stack[-1][2] or _is_boiler(tag, names, bool(stack) and stack[-1][3])
            stack.append((tag, node[0], boiler, inside))
        elif kind == "c":
            # an end without its beginning ends nothing; one that skips others ends them too
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == rest:
                    del stack[k:]
                    break
        elif kind == "r":
            yield from _texts(node[2], stack)
        else:
            top = stack[-1] if stack else ("", "", False, False)
            yield node, tuple(s[1] for s in stack), top[2] or rest in ("title", "option", "legend"), top[3]


def label(nodes: list) -> dict[int, bool]:
    """id of every text node -> whether it belongs to the article."""
    texts = list(_texts(nodes, []))
    out = {id(t[0]): False for t in texts}
    usable = [t for t in texts if not t[2]]
    inside = [t for t in usable if t[3]]
    if any(t[0][2][0] for t in inside):
        return out | {id(t[0]): True for t in inside}
    # no article element: the texts that vary between pages and are not mostly links, in the
    # innermost container that holds nearly all of them
    pages = max((n[1] for n in nodes), default=0)

    def varies(node):
        return pages < TELLING or not node[2][2] or 10 * node[1] < 9 * pages

    rich = [t for t in usable if 2 * t[0][2][1] <= t[0][2][0]]
    eligible = [t for t in rich if varies(t[0])] or rich
    total, path = sum(t[0][2][0] for t in eligible), ()
    while True:
        below: dict[str, int] = {}
        for t in eligible:
            if len(t[1]) > len(path) and t[1][:len(path)] == path:
                below[t[1][len(path)]] = below.get(t[1][len(path)], 0) + t[0][2][0]
        best = max(below, key=below.get, default=None)
        if best is None or 10 * below[best] < 8 * total:
            break
        path += (best,)
    for node, where, _, _ in eligible:
        if where[:len(path)] == path or node[0] == "x h1":
            out[id(node)] = True
    return out


def _choose(wrapper: list, page: list, labels: dict[int, bool], own, chosen: list, depth: int = 0) -> None:
    """Collect the numbers of the page's texts whose wrapper node belongs to the article.

    ``own``: gives the page's own labels, for what the wrapper does not know.
    """
    def alone(nodes):
        for n in nodes:
            if n[0][0] == "x" and own()[id(n)]:
                chosen.extend(n[2][3])
            elif n[0][0] == "r":
                alone(n[2])

    def take(w, p):
        if p[0][0][0] == "x":
            if labels[id(w[0])]:
                chosen.extend(p[0][2][3])
        elif p[0][0][0] == "r":
            _choose(w[0][2], p[0][2], labels, own, chosen, depth + 1)
        elif len(p) > 1:
            _choose(_inner(w)[0], _inner(p)[0], labels, own, chosen, depth + 1)

    if [n[0] for n in wrapper] == [n[0] for n in page]:
        for w, p in zip(wrapper, page):
            take([w], [p])
        return
    x, y = _alike(_items(wrapper, depth), _items(page, depth), depth)
    known = {p[0][0]: p for item in x if item[0][0] == ANY for p in _items(item[0][2], depth)}
    for kind, i1, i2, j1, j2 in _codes(x, y):
        if kind == "equal":
            for w, p in zip(x[i1:i2], y[j1:j2]):
                take(w, p)
        else:
            for part in (p for item in y[j1:j2] for p in _parts(item, depth)):
                if part[0][0] in known:
                    take(known[part[0][0]], part)  # one more round of the irregular group
                else:
                    alone(part)  # the wrapper does not know it: judge it by the page itself


def article(parsed: list[tuple[str, str, int]], wrapper: list, labels: dict[int, bool]) -> str:
    """The article's blocks of a page, joined by line feeds.

    A page of which the wrapper takes nothing is judged by itself.
    """
    page = page_wrapper(parsed)
    chosen: list[int] = []
    own = functools.cache(lambda: label(page))
    _choose(wrapper, page, labels, own, chosen)
    if not chosen:
        _choose([], page, {}, own, chosen)
    return "\n".join(parsed[i][1] for i in sorted(chosen))
