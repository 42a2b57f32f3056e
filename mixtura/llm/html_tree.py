"""Small trees of web pages and the wrappers inferred from them.

A node is a dict: ``l`` label, ``c`` children. In a page, ``c`` holds strings (text) and nodes. In a
wrapper, a node also has ``o`` (optional) and ``r`` (repeated), ``t`` (hashes of its texts while all pages
that have it had the same, 0 once they differed: a slot), ``k`` (pages that have it), ``n`` (characters
of text), ``a`` (of these, in links).

A tree is ``DEPTH`` levels deep at most: as in browsers, what is nested deeper belongs to the last of
these levels. A wrapper node with more than ``WIDE`` children takes those of one label as one repeated
group, and the rarest labels beyond as one optional slot, so wrappers do not grow with a host's pages.

Texts that several pages share at one place do not count when the main part is chosen. Of the main
part, only shared texts outside the run of those that differ are left out (``template_texts``). Names
only tell apart what the texts leave open.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import xxhash

#: Levels of a tree.
DEPTH = 128
#: Children of a wrapper node, and different texts of a repeated one, that are told apart.
WIDE = 256
TEXTS = 4096

# No part can match in two ways, and each ends at the end of the page at the latest, so a page is read in
# one pass whatever it holds. A quote begins a value after = only.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|object|canvas)\b.*?(?:</(?P=raw)\s*+>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9-]*+)(?P<attrs>(?:[^\"'>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+|[\"'])*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?<![a-z-])([a-z-]++)\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s\"'>]++))|\b(hidden)\b", re.I)
# Fixed sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_CLOSED_BY_BLOCK = frozenset(["p"])
_PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table div article main section body".split())
#: Elements that hold no article text.
DROPPED_TAGS = frozenset("head nav footer aside form button select textarea menu dialog script style noscript template iframe fieldset".split())
_NAMES = "ad|ads|adv|advert|advertisement|adsense|banner|promo|promotion|sponsor|sponsored|sidebar|menu|nav|navbar|navigation|footer|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|share|sharing|social|comment|comments|reply|replies|respond|disqus|related|recommended|breadcrumb|breadcrumbs|subscribe|subscription|newsletter|signup|login|search|widget|toolbar|pagination|pager|copyright|legal|disclaimer|skip|hidden"
_DROPPED_NAMES = re.compile(rf"(?:^|[\s_.#-])(?:{_NAMES})(?=$|[\s_.#\d-])", re.I)
#: Names that tell within the main part too, as whole words of a block's class, id or role.
_PLAIN_NAMES = frozenset(
    "comment comments comment-list commentlist comment-section comments-section comments-area comment-form comment-respond comment-thread respond replies disqus disqus_thread "
    "ad ads adv advert adverts advertisement adsense ad-slot ad-unit ad-container ad-banner ad-box ad-wrapper sponsored promo banner share sharing share-buttons share-bar share-links social-share social-links social-buttons "
    "related related-posts related-articles related-links related-stories newsletter newsletter-signup cookie cookies cookie-banner cookie-notice cookie-bar cookie-consent popup breadcrumb breadcrumbs sidebar nav navbar navigation pagination footer hidden".split()
)
_MAIN_NAMES = re.compile(r"(?:^|[\s_.#-])(?:article|articlebody|post|entry|story|content|main)(?=$|[\s_.#\d-])", re.I)


def _attributes(raw: str) -> tuple[str, bool]:
    """Class, id and role as one string with numbers masked, and whether the element is hidden."""
    names, hidden = [], False
    for m in _ATTR.finditer(raw):
        key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role", "itemprop"):
            names += value.split()
        hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value) is not None)
    return re.sub(r"\d+", "0", " ".join(names)), hidden


def parse(page: str) -> dict:
    """The tree of a page. Inline tags are left out, except where their names say that they are
    no article text; unclosed and misplaced tags are tolerated."""
    root = {"l": "", "c": [], "a": 0}
    stack = [root]
    open_: Counter[str] = Counter()
    links = 0

    def close(at: int) -> None:
        for node in stack[at:]:
            open_[node["l"].partition(" ")[0]] -= 1
        del stack[at:]

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            text = html.unescape(text) if "&" in text else text
            stack[-1]["c"].append(text)
            if links:
                stack[-1]["a"] += len(text)
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag == "a":
            links = 0 if m["end"] else 1
        if tag == "br":
            stack[-1]["c"].append(" ")
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[i]["l"].partition(" ")[0] == tag:
                    close(i)
                    break
                if tag in INLINE:
                    break
            continue
        if tag in VOID:
            if tag == "hr":
                stack[-1]["c"].append({"l": "hr", "c": [], "a": 0})
            continue
        names, hidden = _attributes(m["attrs"]) if m["attrs"].strip() else ("", False)
        if tag in INLINE and not (hidden or _DROPPED_NAMES.search(names)):
            continue
        if tag not in INLINE:
            for i in range(len(stack) - 1, 0, -1):
                above = stack[i]["l"].partition(" ")[0]
                if above in _CLOSED_BY_BLOCK or above in _PEERS.get(tag, ()):
                    close(i)
                elif above in _SCOPE or above not in INLINE:
                    break
        node = {"l": f"{tag} {names}{' hidden' * hidden}".strip(), "c": [], "a": 0}
        if len(stack) <= DEPTH:
            stack[-1]["c"].append(node)
        elif not dropped(node["l"], True):  # else its own children, which no one reads
            node["c"] = stack[-1]["c"]
            node["c"].append(" ")
        stack.append(node)
        open_[tag] += 1
    return root


def dropped(label: str, inside: bool) -> bool:
    """Whether a label says that the element is no article text. Within the main part, a header holds
    the title, and only the plainest names count, and only of blocks: what a phrase or a part of an
    article is called says little. The names of html and body tell how the page looks, not what it holds."""
    tag, _, names = label.partition(" ")
    if tag in DROPPED_TAGS or (tag == "header" and not inside):
        return True
    if tag in ("html", "body"):
        return False
    if inside:
        words = names.lower().split()
        return "hidden" in words if tag in INLINE else not _PLAIN_NAMES.isdisjoint(words)
    return bool(names) and (_DROPPED_NAMES.search(names) is not None or re.search(r"(?:^|\s)(?:site-)?(?:header|masthead)(?:$|\s)", names) is not None)


def wrapper_of(node: dict) -> dict:
    """A page's tree as a wrapper of that page alone: neighbours of one label become a repeated group."""
    texts = "".join(x for x in node["c"] if isinstance(x, str)).strip()
    out = {"l": node["l"], "o": 0, "r": 0, "k": 1, "t": [_hash(texts)] if texts else None, "n": len(texts), "a": min(node["a"], len(texts)), "c": []}
    run: list[dict] = []
    for child in node["c"]:
        if isinstance(child, dict):
            if run and run[-1]["l"] != child["l"]:
                out["c"].append(_group(run))
                run = []
            run.append(wrapper_of(child))
    if run:
        out["c"].append(_group(run))
    if len(out["c"]) > WIDE:
        out["c"] = _narrow(_by_label(out["c"]), {}, True)
    return out


def _group(nodes: list[dict]) -> dict:
    """Nodes of one label within a page as one, merged two by two."""
    repeated = len(nodes) > 1
    while len(nodes) > 1:
        nodes = [merged(*nodes[i : i + 2], True) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0] | {"r": 1} if repeated else nodes[0]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 16


def merged(x: dict, y: dict, within: bool = False) -> dict:
    """The wrapper of both: their children are aligned; what only one has becomes optional, and
    texts that differ become a slot. ``within`` a page, neighbours join their texts."""
    if within:
        t = 0 if 0 in (x["t"], y["t"]) else sorted({*(x["t"] or ()), *(y["t"] or ())}) or None
        t = t if not t or len(t) <= TEXTS else 0
    else:
        t = x["t"] if x["t"] == y["t"] else 0
    return {
        "l": x["l"], "o": x["o"] | y["o"], "r": x["r"] | y["r"], "n": x["n"] + y["n"], "a": x["a"] + y["a"],
        "k": max(x["k"], y["k"]) if within else x["k"] + y["k"], "t": t,
        "c": _aligned(x["c"], y["c"], within),
    }


def _aligned(xs: list[dict], ys: list[dict], within: bool) -> list[dict]:
    if len(xs) == len(ys) and all(x["l"] == y["l"] for x, y in zip(xs, ys)):
        return [merged(x, y, within) for x, y in zip(xs, ys)]
    if len(xs) > WIDE or len(ys) > WIDE:
        return _narrow(_by_label(xs), _by_label(ys), within)
    n, m = len(xs), len(ys)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if xs[i]["l"] == ys[j]["l"] else max(best[i + 1][j], best[i][j + 1])
    out: list[dict] = []

    def put(node: dict) -> None:
        if out and out[-1]["l"] == node["l"]:  # alignment may bring equal neighbours together
            out[-1] = merged(out[-1], node, within) | {"r": 1}
        else:
            out.append(node)

    i = j = 0
    while i < n and j < m:
        if xs[i]["l"] == ys[j]["l"]:
            put(merged(xs[i], ys[j], within))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            put(xs[i] | {"o": 1})
            i += 1
        else:
            put(ys[j] | {"o": 1})
            j += 1
    for node in [*xs[i:], *ys[j:]]:
        put(node | {"o": 1})
    return out if len(out) <= WIDE else _narrow(_by_label(out), {}, within)


def _by_label(nodes: list[dict]) -> dict[str, dict]:
    """The nodes by label; those of one label, wherever they stand, as one repeated group."""
    out: dict[str, list[dict]] = {}
    for node in nodes:
        out.setdefault(node["l"], []).append(node)
    return {label: _group(own) for label, own in out.items()}


def _narrow(xs: dict[str, dict], ys: dict[str, dict], within: bool) -> list[dict]:
    """Both groups by label; the labels of the fewest pages beyond ``WIDE`` as one optional slot."""
    out = [merged(x, ys[label], within) if label in ys else x | {"o": 1} for label, x in xs.items()]
    out += [y | {"o": 1} for label, y in ys.items() if label not in xs]
    if len(out) > WIDE:
        order = sorted(range(len(out)), key=lambda i: (out[i]["l"] == "", -out[i]["k"], i))
        kept = sorted(order[:WIDE])
        rest = [out[i] for i in order[WIDE:]]
        n = sum(map(_size, rest))
        out = [out[i] for i in kept] + [{"l": "", "o": 1, "r": 1, "k": max(x["k"] for x in rest), "t": 0, "n": n, "a": 0, "c": []}]
    return out


def _size(node: dict) -> int:
    """Characters of text outside links, below a node."""
    return node["n"] - node["a"] + sum(map(_size, node["c"]))


def _constant(node: dict) -> bool:
    """Whether several pages have the node, all with the same text of its own."""
    return node["k"] > 1 and bool(node["t"])


def _slots(node: dict) -> dict:
    """The wrapper without the template's texts."""
    return node | ({"n": 0, "a": 0} if _constant(node) else {}) | {"c": [_slots(c) for c in node["c"]]}


def _copy(node: dict) -> dict:
    return node | {"c": [_copy(c) for c in node["c"]]}


def _texts(node: dict) -> int:
    """Characters outside links and elements that never hold article text, whatever the names."""
    return 0 if node["l"].partition(" ")[0] in DROPPED_TAGS else node["n"] - node["a"] + sum(map(_texts, node["c"]))


def _named(node: dict, least: float) -> bool:
    """Marks (``x``) the elements whose names do not count, since they hold an article or nearly all
    text; returns whether the node is or holds an article."""
    inner = [_named(c, least) for c in node["c"]]
    tag = node["l"].partition(" ")[0]
    node["x"] = tag not in DROPPED_TAGS and (any(inner) or _texts(node) >= least)
    return tag not in DROPPED_TAGS and (any(inner) or (tag in ("article", "main") and not dropped(node["l"], True)))


def _gone(node: dict, inside: bool) -> bool:
    return not node.get("x") and dropped(node["l"], inside)


def _mass(node: dict, inside: bool = False) -> int:
    """Characters outside links and dropped elements, below a wrapper node."""
    if _gone(node, inside):
        return 0
    return node["n"] - node["a"] + sum(_mass(c, inside) for c in node["c"])


def template_texts(wrapper: dict, path: list[str]) -> list[int]:
    """Keys of the texts within ``path`` that belong to the template, each with the labels above it.

    They are the same on nearly all of the host's pages, three at least, and stand before the first or
    after the last place whose text differs: what pages share in between, as a byline, a date or a
    heading under the title, is the article's. All that an ``article`` element holds is its own.
    """
    if path and path[-1].partition(" ")[0] == "article":
        return []
    least = max(3.0, 0.9 * wrapper["k"])
    nodes, root = [wrapper], 0
    for label in path:
        root = _below(root, label)
        nodes = [c for node in nodes for c in node["c"] if c["l"] == label]
    places: list[tuple[bool, list[int]]] = []  # whether a slot, keys

    def walk(node: dict, at: int) -> None:
        if node["t"] == 0 or (node["t"] and node["k"] < least):
            places.append((True, []))
        elif node["t"]:
            places.append((False, [at ^ t for t in node["t"]]))
        for c in node["c"]:
            if not dropped(c["l"], True):
                walk(c, _below(at, c["l"]))

    for node in nodes:
        walk(node, root)
    slots = [i for i, (slot, _) in enumerate(places) if slot]
    if not slots:
        return []
    outer = {k for i, (_, keys) in enumerate(places) if i < slots[0] or i > slots[-1] for k in keys}
    return sorted(outer)


def _below(at: int, label: str) -> int:
    return _hash(f"{at} {label}")


def main_path(wrapper: dict) -> list[str]:
    """Labels from the root to the main part. An ``article`` or ``main`` element with enough of the
    text is taken; then elements named so; else one descends as long as one child holds most. The
    template's texts count only where pages have no others."""
    slots = _slots(wrapper)
    wrapper = slots if _texts(slots) else _copy(wrapper)
    _named(wrapper, 0.8 * max(1, _texts(wrapper)))
    total = max(1, _mass(wrapper))
    found: list[tuple[int, int, list[str]]] = []

    def walk(node: dict, path: list[str]) -> None:
        for c in node["c"]:
            if _gone(c, False):
                continue
            here = [*path, c["l"]]
            tag, _, names = c["l"].partition(" ")
            rank = 3 if tag == "article" else 2 if tag == "main" or "main" in names.split() else 1 if _MAIN_NAMES.search(names) else 0
            if rank and (mass := _mass(c, True)) >= (0.1 if rank > 1 else 0.4) * total:
                found.append((rank, mass, here))
                if rank == 3:
                    continue
            walk(c, here)

    walk(wrapper, [])
    if found:
        return max(found, key=lambda x: (x[0], x[1]))[2]
    path, node = [], wrapper
    while node["c"]:
        child = max(node["c"], key=_mass)
        # A repeated child is a list of paragraphs: the part around it is the main one.
        if child["r"] or _mass(child) < 0.8 * _mass(node) or child["l"].partition(" ")[0] in ("p", "h1", "h2", "li", "td"):
            break
        path, node = [*path, child["l"]], child
    return path


def text_at(page: dict, path: list[str], template: frozenset[int] = frozenset()) -> str | None:
    """The text of the page's elements at ``path`` but for the template's; None if it has none there."""
    nodes, root = [page], 0
    for label in path:
        root = _below(root, label)
        nodes = [c for node in nodes for c in node["c"] if isinstance(c, dict) and c["l"] == label]
    if not nodes:
        return None
    parts: list[str] = []

    def walk(node: dict, at: int) -> None:
        constant = template and at ^ _hash("".join(x for x in node["c"] if isinstance(x, str)).strip()) in template
        for c in node["c"]:
            if isinstance(c, str):
                parts.append(" " if constant else c)
            elif not dropped(c["l"], bool(path)):
                block = c["l"].partition(" ")[0] not in INLINE
                parts.append(" " * block)
                walk(c, _below(at, c["l"]) if template else 0)
                parts.append(" " * block)

    for node in nodes:
        walk(node, root)
        parts.append(" ")
    return " ".join("".join(parts).split())
