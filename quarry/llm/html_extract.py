"""Main text of web pages by wrappers that are inferred from pages of one host.

A wrapper is a union-free regular expression over tokens: tags, constant texts, text slots, repeated groups (one or more
times) and optional groups. A page's token stream is first folded: runs of one balanced group become a repeated group.
Then the streams of a host's pages are aligned with the wrapper one after the other: texts that differ become slots,
groups that one side lacks become optional or, if they repeat their neighbour, part of a repeated group. Each page is then
matched with the finished wrapper, and the texts of the slots labelled main are taken. A slot is labelled by where it
stands and by what stands in it: inside menus, headers, footers, sidebars, notices, adverts, forms, comments and the like
it is no main text. Elsewhere its texts that stand on all pages that have the slot are template, in articles only if these
are all of a host's pages, and the rest is main text; slots outside articles count only on pages without one. A text that
meets no slot of the wrapper has its place as its slot, so nothing is dropped for want of a match.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import lean, lean_cogroup, lean_group, parts, row_hash, small_batches, stage, with_fields

#: Batches of pages, each with the wrappers of its rows.
Batches = Iterator[tuple[pa.RecordBatch, list[str | None]]]

#: A text is template only if it stands on so many different pages (on all, but two at least, if a host has fewer) and on all that have its slot.
TEMPLATE_PAGES = 4
#: Bytes of wrappers, and rows of counts, up to which they are sent to every executor.
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 100_000
#: Bytes of a host's wrapper up to which it is put beside each of its pages; a longer one goes once to each share of them.
WRAPPER_BYTES = 128 << 10
#: Nodes of wrappers, and counts, that a task keeps before it hands them on.
HELD = 200_000

#: Elements that hold no main text; inline elements; elements without content; words of class, id and role.
NO_TEXT = set("head title nav footer aside form button select option textarea input label fieldset legend dialog menu datalist script style noscript template iframe object svg math canvas audio video map".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OTHER_PARTS = set(
    "ad ads adv advert adverts advertisement advertisements adbox adsbox banner sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars side aside footer footers foot header headers masthead topbar notice notices alert alerts cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations widget widgets toolbar pagination pager search form contentinfo complementary".split()
)

_raw = "script|style|noscript|template|textarea|iframe|title|svg|math|object"
_token = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_raw})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+(?:[\"'][^>]*)?)(?P<whole>>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_attribute = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_spaces = re.compile(r"\s+")
#: Start tags that close an open element of the same set, up to the nearest of the second set.
_CLOSES = {"p": ({"p"}, set()), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
_AFTER_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind o opens, c closes, t is text; rest holds attributes or text. Comments and raw elements go."""
    for m in _token.finditer(page):
        if m["text"] is not None:
            yield "t", "#", m["text"]
        elif m["tag"] and m["whole"]:  # a tag that the page's end cuts off says nothing
            yield ("c" if m["end"] else "o"), m["tag"].lower(), m["attributes"] or ""


def _marks(name: str, attributes: str) -> tuple[str, bool]:
    """The element's name with its classes, and whether it is a part other than main text."""
    other = name in NO_TEXT
    if not attributes or attributes == "/":
        return name, other
    shown = name
    for key, value in _attribute.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            other = True
        elif key in ("class", "id", "role"):
            if key == "class":
                shown = f"{name}.{'.'.join(sorted(value.split()))}"
            if name not in ("html", "body", "article", "main") or key == "role":
                other = other or any(w.lower() in OTHER_PARTS for w in _words.findall(value))
            elif any(w.lower() in ("comment", "comments", "reply", "related", "promo", "ad", "ads", "sponsored") for w in _words.findall(value)) and name == "article":
                other = True
    return shown, other


def layout(page: str) -> tuple[list[tuple[str, str, bool]], list[list]]:
    """The page's text blocks in order (place, text, whether in an article), and its tokens as wrapper nodes.

    A place is a path of elements; inline elements belong to the text. Elements that HTML lets open are closed where they
    end. Of parts other than main text only the outermost tags are kept.
    """
    out: list[tuple[str, str, bool]] = []
    nodes: list[list] = []
    stack: list[tuple[str, str, bool, bool, str]] = [("", "", False, False, "")]
    held: list[str] = []

    def flush() -> None:
        if held:
            text = _spaces.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                _, _, _, article, path = stack[-1]
                nodes.append(["text", text, path, [len(out)]])
                out.append((path, text, article))

    def pop(k: int) -> None:
        while len(stack) > k:
            name, _, _, _, path = stack.pop()
            if name not in INLINE and not stack[-1][2]:
                nodes.append(["tag", "/" + name, path])

    for kind, name, rest in tokens(page):
        if kind == "t":
            if not stack[-1][2]:  # the text of other parts is not needed
                held.append(rest)
        elif name in INLINE and kind == "o":
            if name == "br":
                held.append(" ")
                continue
            shown, other = _marks(name, rest)
            if other:  # an inline advert or the like, in the midst of a block
                stack.append((name, shown, True, stack[-1][3], f"{stack[-1][4]}/{shown}"))
        elif name in INLINE:
            if stack[-1][0] == name:
                stack.pop()
        elif kind == "o":
            flush()
            closes, bar = _CLOSES.get(name, (set(), set()))
            if name in _AFTER_P:
                closes, bar = closes | {"p"}, bar
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in bar:
                    break
                if stack[k][0] in closes:
                    pop(k)
                    break
                if stack[k][0] not in INLINE and stack[k][0] not in ("p", "li", "dt", "dd", "td", "th", "tr"):
                    break
            if name in VOID or rest.endswith("/"):
                continue
            shown, other = _marks(name, rest)
            _, _, above, article, path = stack[-1]
            article = article or name in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?(main|article)\b", rest, re.I))
            other = other or (name == "header" and not stack[-1][3])
            stack.append((name, shown, above or other, article, f"{path}/{shown}"))
            if not above:
                nodes.append(["tag", shown, f"{path}/{shown}"])
        else:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if k or name in ("p",):
                flush()
            if k:
                pop(k)
    flush()
    pop(1)
    return out, nodes


# --- wrappers -------------------------------------------------------------------------------------------------------
# a node is ["tag", name, place], ["text", constant or None, place], ["+", nodes] or ["?", nodes]; a page's texts have the
# numbers of their blocks as a fourth value


def _key(node: list) -> str:
    return node[1] if node[0] == "tag" else "#" if node[0] == "text" else node[0] + "(" + " ".join(map(_key, node[1])) + ")"


def _mark(node: list) -> str:
    """What nodes must have in common to match: kind, name and place."""
    return f"{node[1]} {node[2]}" if node[0] == "tag" else f"# {node[2]}" if node[0] == "text" else node[0] + "(" + " ".join(map(_mark, node[1])) + ")"


def _merge_equal(a: list[list], b: list[list]) -> list[list]:
    """Two node lists of equal marks as one: texts that differ become slots; the blocks of both go to the first."""
    out = []
    for x, y in zip(a, b, strict=True):
        if x[0] == "text":
            if len(x) > 3:
                x[3].extend(y[3] if len(y) > 3 else ())
            out.append(["text", x[1] if x[1] == y[1] else None, *x[2:]])
        elif x[0] == "tag":
            out.append(x)
        else:
            out.append([x[0], _merge_equal(x[1], y[1])])
    return out


def _balanced(nodes: list[list]) -> bool:
    """Whether nodes are whole elements side by side."""
    depth = 0
    for n in nodes:
        if n[0] == "tag":
            depth += -1 if n[1].startswith("/") else 1
            if depth < 0:
                return False
        elif not depth and n[0] == "text":
            return False
    return depth == 0


def fold(nodes: list[list]) -> list[list]:
    """Runs of two or more equal groups of whole elements, of any length, become repeated groups; shortest groups first."""
    length, ids = 1, None
    while 2 * (length := length + 1) <= len(nodes):
        if ids is None:
            known: dict[str, int] = {}
            ids = np.array([known.setdefault(_mark(n), len(known)) for n in nodes])
        same = ids[:-length] == ids[length:]
        if np.count_nonzero(same) < length:
            continue
        runs = np.concatenate(([0], np.cumsum(same)))
        again = (runs[length:] - runs[:-length] == length).tolist()  # whether a group at a place comes again at once
        out: list[list] = []
        i = 0
        while i < len(nodes):
            j = i + length
            if i < len(again) and again[i] and _balanced(nodes[i:j]):
                group = nodes[i:j]
                while j - length < len(again) and again[j - length]:
                    group = _merge_equal(group, nodes[j : j + length])
                    j += length
                out.append(["+", group])
                i = j
            else:
                out.append(nodes[i])
                i += 1
        if len(out) < len(nodes):
            nodes, ids = out, None
    return nodes


def _bodies(nodes: list[list]) -> dict[str, int]:
    return {" ".join(map(_mark, n[1])): len(n[1]) for n in nodes if n[0] == "+"}


def _grouped(nodes: list[list], maybe: list[bool], bodies: dict[str, int]) -> tuple[list[list], list[bool]]:
    """Single stretches that equal the body of a repeated group of the other side become such a group."""
    if not bodies:
        return nodes, maybe
    sizes = sorted(set(bodies.values()), reverse=True)
    keys, out, flags, i = [_mark(n) for n in nodes], [], [], 0
    while i < len(nodes):
        size = next((z for z in sizes if i + z <= len(nodes) and len(set(maybe[i : i + z])) == 1 and bodies.get(" ".join(keys[i : i + z])) == z), 0)
        out.append(["+", nodes[i : i + size]] if size else nodes[i])
        flags.append(maybe[i])
        i += size or 1
    return out, flags


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Rising pairs of equal marks: equal ends, then marks that both have once, then what stands between those."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i == m or j == n:
            continue
        counts_a, counts_b = Counter(a[i:m]), Counter(b[j:n])
        at = {x: k for k, x in enumerate(b[j:n], j) if counts_b[x] == 1}
        tails: list[int] = []  # the longest rising chain of these
        last: list[tuple[int, int]] = []
        before: dict[tuple[int, int], tuple[int, int] | None] = {}
        for k in range(i, m):
            if counts_a[a[k]] == 1 and a[k] in at:
                pair = (k, at[a[k]])
                t = bisect_left(tails, pair[1])
                before[pair] = last[t - 1] if t else None
                tails[t:], last[t:] = [pair[1], *tails[t + 1 :]], [pair, *last[t + 1 :]]
        chain, pair = [], last[-1] if last else None
        while pair:
            chain.append(pair)
            pair = before[pair]
        if chain:
            chain.reverse()
            found += chain
            for (p, q), (r, s) in zip([(i - 1, j - 1), *chain], [*chain, (m, n)], strict=True):
                todo.append((p + 1, r, q + 1, s))
        elif (m - i) * (n - j) <= 40_000:
            for block in SequenceMatcher(None, a[i:m], b[j:n], autojunk=False).get_matching_blocks():
                found += [(i + block.a + k, j + block.b + k) for k in range(block.size)]
        else:  # without anything that stands out, each mark meets the next of its like
            spots: dict[str, list[int]] = {}
            for k in range(i, m):
                spots.setdefault(a[k], []).append(k)
            for k in range(j, n):
                own = spots.get(b[k], ())
                t = bisect_left(own, i)
                if t < len(own):
                    found.append((own[t], k))
                    i = own[t] + 1
    return sorted(found)


def _flat(wrapper: list[list]) -> tuple[list[list], list[bool]]:
    """The wrapper's nodes without optional groups, and whether each is optional."""
    pairs = [(n, node[0] == "?") for node in wrapper for n in (node[1] if node[0] == "?" else [node])]
    return [n for n, _ in pairs], [o for _, o in pairs]


def align(wrapper: list[list], page: list[list]) -> list[list]:
    """The wrapper widened along one alignment so that it covers the page, or another wrapper, too.

    A text of the one side that the other lacks becomes optional, and so do tags and groups.
    """
    (flat, maybe), (other, free) = _flat(wrapper), _flat(page)
    bodies = _bodies(flat)
    flat, maybe = _grouped(flat, maybe, _bodies(other))
    other, free = _grouped(other, free, bodies)
    out: list[list] = []
    i = j = 0
    for k, m in [*_matches([_mark(n) for n in flat], [_mark(n) for n in other]), (len(flat), len(other))]:
        out += [["?", [n]] for n in [*flat[i:k], *other[j:m]]]
        if k < len(flat):
            both = _merge_equal([flat[k]], [other[m]])
            out += [["?", both]] if maybe[k] or free[m] else both
        i, j = k + 1, m + 1
    return out


def _joined(nodes: list[list]) -> list[list]:
    """Neighbouring optional nodes as one optional group."""
    out: list[list] = []
    for n in nodes:
        if n[0] == "?" and out and out[-1][0] == "?":
            out[-1] = ["?", [*out[-1][1], *n[1]]]
        else:
            out.append(n)
    return out


def _bare(nodes: list[list], texts: bool = True) -> list[list]:
    """Nodes without the blocks of a page, and without constants unless `texts`."""
    return [["text", n[1] if texts else None, n[2]] if n[0] == "text" else n if n[0] == "tag" else [n[0], _bare(n[1], texts)] for n in nodes]


def _shape(nodes: list[list]) -> int:
    """Hash of a page's marks."""
    return hash(tuple([(n[0] == "text" or n[1], n[2]) for n in nodes]))


class Matcher:
    """Matches pages with a wrapper: each text block gets the slot, by number, that its text meets in the wrapper.

    A block that meets none has its place as its slot.
    """

    def __init__(self, regex: list[list]):
        self.flat, _ = _flat(regex)
        self.bodies = _bodies(self.flat)
        self.places: dict[str, list[int]] = {}  # where each mark stands
        for i, n in enumerate(self.flat):
            self.places.setdefault(_mark(n), []).append(i)
        self.first: list[int] = []  # number of each node's first text
        n = 0
        for node in self.flat:
            self.first.append(n)
            n += self._texts([node])
        self.known: dict[int, list[int | None]] = {}  # by the hash of a page's marks

    def _texts(self, nodes: list[list]) -> int:
        return sum(1 if n[0] == "text" else 0 if n[0] == "tag" else self._texts(n[1]) for n in nodes)

    def _assign(self, nodes: list[list], at: int, slots: list[int | None]) -> int:
        for n in nodes:
            if n[0] == "text":
                for block in n[3]:
                    slots[block] = at
                at += 1
            elif n[0] != "tag":
                at = self._assign(n[1], at, slots)
        return at

    def _near(self, marks: list[str]) -> tuple[list[str], list[int]]:
        """The wrapper's nodes that a page with these marks may meet, and where they stand; an empty mark for those left out between."""
        own, at = [], []
        for i, mark in sorted((i, mark) for mark in set(marks) for i in self.places.get(mark, ())):
            if i != (at[-1] + 1 if at else 0):
                own.append("")
                at.append(i - 1)
            own.append(mark)
            at.append(i)
        if (at[-1] if at else -1) != len(self.flat) - 1:
            own.append("")
            at.append(len(self.flat) - 1)
        return own, at

    def slots(self, found: list[tuple[str, str, bool]], nodes: list[list]) -> list[str]:
        shape = _shape(nodes)
        numbers = self.known.get(shape)
        if numbers is None:
            numbers = [None] * len(found)
            page = fold(nodes)
            page, _ = _grouped(page, [False] * len(page), self.bodies)
            marks = [_mark(n) for n in page]
            own, at = self._near(marks)
            for i, j in _matches(own, marks):
                self._assign([page[j]], self.first[at[i]], numbers)
            if len(self.known) >= 1000:
                self.known.clear()
            if len(numbers) <= 100:
                self.known[shape] = numbers
        return [b[0] if n is None else str(n) for b, n in zip(found, numbers, strict=True)]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def count_slots(counts: dict, host: str | None, page: str, matcher: Matcher) -> None:
    """Adds a page to counts: (host, slot, in an article, digest of a text): [pages, digests of pages, TEMPLATE_PAGES at most].

    A digest of None stands for all texts of the slot, and a slot of None for the whole host.
    """
    found, nodes = layout(page)
    own = _digest(page)
    seen: set[tuple] = {(host, None, False, None)}
    for (_, text, article), slot in zip(found, matcher.slots(found, nodes), strict=True):
        seen.add((host, slot, article, None))
        seen.add((host, slot, article, _digest(text)))
    for key in seen:
        c = counts.setdefault(key, [0, set()])
        c[0] += 1
        if len(c[1]) < TEMPLATE_PAGES:
            c[1].add(own)


def template_texts(counts: dict) -> list[list]:
    """[slot, digest] of one host's template texts: those on all pages that have their slot, so far as these are enough.

    Outside articles enough are TEMPLATE_PAGES different pages, or all, but two at least, if the host has fewer. In articles
    they must be all pages of a host with TEMPLATE_PAGES different ones, and the articles must have other texts that vary.
    """
    pages, different = next((c[0], len(c[1])) for k, c in counts.items() if k[1] is None)
    slots = {k[1:3]: c[0] for k, c in counts.items() if k[3] is None}
    vary = any(k[2] and k[3] is not None and c[0] < pages for k, c in counts.items())
    found = []
    for (_, slot, article, text), (n, own) in counts.items():
        enough = n == pages and different >= TEMPLATE_PAGES and vary if article else len(own) >= max(2, min(different, TEMPLATE_PAGES))
        if text is not None and enough and n == slots[slot, article]:
            found.append([slot, text])
    return sorted(found)


def widen(wrapper: list[list] | None, page: str) -> list[list]:
    """The wrapper with one more page."""
    nodes = _bare(fold(layout(page)[1]))
    return nodes if wrapper is None else align(wrapper, nodes)


def _push(held: list[tuple[int, list[list]]], nodes: list[list]) -> None:
    """Adds a page's nodes, or a wrapper, to wrappers of falling levels: two of one level are aligned, which makes one of the next.

    So each node is met a number of times that grows with the logarithm of the pages, however wide the wrapper gets.
    """
    level = 0
    while held and held[-1][0] == level:
        nodes = align(held.pop()[1], nodes)
        level += 1
    held.append((level, nodes))


def _merged(held: list[tuple[int, list[list]]]) -> list[list]:
    """One wrapper of those that _push holds."""
    nodes = held[-1][1]
    for _, other in held[-2::-1]:
        nodes = align(other, nodes)
    return nodes


def infer(pages: list[str]) -> dict:
    """The wrapper of a host with these pages: `regex` has the nodes, `template` the slots and digests of texts that are no main text."""
    wrapper: list[list] | None = None
    for page in dict.fromkeys(pages):
        wrapper = widen(wrapper, page)
    regex, counts = _joined(wrapper or []), {}
    matcher = Matcher(regex)
    for page in pages:
        count_slots(counts, None, page, matcher)
    return {"regex": regex, "template": template_texts(counts) if counts else []}


class Extractor:
    """Takes the main texts of a host's pages by the labels of their slots."""

    def __init__(self, wrapper: dict | None):
        self.matcher = Matcher(wrapper["regex"]) if wrapper else None
        self.template: dict[str, set[int]] = {}
        for slot, text in wrapper["template"] if wrapper else ():
            self.template.setdefault(slot, set()).add(int(text))

    def __call__(self, page: str | None) -> str:
        found, nodes = layout(page or "")
        slots = self.matcher.slots(found, nodes) if self.matcher else [None] * len(found)
        marked = any(b[2] for b in found)
        main = [(b[1], s) for b, s in zip(found, slots, strict=True) if b[2] == marked]
        return "\n".join(text for text, s in main if s not in self.template or _digest(text) not in self.template[s])


def extract(page: str | None, wrapper: dict | None) -> str:
    """The page's main text: its blocks in slots labelled main, joined by line ends."""
    return Extractor(wrapper)(page)


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def _structures(pages: DataFrame) -> DataFrame:
    """(host, regex) for every host of pages (host, html): each task widens a wrapper for each host, then these are aligned."""
    small_batches(pages.sparkSession)
    schema = "host string, share int, regex string"
    names = ["host", "share", "regex"]

    def widen_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = TaskContext.get().partitionId() % 32
        own: dict[str, list[tuple[int, list[list]]]] = {}
        shapes: set[tuple[str, int]] = set()

        def held() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([share] * len(own), pa.int32()), pa.array([json.dumps(_merged(w)) for w in own.values()], pa.string())], names)
            own.clear()
            shapes.clear()
            return batch

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                nodes = layout(page)[1]
                shape = (host, _shape(nodes))
                if shape not in shapes:  # a shape that was met before is covered
                    shapes.add(shape)
                    _push(own.setdefault(host, []), _bare(fold(nodes), texts=False))
            if len(shapes) > HELD or sum(len(nodes) for kept in own.values() for _, nodes in kept) > HELD:
                yield held()
        yield held()

    def join(table: pa.Table) -> pa.Table:
        wrappers: list[tuple[int, list[list]]] = []
        for regex in sorted(set(table.column("regex").to_pylist())):
            _push(wrappers, json.loads(regex))
        return pa.table({"host": table.column("host")[:1], "share": table.column("share")[:1], "regex": pa.array([json.dumps(_merged(wrappers))], pa.string())})

    found = pages.mapInArrow(lean(widen_all), schema)
    for by in (["host", "share"], ["host"]):  # by shares first, so that a large host's wrappers do not all meet in one task
        found = found.groupBy(*by).applyInArrow(lean_group(join), schema)
    return stage(found.select("host", "regex"), "wrapper-structures")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _with(pages: DataFrame, wrappers: DataFrame, column: str, names: list[str], f: Callable[[Batches], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """f over all pages (host, of, ...): it gets batches of the columns in names, with the wrapper of each row's host, or None.

    Pages of hosts with long wrappers are dealt into shares by `of`, and a share gets its wrapper once.
    """
    long = F.octet_length(column) > WRAPPER_BYTES
    size, n = wrappers.agg(F.sum(F.when(~long, F.octet_length(column))), F.count_if(long)).first()
    short, few = wrappers, pages
    if n:
        short = wrappers.where(~long)
        wide = stage(wrappers.where(long).select("host"), "long-wrappers")
        few = pages.join(_small(wide), "host", "left_anti")
    joined = few.join(F.broadcast(short) if (size or 0) <= BROADCAST_BYTES else short, "host", "left").select(*names, column)
    done = joined.mapInArrow(lean(lambda batches: f((b, b.column(column).to_pylist()) for b in batches)), schema)
    if not n:
        return done

    def share(table: pa.Table, wrapper: pa.Table) -> pa.Table:
        w = wrapper.column(column)[0].as_py()
        batches = table.select(names).to_batches() or [pa.RecordBatch.from_pylist([], table.select(names).schema)]
        return pa.Table.from_batches(f((b, [w] * b.num_rows) for b in batches))

    shares = parts(pages.sparkSession)
    own = pages.join(_small(wide), "host", "left_semi").withColumn("share", F.pmod("of", F.lit(shares)).cast("int"))
    sent = wrappers.where(long).select("host", column, F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    return done.union(own.groupBy("host", "share").cogroup(sent.groupBy("host", "share")).applyInArrow(lean_cogroup(share), schema))


def _counts(pages: DataFrame, structures: DataFrame) -> DataFrame:
    """count_slots over all pages: host, slot, article, text, n, different (pages, TEMPLATE_PAGES at most)."""
    names = ["host", "slot", "article", "text", "n", "own"]
    types = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def count(batches: Batches) -> Iterator[pa.RecordBatch]:
        known: dict[str, Matcher] = {}
        counts: dict[tuple, list] = {}

        def held() -> pa.RecordBatch:
            columns = [*zip(*counts, strict=True), *zip(*[(c[0], sorted(c[1])) for c in counts.values()], strict=True)] or [()] * 6
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)
            counts.clear()
            return batch

        for batch, regexes in batches:
            for host, page, regex in zip(*[batch.column(c).to_pylist() for c in ("host", "html")], regexes, strict=True):
                if host not in known:
                    if len(known) >= 100:
                        known.clear()
                    known[host] = Matcher(json.loads(regex))
                count_slots(counts, host, page, known[host])
            if len(counts) > HELD:
                yield held()
        yield held()

    found = _with(pages, structures, "regex", ["host", "html"], count, "host string, slot string, article boolean, text long, n long, own array<long>")
    merged = found.groupBy("host", "slot", "article", "text").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("own")).alias("own"))
    return stage(merged.withColumn("different", F.least(F.size(F.array_distinct("own")), F.lit(TEMPLATE_PAGES))).drop("own"), "slot-counts")


def learn_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper) for every host, from all its pages; wrapper is JSON. A null url belongs to the empty host; null pages teach nothing.

    As `infer` does: the expression first, then the template texts by counts of (host, slot, text) and (host, slot).
    """
    p = pages.where(F.col(page).isNotNull()).select(host_of(F.col(url)).alias("host"), F.col(page).alias("html"), row_hash(pages).alias("of"))
    structures = _structures(p.select("host", "html"))
    counts = _counts(p, structures)
    texts = counts.where("text is not null")
    hosts = counts.where("slot is null").select("host", F.col("n").alias("pages"), F.col("different").alias("of"))
    hosts = hosts.join(texts.where("article").groupBy("host").agg(F.min("n").alias("least")), "host", "left")
    slots = counts.where("slot is not null and text is null").select("host", "slot", "article", F.col("n").alias("total"))
    constant = texts.where("different >= 2").join(_small(slots), ["host", "slot", "article"]).where("n = total").join(_small(hosts), "host")
    outside = F.col("different") >= F.greatest(F.lit(2), F.least("of", F.lit(TEMPLATE_PAGES)))
    inside = (F.col("n") == F.col("pages")) & (F.col("of") >= TEMPLATE_PAGES) & (F.col("least") < F.col("pages"))
    template = constant.where(F.when(F.col("article"), inside).otherwise(outside)).groupBy("host").agg(F.sort_array(F.collect_list(F.array("slot", F.col("text").cast("string")))).alias("template"))
    whole = structures.join(template, "host", "left")
    return stage(whole.select("host", F.concat(F.lit('{"regex": '), "regex", F.lit(', "template": '), F.coalesce(F.to_json("template"), F.lit("[]")), F.lit("}")).alias("wrapper")), "wrappers")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Replaces the html column by `text` and `n_chars`; every row stays, its other columns pass through.

    Null or empty html gives an empty text; whole pages of any length are read; repeated rows get equal texts.
    """
    small_batches(pages.sparkSession)
    wrappers = learn_wrappers(pages, url, page)
    others = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    laid = pages.select(F.struct(*others).alias("rest"), host_of(F.col(url)).alias("host"), F.col(page).alias("html"), row_hash(pages).alias("of"))

    def look(batches: Batches) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Extractor] = {}
        for batch, own in batches:
            out = []
            for page, w in zip(batch.column("html").to_pylist(), own, strict=True):
                if w not in known:
                    if len(known) >= 100:
                        known.clear()
                    known[w] = Extractor(json.loads(w) if w else None)
                out.append(known[w](page))
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["rest", "text", "n_chars"])

    done = _with(laid, wrappers, "wrapper", ["rest", "html"], look, with_fields([laid.schema["rest"]], "text string, n_chars long"))
    return done.select(*[F.col(f"rest.`{c}`").alias(c) for c in others], "text", "n_chars")
