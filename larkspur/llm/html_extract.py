"""HTML extraction by wrapper induction: pages of one host are aligned by simple tree matching.

1. Every page is parsed once to a tree of blocks (inline tags are text) and written as such: labels, parents and, for each run of text, its node
   and a hash of its path and words. A host's pages of one layout (the same containers near the top) are a group.
2. Every page of a group is aligned with the group's pivot, the page of the least hash: simple tree matching finds a largest mapping of
   equal labels that keeps order and descent. A text of the pivot that SAME of the other pages, two at least, repeat at the node that maps to it is
   template. All other text varies; by container it is weighed over all pages of the group.
3. The wrapper of a group is the path of the deepest container that holds CONTENT_SHARE of the varying text, the template texts
   under it, and those containers named like boilerplate (adverts, comments, share bars) that recur in the group. A name alone
   drops nothing: a container that no other page has is text of its article. Where the template texts under the path are more than the
   varying ones the pages are copies of each other, and nothing is template.
4. A page's text is that under its wrapper's path, without what the wrapper drops and without elements that are no article
   text by the HTML standard (nav, aside, form, footer, scripts ...; a header only outside articles).

Counts are added up by group inside the tasks, so that a host of any number of pages shuffles a few rows a task and is never gathered. A
page whose group has no differing pages uses the path of its host's largest group, else its article or main element, else the path that most
groups have, else its largest container; there names alone decide, inside articles only whole class names or ids.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: The share of a group's other pages (two at least) that repeat a template text.
SAME = 0.9
CONTENT_SHARE = 0.8
#: The share of a group's pages (two at least) that have a container named like boilerplate, for it to be dropped.
RECURS = 0.05
#: Blocks nested deeper than this are siblings of their container; no text is lost.
DEEPEST = 150
#: Containers so many levels below the root, and outside articles, tell layouts apart.
LAYOUT_DEPTH = 4
#: Pivots and wrappers (hashes and a few paths each) of at most so many groups and bytes are broadcast; more are joined by shuffle, each copied to SALTS keys.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 32 << 20
SALTS = 16
#: Groups whose pivots a task holds, counts of a task and pairs of subtrees whose match is remembered at once; bytes of HTML parsed between two batches given out.
HELD_GROUPS = 64
HELD_COUNTS = 50_000
HELD_MATCHES = 500_000
PIECE_BYTES = 4 << 20

#: Fixed values of the HTML standard.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea iframe noframes noembed svg math object canvas xmp title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - frozenset("caption head html body legend option optgroup tbody td tfoot th thead title tr frameset".split())
#: What an opening tag ends, up to the container that bounds it.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)), "thead": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)), "tfoot": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)),
}
CONTAINERS = frozenset("article main div section body td".split())
LAYOUT_TAGS = CONTAINERS | frozenset("nav header footer aside form".split())
ARTICLES = frozenset(("article", "main"))
#: Never article text; header only outside articles, form only if it doesn't hold an article or a first heading.
NO_TEXT_TAGS = frozenset("nav footer aside menu search dialog head select fieldset button".split())
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Containers of these names may be boilerplate; the alignment decides.
NAMED_TAGS = frozenset("div section ul ol dl table figure details".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination popup promo promoted recommended related reply replies respond share sharing sidebar skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
NO_TEXT, NAMED_WHOLE, NAMED_PART, IN_ARTICLE = 1, 2, 4, 8

_VALUE = r"""(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)"""
_NAME = r"[^\s/>][^\s/>=]*"
_ONE = re.compile(rf"({_NAME})(?:\s*=\s*({_VALUE})?)?")
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE}?)?)*+)(?:>|\Z)", re.S)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_BLANK = " \t\n\r\f\v"


def attributes(text: str) -> dict[str, str]:
    """The attributes of a tag by name in lower case; of equal names the first counts."""
    out: dict[str, str] = {}
    for name, value in _ONE.findall(text):
        if value[:1] in ("'", '"'):
            value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
        out.setdefault(name.lower(), html.unescape(value))
    return out


def key_of(path: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\n{text}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Page:
    """A parsed page: nodes in page order (label, parent, flags), runs of text in page order (node, text)."""

    __slots__ = ("labels", "parents", "flags", "owners", "texts")

    def __init__(self):
        self.labels, self.parents, self.flags = ["#"], [-1], [0]
        self.owners: list[int] = []
        self.texts: list[str] = []

    def tag(self, node: int) -> str:
        return self.labels[node].split(".", 1)[0]

    def paths(self) -> list[str]:
        return paths_of(self.labels, self.parents)

    def layout(self) -> int:
        """A hash of the containers near the root; what an article holds is no layout."""
        depth, seen = [0], set()
        paths = self.paths()
        for node in range(1, len(paths)):
            depth.append(depth[self.parents[node]] + 1)
            if depth[node] <= LAYOUT_DEPTH and self.tag(node) in LAYOUT_TAGS and not self.flags[self.parents[node]] & IN_ARTICLE:
                seen.add(paths[node])
        return key_of("layout", "\n".join(sorted(seen)))


def paths_of(labels: list[str], parents: list[int]) -> list[str]:
    out = [labels[0]]
    for k in range(1, len(labels)):
        out.append(f"{out[parents[k]]}/{labels[k]}")
    return out


def parse(page: str) -> Page:
    """Raw elements lose their content, comments go, character references are decoded; white space in a run becomes one space."""
    out = Page()
    labels, parents, flags = out.labels, out.parents, out.flags
    tags, depth = ["#"], [0]
    forms: list[int] = []
    named: list[int] = []
    holds = [0]  # nodes that are an article or a first heading
    at, node, end = 0, 0, len(page)
    run: list[str] = []
    hidden: list[str] = []  # open inline elements that are not shown

    def flush():
        if run:
            text = _SPACE.sub(" ", html.unescape("".join(run))).strip(_BLANK)
            run.clear()
            if text:
                out.owners.append(node)
                out.texts.append(text)

    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at and not hidden:
            run.append(page[at:stop])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, more = m[2].lower(), m[3]
        if m[1]:
            if tag in BLOCK:
                up = node
                while up and tags[up] != tag:
                    up = parents[up]
                if up:
                    flush()
                    node, hidden = parents[up], []
                elif tag == "p":
                    flush()
            elif hidden and hidden[-1] == tag:
                hidden.pop()
            continue
        if tag in RAW:
            if not (tag in ("svg", "math") and more.rstrip().endswith("/")):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in VOID:
            if tag in ("br", "hr") and not hidden:
                run.append(" ")
            continue
        if tag not in BLOCK:
            if hidden:
                if tag == hidden[-1]:
                    hidden.append(tag)
            elif tag == "button":
                hidden.append(tag)
            elif more:
                marks = attributes(more)
                if "hidden" in marks or marks.get("role", "").lower() in NO_TEXT_ROLES:
                    hidden.append(tag)
            continue
        flush()
        if tag in CLOSES_P:
            while node and tags[node] == "p":
                node = parents[node]
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            up, last = node, 0
            while up and tags[up] not in bounds:
                if tags[up] in ended:
                    last = up
                up = parents[up]
            node = parents[last] if last else node
        parent = node if depth[node] < DEEPEST else parents[node]
        marks = attributes(more) if more else {}
        names = [x for x in marks.get("class", "").split() if not any(c.isdigit() for c in x)]
        flag = flags[parent] & (NO_TEXT | IN_ARTICLE)
        if tag in NO_TEXT_TAGS or (tag == "header" and not flag & IN_ARTICLE) or "hidden" in marks or marks.get("role", "").lower() in NO_TEXT_ROLES:
            flag |= NO_TEXT
        if tag in ARTICLES:
            flag |= IN_ARTICLE
        me = len(labels)
        if tag in NAMED_TAGS and ("class" in marks or "id" in marks):
            own = [*marks.get("class", "").split(), *marks.get("id", "").split()]
            if any(x.lower() in NAMES for x in own):
                flag |= NAMED_WHOLE
            elif any(w in NAMES for x in own for w in _PARTS.findall(_CAMEL.sub(r"\1 \2", x).lower())):
                flag |= NAMED_PART
            if flag & (NAMED_WHOLE | NAMED_PART):
                named.append(me)
        if tag == "form":
            forms.append(me)
        if tag in ("article", "main", "h1"):
            holds.append(me)
        labels.append(".".join([tag, *names[:2]]))
        parents.append(parent)
        flags.append(flag)
        tags.append(tag)
        depth.append(depth[parent] + 1)
        node, hidden = me, []
    flush()
    around = set()
    for k in holds[1:]:
        k = parents[k]
        while k > 0 and k not in around:
            around.add(k)
            k = parents[k]
    for k in named:
        if k in around:
            flags[k] &= ~(NAMED_WHOLE | NAMED_PART)
    inner = {k for k in forms if k not in around}
    if inner:
        for k in range(1, len(labels)):
            if k in inner or (parents[k] in inner):
                inner.add(k)
                flags[k] |= NO_TEXT
    return out


class Shapes:
    """Subtrees by shape (label and shapes of the children), and how many nodes of two shapes a largest mapping matches."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.ids: dict[tuple, int] = {}
        self.label: list[str] = []
        self.children: list[np.ndarray] = []
        self.size: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}

    def of(self, labels: list[str], kids: list[list[int]]) -> list[int]:
        """The shape of each node; nodes are in page order, so children come after their parents."""
        out = [0] * len(labels)
        for k in range(len(labels) - 1, -1, -1):
            own = tuple(out[c] for c in kids[k])
            key = (labels[k], own)
            found = self.ids.get(key)
            if found is None:
                found = self.ids[key] = len(self.label)
                self.label.append(labels[k])
                self.children.append(np.array(own, np.int64))
                self.size.append(1 + sum(self.size[c] for c in own))
            out[k] = found
        return out

    def weigh(self, a: int, b: int) -> int:
        if a == b:
            return self.size[a]
        if self.label[a] != self.label[b]:
            return 0
        one, two = self.children[a], self.children[b]
        if not len(one) or not len(two):
            return 1
        key = (a, b)
        found = self.weights.get(key)
        if found is None:
            row = None
            for row in self.rows(one, two):
                pass
            found = self.weights[key] = 1 + int(row[-1])
        return found

    def rows(self, one: np.ndarray, two: np.ndarray, first: np.ndarray | None = None):
        """Row by row the table of the largest weights of the first i of one against the first j of two; first: the row to go on from."""
        distinct_a, a = np.unique(one, return_inverse=True)
        distinct_b, b = np.unique(two, return_inverse=True)
        table = np.array([[self.weigh(int(x), int(y)) for y in distinct_b] for x in distinct_a], np.int64).reshape(len(distinct_a), len(distinct_b))[:, b]
        row = np.zeros(len(two) + 1, np.int64) if first is None else first
        for i in a:
            row = row.copy()
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + table[i]))
            yield row

    def pairs(self, one: np.ndarray, two: np.ndarray):
        """Matched places of two lists of shapes. Every step-th row of the table is kept and the rows between are computed again, so that memory stays linear."""
        n, m = len(one), len(two)
        if n == m and (one == two).all():
            return [(k, k) for k in range(n)]
        step = max(16, int(n**0.5))
        zero = np.zeros(m + 1, np.int64)
        kept = [zero] + [r for i, r in enumerate(self.rows(one, two), 1) if i % step == 0]
        found, j = [], m
        for block in range(n // step, -1, -1):
            low = block * step
            rows = [kept[block], *self.rows(one[low : low + step], two, kept[block])]
            i = len(rows) - 1
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((low + i, j))
        return found[::-1]


def kids_of(parents: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in parents]
    for k, p in enumerate(parents):
        if p >= 0:
            out[p].append(k)
    return out


def match(shapes: Shapes, a_kids, a_shape, b_kids, b_shape) -> np.ndarray:
    """Simple tree matching: for each node of a the node of b that it maps to in a largest mapping, -1 for none."""
    out = np.full(len(a_shape), -1, np.int64)
    open_ = [(0, 0)] if shapes.label[a_shape[0]] == shapes.label[b_shape[0]] else []
    while open_:
        x, y = open_.pop()
        size = shapes.size[a_shape[x]]
        if a_shape[x] == b_shape[y]:  # a subtree's nodes lie together in page order
            out[x : x + size] = np.arange(y, y + size)
            continue
        out[x] = y
        if a_kids[x] and b_kids[y]:
            one, two = a_kids[x], b_kids[y]
            open_ += [(one[i], two[j]) for i, j in shapes.pairs(shapes.children[a_shape[x]], shapes.children[b_shape[y]])]
    return out


def parser(keep: list[str]):
    names = ["labels", "parents", "flags", "owners", "texts", "keys", "sizes"]

    def lists(rows, kind):
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for r in rows for x in r], kind))

    def run(batches):
        for batch in batches:
            at, column = 0, batch.column("__lk_html")
            sizes = np.cumsum(np.asarray(column.binary_length().fill_null(0) if hasattr(column, "binary_length") else [len(x.as_py() or "") for x in column]))
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE_BYTES, "right")))
                part = batch.slice(at, stop - at)
                at = stop
                pages = [parse(x or "") for x in part.column("__lk_html").to_pylist()]
                paths = [p.paths() for p in pages]
                made = [
                    lists([p.labels for p in pages], pa.string()), lists([p.parents for p in pages], pa.int32()), lists([p.flags for p in pages], pa.int8()), lists([p.owners for p in pages], pa.int32()),
                    lists([p.texts for p in pages], pa.string()), lists([[key_of(path[o], t) for o, t in zip(p.owners, p.texts, strict=True)] for p, path in zip(pages, paths, strict=True)], pa.int64()),
                    lists([[len(t) for t in p.texts] for p in pages], pa.int32()),
                ]
                layout = pa.array([p.layout() for p in pages], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in (*keep, "__lk_host", "__lk_mark")] + [layout, *made], [*keep, "__lk_host", "__lk_mark", "__lk_layout", *(f"__lk_{n}" for n in names)])

    return run


PARSED = "__lk_host string, __lk_mark long, __lk_layout long, __lk_labels array<string>, __lk_parents array<int>, __lk_flags array<tinyint>, __lk_owners array<int>, __lk_texts array<string>, __lk_keys array<long>, __lk_sizes array<int>"
GROUP = ["__lk_host", "__lk_layout"]
PAGES, TEMPLATE, NAMED, WEIGHT = 0, 1, 2, 3


class Pivot:
    def __init__(self, shapes: Shapes, labels: list[str], parents: list[int], owners: list[int], keys: list[int], sizes: list[int]):
        self.kids = kids_of(parents)
        self.shape = shapes.of(labels, self.kids)
        self.paths = paths_of(labels, parents)
        self.all_paths = set(self.paths)
        self.runs = list(zip(owners, keys, sizes, strict=True))


def aligned(shapes: Shapes, pivot: Pivot, labels, parents, flags, owners, keys, sizes) -> tuple[list[tuple[int, int]], dict[str, int], set[str]]:
    """The texts of the pivot (key, size) that the page has at the node that maps to theirs; by container path the size of all other text; paths of containers named like boilerplate."""
    kids = kids_of(parents)
    to = match(shapes, pivot.kids, pivot.shape, kids, shapes.of(labels, kids))
    here = set(zip(owners, keys, strict=True))
    same = [(owner, key, size) for owner, key, size in pivot.runs if (to[owner], key) in here]
    agreed = {(to[owner], key) for owner, key, _ in same}
    paths = paths_of(labels, parents)
    size_of = [0] * len(labels)
    for owner, key, size in zip(owners, keys, sizes, strict=True):
        if (owner, key) not in agreed and not flags[owner] & NO_TEXT:
            size_of[owner] += size
    weights: dict[str, int] = {}
    named: set[str] = set()
    for k in range(len(labels) - 1, -1, -1):
        if flags[k] & (NAMED_WHOLE | NAMED_PART):
            named.add(paths[k])
            continue
        if size_of[k]:
            if parents[k] >= 0:
                size_of[parents[k]] += size_of[k]
            if k == 0 or labels[k].split(".", 1)[0] in CONTAINERS:
                weights[paths[k]] = weights.get(paths[k], 0) + size_of[k]
    return [(key, size) for _, key, size in same], weights, named


def align(batches):
    """Rows (host, layout, kind, key, path, n, more) summed over the pages of a task: pages; template texts of the pivot by key (path of the node, size); named containers by path (1 if the pivot has it); weights by path."""
    shapes = Shapes()
    pivots: dict[tuple, Pivot] = {}
    counts: dict[tuple, int] = {}
    info: dict[tuple, tuple[str, int]] = {}

    def given():
        rows = [(*k[:3], k[3] if k[2] == TEMPLATE else 0, info[k][0] if k[2] == TEMPLATE else k[3], n, info.get(k, ("", 0))[1]) for k, n in counts.items()]
        kinds = (pa.string(), pa.int64(), pa.int8(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], [*GROUP, "kind", "key", "path", "n", "more"])
        counts.clear()
        info.clear()
        return out

    for batch in batches:
        names = [f"{side}_{c}" for side in ("__lk", "pivot") for c in ("labels", "parents", "flags", "owners", "keys", "sizes")]
        columns = {c: batch.column(c) for c in names if c != "pivot_flags"}
        hosts, layouts = (batch.column(c).to_pylist() for c in GROUP)
        for row, group in enumerate(zip(hosts, layouts, strict=True)):
            if group not in pivots:
                if len(pivots) >= HELD_GROUPS or len(shapes.weights) > HELD_MATCHES or len(shapes.ids) > HELD_MATCHES:
                    pivots.clear()
                    shapes.clear()
                pivots[group] = Pivot(shapes, *(columns[f"pivot_{c}"][row].as_py() for c in ("labels", "parents", "owners", "keys", "sizes")))
            pivot = pivots[group]
            same, weights, named = aligned(shapes, pivot, *(columns[f"__lk_{c}"][row].as_py() for c in ("labels", "parents", "flags", "owners", "keys", "sizes")))
            path_of = {key: pivot.paths[owner] for owner, key, _ in pivot.runs} if same else {}
            for kind, found in ((PAGES, [("", 1)]), (WEIGHT, weights.items()), (NAMED, [(p, 1) for p in named])):
                for name, n in found:
                    k = (*group, kind, name)
                    counts[k] = counts.get(k, 0) + n
                    if kind == NAMED:
                        info[k] = ("", int(name in pivot.all_paths))
            for key, size in same:
                k = (*group, TEMPLATE, key)
                counts[k] = counts.get(k, 0) + 1
                info[k] = (path_of[key], size)
            if len(counts) > HELD_COUNTS:
                yield given()
            if len(shapes.weights) > HELD_MATCHES or len(shapes.ids) > HELD_MATCHES:
                pivots.clear()
                shapes.clear()
    if counts:
        yield given()


def extracted(labels, parents, flags, owners, texts, keys, path, template, dropped, fallbacks) -> str:
    """The text of a page. path: that of its wrapper, None if it has none; fallbacks: paths to try before and after the page's articles."""
    paths = paths_of(labels, parents)
    template, dropped = set(template or ()), set(dropped or ())
    tags = [x.split(".", 1)[0] for x in labels]

    def under(chosen: set[int], gone) -> str:
        inside = [False] * len(labels)
        for k in range(len(labels)):
            inside[k] = (k in chosen or (parents[k] >= 0 and inside[parents[k]])) and not flags[k] & NO_TEXT and not gone(k)
        return " ".join(t for o, t, key in zip(owners, texts, keys, strict=True) if inside[o] and key not in template)

    if path is not None:
        return under({k for k, p in enumerate(paths) if p == path}, lambda k: flags[k] & (NAMED_WHOLE | NAMED_PART) and paths[k] in dropped)
    by_name = lambda k: flags[k] & NAMED_WHOLE or (flags[k] & NAMED_PART and not flags[k] & IN_ARTICLE)
    first, last = fallbacks
    articles = {k for k, t in enumerate(tags) if t in ARTICLES and not (parents[k] >= 0 and flags[parents[k]] & IN_ARTICLE)}
    for chosen in ({k for k, p in enumerate(paths) if p == first}, articles, {k for k, p in enumerate(paths) if p == last}):
        text = under(chosen, by_name) if chosen else ""
        if text:
            return text
    size = [0] * len(labels)
    ok = [False] * len(labels)
    for k in range(len(labels)):
        ok[k] = (parents[k] < 0 or ok[parents[k]]) and not flags[k] & NO_TEXT and not by_name(k)
    for o, t in zip(owners, texts, strict=True):
        size[o] += len(t) * ok[o]
    for k in range(len(labels) - 1, 0, -1):
        size[parents[k]] += size[k]
    full = [k for k, t in enumerate(tags) if t in CONTAINERS and size[k] >= CONTENT_SHARE * size[0]]
    return under({max(full, default=0)}, by_name)


def extractor(keep: list[str]):
    def run(batches):
        for batch in batches:
            texts = []
            columns = [batch.column(f"__lk_{c}") for c in ("labels", "parents", "flags", "owners", "texts", "keys")]
            columns += [batch.column(c) for c in ("path", "template", "dropped", "host_path", "usual")]
            for row in range(batch.num_rows):
                *tree, path, template, dropped, host_path, usual = (c[row].as_py() for c in columns)
                texts.append(extracted(*tree, path, template, dropped, (host_path, usual)))
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string()), counts], [*keep, "text", "n_chars"])

    return run


def _with(pages: DataFrame, side: DataFrame, keys: list[str], size, how: str = "inner") -> DataFrame:
    """pages joined with a side of one row a key: broadcast if the side's rows and bytes are within the bounds, else by shuffle on the keys and a salt of the page."""
    found = side.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if found[0] <= BROADCAST_ROWS and found[1] <= BROADCAST_BYTES:
        return pages.join(F.broadcast(side), keys, how)
    salted = side.withColumn("__lk_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("__lk_salt", F.pmod("__lk_mark", F.lit(SALTS)).cast("int")).join(salted, [*keys, "__lk_salt"], how).drop("__lk_salt")


def wrappers(parsed: DataFrame, tables: Tables) -> DataFrame:
    """(host, layout, pages, path, template, dropped) of every group with pages that differ, from all of its pages."""
    tree = [F.col(f"__lk_{c}").alias(f"pivot_{c}") for c in ("labels", "parents", "owners", "keys", "sizes")]
    filled = parsed.where(F.size("__lk_owners") > 0)
    least = tables.cut(filled.groupBy(*GROUP).agg(F.min("__lk_mark").alias("least")))
    first = _with(filled.select(*GROUP, "__lk_mark", *tree), least, GROUP, F.octet_length("__lk_host") + 16).where("__lk_mark = least")
    pivots = tables.cut(first.groupBy(*GROUP).agg(F.first("__lk_mark").alias("pivot_mark"), *(F.first(f"pivot_{c}").alias(f"pivot_{c}") for c in ("labels", "parents", "owners", "keys", "sizes"))))
    bytes_ = F.lit(20) * F.size("pivot_owners") + F.octet_length(F.concat_ws(" ", "pivot_labels")) + F.lit(8) * F.size("pivot_labels")
    met = _with(filled.select(*GROUP, "__lk_mark", *(f"__lk_{c}" for c in ("labels", "parents", "flags", "owners", "keys", "sizes"))), pivots, GROUP, bytes_).where("__lk_mark <> pivot_mark")
    counts = met.drop("__lk_mark", "pivot_mark").mapInArrow(align, "__lk_host string, __lk_layout long, kind byte, key long, path string, n long, more long")
    counts = tables.cut(counts.groupBy(*GROUP, "kind", "key", "path").agg(F.sum("n").alias("n"), F.max("more").alias("more")))
    size = counts.groupBy(*GROUP).agg(F.sum(F.when(F.col("kind") == PAGES, F.col("n"))).alias("pages"), F.sum(F.when((F.col("kind") == WEIGHT) & (F.col("path") == "#"), F.col("n"))).alias("total"))
    depth = F.size(F.split("path", "/"))
    weighed = counts.where((F.col("kind") == WEIGHT) & (F.col("path") != "#")).join(size, GROUP).where(F.col("n") >= F.lit(CONTENT_SHARE) * F.col("total"))
    chosen = weighed.groupBy(*GROUP).agg(F.max(F.struct(depth.alias("depth"), "path", F.col("n").alias("varying"))).alias("c"), F.first("pages").alias("pages"))
    chosen = chosen.select(*GROUP, "pages", F.col("c.path").alias("content"), F.col("c.varying").alias("varying"))
    inside = (F.col("path") == F.col("content")) | F.col("path").startswith(F.concat("content", F.lit("/")))
    decided = counts.where(F.col("kind").isin(TEMPLATE, NAMED)).join(chosen, GROUP).where(inside)
    is_template = (F.col("kind") == TEMPLATE) & (F.col("n") >= F.greatest(F.lit(2), F.lit(SAME) * F.col("pages")))
    is_dropped = (F.col("kind") == NAMED) & (F.col("n") + F.col("more") >= F.greatest(F.lit(2), F.lit(RECURS) * (F.col("pages") + 1)))
    # A group has a row for each text of its pivot at most, and one for each path of a named container that recurs.
    found = decided.where(is_template | is_dropped).groupBy(*GROUP).agg(
        F.collect_set(F.when(is_template, F.col("key"))).alias("template"), F.sum(F.when(is_template, F.col("n") * F.col("more"))).alias("constant"), F.collect_set(F.when(is_dropped, F.col("path"))).alias("dropped")
    )
    both = chosen.join(found, GROUP, "left")
    template = F.when(F.coalesce(F.col("constant"), F.lit(0)) <= F.col("varying"), F.col("template"))
    return tables.cut(both.select(*GROUP, "pages", F.col("content").alias("path"), template.alias("template"), "dropped"))


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (page_id and url) plus text string and n_chars long, a row for each row.

    A null or empty html has an empty text. Pages whose url is null or has no host are one host. Repeated rows are extracted each and count as pages
    each; ties (pages of one hash) are equal pages. Very long pages are aligned whole, row by row of the matching's table. No rows
    in, no rows out. Columns named text or n_chars are replaced, names that begin with __lk_ are reserved, other columns keep their values.
    """
    keep = [c for c in (keep or ["page_id", "url"]) if c.lower() not in {"text", "n_chars"}]
    kinds = dict(pages.dtypes)
    tables = Tables(pages.sparkSession, "wrappers")
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    given = pages.select(*[F.col(f"`{c}`") for c in keep], F.col("html").alias("__lk_html"), host.alias("__lk_host"), F.coalesce(F.xxhash64("html"), F.lit(0)).alias("__lk_mark"))
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    parsed = tables.cut(given.mapInArrow(parser(keep), schema + PARSED))
    # Kept columns may be named like columns of the wrappers.
    table = wrappers(parsed.select(*[c.split()[0] for c in PARSED.split(", ")]), tables)
    votes = table.groupBy("path").agg(F.sum("pages").alias("n")).orderBy(F.desc("n"), "path").limit(1).collect()
    main = tables.cut(table.groupBy("__lk_host").agg(F.max_by("path", F.struct("pages", "path")).alias("host_path")))
    inner = {c: f"__lk_keep{k}" for k, c in enumerate(keep)}
    joined = parsed.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], *[c.split()[0] for c in PARSED.split(", ")])
    joined = _with(joined, table.drop("pages"), GROUP, F.octet_length("path") + F.lit(8) * F.size(F.coalesce("template", F.array())) + F.octet_length(F.concat_ws(" ", "dropped")), "left")
    joined = _with(joined, main, ["__lk_host"], F.octet_length("host_path"), "left").withColumn("usual", F.lit(votes[0]["path"] if votes else None).cast("string"))
    wanted = [*inner.values(), *(f"__lk_{c}" for c in ("labels", "parents", "flags", "owners", "texts", "keys")), "path", "template", "dropped", "host_path", "usual"]
    out = joined.select(*wanted).mapInArrow(extractor(list(inner.values())), "".join(f"{n} {kinds[c]}, " for c, n in inner.items()) + "text string, n_chars long")
    return out.select(*[F.col(n).alias(c) for c, n in inner.items()], "text", "n_chars")


def query(spark, pages: DataFrame) -> DataFrame:
    return extract(pages)
