"""Table markup: pipe tables to HTML (native), HTML to pipe tables and tree-edit similarity (Arrow UDFs).

Very long texts: HTML is parsed and trees are compared without recursion; a tree's memory grows with its nodes, the
distance of two trees with the product of what they differ in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions.edits import distance, edit_distance
from ..functions.text import collapse, strip

#: Lines that are joined at once, so that a page's arrays do not grow line by line.
PAGE = 256


def separates(line: Column, bare: Column) -> Column:
    """Whether a pipe row has pipes, dashes, colons and white space alone, and something other than a pipe before its
    second one, be it white space before the first. One class of characters, possessive: no step goes back."""
    return bare.rlike(r"(?U)^\|[\s\x1c-\x1f:\-|]*+\z") & (~line.startswith("|") | ~bare.startswith("||"))


def md_tables_to_html(text: Column) -> Column:
    """Runs of two or more pipe rows become a table, one line a row; separator rows go; everything else is untouched.
    One left-to-right fold over the lines: `buf` holds the run's lines, `rows` its rendered data rows, `cur` the latest
    lines that are done, `out` pages of those before."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), strip(x).alias("bare")))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), empty.alias("cur"), empty.alias("buf"), empty.alias("rows"))

    def flushed(acc):
        table = F.concat(F.array(F.lit("<table>")), acc["rows"], F.array(F.lit("</table>")))
        return F.concat(acc["cur"], F.when(F.size(acc["rows"]) >= 2, table).otherwise(acc["buf"]))

    def paged(acc, done):
        full = F.struct(F.concat(acc["out"], F.array(F.array_join(done, "\n"))).alias("out"), empty.alias("cur"), empty.alias("buf"), empty.alias("rows"))
        return F.when(F.size(done) >= PAGE, full).otherwise(F.struct(acc["out"].alias("out"), done.alias("cur"), empty.alias("buf"), empty.alias("rows")))

    def step(acc, x):
        line, bare = x["line"], x["bare"]
        is_row = bare.startswith("|") & bare.endswith("|") & (F.length(bare) > 2)
        cells = F.array_join(F.transform(F.split(F.btrim(bare, F.lit("|")), r"\|", -1), lambda c: F.concat(F.lit("<td>"), strip(c), F.lit("</td>"))), "")
        row = F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))
        kept = F.when(separates(line, bare), acc["rows"]).otherwise(F.concat(acc["rows"], F.array(row)))
        inside = F.struct(acc["out"].alias("out"), acc["cur"].alias("cur"), F.concat(acc["buf"], F.array(line)).alias("buf"), kept.alias("rows"))
        return F.when(is_row, inside).otherwise(paged(acc, F.concat(flushed(acc), F.array(line))))

    def joined(acc):
        last = flushed(acc)
        return F.array_join(F.concat(acc["out"], F.when(F.size(last) > 0, F.array(F.array_join(last, "\n"))).otherwise(empty)), "\n")

    done = F.aggregate(lines, start, step, joined)
    return F.when(F.contains(text, F.lit("|")), done).otherwise(text)


#: Elements by their opening and closing tags; an opening tag's name may go on.
_TABLE, _ROW, _CELL = ((re.compile(rf"(?i)<{name}[^>]*>"), re.compile(rf"(?i)</{name}>")) for name in ("table", "tr", "t[dh]"))


def _elements(html: str, lo: int, hi: int, kind: tuple[re.Pattern, re.Pattern]) -> Iterator[tuple[int, int, int, int]]:
    """Start of the element, of its content, end of the content and of the element, for each element of a kind between lo
    and hi, left to right. An opening tag that is never closed ends the search: none after it is closed either."""
    opening, closing = kind
    while (a := opening.search(html, lo, hi)) and (b := closing.search(html, a.end(), hi)):
        yield a.start(), a.end(), b.start(), b.end()
        lo = b.end()


def _bare(cell: str) -> str:
    """The cell without tags; what follows the last > has none."""
    end = cell.rfind(">") + 1
    return (re.sub(r"<[^>]+>", "", cell[:end]) + cell[end:]).strip()


def _with_pipe_tables(html: str) -> str:
    """The page with its tables that have a cell as pipe tables, the first row as head, short rows filled up."""
    out, done = [], 0
    for start, lo, hi, end in _elements(html, 0, len(html), _TABLE):
        rows = [[_bare(html[c:d]) for _, c, d, _ in _elements(html, a, b, _CELL)] for _, a, b, _ in _elements(html, lo, hi, _ROW)]
        width = max(map(len, rows), default=0)
        if width:
            lines = ["| " + " | ".join(row + [""] * (width - len(row))) + " |" for row in rows if row]
            lines.insert(1, "|" + "---|" * width)
            out += [html[done:start], "\n".join(lines)]
            done = end
    return "".join([*out, html[done:]])


@F.pandas_udf(T_.StringType())
def html_tables_to_md(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else _with_pipe_tables(t))


def content_distance(a: Column, b: Column) -> Column:
    """0 for equal cells, 1 if one is empty, else edits over the longer length; white space collapsed."""
    a, b = collapse(a), collapse(b)
    return F.when(a == b, 0.0).when((a == "") | (b == ""), 1.0).otherwise(distance(a, b) / F.greatest(F.length(a), F.length(b)))


Label = tuple[str, int, int, str]  # tag, colspan, rowspan, white-space-collapsed text (of cells)


@dataclass
class Tree:
    """A table as arrays in postorder: the label of each node, and the number of its leftmost leaf."""

    labels: list[Label]
    left: np.ndarray


class _Reader(HTMLParser):
    """Collects elements in the order of their start tags: kind, spans, text, and the one that each is in."""

    KINDS = {"table": "table", "tr": "tr", "td": "td", "th": "td"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.kind, self.spans, self.text, self.inside, self.open = [], [], [], [], []

    def handle_starttag(self, tag, attrs):
        kind = self.KINDS.get(tag)
        if kind is None or (kind != "table" and not self.open):
            return
        given = dict(attrs)
        spans = [given.get("colspan"), given.get("rowspan")]
        self.inside.append(-1 if kind == "table" else self.open[-1])
        self.open.append(len(self.kind))
        self.kind.append(kind)
        self.spans.append([_whole(x) for x in spans])
        self.text.append([])

    def handle_endtag(self, tag):
        kind = self.KINDS.get(tag)
        depth = len(self.open) - 1
        while kind and depth >= 0 and self.kind[self.open[depth]] != kind:
            depth -= 1
        if kind and depth >= 0:
            self.open = self.open[:depth]

    def handle_data(self, data):
        if self.open and self.kind[self.open[-1]] == "td":
            self.text[self.open[-1]].append(data)


def _whole(x: str | None) -> int:
    try:
        return int(x)
    except (TypeError, ValueError):
        return 1


def parse_tables(html: str) -> list[Tree]:
    """The tables of a page, by their start tags, as trees table > tr > td. Head and body sections are flattened, th is
    td; what is not closed swallows what follows; a nested table stands in the list, not in its cell."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    children: list[list[int]] = [[] for _ in r.kind]
    for i, parent in enumerate(r.inside):
        if parent >= 0:
            children[parent].append(i)
    out = []
    for root in [i for i, parent in enumerate(r.inside) if parent < 0]:
        order, work = [], [root]
        while work:  # each node before its children, the last child first; reversed, that is postorder
            order.append(work.pop())
            work += children[order[-1]]
        order.reverse()
        number = {i: k for k, i in enumerate(order)}
        left = np.zeros(len(order), np.int64)
        for k, i in enumerate(order):
            left[k] = left[number[children[i][0]]] if children[i] else k
        out.append(Tree([(r.kind[i], *r.spans[i], " ".join("".join(r.text[i]).split())) for i in order], left))
    return out


def rename_cost(a: Label, b: Label) -> float:
    if a[:3] != b[:3]:
        return 1.0
    if a[0] != "td" or a[3] == b[3]:
        return 0.0
    return edit_distance(a[3], b[3]) / max(len(a[3]), len(b[3])) if a[3] and b[3] else 1.0


def _costs(a: list[Label], b: list[Label]) -> np.ndarray:
    """Rename costs of all pairs of nodes, from those of their distinct labels."""
    kinds_a, kinds_b = {x: i for i, x in enumerate(dict.fromkeys(a))}, {x: i for i, x in enumerate(dict.fromkeys(b))}
    table = np.array([[rename_cost(x, y) for y in kinds_b] for x in kinds_a])
    return table[np.ix_([kinds_a[x] for x in a], [kinds_b[y] for y in b])]


def _last_of_each(left: np.ndarray) -> np.ndarray:
    """The highest node of each leftmost leaf, ascending."""
    _, back = np.unique(left[::-1], return_index=True)
    return np.sort(len(left) - 1 - back)


def _children(t: Tree) -> list[tuple[int, int]]:
    """The nodes of each child of the root, from and to, left to right."""
    out, end = [], len(t.labels) - 1
    while end > 0:
        out.append((int(t.left[end - 1]), end))
        end = out[-1][0]
    return out[::-1]


def _same(a: Tree, x: tuple[int, int], b: Tree, y: tuple[int, int]) -> bool:
    return a.labels[slice(*x)] == b.labels[slice(*y)] and np.array_equal(a.left[slice(*x)] - x[0], b.left[slice(*y)] - y[0])


def _differing(a: Tree, b: Tree) -> tuple[Tree, Tree]:
    """The trees without the first and the last children that both roots have alike, and without equal roots of one child
    each; their distance stays. For a node that leaves what is alike, or comes from there, a node of its like on the same
    side is deleted or inserted, at the same cost, whatever renaming costs."""
    while True:
        x, y = _children(a), _children(b)
        most = min(len(x), len(y))
        head = next((k for k in range(most) if not _same(a, x[k], b, y[k])), most)
        tail = next((k for k in range(most - head) if not _same(a, x[-1 - k], b, y[-1 - k])), most - head)
        left = []
        for t, own in ((a, x), (b, y)):
            own = own[head : len(own) - tail]
            lo, hi = (own[0][0], own[-1][1]) if own else (0, 0)
            left.append((Tree([*t.labels[lo:hi], t.labels[-1]], np.append(t.left[lo:hi] - lo, 0)), len(own)))
        (a, n), (b, m) = left
        if not (n == m == 1 and a.labels[-1] == b.labels[-1]):
            return a, b
        a, b = Tree(a.labels[:-1], a.left[:-1]), Tree(b.labels[:-1], b.left[:-1])


def tree_distance(a: Tree, b: Tree) -> float:
    """Ordered tree edit distance, insert and delete 1, by pairs of subtrees that have a left sibling (or are whole); the
    forests of a pair are compared a row at a time: what comes from above and from the diagonal first, then insertions
    as a running minimum. Equal rows at both ends of a table take no part."""
    a, b = _differing(a, b)
    cost = _costs(a.labels, b.labels)
    trees = np.zeros(cost.shape)
    for i in _last_of_each(a.left):
        first = a.left[i]
        for j in _last_of_each(b.left):
            begin = b.left[j]
            cols = np.arange(begin, j + 1)
            whole = b.left[cols] == begin  # columns whose forest is one tree
            back = b.left[cols] - begin
            at = np.arange(len(cols) + 1.0)
            rows = np.empty((i - first + 2, len(cols) + 1))
            rows[0] = at
            for x, p in enumerate(range(first, i + 1), 1):
                diagonal = rows[a.left[p] - first][back] + trees[p, cols]
                if a.left[p] == first:
                    diagonal[whole] = (rows[x - 1][:-1] + cost[p, cols])[whole]
                step = np.concatenate(([float(x)], np.minimum(rows[x - 1][1:] + 1, diagonal)))
                rows[x] = at + np.minimum.accumulate(step - at)
                if a.left[p] == first:
                    trees[p, cols[whole]] = rows[x][1:][whole]
    return float(trees[-1, -1])


def similarity(pred: str, truth: str) -> float | None:
    """Mean similarity of the k-th tables; unpaired ones score 0; null where neither side has a table."""
    a, b = parse_tables(pred), parse_tables(truth)
    if not a and not b:
        return None
    scores = [max(0.0, 1 - tree_distance(x, y) / max(len(x.labels), len(y.labels))) for x, y in zip(a, b, strict=False)]
    return sum(scores) / max(len(a), len(b))


@F.pandas_udf(T_.DoubleType())
def table_similarity(pred: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([similarity(p, t) for p, t in zip(pred, truth, strict=True)], dtype="float64")
