"""Rows of tables from where letters and ruling lines sit on a page.

A page is one row, an array of its letters and one of its lines; the pages of a batch are read together, some at a time,
since their letters are put in order by the same few steps over columns.  Tables with drawn borders come first: lines that
touch make a grid, and cells without a line between them are one.  Of the letters left over, lines with wide gaps are
rows, cut into columns where the gaps of most of them are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the line above the rows that are put behind a page's text.
BLOCK_TITLE = "[Filas de tabla reconstruidas por posición]"
#: Fixed values, in points: lines this near are one, pieces this near are joined, how far turned labels may run over a table.
TOUCH, JOIN_GAP, TURNED_OVERFLOW = 2.0, 3.0, 120.0
#: Lines of a drawing, least lines of a grid, letters of a cell that is repeated in every row it spans.
MOST_RULES, LEAST_RULES, MOST_REPEATED = 6_000, 6, 120
#: Written cells, their share and their letters, from which a grid holds data.
LEAST_FILLED, FILLED_SHARE, LEAST_LETTERS = 4, 0.25, 8
#: Fixed values, in sizes of a letter: gap between cells, letters of one line, lines of one row, lines of one table.
GAP, SAME_LINE, BAND, TABLE_GAP = 1.5, 0.5, 1.3, 3.0
#: Letters of a cell, of a mean cell, rows of a table, lines of a row.
MOST_CELL, MOST_MEAN, LEAST_ROWS, MOST_LINES = 70, 32.0, 2, 5
#: Columns of prose have lines of so many letters, this share going on from the line above; from so many lines on.
PROSE_LINE, PROSE_SHARE, PROSE_LINES = 22, 0.5, 4

#: Letters of the pages that are read together, more or less, as a page is never cut.
TOGETHER = 1 << 17
#: Ways that letters run; all others are one.
WAYS = ACROSS, UP, DOWN, OTHER = range(4)

#: The columns of marks: a letter has x, end, y (its baseline, growing downward), size, text and direction (across, up, down or
#: other), a line at, from and to and whether it is level; the other columns are null.
MARKS = "doc long, page int, letter boolean, x double, end double, y double, size double, text string, direction string, level boolean, at double, from double, to double"
#: The same of whole pages, and their rows as they are read.
LETTER, LINE = "struct<x:double,end:double,y:double,size:double,text:string,direction:string>", "struct<level:boolean,at:double,from:double,to:double>"
PAGES = f"doc long, page int, letters array<{LETTER}>, lines array<{LINE}>"
READ = "doc long, page int, rows array<struct<ruled:boolean,row:string>>"


@dataclass
class Letters:
    """The letters of one page or of several as columns; ``text`` may be bytes where each is one ASCII letter."""

    x: np.ndarray
    end: np.ndarray
    y: np.ndarray
    size: np.ndarray
    text: np.ndarray
    direction: np.ndarray

    def __post_init__(self) -> None:
        if self.direction.dtype == object:
            self.direction = np.select([self.direction == w for w in ("across", "up", "down")], [ACROSS, UP, DOWN], OTHER).astype(np.int8)

    def pick(self, rows: np.ndarray) -> Letters:
        return Letters(*(v[rows] for v in (self.x, self.end, self.y, self.size, self.text, self.direction)))

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each letter lies: turned ones rise to the left or right of their baseline and run along y."""
        up, down = self.direction == UP, self.direction == DOWN
        half = (self.end - self.x) / 2
        cx = np.where(up, self.x - 0.3 * self.size, np.where(down, self.x + 0.3 * self.size, self.x + half))
        cy = np.where(up, self.y - half, np.where(down, self.y + half, self.y - 0.3 * self.size))
        return cx, cy


@dataclass
class Piece:
    """Letters of one line without a wide gap."""

    x: float
    end: float
    text: str


@dataclass
class Line:
    y: float
    size: float
    pieces: list[Piece]

    def anchors(self) -> bool:
        """Whether the line shows columns: two pieces or more, none too long for a cell."""
        return len(self.pieces) >= 2 and all([len(p.text) <= MOST_CELL for p in self.pieces])


@dataclass
class Grid:
    """A ruled table: its bounds (left, top, right, bottom), rows, and whether it holds data or only decorates."""

    bounds: tuple[float, float, float, float]
    rows: list[str]
    data: bool


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def _runs(group: np.ndarray, values: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Whether a run begins at each of some values sorted by group: one belongs to the run of its group whose first is no
    farther than ``near`` from it."""
    begins = np.ones(len(values), bool)
    if not len(values):
        return begins
    begins[1:] = group[1:] != group[:-1]
    # Where neither changes, a value is as near to the first of its run as the one before it.
    asked = np.flatnonzero(~begins[1:] & ((values[1:] != values[:-1]) | (near[1:] < near[:-1]))) + 1
    of = np.maximum.accumulate(np.where(begins, np.arange(len(values)), 0))[asked]
    cut, first, cuts = -1, 0.0, []
    for i, head, start, value, reach in zip(asked.tolist(), of.tolist(), values[of].tolist(), values[asked].tolist(), near[asked].tolist(), strict=True):
        if abs(value - (first if cut > head else start)) > reach:
            cut, first = i, value
            cuts.append(i)
    begins[cuts] = True
    return begins


def _reach(run: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The farthest end up to each of some pieces in runs (numbered upward)."""
    if not (~(stop[1:] >= stop[:-1]) & (run[1:] == run[:-1])).any():
        return stop
    ends, rank = np.unique(stop, return_inverse=True)
    return ends[np.maximum.accumulate(run * len(ends) + rank) % len(ends)]


def _in_runs(group: np.ndarray, place: np.ndarray, start: np.ndarray, stop: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Things of many groups in runs of nearly one place and by their start in each: their order, where runs begin, the number
    of each one's run and how far those up to it reach.  Equal ones stay in order of place, then as they came."""
    order = np.lexsort((start, place, group))
    begins = _runs(group[order], place[order], near[order])
    run = np.cumsum(begins) - 1
    order = order[np.lexsort((start[order], run))]
    return order, begins, run, _reach(run, stop[order])


def _said(text: np.ndarray) -> tuple[str, np.ndarray]:
    """Texts as one, and where each begins in it, with the end."""
    if text.dtype == np.uint8:
        return text.tobytes().decode("ascii"), np.arange(len(text) + 1)
    parts = text.tolist()
    return "".join(parts), np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), int, len(parts)))]).astype(int)


def _middle(place: np.ndarray, begins: np.ndarray) -> list[float]:
    """The mean place of each run, by numpy's own sum where parts of a point could make it depend on the order."""
    starts = np.flatnonzero(begins)
    stops = [*starts[1:].tolist(), len(place)]
    first = place[starts]
    same = (np.maximum.reduceat(place, starts) == first) & (np.minimum.reduceat(place, starts) == first) & (first == np.rint(first)) & (np.abs(first) < 1 << 30)
    return [v if s else float(place[a:b].mean()) for s, v, a, b in zip(same.tolist(), first.tolist(), starts.tolist(), stops, strict=True)]


def _pieces(group: np.ndarray, letters: Letters) -> tuple[np.ndarray, np.ndarray, Letters, np.ndarray, list[str]]:
    """The pieces of lines written across, by group and from top to bottom and left to right: the letters in that order, their
    groups, where lines and where pieces begin, and the text of each piece."""
    level = np.flatnonzero((letters.direction == ACROSS) & (letters.size > 0) & np.isfinite(letters.y) & np.isfinite(letters.x))
    group, letters = group[level], letters.pick(level)
    order, begins, run, reach = _in_runs(group, letters.y, letters.x, letters.end, letters.size * SAME_LINE)
    letters = letters.pick(order)
    cut = begins.copy()
    cut[1:] |= letters.x[1:] - reach[:-1] > letters.size[1:] * GAP
    said, place = _said(letters.text)
    edges = place[[*np.flatnonzero(cut).tolist(), len(order)]].tolist()
    texts = [said[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    if said.split() != [said]:  # with blanks in it
        texts = [_squeezed(t) for t in texts]
    return group[order], begins, letters, cut, texts


def _lines(group: np.ndarray, letters: Letters) -> dict[int, list[Line]]:
    """For each group of letters its lines written across, from top to bottom, each in pieces from left to right."""
    group, begins, letters, cut, texts = _pieces(group, letters)
    if not texts:
        return {}
    at, starts = np.flatnonzero(cut), np.flatnonzero(begins)
    run = np.cumsum(begins)[at] - 1
    of, size, middle = group[starts].tolist(), letters.size[starts].tolist(), _middle(letters.y, begins)
    out: dict[int, list[Line]] = {}
    last, pieces = -1, []
    for n, x, end, text in zip(run.tolist(), letters.x[at].tolist(), np.maximum.reduceat(letters.end, at).tolist(), texts, strict=True):
        if text:
            if n != last:
                last, pieces = n, []
                out.setdefault(of[n], []).append(Line(middle[n], size[n], pieces))
            pieces.append(Piece(x, end, text))
    return out


def lines_of(letters: Letters) -> list[Line]:
    """The lines of one page written across, from top to bottom, each in pieces from left to right."""
    return _lines(np.zeros(len(letters.x), int), letters).get(0, [])


def _turned(letters: Letters, direction: int) -> str:
    """Text turned a quarter: upward lines follow one another to the right, downward ones to the left."""
    some = letters.pick((letters.direction == direction) & (letters.size > 0) & np.isfinite(letters.x) & np.isfinite(letters.y))
    some = some.pick(np.argsort(some.x, kind="stable"))
    sign = -1 if direction == UP else 1
    runs = np.split(np.arange(len(some.x)), np.flatnonzero(_runs(np.zeros(len(some.x)), some.x, some.size * SAME_LINE))[1:])[::-sign]
    return _squeezed(" ".join(_said(some.text[run[np.argsort(sign * some.y[run], kind="stable")]])[0] for run in runs))


def cell_texts(cell: np.ndarray, letters: Letters) -> dict[int, str]:
    """For each cell (one number a letter) its text on one line, turned text first."""
    group, _, _, cut, pieces = _pieces(cell, letters)
    texts: dict[int, str] = {}
    for c, text in zip(group[cut].tolist(), pieces, strict=True):
        texts[c] = f"{texts[c]} {text}" if text and texts.get(c) else text or texts.get(c, "")
    for c in np.unique(cell[(letters.direction == UP) | (letters.direction == DOWN)]).tolist():
        own = letters.pick(np.flatnonzero(cell == c))
        texts[c] = _squeezed(" ".join([_turned(own, UP), _turned(own, DOWN), texts.get(c, "")]))
    return texts


def cell_text(letters: Letters) -> str:
    """The text of one cell."""
    return cell_texts(np.zeros(len(letters.x), int), letters).get(0, "")


def _components(n: int, links: list[tuple[int, int]]) -> list[int]:
    """For each of ``n`` things the smallest that links lead to, by union and find."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(n)]


def _tidied(page: np.ndarray, level: np.ndarray, at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """page, level, at, from and to of the lines of pages, those at nearly one place moved together and their pieces joined."""
    sound = np.flatnonzero(np.isfinite(at) & np.isfinite(start) & np.isfinite(stop))
    page, level, at, start, stop = (v[sound] for v in (page, level, at, start, stop))
    side = 2 * page + ~level  # of each page the level ones first
    order, begins, run, reach = _in_runs(side, at, start, stop, np.full(len(at), TOUCH))
    start, stop = start[order], stop[order]
    cut = begins.copy()
    cut[1:] |= start[1:] > reach[:-1] + JOIN_GAP
    first = np.flatnonzero(cut)
    # The place of a run is that of its first by place, which need not be its first by start.
    place = np.minimum.reduceat(at[order], np.flatnonzero(begins)) if len(order) else at
    ends = np.maximum.reduceat(stop, first) if len(order) else stop
    return page[order][first], level[order][first], place[run[first]], start[first], ends


def tidied(level: np.ndarray, at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[tuple[bool, float, float, float]]:
    """(level, at, from, to) of the lines of one page, as :func:`_tidied` has them."""
    return list(zip(*(v.tolist() for v in _tidied(np.zeros(len(at), int), level, at, start, stop)[1:]), strict=True))


def _distinct(values: list[float]) -> np.ndarray:
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > TOUCH:
            out.append(v)
    return np.array(out)


@dataclass
class Frame:
    """Where a grid's lines stand, the cell of each of its places and, of the letters inside, the place and the cell."""

    xs: np.ndarray
    ys: np.ndarray
    cell: np.ndarray
    inside: np.ndarray
    owner: np.ndarray


def _frame(level: np.ndarray, at: np.ndarray, start: np.ndarray, stop: np.ndarray, cx: np.ndarray, cy: np.ndarray, turned: np.ndarray) -> Frame | None:
    """The grid that lines which touch one another draw around letters; None with under two rows or columns."""
    xs, ys = _distinct(at[~level].tolist()), _distinct(at[level].tolist())
    if len(xs) < 3 or len(ys) < 3:
        return None
    cols, rows = len(xs) - 1, len(ys) - 1

    def drawn(side: np.ndarray, at_: np.ndarray, over: np.ndarray) -> np.ndarray:
        """Whether a line stands at each of some places (rows) over each of some points along it (columns)."""
        near = np.abs(at[side][None, :] - at_[:, None]) <= TOUCH
        covers = (over[:, None] >= start[side] - TOUCH) & (over[:, None] <= stop[side] + TOUCH)
        return np.einsum("al,ol->ao", near, covers).astype(bool)

    upright = drawn(~level, xs[1:-1], (ys[1:] + ys[:-1]) / 2)
    flat = drawn(level, ys[1:-1], (xs[1:] + xs[:-1]) / 2)
    links = [(i * cols + j, i * cols + j + 1) for j, i in zip(*np.nonzero(~upright), strict=True)]
    links += [(i * cols + j, (i + 1) * cols + j) for i, j in zip(*np.nonzero(~flat), strict=True)]
    cell = np.array(_components(rows * cols, links) if links else range(rows * cols)).reshape(rows, cols)

    turned = turned & (cy >= ys[0] - TURNED_OVERFLOW) & (cy <= ys[-1] + TURNED_OVERFLOW)
    cy = np.where(turned, np.clip(cy, ys[0], ys[-1]), cy)
    inside = np.flatnonzero((cx >= xs[0] - 1) & (cx <= xs[-1] + 1) & (cy >= ys[0] - 1) & (cy <= ys[-1] + 1))
    j = np.clip(np.searchsorted(xs, cx[inside], "right") - 1, 0, cols - 1)
    i = np.clip(np.searchsorted(ys, cy[inside], "right") - 1, 0, rows - 1)
    return Frame(xs, ys, cell, inside, cell[i, j])


def _frames(level: np.ndarray, at: np.ndarray, start: np.ndarray, stop: np.ndarray, cx: np.ndarray, cy: np.ndarray, turned: np.ndarray) -> list[Frame]:
    """The grids of a page."""
    if len(at) < LEAST_RULES:
        return []
    h, v = np.flatnonzero(level), np.flatnonzero(~level)
    meet = (at[v] >= start[h, None] - TOUCH) & (at[v] <= stop[h, None] + TOUCH) & (at[h, None] >= start[v] - TOUCH) & (at[h, None] <= stop[v] + TOUCH)
    if len(h) and meet.all(axis=0).any() and meet.any(axis=0).all():  # one upright line meets all level ones: one grid
        found = [_frame(level, at, start, stop, cx, cy, turned)]
    else:
        group = np.array(_components(len(at), [(int(h[a]), int(v[b])) for a, b in zip(*np.nonzero(meet), strict=True)]))
        found = [_frame(*(c[group == one] for c in (level, at, start, stop)), cx, cy, turned) for one in dict.fromkeys(group.tolist())]
    return [f for f in found if f]


def _grid(frame: Frame, texts: list[str]) -> Grid | None:
    """The table of a frame with the text of each cell; None with under two rows or columns written."""
    cols = frame.cell.shape[1]
    out, widest = [], 0
    for r, own in enumerate(frame.cell.tolist()):
        # A cell's number is that of its first place.
        said = [texts[c] if c // cols == r or len(texts[c]) <= MOST_REPEATED else "" for c in dict.fromkeys(own)]
        while said and not said[-1]:
            said.pop()
        if said:
            widest = max(widest, len(said))
            out.append(" | ".join(said))
    if len(out) < 2 or widest < 2:
        return None
    filled = [t for t in texts if t]
    data = len(filled) >= LEAST_FILLED and len(filled) >= FILLED_SHARE * len(np.unique(frame.cell)) and len(list(islice((c for t in filled for c in t if c.isalpha()), LEAST_LETTERS))) >= LEAST_LETTERS
    return Grid((float(frame.xs[0]), float(frame.ys[0]), float(frame.xs[-1]), float(frame.ys[-1])), out, data)


def _grids(cuts: np.ndarray, letters: Letters, place: tuple[np.ndarray, np.ndarray], lines: tuple[np.ndarray, ...]) -> list[list[Grid]]:
    """For each of some pages, whose letters lie between ``cuts``, its tables with drawn borders from top to bottom."""
    page, *drawn = lines
    edges = np.searchsorted(page, np.arange(len(cuts))).tolist()
    turned = (letters.direction == UP) | (letters.direction == DOWN)
    frames: list[list[Frame]] = []
    for n, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        frames.append(_frames(*(c[edges[n] : edges[n + 1]] for c in drawn), *(c[a:b] for c in (*place, turned))))
    # The cells of all frames are numbered through, so that all their texts are read at once.
    bases = np.cumsum([0, *(f.cell.size for own in frames for f in own)]).tolist()
    each = list(zip(bases, [(a, f) for a, own in zip(cuts[:-1].tolist(), frames, strict=True) for f in own], strict=False))
    inside = np.concatenate([np.empty(0, int), *(a + f.inside for _, (a, f) in each)])
    texts = cell_texts(np.concatenate([np.empty(0, int), *(base + f.owner for base, (_, f) in each)]), letters.pick(inside))
    told = iter([_grid(f, [texts.get(base + c, "") for c in range(f.cell.size)]) for base, (_, f) in each])
    return [sorted((g for g in [next(told) for _ in own] if g), key=lambda g: (g.bounds[1], g.bounds[0])) for own in frames]


def grids(lines: list[tuple[bool, float, float, float]], letters: Letters) -> list[Grid]:
    """The tables of a page that have their borders drawn, from top to bottom, those of mere design too."""
    return _grids(np.array([0, len(letters.x)]), letters, letters.centre(), _columns(lines))[0]


def _columns(lines: list[tuple[bool, float, float, float]]) -> tuple[np.ndarray, ...]:
    """The lines of one page as :func:`_tidied` gives them."""
    level, *places = (np.array([r[n] for r in lines], bool if n == 0 else float) for n in range(4))
    return np.zeros(len(lines), int), level, *places


def _splits(anchors: list[Line]) -> list[float]:
    """Where columns part: the median middle of each gap among the lines of the commonest number of pieces, the larger of equals."""
    counts = Counter(len(a.pieces) for a in anchors)
    columns = max(counts, key=lambda n: (counts[n], n))
    same = [a.pieces for a in anchors if len(a.pieces) == columns]
    return [sorted((p[g].end + p[g + 1].x) / 2 for p in same)[len(same) // 2] for g in range(columns - 1)]


def _column(p: Piece, splits: list[float]) -> int:
    return sum([(p.x + p.end) / 2 >= s for s in splits])


def _goes_on(above: str, below: str) -> bool:
    """Whether a line goes on with the sentence of the line above."""
    return above.endswith("-") or (not above.endswith((".", ":", ";", "?", "!")) and below[:1].islower())


def _in_columns(run: list[Line], splits: list[float]) -> list[list[tuple[int, str]]]:
    """(column, text) of the pieces of each line."""
    return [[(_column(p, splits), p.text) for p in line.pieces] for line in run]


def _prose(placed: list[list[tuple[int, str]]], count: int) -> bool:
    """Whether two columns or more, and all that have lines enough, are running text."""
    columns: list[list[str]] = [[] for _ in range(count)]
    for line in placed:
        for c, text in line:
            columns[c].append(text)
    judged = [c for c in columns if len(c) >= PROSE_LINES]
    going = lambda c: sum(map(_goes_on, c, c[1:])) >= PROSE_SHARE * (len(c) - 1)
    return len(judged) >= 2 and all(sorted(map(len, c))[len(c) // 2] >= PROSE_LINE and going(c) for c in judged)


def _band_rows(run: list[Line], placed: list[list[tuple[int, str]]], whole: bool) -> list[str]:
    """The rows of a table: lines near one another are one, in columns; none if one has too many lines for a row."""
    bands: list[list[list[tuple[int, str]]]] = []
    above = 0.0
    for line, own in zip(run, placed, strict=True):
        if bands and (whole or line.y - above <= line.size * BAND):
            bands[-1].append(own)
        else:
            bands.append([own])
        above = line.y
    if not whole and any(len(b) > MOST_LINES for b in bands):
        return []
    out = []
    for band in bands:
        columns: dict[int, list[str]] = {}
        for own in band:
            for c, text in own:
                columns.setdefault(c, []).append(text)
        cells = [" ".join(columns[c]) for c in sorted(columns)]
        listed = cells and all(len(w) <= 3 and w.endswith((")", ".")) for w in cells[0].split())
        if len(cells) >= 2 and not listed:
            out.append(" | ".join(cells))
    return out


def laid_out_rows(letters: Letters) -> list[str]:
    """Rows of the tables without borders of one page."""
    return _laid_out(lines_of(letters))


def _laid_out(lines: list[Line]) -> list[str]:
    """Rows of the tables without borders: from a line with columns on, through lines like it and single cells below."""
    out, i = [], 0
    while i < len(lines):
        if not lines[i].anchors():
            i += 1
            continue
        run, anchors = [lines[i]], [lines[i]]
        for line in lines[i + 1 :]:
            if line.y - run[-1].y > line.size * TABLE_GAP:
                break
            if line.anchors():
                anchors.append(line)
            else:
                p = line.pieces[0]
                if len(line.pieces) > 1 or len(p.text) > MOST_CELL or any(p.x < s < p.end for s in _splits(anchors)):
                    break
            run.append(line)
        i += len(run)
        if len(anchors) < LEAST_ROWS:
            continue
        splits = _splits(anchors)
        sizes = [len(p.text) for a in anchors for p in a.pieces]
        placed = _in_columns(run, splits)
        prose = _prose(placed, len(splits) + 1)
        if prose or sum(sizes) / len(sizes) <= MOST_MEAN:
            out += _band_rows(run, placed, prose)
    return out


def _rows(cuts: np.ndarray, letters: Letters, lines: tuple[np.ndarray, ...]) -> list[list[tuple[bool, str]]]:
    """(ruled, row) of each of some pages, whose letters lie between ``cuts``: rows of tables with drawn borders, then those
    that the letters left over lie in."""
    cx, cy = letters.centre()
    tables = [[g for g in own if g.data] for own in _grids(cuts, letters, (cx, cy), lines)]
    free = np.ones(len(cx), bool)
    for n, own in enumerate(tables):
        page = slice(int(cuts[n]), int(cuts[n + 1]))
        for left, top, right, bottom in (g.bounds for g in own):
            free[page] &= ~((cx[page] >= left - TOUCH) & (cx[page] <= right + TOUCH) & (cy[page] >= top - TOUCH) & (cy[page] <= bottom + TOUCH))
    rest = np.flatnonzero(free)
    left_over = _lines(np.searchsorted(cuts, rest, "right") - 1, letters.pick(rest))
    return [[(True, r) for g in own for r in g.rows] + [(False, r) for r in _laid_out(left_over.get(n, []))] for n, own in enumerate(tables)]


def rows_of(letters: Letters, lines: list[tuple[bool, float, float, float]]) -> list[tuple[bool, str]]:
    """(ruled, row) of one page."""
    return _rows(np.array([0, len(letters.x)]), letters, _columns(lines))[0]


def _texts(text: pa.Array) -> np.ndarray:
    """Texts as bytes where each is one ASCII letter, else as strings; null is empty."""
    if len(text) and pa.types.is_string(text.type) and not text.null_count and pc.all(pc.equal(pc.binary_length(text), 1)).as_py() and pc.all(pc.string_is_ascii(text)).as_py():
        start = np.frombuffer(text.buffers()[1], np.int32)[text.offset]
        return np.frombuffer(text.buffers()[2], np.uint8)[start : start + len(text)]
    return np.array(pc.fill_null(text, "").to_pylist(), object)


def _fields(column: pa.Array) -> dict[str, pa.Array]:
    """The columns of an array of structs; those of a null are null."""
    return dict(zip((f.name for f in column.type), column.flatten(), strict=True))


def _number(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _read(pages: pa.RecordBatch) -> list[list[tuple[bool, str]]]:
    """:func:`_rows` of pages as Arrow has them; the lines of a drawing count for nothing."""
    count = lambda name: np.array(pc.fill_null(pages[name].value_lengths(), 0))
    said, many = _fields(pages["letters"].flatten()), count("lines")
    way = pc.fill_null(pc.index_in(said["direction"], pa.array(["across", "up", "down"])), OTHER)
    letters = Letters(*(_number(said[n]) for n in ("x", "end", "y", "size")), _texts(said["text"]), np.array(way).astype(np.int8))
    lines, page = _fields(pages["lines"].flatten()), np.repeat(np.arange(len(many)), many)
    kept = np.flatnonzero(many[page] <= MOST_RULES)
    level = np.array(pc.fill_null(lines["level"], False)).astype(bool)
    drawn = _tidied(page[kept], level[kept], *(_number(lines[n])[kept] for n in ("at", "from", "to")))
    return _rows(np.concatenate([[0], np.cumsum(count("letters"))]).astype(int), letters, drawn)


def read_pages(pages: DataFrame) -> DataFrame:
    """doc, page and rows (ruled, row) of the tables on ``pages`` (the columns of ``PAGES``); pages without any are left out.

    A page is one task's work and its marks must fit there; a page of more lines than a table has is a drawing and keeps
    only rows by layout.  Letters without a place or size, and lines without a place, count for nothing.
    """
    kind = pa.schema([("doc", pa.int64()), ("page", pa.int32()), ("rows", pa.list_(pa.struct([("ruled", pa.bool_()), ("row", pa.string())])))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.cumsum(np.array(pc.fill_null(batch["letters"].value_lengths(), 0), int)) // TOGETHER
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                some = batch.slice(a, b - a)
                rows = _read(some)
                ruled, row = pa.array([r[0] for own in rows for r in own], pa.bool_()), pa.array([r[1] for own in rows for r in own], pa.string())
                ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([ruled, row], ["ruled", "row"]))
                told = pa.RecordBatch.from_arrays([some["doc"], some["page"], lists], schema=kind)
                yield told.filter(pa.array([bool(own) for own in rows]))

    return pages.select("doc", "page", "letters", "lines").mapInArrow(read, READ)


def page_rows(marks: DataFrame) -> DataFrame:
    """doc, page, n (from 0), ruled and row of the tables on the pages of ``marks`` (the columns of ``MARKS``), as
    :func:`read_pages` reads them."""
    keyed = marks.filter("doc is not null and page is not null and letter is not null")
    told = lambda kind: F.struct(*[F.col(f.split(":")[0]) for f in kind[len("struct<") : -1].split(",")])
    # What isn't there is null, and lists are of what is.
    lists = F.collect_list(F.when(F.col("letter"), told(LETTER))).alias("letters"), F.collect_list(F.when(~F.col("letter"), told(LINE))).alias("lines")
    # Dealt by a hash of their own: letters and lines that each are dealt by page already, as sides of a union are, would
    # not be dealt again, though Spark may have joined the parts of either side in its own way.
    dealt = keyed.repartition(F.xxhash64("doc", "page"))
    return read_pages(dealt.groupBy("doc", "page").agg(*lists)).select("doc", "page", F.posexplode("rows").alias("n", "r")).select("doc", "page", "n", "r.ruled", "r.row")


def with_rows(text: Column, rows: Column) -> Column:
    """A page's text with its rows (an array) as a block of their own behind it, if it has any."""
    return F.when(F.size(rows) > 0, F.concat(text, F.lit(f"\n\n{BLOCK_TITLE}\n"), F.array_join(rows, "\n"))).otherwise(text)
