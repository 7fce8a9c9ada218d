"""Interpolated Kneser-Ney character n-gram models, one for each class of text.

A character is folded to a symbol of 10 bits and an n-gram of six symbols to a
60-bit code that doubles as its hash: the history of a code is `code >> 10` and
its shorter forms are its low bits, so a model is a few sorted arrays of codes
with a row of log-probabilities (one for each class) beside them. Histories stay
inside a word (letters only, lower-cased; a boundary symbol before and after), so
counting and scoring handle each distinct word of a batch once.

Counting is distributed: every labelled text counts. Partitions emit their own
sums, which Spark adds up. Every class and every counted n-gram is stored, however
rare, so continuation counts, discounts and backoff weights come from the whole
counts, and the model grows with the distinct n-grams of the labelled texts.

So is building: n-grams are dealt to cells by the two symbols before the last,
which all their forms of three symbols or more share, and their histories too. One
pass over the cells sums what discounts and the two lowest orders need, a second
makes each cell's arrays, and these are broadcast in blocks of bounded size
(`blocks`), so neither the driver nor a task holds the model whole.

Defined cases: a null text has no words; a null class teaches nothing; equal rows
count as often as they occur; with no labelled text there is no model; a text of any
length is handled in slices of whole documents.

`shared=True` smooths every class with the pooled counts of all classes instead
of its own shorter histories: an expression that is rare in a class then has the
same backed-off probability in all of them and doesn't tell them apart.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchkit.llm import kernels
from searchkit.llm.blocks import Blocks, Prepare, gathered
from searchkit.llm.common import checkpoint

ORDER, BITS = 6, 10
EDGE = 32  # the boundary symbol; no letter folds to it
#: Text that is handled at once.
SLICE = 3 << 20
#: Slices that are looked up at once in a model that a worker doesn't hold whole.
TOGETHER = 4
#: Distinct (class, n-gram) sums that a task holds before it emits them.
TASK_SUMS = 2_000_000
#: Orders from this one on are made in cells; cells at least, and n-grams that one is meant to have.
CELL_ORDER, LEAST_CELLS, CELL_GRAMS = 3, 64, 50_000

LETTERS = kernels.alnum_words()
LETTERS[0x30:0x3A] = False


def _mask(k: int) -> int:
    return (1 << (BITS * k)) - 1


@dataclass
class Distinct:
    """The distinct words of some documents, as n-gram codes, and where each word occurs."""

    codes: np.ndarray  # of every character event of every distinct word
    heads: np.ndarray  # the first event of each distinct word
    word: np.ndarray  # the distinct word of each word occurrence
    first: np.ndarray  # the first word occurrence of each document

    @property
    def events(self) -> np.ndarray:
        """Character events of each distinct word."""
        return np.diff(np.append(self.heads, len(self.codes)))


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> Distinct | None:
    low = kernels.LOWER[data]
    w = kernels.Words(low, offsets, LETTERS)
    if not len(w):
        return None
    _, at, word = np.unique(w.hashes, return_index=True, return_inverse=True)
    s, size = w.starts[at], w.ends[at] - w.starts[at]
    out = np.full(int(size.sum()) + len(at) + 1, 32, np.uint8)
    put = np.arange(int(size.sum())) + np.repeat(np.arange(1, len(at) + 1), size)
    out[put] = low[np.arange(int(size.sum())) + np.repeat(s - (np.cumsum(size) - size), size)]
    points = np.frombuffer(out.tobytes().decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    edges = np.flatnonzero(points == 32)
    symbols = np.where(points < 1024, points, 64 + (points * 0x9E3779B1 >> 12) % 960)
    symbols[edges] = EDGE
    symbols[(symbols == EDGE) & (points != 32)] = EDGE + 1
    # Events are all symbols but the first edge; a word's closing edge is one of its events.
    begin = np.repeat(edges[:-1], np.diff(edges))
    at_event = np.arange(1, len(symbols))
    back = at_event - begin
    codes = np.zeros(len(at_event), np.int64)
    for j in range(ORDER):
        real = symbols[np.maximum(at_event - j, 0)]
        codes |= np.where(back >= j, real, EDGE) << (BITS * j)
    return Distinct(codes, edges[:-1], word, w.first)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cls, code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((code, cls))
    cls, code, n = cls[order], code[order], n[order]
    new = np.ones(len(cls), bool)
    new[1:] = (cls[1:] != cls[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(new)
    return cls[at], code[at], np.add.reduceat(n, at) if len(at) else n


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, cls): sums (cls, code, n)."""
    names: dict[str, int] = {}
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def emit() -> Iterator[pa.RecordBatch]:
        cls, code, n = _merged(parts)
        labels = np.array(list(names), object)
        for a in range(0, len(cls), 500_000):
            b = a + 500_000
            yield pa.RecordBatch.from_arrays([pa.array(labels[cls[a:b]], pa.string()), pa.array(code[a:b]), pa.array(n[a:b])], names=["cls", "code", "n"])

    for batch in batches:
        data, offsets = kernels.flat(batch.column(0))
        labels = batch.column(1).to_pylist()
        cls = np.array([names.setdefault(x, len(names)) for x in labels], np.int64)
        for a, b in kernels.slices(offsets, SLICE):
            d = distinct_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if d is None:
                continue
            local, of_doc = np.unique(cls[a:b], return_inverse=True)
            of_word = np.repeat(of_doc, np.diff(d.first))
            times = np.bincount(of_word * len(d.heads) + d.word, minlength=len(local) * len(d.heads)).reshape(len(local), -1)
            codes, slot = np.unique(d.codes, return_inverse=True)
            for c, each in zip(local.tolist(), times, strict=True):
                n = np.bincount(slot, weights=np.repeat(each, d.events), minlength=len(codes)).astype(np.int64)
                some = np.flatnonzero(n)
                parts.append((np.full(len(some), c), codes[some], n[some]))
            if len(parts) > 64:
                parts[:] = [_merged(parts)]
                if len(parts[0][0]) > TASK_SUMS:
                    yield from emit()
                    parts.clear()
    if parts:
        yield from emit()


def counts(labelled: DataFrame, prepare: Prepare | None = None) -> DataFrame:
    """(cls, code, n) over all rows, which are (text, cls) once `prepare` has had them in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _count(batches if prepare is None else map(prepare, batches))

    return labelled.mapInArrow(run, "cls string, code long, n long").groupBy("cls", "code").agg(F.sum("n").alias("n"))


def cell_of(code: np.ndarray, cells: int) -> np.ndarray:
    """The cell of n-grams, by the two symbols before the last."""
    return ((code >> BITS & _mask(2)) * 0x9E3779B1 >> 12) % cells


#: Of one order: k, sorted codes and their log-probabilities, sorted histories and their backoff weights.
Level = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _descend(levels: list[Level], codes: np.ndarray, rest: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Add what these orders (longest first) know of codes[rest] to out[rest]; gives what none of them knows."""
    for k, known, logp, histories, backoff in levels:
        if not len(rest):
            break
        want = codes[rest] & _mask(k)
        at, hit = _find(known, want)
        out[rest[hit]] += logp[at[hit]]
        rest, want = rest[~hit], want[~hit]
        if k > 1:
            at, hit = _find(histories, want >> BITS)
            out[rest[hit]] += backoff[at[hit]]
        else:
            out[rest] += backoff[0]
    return rest


class Model:
    """The log-probabilities of n-grams under each class: low orders whole, higher ones in blocks of cells."""

    def __init__(self, classes: list[str], base: list[Level], cells: int, blocks: Blocks):
        self.classes, self.base, self.cells, self.blocks = classes, base, cells, blocks

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """The log-probability of each event under each class."""
        out = np.zeros((len(codes), len(self.classes)), np.float32)
        cell = cell_of(codes, self.cells)
        unseen = np.ones(len(codes), bool)
        rest = []
        for has, levels in self.blocks:
            mine = has[cell] & unseen
            unseen &= ~mine
            rest.append(_descend(levels, codes, np.flatnonzero(mine), out))
        rest.append(np.flatnonzero(unseen))
        _descend(self.base, codes, np.concatenate(rest), out)
        return out

    def each(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, Distinct, np.ndarray]]:
        """Of each slice [a, b) of documents with a word: its distinct words and the log-probabilities of their events.

        Where a worker reads the blocks anew each time, the events of a few slices are looked up at once.
        """
        parts, together = [], 1 if self.blocks.held else TOGETHER
        for a, b in kernels.slices(offsets, SLICE):
            d = distinct_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if d is not None:
                parts.append((a, b, d))
            if len(parts) == together:
                yield from self._looked_up(parts)
                parts = []
        yield from self._looked_up(parts)

    def _looked_up(self, parts: list[tuple[int, int, Distinct]]) -> Iterator[tuple[int, int, Distinct, np.ndarray]]:
        if not parts:
            return
        codes, slot = np.unique(np.concatenate([d.codes for _, _, d in parts]), return_inverse=True)
        logp, at = self.log_probs(codes), 0
        for a, b, d in parts:
            yield a, b, d, logp[slot[at : at + len(d.codes)]].astype(np.float64)
            at += len(d.codes)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The summed log-probabilities of each document by class, and its character events."""
        n = len(offsets) - 1
        total, events = np.zeros((n, len(self.classes))), np.zeros(n, np.int64)
        for a, b, d, logp in self.each(data, offsets):
            total[a:b] = segment_sums(np.add.reduceat(logp, d.heads, axis=0), d.word, d.first)
            events[a:b] = segment_sums(d.events[:, None].astype(np.float64), d.word, d.first)[:, 0]
        return total, events


def segment_sums(values: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[index] between consecutive bounds; the same order of addition for the same document."""
    out = np.zeros((len(first) - 1, values.shape[1]))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for c in range(values.shape[1]):
            out[some, c] = np.add.reduceat(values[:, c][index], first[some])
    return out


def _find(known: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(known, want), len(known) - 1)
    return at, known[at] == want


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their weights."""
    u, inv = np.unique(keys, return_inverse=True)
    return u, np.bincount(inv, weights=weights, minlength=len(u))


def shorter(code: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Kneser-Ney counts of order k - 1 from those of order k.

    A form counts the distinct symbols before it, but one at the beginning of a word,
    which has none before it, as often as it occurs.
    """
    low = code & _mask(k - 1)
    starts = (low >> (BITS * (k - 2))) == EDGE
    return _sums(low, np.where(starts, n, 1))


def _discount(ones: float, twos: float) -> float:
    return min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5


class _Order:
    """The counts of one order of one chain (a class, or all classes pooled)."""

    def __init__(self, code: np.ndarray, n: np.ndarray, discount: float):
        self.code, self.n, self.discount = code, n.astype(np.float64), discount
        self.history, self.total = _sums(code >> BITS, self.n)
        _, self.types = _sums(code >> BITS, np.ones(len(code)))

    def probs(self, codes: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """p(symbol | history) of codes, given the probabilities of their shorter forms."""
        if not len(self.code):
            return lower
        at, seen = _find(self.code, codes)
        h, known = _find(self.history, codes >> BITS)
        own = np.maximum(np.where(seen, self.n[at], 0) - self.discount, 0)
        return np.where(known, (own + self.discount * self.types[h] * lower) / self.total[h], lower)

    def backoff(self, histories: np.ndarray) -> np.ndarray:
        if not len(self.history):
            return np.ones(len(histories))
        h, known = _find(self.history, histories)
        return np.where(known, self.discount * self.types[h] / self.total[h], 1.0)


def _log(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-30)).astype(np.float32)


class _Builder:
    """The levels of a model from counts; chains are the classes and, last, all of them pooled where they share backoff."""

    def __init__(self, classes: int, shared: bool):
        self.classes, self.shared = classes, shared
        self.chains = classes + shared
        self.discounts = np.full((ORDER + 1, self.chains), 0.5)

    def of_chains(self, cls: np.ndarray, code: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The sorted counts of each chain, from those of classes."""
        out = [_sums(code[own], n[own]) for own in (cls == c for c in range(self.classes))]
        return [*out, _sums(code, n)] if self.shared else out

    def tally(self, cls: np.ndarray, code: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of one cell, to be added up over all: (chain, order, codes, counts) of the order below the cells', and for each order in cells how many n-grams count 1 and 2."""
        for chain, (x, y) in enumerate(self.of_chains(cls, code, n)):
            for k in range(ORDER, CELL_ORDER - 1, -1):
                yield chain, k, np.array([1, 2]), np.array([(y == 1).sum(), (y == 2).sum()])
                x, y = shorter(x, y, k)
            yield chain, CELL_ORDER - 1, x, y

    def base(self, tallied: Iterable[tuple[int, int, np.ndarray, np.ndarray]]) -> list[Level]:
        """The orders below the cells', and every discount."""
        low: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for chain, k, code, n in tallied:
            if k >= CELL_ORDER:
                both = dict(zip(code.tolist(), n.tolist(), strict=True))
                self.discounts[k, chain] = _discount(both.get(1, 0), both.get(2, 0))
            else:
                low[chain] = _sums(code, n)
        none = (np.zeros(0, np.int64), np.zeros(0))
        orders = {k: [] for k in range(1, CELL_ORDER)}
        for chain in range(self.chains):
            x, y = low.get(chain, none)
            for k in range(CELL_ORDER - 1, 0, -1):
                self.discounts[k, chain] = _discount(float((y == 1).sum()), float((y == 2).sum()))
                orders[k].append(_Order(x, y, self.discounts[k, chain]))
                if k > 1:
                    x, y = shorter(x, y, k)
        levels, self.below = self._levels(orders, None)
        return levels

    def cell(self, cls: np.ndarray, code: np.ndarray, n: np.ndarray) -> list[Level]:
        """The orders of one cell."""
        orders: dict[int, list[_Order]] = {k: [] for k in range(CELL_ORDER, ORDER + 1)}
        for chain, (x, y) in enumerate(self.of_chains(cls, code, n)):
            for k in range(ORDER, CELL_ORDER - 1, -1):
                orders[k].append(_Order(x, y, self.discounts[k, chain]))
                x, y = shorter(x, y, k)
        return self._levels(orders, self.below)[0]

    def _levels(self, orders: dict[int, list[_Order]], below) -> tuple[list[Level], tuple[np.ndarray, np.ndarray]]:
        levels = []
        for k in sorted(orders):
            chains = orders[k]
            codes = np.unique(np.concatenate([c.code for c in chains]))
            histories = np.unique(codes >> BITS)
            if below is None:
                lower = np.full((len(codes), self.classes), 1.0 / (1 << BITS))
            else:
                lower = below[1][_find(below[0], codes & _mask(k - 1))[0]] if len(codes) else np.zeros((0, self.classes))
            if self.shared:
                pooled = chains[-1]
                p = np.repeat(pooled.probs(codes, lower[:, 0])[:, None], self.classes, axis=1)
                b = np.repeat(pooled.backoff(histories)[:, None], self.classes, axis=1)
                if k == ORDER:
                    p = np.stack([c.probs(codes, p[:, i]) for i, c in enumerate(chains[:-1])], axis=1)
                    b = b * np.stack([c.backoff(histories) for c in chains[:-1]], axis=1)
            else:
                p = np.stack([c.probs(codes, lower[:, i]) for i, c in enumerate(chains)], axis=1)
                b = np.stack([c.backoff(histories) for c in chains], axis=1)
            if k == 1:
                b = (b[:1] if len(b) else np.ones((1, self.classes))) / (1 << BITS)
            below = codes, p
            levels.append((k, codes, _log(p), histories, _log(b)))
        return levels[::-1], below


def _joined(cells: int, parts: list[tuple[int, list[Level]]]) -> tuple[tuple[np.ndarray, list[Level]], int]:
    """One block of some cells: which they are and their levels as one, and its size in bytes."""
    has = np.zeros(cells, bool)
    has[[c for c, _ in parts]] = True
    levels = []
    for i in range(ORDER - CELL_ORDER + 1):
        k = parts[0][1][i][0]
        codes, logp, histories, backoff = (np.concatenate([levels_[i][j] for _, levels_ in parts]) for j in range(1, 5))
        x, y = np.argsort(codes), np.argsort(histories)
        levels.append((k, codes[x], logp[x], histories[y], backoff[y]))
    return (has, levels), sum(a.nbytes for level in levels for a in level[1:])


def build(classes: list[str], cls: np.ndarray, code: np.ndarray, n: np.ndarray, shared: bool = False) -> Model:
    """The model of counted n-grams that one machine holds."""
    builder = _Builder(len(classes), shared)
    base = builder.base(builder.tally(cls, code, n))
    return Model(list(classes), base, 1, Blocks(None, [_joined(1, [(0, builder.cell(cls, code, n))])]))


def _cells(batches: Iterator[pa.RecordBatch], number: dict[str, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, cls, code, n) of (cell, cls, code, n) rows sorted by cell."""
    held: list[tuple[np.ndarray, ...]] = []

    def done() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        cell, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
        return (int(cell[0]), *rest)

    for batch in batches:
        cell, code, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
        names = batch.column(1).dictionary_encode()
        cls = np.array([number[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if len(cell) else np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))[: len(cell)]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cell)], strict=True):
            if held and held[0][0][0] != cell[a]:
                yield done()
                held = []
            held.append((cell[a:b], cls[a:b], code[a:b], n[a:b]))
    if held:
        yield done()


def train(labelled: DataFrame, shared: bool = False, prepare: Prepare | None = None, cell_grams: int = CELL_GRAMS, **limits: int) -> Model | None:
    """Count all labelled (text, cls) rows and build the model; None when no text has a class and a word."""
    counted = checkpoint(counts(labelled, prepare))
    sizes = {r["cls"]: r["count"] for r in counted.groupBy("cls").count().collect()}  # a row for each class
    if not sizes:
        return None
    classes = sorted(sizes)
    number = {c: i for i, c in enumerate(classes)}
    cells = max(LEAST_CELLS, -(-sum(sizes.values()) // cell_grams))
    symbols = F.shiftright("code", BITS).bitwiseAND(F.lit(_mask(2)))
    dealt = counted.withColumn("cell", (F.shiftright(symbols * F.lit(0x9E3779B1), 12) % cells).cast("int"))
    dealt = dealt.select("cell", "cls", "code", "n").repartition("cell").sortWithinPartitions("cell")
    builder = _Builder(len(classes), shared)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, *cell in _cells(batches, number):
            for chain, k, code, n in builder.tally(*cell):
                same = np.full(len(code), chain * (ORDER + 1) + k, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(same), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["of", "code", "n"])

    # At most 2^20 pairs of symbols for each chain.
    summed = dealt.mapInArrow(tally, "of int, code long, n long").groupBy("of", "code").agg(F.sum("n").alias("n")).toArrow()
    of, code, n = (summed[c].to_numpy() for c in ("of", "code", "n"))
    base = builder.base((int(x) // (ORDER + 1), int(x) % (ORDER + 1), code[of == x], n[of == x]) for x in np.unique(of))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, *rest in _cells(batches, number):
            packed = pickle.dumps((cell, builder.cell(*rest)), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["packed"])

    packed = checkpoint(dealt.mapInArrow(make, "packed binary"))
    blocks = Blocks(labelled.sparkSession, (_joined(cells, [pickle.loads(r["packed"]) for r in rows]) for rows in gathered(packed, "packed", **limits)))
    return Model(classes, base, cells, blocks)
