"""Periodic runs of words by the runs theorem.

The longest Lyndon word at each place, under an order of words and under the reverse of that order, comes from the
next smaller value of the inverse suffix array. Every run holds such a Lyndon word as its root, so extending each one
to the right and to the left finds all runs. How far two places agree is the least LCP value between their ranks,
told by a sparse table over blocks of the LCP array. Leftward agreement needs the same of the reversed text, which
is built only for texts that have a candidate. Texts are taken many at a time: a rank begins with the text's number,
so nothing is compared across texts.

Defined cases: null and empty texts have no runs and an empty collapsed text; repeated rows each get their result;
an empty table gives no rows; columns named in ``keep`` are handed on, others play no part. Words are told apart by 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from kelpline.llm import textcore, workers
from kelpline.session import prepare

BLOCK = 32  # LCP values in an entry of the sparse table
QUERIES = 1 << 13  # that are answered at once
LONGEST = np.iinfo(np.int64).max


class Suffixes:
    """Suffix ranks of several sequences of whole numbers from 1 on. Each sequence ends in a terminator, smaller than all."""

    def __init__(self, symbols: np.ndarray, sequence: np.ndarray, lcp: bool):
        n = len(symbols)
        key = sequence * (int(symbols.max(initial=0)) + 1) + symbols
        order = np.argsort(key)
        begin = self._begins(key[order])
        self.rank = np.empty(n, np.int64)
        self.rank[order] = begin
        self.names = [(1, self.rank.astype(np.int32))] if lcp else []
        active, length = self._shared(order, begin), 1
        while len(active):
            # Active suffixes share *length* symbols with another one; those symbols hold no terminator.
            key = self.rank[active] * n + self.rank[active + length]
            order = np.argsort(key)
            active, key = active[order], key[order]
            old, new = self._begins(key // n), self._begins(key)
            self.rank[active] = self.rank[active] + new - old
            active, length = self._shared(active, new), 2 * length
            if lcp and len(active):
                self.names.append((length, self.rank.astype(np.int32)))
        if lcp:
            self.lcp = self._lcp(n)
            self._table()
            del self.names

    @staticmethod
    def _begins(key: np.ndarray) -> np.ndarray:
        """For each place of a sorted list the place where its value begins."""
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        return np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))

    @staticmethod
    def _shared(places: np.ndarray, begin: np.ndarray) -> np.ndarray:
        alone = np.ones(len(begin) + 1, bool)
        alone[1:-1] = begin[1:] != begin[:-1]
        return places[~(alone[:-1] & alone[1:])]

    def _lcp(self, n: int) -> np.ndarray:
        """Agreement of each suffix with the one before it in rank, from the ranks of prefixes of doubling length."""
        suffixes = np.empty(n, np.int64)
        suffixes[self.rank] = np.arange(n)
        out = np.zeros(n, np.int64)
        first = self.names[0][1]
        places = np.flatnonzero(first[suffixes[1:]] == first[suffixes[:-1]]) + 1
        one, other, agreed = suffixes[places], suffixes[places - 1], np.zeros(len(places), np.int64)
        for length, names in reversed(self.names):
            agreed += np.where(names[one + agreed] == names[other + agreed], length, 0)
        out[places] = agreed
        return out

    def _table(self) -> None:
        blocks = -(-len(self.lcp) // BLOCK)
        padded = np.full(blocks * BLOCK, LONGEST)
        padded[: len(self.lcp)] = self.lcp
        self.padded, self.table = padded, [padded.reshape(blocks, BLOCK).min(axis=1)]
        while 2 ** len(self.table) <= blocks:
            last, step = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def agreement(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at two different places share."""
        a, b = self.rank[one], self.rank[other]
        first, last = np.minimum(a, b) + 1, np.maximum(a, b)  # of the LCP values between them
        return np.concatenate([np.zeros(0, np.int64), *(self._least(first[q : q + QUERIES], last[q : q + QUERIES]) for q in range(0, len(first), QUERIES))])

    def _least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.full(len(first), LONGEST)
        reach = np.arange(BLOCK)
        for places in (first[:, None] + reach, last[:, None] - reach):  # the blocks at both ends, value by value
            inside = (places >= first[:, None]) & (places <= last[:, None])
            out = np.minimum(out, np.where(inside, self.padded[np.where(inside, places, 0)], LONGEST).min(axis=1))
        a, b = first // BLOCK + 1, last // BLOCK  # whole blocks between: a to b - 1
        for level in range(len(self.table)):
            own = np.flatnonzero((b - a >= 2**level) & (b - a < 2 ** (level + 1)))
            if len(own):
                table = self.table[level]
                out[own] = np.minimum(out[own], np.minimum(table[a[own]], table[b[own] - 2**level]))
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next place with a smaller value, by a tree of minima; every place but the last of a sequence has one."""
    levels = max(1, int(len(values)).bit_length())
    tree = [np.full(1 << levels, LONGEST)]
    tree[0][: len(values)] = values
    while len(tree[-1]) > 1:
        tree.append(tree[-1].reshape(-1, 2).min(axis=1))
    out = np.full(len(values), len(values))
    asked = np.arange(len(values))
    node = asked + 1  # a node of the level that begins where the search goes on
    for level in range(levels):
        odd = (node & 1).astype(bool)
        hit = odd & (tree[level][np.minimum(node, len(tree[level]) - 1)] < values[asked]) & (node < len(tree[level]))
        found, at = asked[hit], node[hit]
        for down in range(level - 1, -1, -1):
            at = 2 * at
            at += tree[down][at] >= values[found]
        out[found] = at
        asked, node = asked[~hit], (node + odd)[~hit] >> 1
        asked, node = asked[(inside := node < len(tree[level + 1]))], node[inside]
    return out


def _terminated(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with a 0 after each sequence, the sequence of each, place where each sequence begins)."""
    counts = np.diff(bounds)
    begins = bounds[:-1] + np.arange(len(counts))
    sequence = np.repeat(np.arange(len(counts)), counts + 1)
    out = np.zeros(len(symbols) + len(counts), np.int64)
    out[np.arange(len(symbols)) + np.repeat(np.arange(len(counts)), counts)] = symbols
    return out, sequence, begins


def periodic_runs(symbols: np.ndarray, bounds: np.ndarray, least_length: int, least_exponent: int) -> np.ndarray:
    """(sequence, start, length, period) of the runs, sorted. *symbols* are whole numbers from 1 on, *bounds* where sequences begin and end."""
    none = np.zeros((0, 4), np.int64)
    if not len(symbols):
        return none
    text, sequence, begins = _terminated(symbols, bounds)
    forward = Suffixes(text, sequence, lcp=True)
    top = int(text.max()) + 1
    backward = Suffixes(np.where(text > 0, top - text, 0), sequence, lcp=False)
    places = np.flatnonzero(text > 0)
    roots = []
    for order in (forward, backward):
        after = next_smaller(order.rank)[places]
        again = text[after] == text[places]  # a run goes on with its root's first word
        roots.append(places[again] * len(text) + after[again])
    one, two = np.divmod(np.unique(np.concatenate(roots)), len(text))
    period = two - one
    right = forward.agreement(one, two)
    # The leftmost root of a run is followed by the rest of the run but for less than two periods.
    far = right >= (least_exponent - 2) * period
    one, two, period, right = one[far], two[far], period[far], right[far]
    if not len(one):
        return none
    left = _leftward(symbols, bounds, sequence, begins, one, two)
    start, length = one - left - begins[sequence[one]], left + period + right
    whole = (length >= least_length) & (length >= least_exponent * period)
    return np.unique(np.stack([sequence[one], start, length, period], axis=1)[whole], axis=0)


def _leftward(symbols: np.ndarray, bounds: np.ndarray, sequence: np.ndarray, begins: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many symbols before two places of a sequence agree, from the reversed sequences."""
    own = np.unique(sequence[one])
    counts = np.diff(bounds)[own]
    ends = np.cumsum(counts)
    back = np.repeat(bounds[own + 1] - 1, counts) - (np.arange(ends[-1]) - np.repeat(ends - counts, counts))
    text, number, firsts = _terminated(symbols[back], np.concatenate([[0], ends]))
    mirrored = Suffixes(text, number, lcp=True)
    which = np.searchsorted(own, sequence[one])
    turn = lambda at: firsts[which] + counts[which] - (at - begins[sequence[one]])  # noqa: E731  the place before *at*, mirrored
    out = np.zeros(len(one), np.int64)
    inner = one > begins[sequence[one]]
    out[inner] = mirrored.agreement(turn(one)[inner], turn(two)[inner])
    return out


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each row's kept words, joined by one space."""
    before = np.concatenate([[0], np.cumsum(keep)])[bounds]
    lengths = (ends - starts)[keep]
    rows = np.diff(before)
    sizes = lengths + 1
    if len(sizes):
        sizes[(before[1:] - 1)[rows > 0]] -= 1  # no space after the last word
    total = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(total[-1], 0x20, np.uint8)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[inside + np.repeat(total[:-1], lengths)] = data[inside + np.repeat(starts[keep], lengths)]
    offsets = total[before].astype(np.int64)
    made = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    return made.cast(pa.string())


def _dropped(runs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    change = np.zeros(bounds[-1] + 1, np.int64)
    first = bounds[runs[:, 0]] + runs[:, 1]
    np.add.at(change, first + runs[:, 3], 1)
    np.add.at(change, first + runs[:, 2], -1)
    return np.cumsum(change)[:-1] > 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """The *keep* columns of every row, its ``runs`` (start, length, period; sorted) of at least *least_length* words and
    *least_exponent* (from 3) periods, and ``collapsed``: the words that no run contains after its first period, joined by one space."""
    prepare(docs.sparkSession)
    rows = docs.select(*keep, docs[text].cast("string").alias("__text"))
    run = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
    schema = StructType([*rows.schema.fields[:-1], StructField("runs", ArrayType(run)), StructField("collapsed", StringType())])

    @workers.task
    def search(batches):
        for batch in batches:
            for first, end, data, offsets in textcore.parts(batch.column("__text")):
                starts, ends, bounds = textcore.words(data, offsets)
                _, symbols = np.unique(textcore.span_hashes(data, starts, ends), return_inverse=True)
                runs = periodic_runs(symbols.astype(np.int64) + 1, bounds, least_length, least_exponent)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(runs[:, 0], np.arange(end - first + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, c])) for c in (1, 2, 3)], fields=list(RUN)),
                )
                collapsed = _joined(data, starts, ends, ~_dropped(runs, bounds), bounds)
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in batch.columns[:-1]), lists, collapsed], [*batch.schema.names[:-1], "runs", "collapsed"])

    return rows.mapInArrow(search, schema)
