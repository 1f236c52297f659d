"""Secret scans: base patterns, and formats inferred as probabilistic automata.

Labelled credentials of each format are built into a prefix tree; states whose continuations are statistically
compatible (Hoeffding bound, as in the ALERGIA algorithm) are merged into a probabilistic automaton. Every
candidate, a run of credential characters, is scored by the log-likelihood of each format's automaton over that of
the automata learned from labelled non-credentials; those above the margin add spans of kind ``format``. A format
gives strings shorter than its shortest labelled credential no likelihood (merged states forget the length), which
decides shorter runs without a walk through its automaton. The base patterns' spans always stay; of a candidate that they
overlap, what is left on each side is a candidate of its own.

Defined cases: null texts are empty; empty texts have no span; very long texts are scanned whole; equal spans
of two kinds are both listed, by start and then kind; repeated rows get equal answers; empty tables give none;
other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm import workers
from kelpline.llm.textcore import parts
from kelpline.session import prepare

#: Fixed values of the query's contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "format")

CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}"  # from the length of the shortest labelled credential
MARGIN = 0.25  # nats per character by which a format must beat the non-credentials

_HEX_BYTE, _CANDIDATE_BYTE, _SIGN = (np.zeros(256, bool) for _ in range(3))
_HEX_BYTE[[ord(c) for c in "0123456789abcdef"]] = True
_CANDIDATE_BYTE[[ord(c) for c in string.ascii_letters + string.digits + "+/_=-"]] = True
_SIGN[[ord(":"), ord("=")]] = True


def labelled(seed: int = 5, each: int = 250) -> dict[str, list[str]]:
    """Credentials by format and, under ``not:``, strings that are none; made by rule, so no real one is stored."""
    draw = random.Random(seed)
    some = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    lower, capital = string.ascii_lowercase, string.ascii_uppercase
    upper, alnum, base64 = string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    syllables = [a + b for a in "bcdfghlmnprst" for b in ("a", "e", "i", "o", "u", "an", "er", "tion", "ing")]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(4, 9)))
    makers = {
        "access": lambda: "AKIA" + some(upper, 16),
        "hex": lambda: some("0123456789abcdef", draw.choice((32, 40, 64))),
        "prefixed": lambda: draw.choice(("ghp_", "gho_", "glpat-", "sk_live_", "xoxb-")) + some(alnum, draw.choice((20, 24, 36))),
        "base64": lambda: some(base64, draw.choice((40, 43, 64))) + draw.choice(("", "=", "==")),
        "not:digits": lambda: some(string.digits, draw.randint(8, 24)),
        "not:grouped": lambda: "-".join(some(string.digits, 4) for _ in range(draw.randint(3, 6))),
        "not:word": word,
        "not:name": lambda: draw.choice("-_/").join([word(), word(), some(string.digits, draw.randint(1, 4))]),
        "not:lower": lambda: some(lower, draw.randint(8, 40)),
        "not:capitals": lambda: "_".join(some(capital, draw.randint(2, 10)) for _ in range(draw.randint(2, 5))),
        "not:camel": lambda: "".join(some(capital, 1) + some(lower, draw.randint(2, 9)) for _ in range(draw.randint(2, 5))),
        "not:rule": lambda: draw.choice("=-_+/") * draw.randint(8, 80),
    }
    return {name: [make() for _ in range(each)] for name, make in makers.items()}


class Automaton:
    """A probabilistic automaton: state 0 starts; step[q][c] is the next state, seen[q][c] how often."""

    def __init__(self, words: Sequence[str], alpha: float = 0.05):
        self.step: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        self.visits: list[int] = [0]
        self.least = min(map(len, words), default=0)
        for word in words:
            q = 0
            self.visits[0] += 1
            for c in word:
                if c not in self.step[q]:
                    self.step[q][c] = len(self.step)
                    self.step.append({})
                    self.seen.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                self.seen[q][c] = self.seen[q].get(c, 0) + 1
                q = self.step[q][c]
                self.visits[q] += 1
            self.ends[q] += 1
        self.width = math.sqrt(math.log(2 / alpha) / 2)
        self._merge_all()

    def _near(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) < self.width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self.visits[a], self.visits[b]
            if not n1 or not n2:
                continue
            if not self._near(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in {*self.seen[a], *self.seen[b]}:
                if not self._near(self.seen[a].get(c, 0), n1, self.seen[b].get(c, 0), n2):
                    return False
                if c in self.step[a] and c in self.step[b]:
                    todo.append((self.step[a][c], self.step[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below *b* to the state *a*."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, n in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + n
                if c in self.step[a]:
                    todo.append((self.step[a][c], self.step[b][c]))
                else:
                    self.step[a][c] = self.step[b][c]

    def _merge_all(self) -> None:
        red = [0]
        edge = {q: (0, c) for c, q in self.step[0].items()}
        while edge:
            b = min(edge)
            parent, c = edge.pop(b)
            for r in red:
                if self._compatible(r, b):
                    self.step[parent][c] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
            known = set(red)
            edge = {q: (r, c) for r in red for c, q in self.step[r].items() if q not in known}
        number = {q: i for i, q in enumerate(red)}
        self.step = [{c: number[t] for c, t in self.step[q].items()} for q in red]
        self.seen, self.ends, self.visits = ([x[q] for q in red] for x in (self.seen, self.ends, self.visits))

    def _log(self, q: int, c: str) -> float:
        """Log-probability of *c* in state *q*, smoothed over the alphabet."""
        return math.log((self.seen[q].get(c, 0) + 0.02) / (self.visits[q] + 0.02 * 66))

    def score(self, word: str) -> float:
        """Log-likelihood by character; none for a word shorter than any that is known."""
        if len(word) < self.least:
            return -math.inf
        q, total = 0, 0.0
        for c in word:
            total += self._log(q, c)
            q = self.step[q].get(c, 0)
        return total / len(word)


def infer(examples: dict[str, list[str]] | None = None) -> tuple[list[Automaton], list[Automaton]]:
    """(automata of credentials, automata of non-credentials)."""
    made = {name: Automaton(words) for name, words in sorted((examples or labelled()).items())}
    for name, automaton in made.items():
        if name.startswith("not:"):
            automaton.least = 0  # what is no credential may be of any length
    return [a for n, a in made.items() if not n.startswith("not:")], [a for n, a in made.items() if n.startswith("not:")]


def shortest(automata: tuple[list[Automaton], list[Automaton]]) -> int:
    """The length of the shortest labelled credential."""
    return max(1, min(a.least for a in automata[0]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the base patterns' matches."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def left_over(start: int, end: int, taken: Sequence[tuple[int, int, int]], first: int = 0) -> Iterator[tuple[int, int]]:
    """What the spans *taken*, in order and from number *first*, leave of start to end."""
    for i in range(first, len(taken)):
        s, _, e = taken[i]
        if s >= end:
            break
        if e > start:
            if s > start:
                yield start, s
            start = e
    if start < end:
        yield start, end


def format_spans(text: str, automata: tuple[list[Automaton], list[Automaton]], taken: Sequence[tuple[int, int, int]] = ()) -> list[tuple[int, int, int]]:
    """Added spans: of each candidate, what the spans *taken* leave on each side is scored."""
    found, least, first = [], shortest(automata), 0
    for m in re.finditer(CANDIDATE % least, text):
        while first < len(taken) and taken[first][2] <= m.start():
            first += 1
        for start, end in left_over(m.start(), m.end(), taken, first):
            word = text[start:end]
            if len(word) >= least and max(a.score(word) for a in automata[0]) > max(a.score(word) for a in automata[1]) + MARGIN:
                found.append((start, 3, end))
    return found


def _long_runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Whether each row has a run of *least* bytes (runs over two rows may count as well: a filter only)."""
    bounds = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts = bounds[::2][bounds[1::2] - bounds[::2] >= least]
    ends = bounds[1::2][bounds[1::2] - bounds[::2] >= least]
    return np.searchsorted(starts, offsets[1:]) > np.searchsorted(ends, offsets[:-1], "right")


def scan(column: pa.Array, automata: tuple[list[Automaton], list[Automaton]]) -> Iterator[tuple[str, list, list]]:
    """(text, base spans, added spans) of each row, in order. Rows that hold nothing a pattern needs are passed over."""
    texts = column
    least = min(20, shortest(automata))  # 20 for the base patterns
    for first, end, data, offsets in parts(column):
        signs = np.flatnonzero(_SIGN[data])
        worth = np.searchsorted(signs, offsets[1:]) > np.searchsorted(signs, offsets[:-1])
        worth |= _long_runs(_CANDIDATE_BYTE[data], offsets, least)
        for row in range(first, end):
            text = (texts[row].as_py() or "") if worth[row - first] else ""
            base = base_spans(text)
            yield text, base, format_spans(text, automata, base)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", examples: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of every row; spans count code points."""
    prepare(docs.sparkSession)
    automata = infer(examples)  # of a fixed number of labelled examples
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))

    @workers.task
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for _, base, added in scan(batch.column("text"), automata):
                for k in range(3):
                    columns[k].append(sum(x[1] == k for x in base))
                columns[3].append(hashlib.sha256(listed(base).encode()).hexdigest())
                columns[4].append(listed(base + added))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    made = rows.mapInArrow(found, f"id {rows.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return made.withColumnRenamed("id", key)


def redact(docs: DataFrame, mask: str = "[SECRET]", text: str = "text", examples: dict[str, list[str]] | None = None) -> DataFrame:
    """*docs* with every span of its texts replaced by *mask*; all rows and columns stay, null texts too."""
    prepare(docs.sparkSession)
    automata = infer(examples)

    @workers.task
    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            new = column.to_pylist()
            for row, (whole, base, added) in enumerate(scan(column, automata)):
                if base or added:
                    out, at = [], 0
                    for s, _, e in sorted(base + added):
                        if s >= at:
                            out += [whole[at:s], mask]
                        at = max(at, e)
                    new[row] = "".join([*out, whole[at:]])
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(new, column.type))

    return docs.mapInArrow(cleaned, docs.schema)
