"""Secret scans: base patterns, and formats inferred from labelled credentials."""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import Shared, slices, stored, texts
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

# The base patterns, in the order that sorts equal starts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole, so this is a run of 24 or more
KINDS = ("assign", "access", "hex")
#: No match without one of these (lower case).
ASSIGN_HINTS = ("passw", "secret", "token", "api")

#: What may be a credential of a known format: a run of these with a digit and a letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Ordinary text, for the background automaton.
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: One ordinary string of so many (by hash) is offered to the background sample.
ORDINARY_SHARE = 16
#: Most strings of a kind that an automaton is learned from (smallest hashes first), and the
#: longest string learned from; strings of any length are scored.
SAMPLE, LONGEST = 1_000, 256
#: Hoeffding bound's confidence; states reached by fewer strings than this are compatible with any.
ALPHA, LEAST = 0.05, 10
#: Share of each next symbol that automata give to symbols they never saw there.
UNSEEN = 1e-3
#: Least log-likelihood ratio (format against background) of a credential, in nats per symbol.
MARGIN = 0.25

SYMBOLS = str.maketrans({c: s for s, group in {"9": "0123456789", "f": "abcdef", "z": "ghijklmnopqrstuvwxyz", "F": "ABCDEF", "Z": "GHIJKLMNOPQRSTUVWXYZ"}.items() for c in group})
#: Symbols of a credential after SYMBOLS: 9 f z F Z and + / _ . = - themselves, and the end.
ALPHABET = 12


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's number, end) of the base matches, sorted."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def credential(text: str, start: int, kind: int, end: int) -> str:
    return ASSIGN.match(text, start, end)[2] if kind == 0 else text[start:end]


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of possible credentials that touch no base span."""
    at = 0
    taken = sorted((a, b) for a, _, b in base)
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at < len(taken) and taken[at][0] < b:
            continue
        s = m[0]
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            yield a, b


@dataclass
class State:
    n: int = 0
    ends: int = 0
    out: dict[str, int] = field(default_factory=dict)
    next: dict[str, int] = field(default_factory=dict)


def prefix_tree(strings: list[str]) -> list[State]:
    states = [State()]
    for s in strings:
        here = 0
        for c in s:
            state = states[here]
            state.n += 1
            state.out[c] = state.out.get(c, 0) + 1
            if c not in state.next:
                state.next[c] = len(states)
                states.append(State())
            here = state.next[c]
        states[here].n += 1
        states[here].ends += 1
    return states


def differs(f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
    """Whether two frequencies are too far apart to be of one probability (Hoeffding)."""
    return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def compatible(states: list[State], a: int, b: int, bound: float) -> bool:
    todo = [(a, b)]
    while todo:
        x, y = (states[i] for i in todo.pop())
        if x.n < LEAST or y.n < LEAST:
            continue
        if differs(x.ends, x.n, y.ends, y.n, bound):
            return False
        for c in x.out.keys() | y.out.keys():
            if differs(x.out.get(c, 0), x.n, y.out.get(c, 0), y.n, bound):
                return False
            if c in x.next and c in y.next:
                todo.append((x.next[c], y.next[c]))
    return True


def fold(states: list[State], into: int, tree: int) -> None:
    """Adds the prefix subtree at *tree* to the automaton from *into* on."""
    todo = [(into, tree)]
    while todo:
        i, j = todo.pop()
        a, b = states[i], states[j]
        a.n += b.n
        a.ends += b.ends
        for c, n in b.out.items():
            a.out[c] = a.out.get(c, 0) + n
        for c, j in b.next.items():
            if c in a.next:
                todo.append((a.next[c], j))
            else:
                a.next[c] = j


def inferred(strings: list[str], alpha: float = ALPHA) -> list[State]:
    """A probabilistic automaton: the prefix tree's states, breadth first, are merged with the first
    accepted state whose continuations are statistically compatible, or accepted themselves."""
    states = prefix_tree(strings)
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    red, blue = [0], deque((0, c) for c in sorted(states[0].next))
    done: set[tuple[int, str]] = set(blue)
    while blue:
        parent, c = blue.popleft()
        node = states[parent].next[c]
        if node in red:
            continue
        target = next((r for r in red if compatible(states, r, node, bound)), None)
        if target is None:
            red.append(node)
            target = node
        else:
            states[parent].next[c] = target
            fold(states, target, node)
        for r in (target,) if target == node else red:
            for d in sorted(states[r].next):
                if (r, d) not in done or states[r].next[d] not in red and (r, d) not in blue:
                    done.add((r, d))
                    blue.append((r, d))
    number = {r: i for i, r in enumerate(red)}
    return [State(s.n, s.ends, s.out, {c: number[t] for c, t in s.next.items() if t in number}) for s in (states[r] for r in red)]


def log_likelihood(automaton: list[State], symbols: str) -> float:
    """Log-probability of the string; what the automaton never saw has a small probability, after
    which it starts anew."""
    total, here = 0.0, 0
    known, unseen = math.log1p(-UNSEEN), math.log(UNSEEN / ALPHABET)
    for c in symbols:
        state = automaton[here]
        seen = state.out.get(c, 0)
        total += known + math.log(seen / state.n) if seen else unseen
        here = state.next.get(c, 0)
    state = automaton[here]
    return total + (known + math.log(state.ends / state.n) if state.ends else unseen)


@dataclass
class Formats:
    """An automaton for each kind with labelled credentials, and one of ordinary strings."""

    kinds: dict[str, list[State]]
    background: list[State]

    def best(self, text: str) -> tuple[str, float] | None:
        """The likeliest format and its log-likelihood ratio per symbol, if there is any."""
        if not self.kinds or not self.background:
            return None
        symbols = text.translate(SYMBOLS)
        other = log_likelihood(self.background, symbols)
        score, kind = max((log_likelihood(a, symbols), k) for k, a in self.kinds.items())
        return kind, (score - other) / len(symbols)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows: dict[tuple[str, str], None] = {}
        for text in texts(part):
            if not text:
                continue
            base = base_spans(text)
            for start, kind, end in base:
                value = credential(text, start, kind, end)
                if len(value) <= LONGEST:
                    rows[KINDS[kind], value] = None
            inside = {i for a, _, b in base for i in (a, b - 1)}
            for m in ORDINARY.finditer(text):
                if xxhash.xxh32_intdigest(m[0].encode()) % ORDINARY_SHARE == 0:
                    if m.end() - m.start() <= LONGEST and not inside.intersection(range(*m.span())):
                        rows["ordinary", m[0]] = None
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], ["kind", "value"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> Shared:
    """Automata from the credentials that the base patterns label in all texts, and from ordinary
    strings beside them: of each kind the *sample* distinct strings of the smallest hash."""
    rows = docs.select("text").mapInArrow(_labelled, "kind string, value string")
    strings: dict[str, list[str]] = {}
    held = stored(rows.distinct(), "labelled-strings")
    for kind in (*KINDS, "ordinary"):
        chosen = held.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        strings[kind] = [r.value.translate(SYMBOLS) for r in chosen]
    made = {k: inferred(v) for k, v in strings.items() if v}
    background = made.pop("ordinary", [])
    return Shared(docs.sparkSession, Formats(made, background))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan(text: str | None, formats: Formats) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans: (start, kind, end) by start, then kind (base ones first)."""
    text = text or ""
    base = base_spans(text)
    found = [(start, kind, KINDS[kind], end) for start, kind, end in base]
    for start, end in candidates(text, base):
        best = formats.best(text[start:end])
        if best is not None and best[1] >= MARGIN:
            found.append((start, len(KINDS), f"format_{best[0]}", end))
    found.sort()
    return [(a, KINDS[k], b) for a, k, b in base], [(a, name, b) for a, _, name, b in found]


def secrets(docs: DataFrame, formats: Shared) -> DataFrame:
    """One row per document: counts of base matches by kind, hash of their spans, all spans.

    Spans are in code points. A candidate that no base pattern matches is added as
    format_<kind> if its string is likelier under that kind's automaton than in ordinary text, by
    the margin. NULL and empty texts have no spans; repeated rows come back as often as they came
    in. Without any labelled credential only base spans come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, hashes, spans = [[], [], []], [], []
            for text in texts(part):
                base, every = scan(text, formats.value)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[1] == kind for s in base))
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            columns = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
