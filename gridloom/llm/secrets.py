"""Secret scans by one combined deterministic automaton.

All rules' expressions are compiled together: expressions to one nondeterministic automaton, subset
construction to a deterministic one over classes of bytes, minimisation by partition refinement, and from
that transition arrays.  The text of a whole slice is scanned in one byte pass for all rules, many pieces side
by side (pieces end at bytes that no rule can contain).  The pass goes from the end to the start with the
automaton of the reversed expressions, which begins anew at every byte: its state says of which rules a match
starts at this byte.  From the leftmost such place after a rule's match before, the automaton of the
expressions themselves is run to where the rule's longest match ends, and no further.

So the pass reads each byte once, and the ends are looked for inside of matches only: time is linear in the
text for rules that, like these, can't go on in vain after the end of a match.

Scale: a map over documents.  Nothing is shuffled; the transition arrays go out with the tasks.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.text import HEAD, Texts, texts


class Rule(NamedTuple):
    """``least`` counts the bytes from where ``match`` first accepts to its end, shorter matches are dropped
    after matching.  ``search``, if given, stands for ``match`` in the pass: a match starts wherever it does,
    and wherever a match that isn't dropped starts, it does.  It saves states or keeps such places rare."""

    kind: str
    match: str
    least: int = 1
    search: str | None = None


KEYWORDS = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
#: The base rules come first and in the order that breaks ties between spans.
RULES = (
    Rule("assign", KEYWORDS + "[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "AKIA[A-Z0-9]+", 16, "AKIA[A-Z0-9]"),
    Rule("hex", "[0-9a-f]+", 24, "[0-9a-f]{24}"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]+", 36, "gh[pousr]_[A-Za-z0-9]"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 10, "xox[abprs]-[A-Za-z0-9-]"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 16, "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]"),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
N_BASE = 3


class _Nfa:
    """Thompson's construction over bytes for the syntax that rules use: classes, groups, |, ?, *, +, {n}."""

    def __init__(self):
        self.free: list[list[int]] = []  # moves without a byte
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.accepts: dict[int, int] = {}

    def reversed(self, starts: list[int]) -> _Nfa:
        """The automaton of the reversed words: it goes from the ends to the ``starts``."""
        back = _Nfa()
        for _ in self.free:
            back.state()
        for a, to in enumerate(self.free):
            for b in to:
                back.free[b].append(a)
        for a, move in enumerate(self.moves):
            if move:  # every state is entered by one byte move at most
                back.moves[move[1]] = (move[0], a)
        back.accepts = {a: rule for rule, a in enumerate(starts)}
        return back

    def state(self) -> int:
        self.free.append([])
        self.moves.append(None)
        return len(self.free) - 1

    def add(self, expression: str, rule: int) -> int:
        self.text, self.at = expression, 0
        start, end = self._either()
        self.accepts[end] = rule
        return start

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _either(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self._sequence()
            self.free[start].append(a)
            self.free[b].append(end)
            if self._peek() != "|":
                return start, end
            self.at += 1

    def _sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self._peek() not in ("", "|", ")"):
            a, b = self._repeated()
            self.free[end].append(a)
            end = b
        return start, end

    def _repeated(self) -> tuple[int, int]:
        begin = self.at
        a, b = self._atom()
        after = self.at
        sign = self._peek()
        if sign == "{":
            close = self.text.index("}", self.at)
            times = int(self.text[self.at + 1 : close])
            for _ in range(times - 1):
                self.at = begin
                c, d = self._atom()
                assert self.at == after
                self.free[b].append(c)
                b = d
            self.at = close + 1
        elif sign and sign in "?*+":
            self.at += 1
            start, end = self.state(), self.state()
            self.free[start].append(a)
            self.free[b].append(end)
            if sign in "?*":
                self.free[start].append(end)
            if sign in "*+":
                self.free[b].append(a)
            return start, end
        return a, b

    def _atom(self) -> tuple[int, int]:
        c = self._peek()
        self.at += 1
        if c == "(":
            a, b = self._either()
            self.at += 1
            return a, b
        allowed: set[int] = set()
        if c == "[":
            while (x := self._peek()) != "]":
                self.at += 1
                if self._peek() == "-" and self.text[self.at + 1] != "]":
                    allowed.update(range(ord(x), ord(self.text[self.at + 1]) + 1))
                    self.at += 2
                else:
                    allowed.add(ord(x))
            self.at += 1
        else:
            allowed.add(ord(c))
        a, b = self.state(), self.state()
        self.moves[a] = (frozenset(allowed), b)
        return a, b


class Automaton(NamedTuple):
    """next[state * classes + byte class], a state's accepted rules and those that it can reach as bits, and
    each byte's class.  State 0 is the start, accepting states follow the others."""

    next: np.ndarray
    accepts: np.ndarray
    reaches: np.ndarray
    classes: np.ndarray
    width: int


def compile_rules(expressions: list[str], backward: bool) -> Automaton:
    """The anchored automaton of all expressions, or, ``backward``, that of the reversed ones, from any byte."""
    nfa = _Nfa()
    starts = [nfa.add(e, i) for i, e in enumerate(expressions)]
    if backward:
        nfa, starts = nfa.reversed(starts), list(nfa.accepts)
    sets = sorted({m[0] for m in nfa.moves if m}, key=sorted)
    signature = {b: tuple(b in s for s in sets) for b in range(256)}
    names = {s: i for i, s in enumerate(dict.fromkeys(signature.values()))}
    classes = np.array([names[signature[b]] for b in range(256)], np.int64)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(names))]

    def closed(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in nfa.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(s for s in seen if nfa.moves[s] or s in nfa.accepts)

    first = closed(set(starts))
    number, todo, table = {first: 0}, [first], []
    while todo:
        state = todo.pop(0)
        by_class: dict[int, set[int]] = defaultdict(set)
        for s in state:
            if nfa.moves[s]:
                allowed, to = nfa.moves[s]
                for c, b in enumerate(sample):
                    if b in allowed:
                        by_class[c].add(to)
        row = []
        for c in range(len(sample)):
            to = closed(by_class[c]) if c in by_class else frozenset()
            if backward:
                to |= first
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table.append(row)
    accepts = np.zeros(len(number), np.int64)
    for state, i in number.items():
        for s in state:
            if s in nfa.accepts:
                accepts[i] |= 1 << nfa.accepts[s]
    return _minimal(np.array(table), accepts, classes)


def _minimal(table: np.ndarray, accepts: np.ndarray, classes: np.ndarray) -> Automaton:
    """Merges states that no input tells apart (refinement of the partition by accepted rules)."""
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    order = [part[0], *sorted((p for p in dict.fromkeys(part.tolist()) if p != part[0]), key=lambda p: bool(accepts[part == p].any()))]
    rank = {p: i for i, p in enumerate(order)}
    at = [int(np.flatnonzero(part == p)[0]) for p in order]
    table, accepts = np.array([rank[p] for p in part.tolist()])[table[at]].astype(np.int32), accepts[at]
    reaches = accepts.copy()
    while (more := reaches | np.bitwise_or.reduce(reaches[table], axis=1)).tolist() != reaches.tolist():
        reaches = more
    return Automaton(table.reshape(-1), accepts, reaches, classes, table.shape[1])


@lru_cache(maxsize=4)
def automata(rules: tuple[Rule, ...] = RULES) -> tuple[Automaton, Automaton]:
    """The automaton of the pass and that of the matches."""
    return compile_rules([r.search or r.match for r in rules], True), compile_rules([r.match for r in rules], False)


def match_starts(t: Texts, back: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where matches start in a slice, in order: place, rule bits, end of the piece, text number."""
    outside = (back.next.reshape(-1, back.width) == 0).all(axis=0)[back.classes]  # after such a byte every state is the start again
    starts, ends, owner = t.runs(outside)
    order = np.argsort(starts - ends, kind="stable")  # longest first: those still running are a prefix
    last, left = ends[order] - 1, (ends - starts)[order]
    rows = np.zeros(len(order), np.int32)  # state times width
    classes = back.classes.astype(np.int32)[t.data]
    moves = back.next * np.int32(back.width)
    accepting = (int(np.flatnonzero(back.accepts)[0]) if back.accepts.any() else len(back.accepts)) * back.width
    running = len(order) - np.searchsorted(left[::-1], np.arange(int(left.max(initial=0)) + 1), "right")  # longer than k
    at, states, pieces = [], [], []
    active, k = len(order), 0
    while active > 8:
        active = int(running[k])
        s = moves[rows[:active] + classes[last[:active] - k]]
        rows[:active] = s
        if active and s.max() >= accepting:
            i = np.flatnonzero(s >= accepting)
            at.append(last[i] - k)
            states.append(s[i] // back.width)
            pieces.append(i)
        k += 1
    step, width = moves.tolist(), back.width
    for i in range(active):  # a few very long pieces go on one by one
        s, mine = int(rows[i]), []
        for j, c in enumerate(classes[last[i] + 1 - left[i] : last[i] + 1 - k][::-1].tolist()):
            s = step[s + c]
            if s >= accepting:
                mine.append((j, s))
        if mine:
            found = np.array(mine)
            at.append(last[i] - k - found[:, 0])
            states.append(found[:, 1] // width)
            pieces.append(np.full(len(mine), i))
    if not at:
        return (np.zeros(0, np.int64),) * 4
    place, piece = np.concatenate(at), order[np.concatenate(pieces)]
    by = np.argsort(place)
    return place[by], back.accepts[np.concatenate(states)][by], ends[piece][by], owner[piece][by]


class Matcher:
    """Leftmost longest matches that don't overlap, rule by rule, from the places where matches start."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.back, ahead = automata(rules)
        self.next, self.accepts, self.reaches = ahead.next.tolist(), ahead.accepts.tolist(), ahead.reaches.tolist()
        self.classes, self.width, self.rules = ahead.classes.astype(np.int32), ahead.width, rules

    def spans(self, t: Texts) -> list[tuple[int, int, int, int]]:
        """text number, rule, start and end in bytes of the slice, of all matches that are long enough."""
        place, bits, limit, owner = match_starts(t, self.back)
        out = []
        for r, rule in enumerate(self.rules):
            mine = np.flatnonzero(bits >> r & 1)
            starts, k = place[mine], 0
            while k < len(starts):
                begin = int(starts[k])
                early, end = self._end(t, begin, int(limit[mine[k]]), 1 << r)
                if early and end - early + 1 >= rule.least:
                    out.append((int(owner[mine[k]]), r, begin, end))
                k = max(k + 1, int(np.searchsorted(starts, end)))
        return out

    def _end(self, t: Texts, at: int, limit: int, bit: int) -> tuple[int, int]:
        """Where the rule's match from ``at`` may end first and last."""
        s, early, end, size = 0, 0, at, 64
        while at < limit:
            for c in self.classes[t.data[at : min(at + size, limit)]].tolist():
                s = self.next[s * self.width + c]
                if not self.reaches[s] & bit:
                    return early, end
                at += 1
                if self.accepts[s] & bit:
                    early, end = early or at, at
            size *= 2
        return early, end


def _scanner(rules: tuple[Rule, ...]):
    span = pa.list_(pa.struct([("kind", pa.int32()), ("from", pa.int64()), ("to", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rules)
        for batch in batches:
            for row, t in texts(batch.column("text"), size=4 << 20):  # more pieces side by side
                spans: list[list[dict]] = [[] for _ in range(t.n)]
                found = matcher.spans(t)
                heads = np.concatenate([[0], np.cumsum(HEAD[t.data[: t.size]])]) if found else None  # bytes to code points
                for d, r, a, b in found:
                    zero = heads[t.at[d]]
                    spans[d].append({"kind": r, "from": int(heads[a] - zero), "to": int(heads[b] - zero)})
                for x in spans:
                    x.sort(key=lambda y: (y["from"], y["kind"]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, t.n), pa.array(spans, span)], ["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (kind, from, to), for each row of ``docs``.

    ``kind`` is the rule's number, positions are code points of the whole text, end exclusive, sorted by
    start, then kind.  Spans of one kind don't overlap; those of two kinds may.  Null and empty texts have
    none.  Other columns aren't read, every row gives a row.
    """
    schema = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", spans array<struct<kind:int,`from`:bigint,`to`:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(_scanner(rules), schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [r.kind for r in RULES]
    for batch in batches:
        rows = batch.column("spans").to_pylist()
        say = lambda xs: ",".join(f"{kinds[x['kind']]}:{x['from']}:{x['to']}" for x in xs)
        counts = [pa.array([sum(x["kind"] == k for x in row) for row in rows], pa.int64()) for k in range(N_BASE)]
        base = [hashlib.sha256(say([x for x in row if x["kind"] < N_BASE]).encode()).hexdigest() for row in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array([say(row) for row in rows], pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def op9_secret_scan(docs: DataFrame) -> DataFrame:
    """The contract's digest columns for each row of ``docs``, and all spans as ``kind:start:end``.

    A null doc_id stays null; null and empty texts have no spans, counts of 0 and the hash of an empty text.
    """
    found = find_secrets(docs.withColumn("doc_id", docs["doc_id"].cast("long")))
    return found.mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
