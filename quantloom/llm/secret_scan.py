"""Secret scan with one deterministic automaton for all rules.

The rules are regular expressions. Each is parsed here, turned into a Thompson automaton, determinised by subset
construction and minimised. A second subset construction joins them: a state of the scanner is, for every rule, the
states of its matches that may be open, oldest first. It is minimised by partition refinement; the result is one
transition array (state x byte -> state) and, for each state, what entering it does: which rules' matches end there,
which begin to hold, and where open ones began. Scanning a text is a single pass over its UTF-8 bytes that follows
the array; all rules advance together, and every span is placed in that pass. No byte is read twice.

Where a match began is known from the state alone while all ways to it are of one length; only beyond that is it
kept in a register of the rule. Matches are leftmost, longest and do not overlap within a rule. A rule's length
condition (`least`) is applied to the placed span, so that counters of several rules do not multiply in the array.

Results for odd input: a null text counts as empty; a text without secrets gives no spans; texts of any
length are scanned whole in constant memory besides the text and its spans; rows with equal or null doc_id each get
their own result; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from quantloom.llm.common import utf8


@dataclass(frozen=True)
class Rule:
    """Patterns have literals, classes, groups, | and ? * + {m,} on single items.

    `least`: a match counts if the pattern held at so many of its last bytes, one after the other; for a pattern that
    ends in [..]+, the length of that item. Shorter matches are consumed and dropped. `base`: a kind of the contract."""

    kind: str
    pattern: str
    least: int
    base: bool = True


# The rules.
_NAME = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
RULES = (
    Rule("assign", _NAME + "[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=\\-]+", 6),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]+", 24),
    # added by this operator, after the base kinds
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 36, base=False),
    Rule("google", "AIza[A-Za-z0-9_\\-]+", 35, base=False),
    Rule("slack", "xox[abprs]-[A-Za-z0-9\\-]+", 10, base=False),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, base=False),
)


class _Nfa:
    """Thompson automaton: `eps[s]` are free moves, `moves[s]` is (set of bytes, target)."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.moves.append(None)
        return len(self.eps) - 1

    def parse(self, pattern: str) -> tuple[int, int]:
        self.text, self.at = pattern, 0
        start, end = self._alternatives()
        if self.at != len(pattern):
            raise ValueError(f"can't parse {pattern!r} at {self.at}")
        return start, end

    def _alternatives(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self._sequence()
            self.eps[start].append(a)
            self.eps[b].append(end)
            if self.text[self.at : self.at + 1] != "|":
                return start, end
            self.at += 1

    def _sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            begun = self.at
            a, b = self._item()
            body = (begun, self.at)
            low, high = self._times()
            if (low, high) == (1, 1):
                self.eps[end].append(a)
                end = b
                continue
            pieces = [(a, b)]
            for _ in range(max(low, 1) - 1):
                pieces.append(self._again(body))
            for k, (x, y) in enumerate(pieces):
                if low == 0:
                    skip = self.state()
                    self.eps[end] += [x, skip]
                    self.eps[y].append(skip)
                    if high is None:
                        self.eps[y].append(x)
                    end = skip
                else:
                    self.eps[end].append(x)
                    if high is None and k == len(pieces) - 1:
                        self.eps[y].append(x)
                    end = y
        return start, end

    def _again(self, body: tuple[int, int]) -> tuple[int, int]:
        kept, self.at = self.at, body[0]
        out = self._item()
        self.at = kept
        return out

    def _item(self) -> tuple[int, int]:
        c = self.text[self.at]
        if c == "(":
            self.at += 1
            out = self._alternatives()
            self.at += 1
            return out
        if c == "[":
            return self._byte(self._class())
        if c == "\\":
            self.at += 1
            c = self.text[self.at]
        self.at += 1
        return self._byte(frozenset(c.encode()))

    def _class(self) -> frozenset:
        self.at += 1
        found: set[int] = set()
        while self.text[self.at] != "]":
            escaped = self.text[self.at] == "\\"
            self.at += escaped
            low = high = ord(self.text[self.at])
            self.at += 1
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                high = ord(self.text[self.at + 1])
                self.at += 2
            found |= set(range(low, high + 1))
        self.at += 1
        return frozenset(found)

    def _times(self) -> tuple[int, int | None]:
        c = self.text[self.at : self.at + 1]
        if c and c in "?*+":
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            close = self.text.index("}", self.at)
            low = int(self.text[self.at + 1 : close].rstrip(","))
            self.at = close + 1
            return low, None
        return 1, 1

    def _byte(self, allowed: frozenset) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.moves[a] = (allowed, b)
        return a, b


@dataclass(frozen=True)
class Dfa:
    """`step[state, byte]` is the next state; state 0 starts. Dead ends are state `dead` (-1: none)."""

    step: np.ndarray
    accepts: np.ndarray
    dead: int


def _refined(step: np.ndarray, outputs: np.ndarray) -> np.ndarray:
    """Minimisation: classes of states of equal output are split until all members of a class move alike. Returns the
    state's name, 0 for the first one's, in the order of their first members."""
    classes = np.unique(outputs, return_inverse=True)[1].reshape(-1)
    while True:
        refined = np.unique(np.concatenate([classes[:, None], classes[step]], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        if refined.max() == classes.max():
            break
        classes = refined
    _, first, members = np.unique(classes, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[members.reshape(-1)]


def compile_dfa(pattern: str) -> Dfa:
    """Minimal automaton of a pattern, for matches that begin where it starts."""
    nfa = _Nfa()
    start, final = nfa.parse(pattern)

    def close(states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.moves[s] or s == final)

    first = close({start})
    ids, order, rows = {first: 0}, [first], []
    for states in order:
        targets: list[set[int]] = [set() for _ in range(256)]
        for s in states:
            if nfa.moves[s]:
                allowed, t = nfa.moves[s]
                for byte in allowed:
                    targets[byte].add(t)
        row = []
        for raw in targets:
            reached = close(raw)
            if reached not in ids:
                ids[reached] = len(order)
                order.append(reached)
            row.append(ids[reached])
        rows.append(row)
    step, accepts = np.array(rows), np.array([final in s for s in order])
    names = _refined(step, accepts)
    out, acc = np.zeros((names.max() + 1, 256), np.int32), np.zeros(names.max() + 1, bool)
    out[names], acc[names] = names[step], accepts
    dead = [s for s in range(len(out)) if not acc[s] and (out[s] == s).all()]
    return Dfa(out, acc, dead[0] if dead else -1)


def _depths(dfa: Dfa) -> list[int | None]:
    """How many bytes lead to each state, None where ways of several lengths do."""
    seen: dict[int, int | None] = {0: 0}
    todo = [0]
    while todo:
        s = todo.pop()
        for t in set(dfa.step[s].tolist()) - {dfa.dead}:
            d = None if seen[s] is None else seen[s] + 1
            if t not in seen or (seen[t] is not None and seen[t] != d):
                seen[t] = d if t not in seen else None
                todo.append(t)
    return [seen.get(s) for s in range(len(dfa.step))]


#: Column of the transition array that ends a text.
END = 256


@dataclass(frozen=True)
class Scanner:
    """`step[state, byte or END]` is the next state, `acts[state]` what entering it does, one entry for each rule that
    does anything: (rule, ends, begins, holds).

    ends: a match ended before this byte; begins: where the rule's open matches began, for its registers; holds: the
    open match holds from this byte on. A place is a register if not negative, else -1 - (bytes back from this one)."""

    step: np.ndarray
    acts: tuple


def compile_scanner(patterns: tuple[str, ...]) -> Scanner:
    """One minimal automaton that places the matches of all patterns. Refused with ValueError: patterns that match
    nothing at all, that stop to hold before a longer match, or of which a match can lie inside an open older one."""
    dfas = [compile_dfa(p) for p in patterns]
    depths = [_depths(d) for d in dfas]
    columns = np.unique(np.concatenate([d.step for d in dfas]), axis=1, return_index=True, return_inverse=True)
    sample, class_of = columns[1].tolist(), columns[2].reshape(-1)  # bytes that no rule tells apart are one column

    @lru_cache(maxsize=None)
    def advance(r: int, open_at: tuple, byte: int) -> tuple:
        dfa, depth = dfas[r], depths[r]
        now, places, ends, holds, register = [], [], None, False, 0
        for k, q in enumerate((*open_at, 0)):
            fresh = k == len(open_at)
            place = -1 if fresh else register if depth[q] is None else -1 - depth[q]
            register += not fresh and depth[q] is None
            t = dfa.dead if byte == END else int(dfa.step[q, byte])
            if t == dfa.dead:
                if dfa.accepts[q]:
                    ends = place
                continue
            if dfa.accepts[q] and not dfa.accepts[t]:
                raise ValueError(f"{patterns[r]!r}: a match may stop to hold and go on")
            if t in now:
                continue
            now.append(t)
            places.append(place)
            if dfa.accepts[t]:
                if len(now) > 1:
                    raise ValueError(f"{patterns[r]!r}: a match may lie inside an open one")
                holds = not dfa.accepts[q]
                break  # the oldest match holds: no other begins inside it
        begins = tuple(p for p, t in zip(places, now, strict=True) if depth[t] is None)
        begins = None if begins == tuple(range(len(begins))) else begins
        act = (r, ends, begins, holds) if ends is not None or begins or holds else None
        return tuple(now), act

    if any(d.accepts[0] or d.dead < 0 for d in dfas):
        raise ValueError("a pattern matches nothing at all, or never ends")
    first = (((),) * len(dfas), ())
    ids, order, rows = {first: 0}, [first], []
    for open_at, _ in order:
        row = []
        for byte in (*sample, END):
            made = [advance(r, x, byte) for r, x in enumerate(open_at)]
            state = (tuple(x for x, _ in made), tuple(a for _, a in made if a))
            if state not in ids:
                ids[state] = len(order)
                order.append(state)
            row.append(ids[state])
        rows.append(row)
    step = np.array(rows)
    kinds: dict[tuple, int] = {}
    outputs = np.array([kinds.setdefault(acts, len(kinds)) for _, acts in order])
    names = _refined(step, outputs)
    out, acts = np.zeros((names.max() + 1, step.shape[1]), np.int32), [()] * (names.max() + 1)
    out[names] = names[step]
    for name, (_, act) in zip(names.tolist(), order, strict=True):
        acts[name] = act
    return Scanner(out[:, [*class_of.tolist(), len(sample)]], tuple(acts))


@lru_cache(maxsize=8)
def _machine(rules: tuple[Rule, ...]) -> list:
    """The transition array as rows that hold their successor rows, one index per byte in the scan, and then the acts."""
    scanner = compile_scanner(tuple(r.pattern for r in rules))
    rows: list[list] = [[] for _ in scanner.acts]
    for row, targets, acts in zip(rows, scanner.step.tolist(), scanner.acts, strict=True):
        row += [rows[t] for t in targets]
        row.append(acts)
    return rows[0]


def find_secrets(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then rule order."""
    row = _machine(rules)
    data = utf8(text)
    began: list[list[int]] = [[] for _ in rules]
    held = [0] * len(rules)
    found = []
    for i, byte in enumerate(chain(data, (END,))):  # the one pass: every rule advances with each byte
        row = row[byte]
        if row[-1]:
            for r, ends, begins, holds in row[-1]:
                if ends is not None and i - held[r] >= rules[r].least:
                    found.append((began[r][ends] if ends >= 0 else i + 1 + ends, r, i))
                if begins is not None:
                    began[r] = [began[r][k] if k >= 0 else i + 1 + k for k in begins]
                if holds:
                    held[r] = i
    if found and len(data) != len(text):
        starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        found = [(int(np.searchsorted(starts, a)), r, int(np.searchsorted(starts, b))) for a, r, b in found]
    return [(rules[r].kind, a, b) for a, r, b in sorted(found)]


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Text with each span replaced by [kind]; overlapping spans become one."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A narrow map: no shuffle, whole texts, a batch at a time. See the module for odd input.
    """
    base = {r.kind for r in rules if r.base}

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in batch.column("text").to_pylist():
                found = find_secrets(text, rules)
                kinds = [k for k, _, _ in found]
                join = lambda rows: ",".join(f"{k}:{a}:{b}" for k, a, b in rows)
                digest = hashlib.sha256(join([x for x in found if x[0] in base]).encode()).hexdigest()
                for col, value in zip(cols, (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, join(found)), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every secret replaced by its [kind] in the text; other columns stay as they are."""
    at = docs.columns.index("text")

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [redact(t, find_secrets(t, rules)) for t in batch.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(scan, docs.schema)
