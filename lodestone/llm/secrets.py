"""Secret scan: one deterministic automaton for all rules.

The rules are written in a small regex dialect, compiled by Thompson and subset construction into one automaton over
UTF-8 bytes, minimised (Moore's partition refinement) and laid out as arrays.  Every text passes it once, byte by byte;
thousands of stretches of text advance together, one array look-up per step.  Stretches are cut at bytes that
send every state to the start; where there is none for long, anywhere, and a stretch whose guessed first state was wrong is
passed again from the right one.  The pass yields the rules each text holds; spans are then read off by the automaton of the
single rule, from the left, longest first, without overlap.

Rows: a null text is empty; empty and null texts have zero counts and empty span lists; very long texts are scanned whole, in time
that grows with their length; repeated rows give repeated results; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, table, utf8


@dataclass(frozen=True)
class Rule:
    """kind; pattern; least: code points that a kept match must have; least_value: those that its value, after : or =, must have.
    seen: what the combined pass looks for, where that differs: something that every kept match holds, so that the pass keeps few states."""

    kind: str
    pattern: str
    least: int = 0
    least_value: int = 0
    seen: str = ""


# The three base rules, then those this scan adds.
RULES = (
    Rule("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]+", least_value=12, seen="([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=]"),
    Rule("access", "AKIA[A-Z0-9]+", least=18, seen="AKIA[A-Z0-9]{4}"),
    Rule("hex", "[0-9a-f]+", least=16, seen="[0-9a-f]{16}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40, seen="gh[pousr]_"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=15, seen="xox[abprs]-"),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39, seen="AIza"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", least=40, seen="eyJ"),
)
BASE = 3


class _Parser:
    """Literals, \\-escapes, [...] with ranges, (...|...), ?, *, + and {n}, into Thompson fragments over bytes."""

    def __init__(self, nfa: Nfa, text: str):
        self.nfa, self.text, self.at = nfa, text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def alternatives(self) -> tuple[int, int]:
        first, last = self.nfa.state(), self.nfa.state()
        while True:
            a, b = self.sequence()
            self.nfa.free[first].append(a)
            self.nfa.free[b].append(last)
            if self.peek() != "|":
                return first, last
            self.at += 1

    def sequence(self) -> tuple[int, int]:
        first = last = self.nfa.state()
        while self.peek() not in ("", "|", ")"):
            begin = self.at
            a, b = self.atom()
            sign = self.peek()
            if sign and sign in "?*+":
                self.at += 1
                if sign in "?*":
                    self.nfa.free[a].append(b)
                if sign in "*+":
                    self.nfa.free[b].append(a)
            elif sign == "{":
                end, stop = self.at, self.text.index("}", self.at)
                times = int(self.text[self.at + 1 : stop])
                for _ in range(times - 1):
                    self.at = begin
                    c, d = self.atom()
                    self.nfa.free[b].append(c)
                    b = d
                assert self.at == end
                self.at = stop + 1
            self.nfa.free[last].append(a)
            last = b
        return first, last

    def atom(self) -> tuple[int, int]:
        if self.peek() == "(":
            self.at += 1
            out = self.alternatives()
            self.at += 1
            return out
        a, b = self.nfa.state(), self.nfa.state()
        self.nfa.moves[a].append((self.members(), b))
        return a, b

    def members(self) -> frozenset[int]:
        c = self.peek()
        self.at += 1
        if c == "\\":
            self.at += 1
            return frozenset(self.text[self.at - 1].encode())
        if c != "[":
            return frozenset(c.encode())
        stop = self.text.index("]", self.at)
        inner, out, i = self.text[self.at : stop], set(), 0
        self.at = stop + 1
        while i < len(inner):
            if inner[i + 1 : i + 2] == "-" and i + 2 < len(inner):
                out |= set(range(ord(inner[i]), ord(inner[i + 2]) + 1))
                i += 3
            else:
                out.add(ord(inner[i]))
                i += 1
        return frozenset(out)


class Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.ends: dict[int, int] = {}

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1


@dataclass(frozen=True)
class Automaton:
    """step[state * classes + of_byte[byte]] is the next state; ends[state] has a bit for each rule that a match of it ends there."""

    of_byte: np.ndarray
    step: np.ndarray
    ends: np.ndarray
    classes: int
    start: int
    dead: int


def compile_rules(patterns: Iterable[str], anywhere: bool) -> Automaton:
    """Subset construction and minimisation.  anywhere: a match may begin at any byte; else at the first only."""
    nfa = Nfa()
    root = nfa.state()
    for i, pattern in enumerate(patterns):
        first, last = _Parser(nfa, pattern).alternatives()
        nfa.free[root].append(first)
        nfa.ends[last] = 1 << i
    sets = {m for moves in nfa.moves for m, _ in moves}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    number = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    of_byte, example = np.array([number[s] for s in signature], np.int32), [signature.index(s) for s in number]

    def closed(states: Iterable[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in nfa.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    base = closed([root])
    found, todo, rows = {base: 0}, deque([base]), []
    while todo:
        now, row = todo.popleft(), []
        for byte in example:
            to = {t for s in now for m, t in nfa.moves[s] if byte in m}
            to = closed(to) | base if anywhere else closed(to)
            if to not in found:
                found[to] = len(found)
                todo.append(to)
            row.append(found[to])
        rows.append(row)
    step = np.array(rows, np.int32)
    ends = np.array([sum({nfa.ends.get(s, 0) for s in states}) for states in found], np.int32)
    block = np.unique(ends, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    kept = np.unique(block, return_index=True)[1]
    dead = block[found[frozenset()]] if frozenset() in found else -1
    return Automaton(of_byte, block[step[kept]].astype(np.int32).ravel(), ends[kept], step.shape[1], int(block[0]), int(dead))


@cache
def combined(rules: tuple[Rule, ...] = RULES) -> Automaton:
    return compile_rules([r.seen or r.pattern for r in rules], anywhere=True)


@cache
def single(rule: Rule) -> tuple[list[int], list[list[int]], list[bool], int, int, np.ndarray]:
    """The rule's own automaton as lists, for a walk over one match, and the bytes with which a match begins."""
    a = compile_rules([rule.pattern], anywhere=False)
    rows = a.step.reshape(-1, a.classes)
    return a.of_byte.tolist(), rows.tolist(), (a.ends > 0).tolist(), a.start, a.dead, rows[a.start][a.of_byte] != a.dead


def _advance(begin: np.ndarray, length: np.ndarray, entry: np.ndarray, coded: np.ndarray, a: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches from their entry states, all together: their last states, and stretch, place and state of each byte that ends a match."""
    step, hit = (a.step * a.classes).astype(np.int32), np.zeros(len(a.ends) * a.classes, bool)
    hit[np.flatnonzero(a.ends) * a.classes] = True
    order = np.argsort(-length, kind="stable")  # long ones first: those still under way stay in front
    at, state = begin[order], (entry[order] * a.classes).astype(np.int32)
    n = length[order]
    live = np.searchsorted(-n, -np.arange(n[0]), side="left") if len(n) else []
    lanes, places, states = [], [], []
    for k, m in enumerate(live):
        s = step[state[:m] + coded[at[:m] + k]]
        state[:m] = s
        if hit[s].any():
            i = np.flatnonzero(hit[s])
            lanes.append(order[i])
            places.append(at[i] + k)
            states.append(s[i] // a.classes)
    out = np.empty(len(begin), np.int64)
    out[order] = state // a.classes
    join = lambda xs: np.concatenate([*xs, np.zeros(0, np.int64)]).astype(np.int64)
    return out, join(lanes), join(places), join(states)


def _unknown(known: dict[tuple[int, int], int], guessed: list[bool], start: int, entry: np.ndarray) -> list[tuple[int, int]]:
    """Sets the stretches' entry states as far as the last states of those before are known.  Where one isn't, the same entry is asked
    for all stretches up to the next clearing byte, as a state that lasts, lasts long."""
    todo, k, n = [], 0, len(guessed)
    while k < n:
        entry[k] = e = known[k - 1, int(entry[k - 1])] if guessed[k] else start
        k += 1
        if (k - 1, e) in known:
            continue
        todo.append((k - 1, e))
        while k < n and guessed[k]:
            if (k, e) not in known:
                todo.append((k, e))
            k += 1
    return todo


def rules_in(offsets: np.ndarray, data: np.ndarray, a: Automaton, lanes: int = 8192, reach: int = 512) -> np.ndarray:
    """The one pass: a bit mask, for each text, of the rules of which it holds a match.  reach: how far a cut looks for a clearing byte."""
    out = np.zeros(len(offsets) - 1, np.int32)
    rows = a.step.reshape(-1, a.classes)
    clears = np.flatnonzero((rows == a.start).all(axis=0))
    clearing = np.isin(a.of_byte, clears)
    assert int(a.of_byte[0]) in clears
    # Texts are parted by a zero byte, which clears the state, and so are the stretches.
    n = len(data) + len(out)
    if not n:
        return out
    gap = np.zeros(n, bool)
    first = offsets[:-1] + np.arange(len(out))
    gap[offsets[1:] + np.arange(len(out))] = True
    text = np.zeros(n, np.uint8)
    text[~gap] = data
    cuts = np.append(np.flatnonzero(clearing[text]) + 1, n)
    want = np.linspace(0, n, min(lanes, max(1, n // 256)) + 1)[1:-1].astype(np.int64)
    clear = cuts[np.searchsorted(cuts, want)]
    begin = np.unique(np.concatenate([[0], np.where(clear - want <= reach, clear, want)]))
    begin = begin[begin < n]
    guessed = (begin > 0) & ~clearing[text[begin - 1]]
    length, coded = np.diff(np.append(begin, n)), a.of_byte.astype(np.uint8)[text]
    entry = np.full(len(begin), a.start, np.int64)
    last, hits, place, state = _advance(begin, length, entry, coded, a)
    came = entry[hits]
    if (guessed[1:] & (last[:-1] != a.start)).any():
        known = {(k, a.start): e for k, e in enumerate(last.tolist())}
        while todo := _unknown(known, guessed.tolist(), a.start, entry):
            again, e = (np.array(x, np.int64) for x in zip(*todo))
            ends, h, p, s = _advance(begin[again], length[again], e, coded, a)
            known |= zip(todo, ends.tolist())
            hits, came, place, state = (np.concatenate(x) for x in ((hits, again[h]), (came, e[h]), (place, p), (state, s)))
        right = entry[hits] == came
        place, state = place[right], state[right]
    np.bitwise_or.at(out, np.searchsorted(first, place, side="right") - 1, a.ends[state])
    return out


MARK = 16


def spans_of(text: bytes, rule: Rule) -> list[tuple[int, int]]:
    """Byte spans of the rule's matches, leftmost and longest, without overlap; those too short are dropped afterwards.
    A place and state, noted every MARK bytes, from which a walk met no end isn't walked from again, so the time is linear."""
    of_byte, rows, ends, start, dead, begins = single(rule)
    out, free, states, fruitless = [], 0, len(rows), set()
    for s in np.flatnonzero(begins[np.frombuffer(text, np.uint8)]).tolist():
        if s < free:
            continue
        state, end, i, passed = start, 0, s, []
        while i < len(text):
            state = rows[state][of_byte[text[i]]]
            i += 1
            if state == dead:
                break
            if ends[state]:
                end = i
            if not i % MARK:
                if (mark := i * states + state) in fruitless:
                    break
                passed.append(mark)
        fruitless.update(x for x in passed if x // states > end)
        if end:
            free = end
            if end - s >= rule.least and _value(text[s:end], rule) >= rule.least_value:
                out.append((s, end))
    return out


def _value(match: bytes, rule: Rule) -> int:
    """Length of the match's value: what follows the first : or = with its blanks and one quote."""
    if not rule.least_value:
        return 0
    i = min(x for x in (match.find(b":"), match.find(b"=")) if x >= 0) + 1
    while match[i : i + 1] == b" ":
        i += 1
    return len(match) - i - (match[i : i + 1] in (b'"', b"'"))


OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], automaton: Automaton) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for b in batches:
        offsets, data = utf8(b.column(1))
        n = len(b)
        found = rules_in(offsets, data, automaton)
        counts, sha, listed = np.zeros((len(rules), n), np.int64), [nothing] * n, [""] * n
        for i in np.flatnonzero(found).tolist():
            raw = data[offsets[i] : offsets[i + 1]]
            text, points = raw.tobytes(), np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            spans = [(int(points[s]), k, int(points[e])) for k, r in enumerate(rules) if found[i] >> k & 1 for s, e in spans_of(text, r)]
            spans.sort()
            for _, k, _ in spans:
                counts[k, i] += 1
            said = lambda xs: ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in xs)
            sha[i], listed[i] = hashlib.sha256(said([x for x in spans if x[1] < BASE]).encode()).hexdigest(), said(spans)
        yield batch(OUT, doc_id=b.column(0), n_assign=counts[0], n_access=counts[1], n_hex=counts[2], base_sha256=sha, spans=listed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document: counts of the base kinds, their digest and all spans as kind:start:end in code points.  The first three rules are the base."""
    automaton = combined(rules)  # compiled once, on the driver; tasks get its arrays
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(lambda bs: _digests(bs, rules, automaton), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redacted(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], automaton: Automaton, column: int, chars: int | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        offsets, data = utf8(b.column(column))
        found = rules_in(offsets, data, automaton)
        dirty = np.flatnonzero(found).tolist()
        columns = list(b.columns)
        if dirty:
            texts = b.column(column).to_pylist()
            for i in dirty:
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                spans = sorted((s, e, r.kind) for k, r in enumerate(rules) if found[i] >> k & 1 for s, e in spans_of(text, r))
                out, at = [], 0
                for s, e, kind in spans:
                    if s >= at:
                        out += [text[at:s], f"[{kind}]".encode()]
                    at = max(at, e)
                texts[i] = b"".join([*out, text[at:]]).decode()
            columns[column] = pa.array(texts, b.column(column).type)
            if chars is not None:
                n = b.column(chars).to_pylist()
                for i in dirty:
                    n[i] = len(texts[i])
                columns[chars] = pa.array(n, b.column(chars).type)
        yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All documents and columns, with [kind] in place of each secret (overlapping ones as one) and n_chars, if there, to match."""
    automaton, column = combined(rules), docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return docs.mapInArrow(lambda bs: _redacted(bs, rules, automaton, column, chars), docs.schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
