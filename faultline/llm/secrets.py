"""Secret scans with one combined, minimised byte automaton.

Every rule regex becomes an NFA; the product of all rules is determinised by subset construction,
minimised, and stored as two transition arrays (``next`` and ``emit``). A text is scanned once, byte
by byte, for all rules together. A rule's component keeps its threads ordered by start, so the
automaton reports leftmost, longest, non-overlapping matches; when the leftmost thread has matched
and cannot go on, the component restarts at that byte and the transition emits the rule. The start
of a reported match is found by the rule's reversed automaton, bounded by the rule's previous match.

Offsets are code points, end exclusive. Null and empty texts have no spans. Rows are independent, so
repeated rows, ties and empty tables need no special case; columns other than the id and the text
are never read by ``scan``, so clashing extra columns do no harm.
"""

from __future__ import annotations

import operator
import re
import re._constants as C
import re._parser as regex_parser
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex over bytes, a test that a match must pass to be reported, and the end of
    what it opens, given the bytes and the end of the match."""

    kind: str
    pattern: str
    valid: Callable[[bytes], bool] = field(default=lambda match: True)
    base: bool = False
    extent: Callable[[bytes, int], int] = field(default=lambda data, end: end)


def _long_value(match: bytes) -> bool:
    """An assignment counts if the value right of its first ``:`` or ``=`` has 12 characters."""
    cut = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[cut + 1 :].lstrip(b" ")
    return len(value[1:] if value[:1] in (b'"', b"'") else value) >= 12


def _at_least(length: int) -> Callable[[bytes], bool]:
    return lambda match: len(match) >= length


_BOUNDARY = re.compile(rb"-----(BEGIN|END) ([A-Z0-9 ]*+)-----")
_GAP = rb"""(?:[\s>#|*"',]|\\[nrt])*+"""
_RUN = rb"[A-Za-z0-9+/]{16,}+={0,2}"
#: Headers and runs of base64; after a run, also shorter ones that fill a line or end in padding.
_BODY = re.compile(
    rb"(?:" + _GAP + rb"[A-Za-z][A-Za-z0-9-]*+:[^\n\\]*+)*+" + _GAP + _RUN
    + rb"(?:" + _GAP + _RUN + rb"|(?:\r?\n|\\r\\n|\\n)[\x20\t>#|*\"',]*+[A-Za-z0-9+/]++={0,2}(?=[\x20\t\"',]*+(?:[\r\n\\]|\Z))|" + _GAP + rb"[A-Za-z0-9+/]++={1,2})*+"
)


def _key_end(data: bytes, end: int) -> int:
    """The end of a private key after its BEGIN line: its END line, or its last base64 line if another
    heading or the end of the text comes first. Each search ends at the next heading."""
    edge = _BOUNDARY.search(data, end)
    if edge and edge[1] == b"END" and edge[2].endswith(b"PRIVATE KEY"):
        return edge.end()
    body = _BODY.match(data, end, edge.start() if edge else len(data))
    return body.end() if body else end


# The rules, in the order of their kinds. Hex runs are so common that their length is
# counted by the automaton (a run is maximal, so this keeps the same matches as a test afterwards);
# the other lengths are tests, as counters of several rules would multiply the states.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", _long_value, True),
    Rule("access", r"AKIA[A-Z0-9]+", _at_least(18), True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", _at_least(40)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", _at_least(15)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", extent=_key_end),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)


class Nfa:
    """Thompson construction over bytes from a parsed regex."""

    def __init__(self, pattern: str, reverse: bool = False):
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []
        self.reverse = reverse
        self.start = self._new()
        self.accept = self._sequence(list(regex_parser.parse(pattern)), self.start, False)

    def _new(self) -> int:
        self.steps.append([])
        self.empty.append([])
        return len(self.steps) - 1

    def _sequence(self, items: list, at: int, fold: bool) -> int:
        for op, arg in reversed(items) if self.reverse else items:
            at = self._item(op, arg, at, fold)
        return at

    def _bytes(self, at: int, members: set[int], fold: bool) -> int:
        if fold:
            members = members | {ord(chr(b).swapcase()) for b in members if chr(b).isalpha()}
        if any(b > 127 for b in members):
            raise ValueError("rules name ASCII characters only")
        end = self._new()
        self.steps[at].append((frozenset(members), end))
        return end

    def _item(self, op, arg, at: int, fold: bool) -> int:
        if op is C.LITERAL:
            return self._bytes(at, {arg}, fold)
        if op is C.IN:
            members: set[int] = set()
            for kind, value in arg:
                if kind is C.LITERAL:
                    members.add(value)
                elif kind is C.RANGE:
                    members.update(range(value[0], value[1] + 1))
                else:
                    raise ValueError(f"unsupported class item {kind}")
            return self._bytes(at, members, fold)
        if op is C.SUBPATTERN:
            return self._sequence(list(arg[3]), at, fold or bool(arg[1] & 2))
        if op is C.BRANCH:
            end = self._new()
            for branch in arg[1]:
                first = self._new()
                self.empty[at].append(first)
                self.empty[self._sequence(list(branch), first, fold)].append(end)
            return end
        if op is C.MAX_REPEAT:
            low, high, body = arg
            for _ in range(low):
                at = self._sequence(list(body), at, fold)
            if high is C.MAXREPEAT:
                loop = self._new()
                self.empty[at].append(loop)
                self.empty[self._sequence(list(body), loop, fold)].append(loop)
                return loop
            end = self._new()
            self.empty[at].append(end)
            for _ in range(high - low):
                at = self._sequence(list(body), at, fold)
                self.empty[at].append(end)
            return end
        raise ValueError(f"unsupported regex item {op}")

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for q in self.empty[todo.pop()]:
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        return frozenset(seen)

    def move(self, states, byte: int) -> frozenset[int]:
        return self.closure({q for s in states for members, q in self.steps[s] if byte in members})


class _Component:
    """One rule inside the product: threads ordered by start, earliest first."""

    def __init__(self, nfa: Nfa):
        self.nfa = nfa
        self.begin = nfa.closure({nfa.start})
        if nfa.accept in self.begin:
            raise ValueError("a rule may not match the empty text")

    @lru_cache(maxsize=None)  # noqa: B019  lives as long as the compiled rules
    def step(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        """The next threads, and whether a match of this rule ended before the byte."""
        matched = bool(state) and self.nfa.accept in state[0]
        groups = state if matched else (*state, self.begin)
        after = self._advance(groups, byte)
        if matched and not after:
            return self._advance((self.begin,), byte), True
        return after, False

    def _advance(self, groups: tuple, byte: int) -> tuple:
        out, taken = [], set()
        for group in groups:
            if alive := self.nfa.move(group, byte) - taken:
                taken |= alive
                if self.nfa.accept in alive:
                    if out:
                        raise ValueError("a later start may match before an earlier one ends: rewrite the rule")
                    return (alive,)
                out.append(alive)
        return tuple(out)

    def ended(self, state: tuple) -> bool:
        return bool(state) and self.nfa.accept in state[0]


def _byte_classes(nfas: list[Nfa]) -> tuple[np.ndarray, list[int]]:
    """A class number for each byte, and one byte of each class."""
    sets = list(dict.fromkeys(members for nfa in nfas for steps in nfa.steps for members, _ in steps))
    keys: dict[tuple, int] = {}
    classes = np.zeros(256, np.uint8)
    samples: list[int] = []
    for byte in range(256):
        key = tuple(byte in members for members in sets)
        if key not in keys:
            keys[key] = len(samples)
            samples.append(byte)
        classes[byte] = keys[key]
    return classes, samples


def _minimise(nxt: np.ndarray, emit: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moore's refinement of a machine with outputs on its transitions; state 0 stays first."""
    _, block = np.unique(np.column_stack([emit, final]), axis=0, return_inverse=True)
    block = block.reshape(-1)
    while True:
        _, finer = np.unique(np.column_stack([block, block[nxt]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    _, first = np.unique(block, return_index=True)
    order = np.argsort(first)  # blocks by their earliest state, so the start keeps number 0
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    keep = first[order]
    return rank[block[nxt[keep]]], emit[keep], final[keep]


class Automaton:
    """The product of all rules as transition arrays ``next[state, class]`` and ``emit[state, class]``.

    ``emit`` and ``final`` are bit masks of rules: those whose match ended before the byte, or at the
    end of the text. A rule qualifies if every live state after its first acceptance accepts.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        nfas = [Nfa(rule.pattern) for rule in rules]
        parts = [_Component(nfa) for nfa in nfas]
        self.classes, samples = _byte_classes(nfas)
        states: dict[tuple, int] = {tuple(() for _ in parts): 0}
        todo, nxt, emit, final = list(states), [], [], []
        for state in todo:  # grows while it runs
            row, out = [], []
            for byte in samples:
                mask, target = 0, []
                for k, part in enumerate(parts):
                    threads, ended = part.step(state[k], byte)
                    if part.ended(state[k]) and threads and not ended and part.nfa.accept not in threads[0]:
                        raise ValueError(f"{rules[k].kind}: what follows a match must match too")
                    mask |= ended << k
                    target.append(threads)
                key = tuple(target)
                if key not in states:
                    states[key] = len(states)
                    todo.append(key)
                row.append(states[key])
                out.append(mask)
            nxt.append(row)
            emit.append(out)
            final.append(sum(part.ended(s) << k for k, (part, s) in enumerate(zip(parts, state))))
        self.raw_states = len(states)
        self.next, self.emit, self.final = _minimise(np.array(nxt), np.array(emit), np.array(final))
        self.back = [_Backward(rule.pattern) for rule in rules]


class _Backward:
    """The reversed rule: the earliest start of a match that ends at a given byte."""

    def __init__(self, pattern: str):
        self.nfa = Nfa(pattern, reverse=True)
        self.begin = self.nfa.closure({self.nfa.start})
        self.step = lru_cache(maxsize=None)(self.nfa.move)

    def start(self, data: bytes, end: int, floor: int) -> int:
        state, found = self.begin, end
        for at in range(end - 1, floor - 1, -1):
            state = self.step(state, data[at])
            if not state:
                break
            if self.nfa.accept in state:
                found = at
        return found


class _Event:
    """A transition that reports rules; it cannot be indexed, which is what stops the fast loop."""

    __slots__ = ("mask", "row")

    def __init__(self, mask: int, row: list):
        self.mask, self.row = mask, row


class Scanner:
    """Runs the automaton: each state is a list of 256 links, so a byte costs one list access."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.automaton = a = Automaton(rules)
        rows: list[list] = [[None] * 257 for _ in range(len(a.next))]
        links: dict[tuple[int, int], _Event] = {}
        for s, row in enumerate(rows):
            by_class = []
            for t, mask in zip(a.next[s].tolist(), a.emit[s].tolist()):
                by_class.append(links.setdefault((mask, t), _Event(mask, rows[t])) if mask else rows[t])
            row[:256] = [by_class[c] for c in a.classes.tolist()]
            row[256] = int(a.final[s])
        self.first = rows[0]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, rule mask) of each report, in one pass over the bytes."""
        found: list[tuple[int, int]] = []
        row, todo = self.first, iter(data)
        while True:
            try:
                for byte in todo:
                    row = row[byte]
                break
            except TypeError:  # the row reached by the byte before was a report
                at = len(data) - operator.length_hint(todo) - 1
                found.append((at - 1, row.mask))
                row = row.row[byte]
        if isinstance(row, _Event):
            found.append((len(data) - 1, row.mask))
            row = row.row
        if row[256]:
            found.append((len(data), row[256]))
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule number) in bytes, valid matches only, by start and then rule."""
        rules, back = self.automaton.rules, self.automaton.back
        floor, out = [0] * len(rules), []
        for end, mask in self.ends(data):
            for k, rule in enumerate(rules):
                if mask >> k & 1:
                    start = back[k].start(data, end, floor[k])
                    floor[k] = end
                    if rule.valid(data[start:end]):
                        out.append((start, rule.extent(data, end), k))
        return sorted(out, key=lambda s: (s[0], s[2]))

    def points(self, data: bytes) -> list[tuple[int, int, int]]:
        """``spans`` in code points."""
        out, at, point = [], 0, 0
        for start, end, k in self.spans(data):  # starts never fall
            point += len(data[at:start].decode("utf-8", "surrogatepass"))
            at = start
            out.append((point, point + len(data[start:end].decode("utf-8", "surrogatepass")), k))
        return out


@lru_cache(maxsize=4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: the id, and ``spans`` of all kinds, by start and then kind as listed."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(RULES)
        kinds = [rule.kind for rule in RULES]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": kinds[k], "start": s, "end": e} for s, e, k in scanner.points((text or "").encode())] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], [id_column, "spans"])

    return arrow_map(docs.select(id_column, text_column), work, f"`{id_column}` {id_type}, spans {SPANS}", text_column)


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows: counts of the base kinds, the digest of the base spans, and all spans as text."""
    base = [rule.kind for rule in RULES if rule.base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[secret]") -> DataFrame:
    """All rows and columns; every span in the text (overlaps merged) becomes ``mark``; null stays null."""
    fields = docs.columns
    at = fields.index(text_column)

    def clean(scanner: Scanner, text: str | None) -> str | None:
        data = (text or "").encode()
        if not (spans := scanner.spans(data)):
            return text
        out, done = [], 0
        for start, end, _ in spans:
            if start >= done:
                out += [data[done:start], mark.encode()]
            done = max(done, end)
        return b"".join([*out, data[done:]]).decode()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(RULES)
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(scanner, t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, fields)

    return arrow_map(docs, work, docs.schema, text_column)
