"""Secret scan by one combined deterministic automaton.

Every rule is a regular expression over bytes.  ``compile_rules`` builds one
automaton for ``.*reverse(rule)`` of all rules together: positions of the
expressions (Glushkov) -> subset construction -> minimisation -> one flat
transition array over byte classes.  Read from the end of a text to its start,
it is in an accepting state exactly where some rule has a match that *starts*,
so a single pass over the bytes finds the starts of all rules.  The end of
each match comes from the rule's own forward automaton, run only from those
starts; matches are leftmost, longest and do not overlap within a kind, and a
match that is too short is dropped after it has used up its bytes.

Nulls and empty texts have no spans.  Repeated rows are scanned each for
itself.  Other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import load


@dataclass(frozen=True)
class Rule:
    """``pattern``: literals, ``[...]`` with ranges, ``(a|b)``, ``? * +`` and ``\\xNN``.

    ``least`` is the least length of the whole match, ``least_value`` that of
    the trailing run of the last class (0: not asked).
    """

    kind: str
    pattern: str
    least: int = 0
    least_value: int = 0
    fold: bool = False


#: The base kinds and their patterns, then further well-known token shapes.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", least_value=6, fold=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f]+"),
    Rule("github", r"gh(p|o|u|s|r)_[A-Za-z0-9]+", least=30),
    Rule("slack", r"xox(a|b|p|r|s)-[A-Za-z0-9-]+", least=20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=35),
    Rule("session", r"ASIA[A-Z0-9]+", least=20),
    Rule("aws_secret", r"""aws_?secret_?access_?key["']?\x20*[:=]\x20*["']?[A-Za-z0-9/+=]+""", least_value=40, fold=True),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]+", least=27),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    # To the END line; where there is none, the lines of the body that follow.
    Rule("pem", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----(([\x09\x0A\x0D\x20-\x2C\x2E-\x7E]|-[\x09\x0A\x0D\x20-\x2C\x2E-\x7E])*-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----|(\x20*\x0D?(\x0A|\\n)[A-Za-z0-9+/=]+)*)"),
)
BASE_KINDS = ("assign", "access", "hex")


# -- patterns to position automata -------------------------------------------------


class _Parser:
    """A pattern's Glushkov sets; each position holds a set of bytes."""

    def __init__(self, pattern: str, fold: bool):
        self.text, self.at, self.fold = pattern, 0, fold
        self.bytes: list[frozenset[int]] = []
        self.follow: list[set[int]] = []
        self.null, self.first, self.last = self.either()
        if self.at != len(pattern):
            raise ValueError(f"can't read {pattern!r} at {self.at}")

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def either(self):
        null, first, last = self.sequence()
        while self.peek() == "|":
            self.at += 1
            n, f, l = self.sequence()
            null, first, last = null or n, first | f, last | l
        return null, first, last

    def sequence(self):
        null, first, last = True, set(), set()
        while self.peek() not in ("", "|", ")"):
            n, f, l = self.repeated()
            for p in last:
                self.follow[p] |= f
            first = first | f if null else first
            last = last | l if n else l
            null = null and n
        return null, first, last

    def repeated(self):
        null, first, last = self.atom()
        while self.peek() in ("?", "*", "+") and self.peek():
            mark = self.peek()
            self.at += 1
            if mark in "*+":
                for p in last:
                    self.follow[p] |= first
            null = null or mark in "?*"
        return null, first, last

    def atom(self):
        if self.peek() == "(":
            self.at += 1
            out = self.either()
            self.at += 1
            return out
        if self.peek() == "[":
            end = self.text.index("]", self.at + 1)
            chars, self.at = self.members(self.text[self.at + 1 : end]), end + 1
        else:
            chars = {self.one()}
        if self.fold:
            chars |= {ord(chr(c).swapcase()) for c in chars if c < 128 and chr(c).isalpha()}
        self.bytes.append(frozenset(chars))
        self.follow.append(set())
        p = len(self.bytes) - 1
        return False, {p}, {p}

    def one(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        if self.text[self.at] == "x":
            self.at += 3
            return int(self.text[self.at - 2 : self.at], 16)
        self.at += 1
        return ord(self.text[self.at - 1])

    def members(self, body: str) -> set[int]:
        outer, self.text, self.at, out = (self.text, self.at), body, 0, set()
        while self.at < len(body):
            low = self.one()
            if self.peek() == "-" and self.at + 1 < len(body):
                self.at += 1
                out |= set(range(low, self.one() + 1))
            else:
                out.add(low)
        self.text, self.at = outer
        return out


@dataclass
class Automaton:
    """``classes`` maps a byte to its class; state s reads class c at ``table[s + c]`` (s is already scaled).

    States from ``accepting`` on accept; ``rules[s]`` is the bit mask of rules.
    """

    classes: bytes
    table: list[int]
    start: int
    accepting: int
    rules: dict[int, int]
    dead: int


def _byte_classes(sets: list[frozenset[int]]) -> tuple[bytes, list[int]]:
    """Bytes that no set tells apart share a class; one byte stands for each class."""
    seen: dict[tuple, int] = {}
    classes, stands = bytearray(256), []
    distinct = list(dict.fromkeys(sets))
    for b in range(256):
        key = tuple(b in s for s in distinct)
        if key not in seen:
            seen[key] = len(seen)
            stands.append(b)
        classes[b] = seen[key]
    return bytes(classes), stands


def _determinise(parsed: list[_Parser], backward: bool, search: bool) -> Automaton:
    """One automaton for all; ``backward`` reads from the end, ``search`` lets a match begin anywhere."""
    sets, follow, final, initial, base = [], [], {}, set(), 0
    for k, p in enumerate(parsed):
        n = len(p.bytes)
        sets += p.bytes
        if backward:
            turned: list[set[int]] = [set() for _ in range(n)]
            for a, nexts in enumerate(p.follow):
                for b in nexts:
                    turned[b].add(a)
            step, begins, ends = turned, p.last, p.first
        else:
            step, begins, ends = p.follow, p.first, p.last
        follow += [frozenset(base + x for x in s) for s in step]
        initial |= {base + x for x in begins}
        for x in ends:
            final[base + x] = final.get(base + x, 0) | 1 << k
        base += n
    classes, stands = _byte_classes(sets)
    width = len(stands)
    of_class = [frozenset(p for p in range(base) if b in sets[p]) for b in stands]
    start = frozenset()
    numbers, rows, todo = {(True, start): 0}, [], [(True, start)]
    while todo:  # subset construction
        fresh, state = todo.pop(0)
        reach = set().union(*(follow[p] for p in state)) if state else set()
        if search or fresh:
            reach |= initial
        row = []
        for c in range(width):
            key = (False, frozenset(reach & of_class[c]))
            if key not in numbers:
                numbers[key] = len(numbers)
                todo.append(key)
            row.append(numbers[key])
        rows.append(row)
    masks = [0] * len(numbers)
    for (_, state), i in numbers.items():
        for p in state:
            masks[i] |= final.get(p, 0)
    block = {m: i for i, m in enumerate(dict.fromkeys(masks))}
    part = [block[m] for m in masks]
    while True:  # refine until no class of states splits
        keys = [(part[i], *(part[j] for j in rows[i])) for i in range(len(rows))]
        names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        new = [names[k] for k in keys]
        if len(names) == len(set(part)):
            break
        part = new
    stand = {}
    for i, b in enumerate(part):
        stand.setdefault(b, i)
    order = sorted(stand, key=lambda b: masks[stand[b]] != 0)
    place = {b: k for k, b in enumerate(order)}
    scale = 1 << (width - 1).bit_length()
    table = [0] * (len(order) * scale)
    for b in order:
        for c, j in enumerate(rows[stand[b]]):
            table[place[b] * scale + c] = place[part[j]] * scale
    quiet = sum(not masks[stand[b]] for b in order)
    dead = next((place[b] * scale for b in order if not masks[stand[b]] and all(part[j] == b for j in rows[stand[b]])), -1)
    return Automaton(classes, table, place[part[0]] * scale, quiet * scale, {place[b] * scale: masks[stand[b]] for b in order if masks[stand[b]]}, dead)


class Scanner:
    """Compiled rules; ``spans(text)`` gives (kind, start, end) in code points by start, then kind as listed."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        parsed = [_Parser(r.pattern, r.fold) for r in rules]
        if any(p.null for p in parsed):
            raise ValueError("a rule must not match the empty text")
        self.starts = _determinise(parsed, backward=True, search=True)
        self.ends = [_determinise([p], backward=False, search=False) for p in parsed]
        self.value = [max((p.bytes[x] for x in p.last), key=len) for p in parsed]

    def _longest(self, k: int, data: bytes, at: int) -> int:
        a = self.ends[k]
        classes, table, accepting, dead, s, end = a.classes, a.table, a.accepting, a.dead, a.start, -1
        for i in range(at, len(data)):
            s = table[s + classes[data[i]]]
            if s == dead:
                break
            if s >= accepting:
                end = i + 1
        return end

    def _kept(self, k: int, data: bytes, a: int, b: int) -> bool:
        rule = self.rules[k]
        if b - a < rule.least:
            return False
        if not rule.least_value:
            return True
        return b - self._value_start(k, data, a, b) >= rule.least_value

    def _value_start(self, k: int, data: bytes, a: int, b: int) -> int:
        """Where the value begins: after the first separator, blanks and one quote."""
        i = a
        while data[i] not in b":=":
            i += 1
        i += 1
        while data[i] == 32:
            i += 1
        return i + (data[i] in b"\"'")

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        a = self.starts
        table, accepting, s, size = a.table, a.accepting, a.start, len(data)
        found = []
        for i, c in enumerate(data[::-1].translate(a.classes)):
            s = table[s + c]
            if s >= accepting:
                found.append((size - 1 - i, a.rules[s]))
        spans, used = [], [0] * len(self.rules)
        for at, mask in reversed(found):
            for k in range(len(self.rules)):
                if mask >> k & 1 and at >= used[k]:
                    used[k] = end = self._longest(k, data, at)
                    if self._kept(k, data, at, end):
                        spans.append((at, k, end))
        spans.sort()
        return spans

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        found = self.byte_spans(data)
        if found and len(data) != len(text):
            cuts, at, points = {}, 0, 0
            for cut in sorted({x for a, _, b in found for x in (a, b)}):
                points += len(data[at:cut].decode("utf-8", "surrogatepass"))
                at, cuts[cut] = cut, points
            found = [(cuts[a], k, cuts[b]) for a, k, b in found]
        return [(self.rules[k].kind, a, b) for a, k, b in found]


_scanners: dict[tuple, Scanner] = {}


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """One compiled scanner for each worker process."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan_secrets(df: DataFrame, text: str = "text", out: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with ``out``: the kind, start and end (code points, end exclusive) of every secret in ``text``."""
    return df.withColumn(out, _span_udf(rules)(F.col(text)))


def _span_udf(rules: tuple[Rule, ...]):
    @F.arrow_udf(SPANS)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for col in texts:
            yield pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in scan.spans(x)] for x in col.to_pylist()], kind)

    return find


def redact_secrets(df: DataFrame, text: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with every secret in ``text`` replaced by ``mask``; overlapping spans are replaced together, null stays null."""

    @F.arrow_udf("string")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = scanner(rules)
        for col in texts:
            out = []
            for x in col.to_pylist():
                parts, at = [], 0
                for _, a, b in scan.spans(x):
                    if a >= at:
                        parts += [x[at:a], mask]
                    at = max(at, b)
                out.append("".join([*parts, x[at:]]) if parts else x)
            yield pa.array(out, pa.string())

    return df.withColumn(text, clean(F.col(text)))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret of every whole text of ``documents``, with the digest columns of the base kinds."""
    found = scan_secrets(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def base_sha256(spans: list[tuple[str, int, int]]) -> str:
    """The digest column of one text's spans, in Python, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in BASE_KINDS).encode()).hexdigest()
