"""Operator 3: secret scans. Base patterns, and guess costs of values in a credential context."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import chunks, map_batches, pick

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.A)
HEX = re.compile(r"[0-9a-f]{24,}")
#: Names of credentials (group 1: those of ASSIGN) before a whole value, which is judged by guess cost alone. A value is a run of
#: printable characters without spaces; one in quotes ends at the closing quote. Values are looked at, not taken: they may hold names.
CONTEXT = re.compile(
    r"""(?:(password|passwd|secret|token|api_?key)|pwd|pass|passphrase|credential|credentials|auth|bearer|private_?key|access_?key|client_?key)["']?\x20*[:=]\x20*"""
    r"""(?="((?:\\[!-~]|[!#-\[\]-~])*)"|'((?:\\[!-~]|[!-&(-\[\]-~])*)'|["']?([!-~]+))""", re.I | re.A,
)
#: Cheap RE2 screens: a text without a hit has no match of the pattern.
SCREENS = (
    (ASSIGN, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    (ACCESS, "AKIA"),
    (HEX, r"[0-9a-f]{24}"),
    (CONTEXT, r"""(?i)(password|passwd|secret|token|pwd|pass|passphrase|credentials?|auth|bearer|key)["']?\x20*[:=]"""),
)
#: Words by how soon an attacker tries them.
WORDS = """password admin welcome letmein login master dragon monkey shadow sunshine princess football baseball superman
batman qwerty trustno iloveyou secret access hello whatever freedom ninja mustang michael jordan hunter ranger buster
soccer hockey killer george andrew charlie thomas summer winter spring autumn test guest root user default changeme
example sample demo token value your key the and for with from this that name word pass code data server client database
service account public private local""".split()
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qazwsxedcrfvtgbyhnujmikolp", "abcdefghijklmnopqrstuvwxyz")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
KINDS = ("assign", "access", "hex", "guess")


class GuessCost:
    """log10 of the guesses for a value: the cheapest way to cut it into known and brute-force spans.

    A path of k spans costs the sum of their logs plus log10(k!), as the order of spans must be guessed too.
    """

    def __init__(self, words=tuple(WORDS)):
        self.rank = {w: math.log10(i + 2) for i, w in reversed(list(enumerate(words)))}
        self.longest = max(map(len, self.rank), default=0)
        self.walks = [r for k in KEYBOARD for r in (k, k[::-1])]

    def _spans(self, s: str):
        low, n = s.lower(), len(s)
        found: dict[tuple[int, int], float] = {}

        def put(i, j, cost):
            if cost < found.get((i, j), math.inf):
                found[i, j] = cost

        runs = {size: [0] * (n + 1) for size in (1, 2, 3, 4)}  # how many places on, s[i] equals s[i + size]
        for size, run in runs.items():
            for i in range(n - size - 1, -1, -1):
                run[i] = run[i + 1] + 1 if s[i] == s[i + size] else 0
        for i in range(n):
            for j in range(i + 3, min(n, i + self.longest) + 1):
                if (r := self.rank.get(low[i:j])) is not None:
                    put(i, j, r + (0.31 if s[i:j] != low[i:j] else 0))
            if (k := runs[1][i] + 1) >= 3:
                put(i, i + k, math.log10(94 * k))
            for size in (2, 3, 4):
                if (k := runs[size][i] // size + 1) >= 3:
                    put(i, i + k * size, size * math.log10(36) + math.log10(k))
            for walk in self.walks:
                if (at := walk.find(low[i])) >= 0:
                    j = i + 1
                    while j < n and at + j - i < len(walk) and low[j] == walk[at + j - i]:
                        j += 1
                    if j - i >= 3:
                        put(i, j, math.log10(len(self.walks) * 30 * (j - i)))
        for m in DATE.finditer(s):
            put(m.start(), m.end(), math.log10(365.25 * 120 if m.end() - m.start() > 4 else 120))
        return found

    def __call__(self, value: str) -> float:
        return self.best(value)[0]

    def best(self, value: str, below: float = math.inf) -> tuple[float, list[tuple[int, int, float]]]:
        """The cost and the spans of the best cut, exact; a value that costs `below` or more has a cost not under it, and no spans.

        As k! couples the spans, the programme keeps the least sum for each place, number of spans and kind of the last
        one. States that can't end under the cost of a known cut, or under `below`, are left out.
        """
        n = len(value)
        base = sum(size for have, size in ((re.search("[a-z]", value), 26), (re.search("[A-Z]", value), 26), (re.search("[0-9]", value), 10), (re.search("[^A-Za-z0-9]", value), 32)) if have) or 1
        one = math.log10(max(10, base))
        starts: dict[int, list[tuple[int, float]]] = {}
        for (i, j), c in self._spans(value).items():
            starts.setdefault(i, []).append((j, c))
        rest = [0.0] * (n + 1)  # the least sum to the end, without k!
        for i in range(n - 1, -1, -1):
            rest[i] = min([one + rest[i + 1], *[c + rest[j] for j, c in starts.get(i, ())]])
        if rest[0] >= below:
            return rest[0], []
        # a known cut: the one of the least sum
        known, k, i, brute = rest[0], 0, 0, False
        while i < n:
            j, _, brute_next = min([(i + 1, one + rest[i + 1], True), *[(j, c + rest[j], False) for j, c in starts.get(i, ())]], key=lambda x: x[1])
            k += not (brute and brute_next)
            i, brute = j, brute_next
        orders = lambda k: math.lgamma(k + 1) / math.log(10)
        most = min(known + orders(k) + 1e-9, below)
        # states[i][spans, last is brute force] = (sum, place before, state before, cost of the last span)
        states: list[dict] = [{} for _ in range(n + 1)]
        states[0][0, False] = (0.0, -1, None, 0.0)
        for i in range(n):
            for (k, brute), (cost, *_) in states[i].items():
                for j, c, b in ((i + 1, one, True), *[(j, c, False) for j, c in starts.get(i, ())]):
                    to = (k + (not (b and brute)), b)
                    if cost + c + rest[j] + orders(to[0]) <= most and cost + c < states[j].get(to, (math.inf,))[0]:
                        states[j][to] = (cost + c, i, (k, brute), c)
        if not states[n]:
            return most, []
        state = min(states[n], key=lambda x: states[n][x][0] + orders(x[0]))
        total = states[n][state][0] + orders(state[0])
        spans, j = [], n
        while j > 0:
            _, i, before, c = states[j][state]
            if state[1] and spans and spans[-1][3] and spans[-1][0] == j:
                spans[-1] = (i, spans[-1][1], spans[-1][2] + c, True)
            else:
                spans.append((i, j, c, state[1]))
            j, state = i, before
        return total, [(i, j, round(c, 3)) for i, j, c, _ in reversed(spans)]


def scan(text: str | None, cost: GuessCost, least: float, hits=(True,) * 4) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind in the order of KINDS."""
    found: list[tuple[int, int, str]] = []
    if not text:
        return found
    values: list[tuple[int, int]] = []
    if hits[0]:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                found.append((m.start(), m.end(), "assign"))
                values.append(m.span(2))
    if hits[1]:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if hits[2]:
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if hits[3]:
        for m in CONTEXT.finditer(text):
            a, b = next(m.span(g) for g in (2, 3, 4) if m[g] is not None)
            if b - a >= (6 if m[1] else 8):
                values.append((a, b))
    known = -1
    for a, b in sorted(dict.fromkeys(values), key=lambda x: (x[0], -x[1])):  # of values from one place, the longest that costs enough
        if a != known and cost.best(text[a:b], least)[0] >= least:
            found.append((a, b, "guess"))
            known = a
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_secrets(docs: DataFrame, least: float = 10.0, words=tuple(WORDS), text: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind,start,end>> for every row of docs; null and empty texts have no spans.

    kinds assign, access and hex are the fixed patterns; guess marks a value in a credential context whose cheapest
    segmentation needs 10**least guesses or more. Rows are read whole, one at a time; repeated rows repeat.
    """

    def run(batches):
        cost = GuessCost(words)
        for batch in chunks(batches, most=1 << 20):
            ids, texts = pick(batch, "doc_id", "text")
            hits = [pc.fill_null(pc.match_substring_regex(texts, s), False).to_pylist() for _, s in SCREENS]
            some = [any(h) for h in zip(*hits)]
            spans = [scan(t.as_py(), cost, least, h) if any_hit else [] for t, any_hit, h in zip(texts, some, zip(*hits))]
            rows = [[{"kind": k, "start": a, "end": b} for a, b, k in x] for x in spans]
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.col(text).alias("text")), run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """docs with every span replaced by mask; overlapping spans are masked as one. Null texts stay null."""

    def cut(text, spans):
        if text is None or not spans:
            return text
        out, at = [], 0
        for s in sorted(spans, key=lambda s: s["start"]):
            if s["start"] >= at:
                out += [text[at : s["start"]], mask]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    cost_args = {"least": 10.0, "words": tuple(WORDS)} | options
    names = docs.columns

    def run(batches):
        cost = GuessCost(cost_args["words"])
        for batch in chunks(batches, most=1 << 20):
            at = batch.schema.get_field_index("text")
            texts = [cut(t, [{"start": a, "end": b} for a, b, _ in scan(t, cost, cost_args["least"])]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return map_batches(docs.select(*names), run, docs.schema)


def sha256_of(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
