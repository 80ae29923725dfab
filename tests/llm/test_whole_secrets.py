"""Operator 3: values are scanned whole under every name, and guess costs are exact minima."""

import random
import time

import pytest

from roadloom.llm.secrets import GuessCost, find_secrets, redact, scan


@pytest.mark.parametrize("name", ["password", "passwd", "Secret", "token", "api_key", "apikey", "client_key"])
def test_whole_values(name):
    for value in ("p@9$xL!2vQ", "Tr0ub4dor&3!", "#Zk3$mQ8"):
        for text, at in ((f"{name}={value} x", len(name) + 1), (f'{{"{name}": "{value}","n":"a"}}', len(name) + 6), (f"{name}: '{value}'", len(name) + 3)):
            assert (at, at + len(value), "guess") in scan(text, GuessCost(), 10.0)
    assert scan(f'{{"{name}":"","next":"Zk3$mQ8vXw"}}', GuessCost(), 10.0) == []


def test_base_spans_stay_and_redaction_is_whole(spark):
    df = spark.createDataFrame([(1, "password: Tr0ub4dor&3! end"), (2, "password=p@9$xL!2vQ"), (3, "password=" + "z" * 600)], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in find_secrets(df).collect()}
    assert got == {1: [("assign", 0, 19), ("guess", 10, 22)], 2: [("guess", 9, 19)], 3: [("assign", 0, 609)]}
    assert {r.doc_id: r.text for r in redact(df).collect()} == {1: "[SECRET] end", 2: "password=[SECRET]", 3: "[SECRET]"}


def test_long_values_cost_as_a_whole():
    cost, t = GuessCost(), time.time()
    assert cost("a" * 600) < 5 and cost("ab" * 4000) < 10 and cost.best("xK9$vQ2m" * 4000, 10.0)[0] >= 10
    assert time.time() - t < 20


def test_exact_minimum():
    import math

    r, cost = random.Random(4), GuessCost()
    for _ in range(60):
        s = "".join(r.choice(["the", "key", "aaa", "x", "7", "qwe", "2019", "Z!", "abab", "master"]) for _ in range(4))[:11]
        n, spans = len(s), cost._spans(s)
        one = math.log10(max(10, sum(z for c, z in ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10)) if any(map(c, s))) + 32 * any(not c.isalnum() for c in s)))

        def least(i, k, brute, total):
            if i == n:
                return total + math.log10(math.factorial(k))
            ways = [least(j, k + 1, False, total + c) for (a, j), c in spans.items() if a == i]
            return min([*ways, least(i + 1, k + (not brute), True, total + one)])

        got, cut = cost.best(s)
        assert got == pytest.approx(least(0, 0, False, 0.0), abs=1e-6)
        assert got == pytest.approx(sum(c for *_, c in cut) + math.log10(math.factorial(len(cut))), abs=0.01)
        assert [i for i, *_ in cut] == [0, *[j for _, j, _ in cut[:-1]]] and cut[-1][1] == n


def test_base_spans_of_the_table(spark):
    """The query's counts and digest against the contract's patterns, over every whole text and awkward ones."""
    import hashlib
    import re

    from roadloom.llm import queries as q

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = {}
    for r in docs:
        t = r.text or ""
        spans = [("assign", m.span()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [("access", m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [("hex", m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort(key=lambda x: (x[1][0], ("assign", "access", "hex").index(x[0])))
        text = ",".join(f"{k}:{a}:{b}" for k, (a, b) in spans)
        want[r.doc_id] = (*[sum(k == x for k, _ in spans) for x in ("assign", "access", "hex")], hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in q.op3_secrets(spark, sf).collect()}
    assert got == want and sum(x[0] + x[1] + x[2] for x in want.values()) > 5


def test_awkward_rows(spark):
    rows = [(None, "token=abcdef123"), (1, None), (1, ""), (2, "x" * 2_000_000 + " password: hunter2secret9"), (2, "x" * 2_000_000 + " password: hunter2secret9")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as spans", "2 as kind")
    got = sorted(((r.doc_id or 0, len(r.spans)) for r in find_secrets(df).collect()))
    assert got[1:3] == [(1, 0), (1, 0)] and got[3] == got[4] and got[3][1] >= 1 and got[0][1] >= 1
    assert {r.text for r in redact(df.where("doc_id = 1")).collect()} == {None, ""} and find_secrets(df.where("false")).count() == 0
