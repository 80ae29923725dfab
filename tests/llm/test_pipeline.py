"""The stages of the pipeline against plain versions, and operators on tables with awkward columns and long texts."""

import collections
import hashlib
import re

import pytest

import corpus_pipeline as cp
from roadloom.llm.language import predict, train
from roadloom.llm.lines import dedup_lines
from roadloom.llm.mixing import mix_sources, with_copies
from roadloom.llm.repeats import remove_repeats
from tests.llm.test_brute_force import classes

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10**6 + i, t, "en", "x", 0) for i, t in enumerate([None, "", "12 34", "one line\n" * 3, "A short note, nothing else."])]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(cp.materialize(stage(spark, out[-1], SF)))
    return [[r.asDict() for r in df.collect()] for df in out]


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_language_stage(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert after == {d: t for d, t in before.items() if t is not None and any(map(str.isalpha, t))}
    assert set(stages[1][0]) == set(stages[0][0])


def plain_lines(docs):
    """{doc_id: numbers of lines that go}: blocks of 1 and 2 lines of 50 words or more, and of 3 lines, but their first copy."""
    lines = {d: [(i, x) for i, x in enumerate(t.split("\n")) if WORDS.search(x)] for d, t in docs.items()}
    places = collections.defaultdict(list)
    for d in sorted(lines):
        for n in (1, 2, 3):
            for i in range(len(lines[d]) - n + 1):
                part = lines[d][i : i + n]
                if n == 3 or sum(len(WORDS.findall(x)) for _, x in part) >= 50:
                    places[tuple(x for _, x in part)].append((d, [k for k, _ in part]))
    gone = collections.defaultdict(set)
    for found in places.values():
        for d, numbers in found[1:]:
            gone[d] |= set(numbers)
    return gone


def test_line_stage(stages):
    before, after = texts(stages[1]), texts(stages[2])
    gone = plain_lines(before)
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in before.items()}
    assert any(gone.values()) and after == {d: t for d, t in want.items() if not gone[d] or t.strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_near_duplicate_stage(stages):
    before = stages[2]
    sets = []
    for r in sorted(before, key=lambda r: r["doc_id"]):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORDS.findall(r["text"])]
        sets.append((r["doc_id"], {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a][1] and 5 * len(sets[a][1] & sets[b][1]) >= 4 * len(sets[a][1] | sets[b][1])]
    assert links
    keep = {sets[i][0] for i, c in enumerate(classes(len(sets), links)) if c == i}
    assert {r["doc_id"] for r in stages[3]} == keep


def test_mix_stage(stages):
    size = {r["doc_id"]: len(WORDS.findall(r["text"])) for r in stages[3]}
    source = {r["doc_id"]: r["source"] for r in stages[3]}
    totals = collections.Counter()
    for d, n in size.items():
        totals[source[d]] += n
    names = sorted(totals, key=lambda s: (s is None, s))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        left = 1.5 * sum(totals.values()) - sum(target.values())
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * totals[s]}
        if not over:
            break
        target |= {s: 2 * totals[s] for s in over}
        free -= over
    target |= {s: left * w[s] / sum(w[x] for x in free) for s in free}
    copies = collections.Counter(r["doc_id"] for r in stages[4])
    assert set(copies.values()) <= {1, 2} and set(copies) <= set(size)
    for s in names:
        taken = sum(size[d] * n for d, n in copies.items() if source[d] == s)
        assert abs(taken - target[s]) <= max(n for d, n in size.items() if source[d] == s)
    for r in stages[4]:
        assert r["text"] == texts(stages[3])[r["doc_id"]]


def test_packing_stage(stages):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    copies = collections.Counter(r["doc_id"] for r in stages[4])
    t = texts(stages[4])
    size = {d: len(tok.encode(t[d], add_special_tokens=False).ids) + 1 for d in copies}
    total, bins = collections.Counter(), collections.defaultdict(list)
    for r in stages[5]:
        total[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert total == {d: size[d] * n for d, n in copies.items()}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.02 * -(-sum(total.values()) // 1024) + 1


def test_empty_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, SF))
        assert docs.count() == 0


def test_clashing_columns(spark):
    names = "doc_id long, text string, source string, lang string, n_lines long, n_removed long, row long, id long, sig long, gone long, hit__ long, bucket__ long, lang_pred string, score double, `a b` long, __copies long, __source string, __rounds long, __below long"
    text = "first line here\nsecond line here\nthird line here"
    df = spark.createDataFrame([(i, text, "s", "en", *[7] * 8, "x", 0.5, 7, 9, "y", 7, 7) for i in (1, 2, 2)], names)
    out = dedup_lines(df)
    assert collections.Counter(out.columns) == collections.Counter(df.columns)
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed, r.row, r["a b"], r.gone) for r in out.collect()) == [(1, text, 3, 0, 7, 7, 7), (2, "", 3, 3, 7, 7, 7), (2, "", 3, 3, 7, 7, 7)]
    p = predict(df, train(df), keep=True)
    assert collections.Counter(p.columns) == collections.Counter(df.columns) and {r.lang_pred for r in p.collect()} == {"en"}
    m = with_copies(df)
    assert collections.Counter(m.columns) == collections.Counter(df.columns) and m.count() == 3 and {r["__source"] for r in m.collect()} == {"y"}
    assert mix_sources(df).count() == 3


def test_one_id_with_other_texts(spark):
    """Rows that repeat a doc_id with other texts are documents of their own for lines."""
    a, b = "p q r\ns t u\nv w x", "1 2 3\np q r\ns t u\nv w x"
    df = spark.createDataFrame([(1, a), (1, b), (2, "x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_removed) for r in dedup_lines(df).collect())
    assert got in ([(1, "1 2 3", 3), (1, a, 0), (2, "x", 0)], [(1, "", 3), (1, b, 0), (2, "x", 0)])


def test_very_long_texts(spark):
    """Texts over the size of a part, read in parts that overlap, against windows one by one."""
    base = hashlib.sha256(b"a").hexdigest()
    noise = lambda k, n: "".join(hashlib.sha256(f"{k}/{i}".encode()).hexdigest() for i in range(n // 64))
    block = noise("block", 960)
    t = [noise("x", 400_000) + block + noise("y", 262_144 - 500) + base, block[:700] + noise("z", 300_000), noise("u", 600_000)]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(df, 400).collect()}
    seen = collections.Counter(x[i : i + 400] for x in t for i in range(len(x) - 399))
    for d, x in enumerate(t):
        cover = bytearray(len(x))
        for i in range(len(x) - 399):
            if seen[x[i : i + 400]] > 1:
                cover[i : i + 400] = b"\x01" * 400
        runs = len(re.findall(rb"\x01+", bytes(cover)))
        assert got[d] == (len(x), sum(cover), runs)
    assert got[0][1] > 600 and got[2][1] == 0
    line = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, line + "\n" + noise("q", 900_000)), (2, "\n".join([line] * 3000))], "doc_id long, text string")
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in dedup_lines(df).collect()} == {1: (2, 0), 2: (3000, 3000)}
