"""Operator 7: best-fit packing of token sequences under token, document-count and attention-cost capacities."""

from __future__ import annotations

import base64
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import HashCache, Roll, _trim, chunks, map_batches, materialize, pick

#: Code points below this are split with numpy; a text with others goes to the tokenizer whole.
SIMPLE = 0x250
LETTER, NUMBER, OTHER, SPACE, EDGE = 1, 2, 3, 4, 9


def _classes() -> np.ndarray:
    out = np.full(SIMPLE + 1, OTHER, np.uint8)
    for c in range(SIMPLE):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
    out[SIMPLE] = EDGE
    return out


class PieceTokenizer:
    """Ids of whole texts by the byte-level BPE byte_bpe_50k, from `folder` or else where public_tokenizers has it.

    Texts of simple code points are split with numpy by the vocabulary's own pattern, and each distinct piece is
    encoded once (as text repeats words, that is a small part); the others are encoded by the tokenizer directly.
    """

    def __init__(self, folder: str | None = None):
        import tiktoken
        from public_tokenizers import PATTERN, path
        from tokenizers import Tokenizer

        place = (lambda name: f"{folder}/{name}") if folder else path
        self.load = lambda: Tokenizer.from_file(place("byte_bpe_50k.json"))
        self.whole = self.load()
        with open(place("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.whole = None  # comes back with the first text that needs it
        _trim()
        self.kind, self.roll = _classes(), Roll(7, size=SIMPLE + 1)
        self.cache, self.flat, self.used = HashCache(2, np.int64, 150_000), np.zeros(1 << 16, np.uint32), 0

    def _pieces(self, cp: np.ndarray) -> np.ndarray:
        """Start places of the pieces, and of the edges between texts (code SIMPLE)."""
        kind = self.kind[cp]
        begins = np.ones(len(cp), bool)
        begins[1:] = kind[1:] != kind[:-1]
        begins[kind == EDGE] = True
        solid = kind <= OTHER
        # the last space of a run before other text stands alone, or is the prefix of that text
        after = np.flatnonzero(begins[1:] & solid[1:] & (kind[:-1] == SPACE)) + 1
        begins[after - 1] = True
        begins[after[cp[after - 1] == 32]] = False
        # contractions: a lone apostrophe that begins a piece, then s, t, m, d, re, ve or ll
        mark = np.flatnonzero((cp == 39) & begins)
        mark = mark[mark + 1 < len(cp)]
        mark = mark[kind[mark + 1] == LETTER]
        if len(mark):
            one = cp[mark + 1]
            two = cp[np.minimum(mark + 2, len(cp) - 1)]
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for m, k in ((mark[single], 1), (mark[double & ~single], 2)):
                begins[m + 1] = False
                rest = m + 1 + k
                rest = rest[rest < len(cp)]
                begins[rest[kind[rest] == LETTER]] = True
        return np.flatnonzero(begins)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        simple = []
        for i, t in enumerate(texts):
            if t and (not t.isascii() and max(t) >= chr(SIMPLE) or any(s in t for s in self.special)):
                self.whole = self.whole or self.load()
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)
            elif t:
                simple.append(i)
            else:
                out[i] = np.zeros(0, np.uint32)
        if not simple:
            return out
        joined = chr(SIMPLE).join(texts[i] for i in simple) + chr(SIMPLE)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = self._pieces(cp)
        ends = np.append(starts[1:], len(cp))
        keys = self.roll.spans(self.roll.sums(cp), starts, ends)
        edge = cp[starts] == SIMPLE
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.cache.keys) + len(distinct) > self.cache.most:
            self.cache.clear()
            self.used = 0
        at, known = self.cache.find(distinct)
        if not known.all():
            new = first[~known]
            ids = [[] if s == SIMPLE else self.encode(joined[a:b]) for a, b, s in zip(starts[new].tolist(), ends[new].tolist(), cp[starts[new]].tolist())]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(sizes.sum())
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * total, np.uint32)])
            self.flat[self.used : self.used + total] = np.fromiter((x for y in ids for x in y), np.uint32, total)
            self.cache.add(distinct[~known], np.stack([self.used + np.cumsum(sizes) - sizes, sizes], axis=1))
            self.used += total
            at, _ = self.cache.find(distinct)
        place, sizes = self.cache.values[at[back]].T
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(place - upto[:-1], sizes) + np.arange(upto[-1])]
        for i, a, b in zip(simple, np.concatenate([[0], upto[1:][edge]])[:-1].tolist(), upto[1:][edge].tolist()):
            out[i] = ids[a:b]
        return out


def cut_pieces(docs: DataFrame, folder: str | None = None, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], pid: texts longer than capacity are cut, the first piece is the rest."""

    def run(batches):
        encode, pid = PieceTokenizer(folder), TaskContext.get().partitionId()  # its tables go with the task
        for batch in chunks(batches, most=1 << 18):
            ids, texts = pick(batch, "doc_id", "text")
            rows: list[tuple] = []
            who, tokens = [], []
            for i, got in enumerate(encode(texts.fill_null("").to_pylist())):
                got = np.append(got, np.uint32(end_id)).astype("<u4")
                n = len(got)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    who.append(i)
                    rows.append((k, a, b - a, zlib.crc32(got[a:b].tobytes())))
                    if keep_ids:
                        tokens.append(got[a:b].astype(np.int32))
            k, start, length, crc = zip(*rows)
            columns = [ids.take(pa.array(who, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
            columns.append(pa.array([pid] * len(who), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "pid"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{', ids array<int>' if keep_ids else ''}, pid int")


def plan_bins(counts: dict[int, int], capacity: int, max_docs: int, max_cost: float, weights=(1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, int]:
    """Vector best fit, decreasing, over lengths: rows (length, first rank, many, first bin, offset), and the bins.

    Items of one length are alike (tokens, one document, cost length**2), so whole ranges of bins in one state take one
    range of items in a step; the work depends on the number of lengths, not of documents. rule: "norm" takes the bins
    with the least weighted norm of what would be left, "dot" those with the largest weighted dot product of item and room.
    """
    caps = np.array([capacity, max_docs, max_cost], float)
    weights = np.array(weights, float)
    room, span = np.zeros((0, 3)), np.zeros((0, 2), np.int64)  # what is left in a bin of the range; first bin and many
    rows, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        item = np.array([length, 1, float(length) ** 2])
        if (item > caps).any():
            raise ValueError(f"a piece of {length} tokens fits in no bin")
        while left:
            fit = np.flatnonzero((room >= item).all(axis=1))
            if len(fit):
                score = (weights * ((room[fit] - item) / caps) ** 2).sum(1) if rule == "norm" else -(weights * (room[fit] / caps) * (item / caps)).sum(1)
                c = fit[np.argmin(score)]
                first, many = span[c]
                take = min(left, many)
                rows.append((length, rank, take, first, capacity - int(room[c, 0])))
                if take < many:
                    room, span = np.vstack([room, room[c]]), np.vstack([span, [first + take, many - take]])
                room[c] -= item
                span[c] = first, take
            else:
                per = int(min(caps // item))
                take = left if left < per else left // per  # bins: all left in one, or as many full ones as there are
                layers = 1 if left < per else per
                if left < per:
                    take, layers = 1, left
                for k in range(layers):
                    rows.append((length, rank + k * take, take, bins, k * length))
                room, span = np.vstack([room, caps - layers * item]), np.vstack([span, [bins, take]])
                bins += take
                take *= layers
            left -= take
            rank += take
            if len(room) > 64:
                keep = room[:, 0] >= min(counts)
                room, span = room[keep & (room[:, 1] >= 1)], span[keep & (room[:, 1] >= 1)]
    return np.array(rows, np.int64).reshape(-1, 5), bins


def pack(docs: DataFrame, folder: str | None = None, capacity: int = 1024, max_docs: int | None = None, max_cost: float | None = None, end_id: int = 2, keep_ids: bool = False, rule: str = "norm") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset for all docs.

    Null and empty texts are one piece of the end id alone; repeated rows are packed each; an empty table gives no rows;
    other columns are not read. The driver sees a histogram of at most `capacity` lengths and the plan made from it.
    """
    pieces = materialize(cut_pieces(docs, folder, capacity, end_id, keep_ids))
    counts = pieces.groupBy("pid", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("pid", "length", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_bins(histogram, capacity, max_docs or capacity, max_cost or float(capacity) ** 2, rule=rule)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = docs.sparkSession.sparkContext.broadcast(plan[order])

    def place(batches):
        rows = plan.value
        width = int(rows[:, 1].max(initial=0)) + 1
        keys = rows[:, 0] * width + rows[:, 1]
        for batch in batches:
            length, rank = (x.to_numpy() for x in pick(batch, "length", "rank"))
            at = np.searchsorted(keys, length * width + rank, side="right") - 1
            out = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("pid", "rank", "base")]
            names = [n for n in batch.schema.names if n not in ("pid", "rank", "base")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], [*names, "sequence_id", "offset"])

    local = F.row_number().over(Window.partitionBy("pid", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.join(offsets, ["pid", "length"]).withColumn("rank", F.col("base") + local).drop("base")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "rank")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(ranked, place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{', ids array<int>' if keep_ids else ''}, sequence_id long, offset long")
