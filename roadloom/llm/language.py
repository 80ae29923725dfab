"""Operator 6: language ID by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import bytes_of, chunks, map_batches, materialize, pick

#: Bounds of the training sample: rows of each label, and the windows drawn from a row on the average (in proportion to its length).
SAMPLE_ROWS, DRAWS = 400, 24
#: Bytes that the network labels at a time, and bytes that it reads before and behind them.
SEGMENT, CONTEXT = 240, 16
#: Bytes of a training window.
TRAINED = 48
#: Segments that are read side by side. Blocks are always this wide, so that sums are added up in the same way whatever
#: stands beside a text.
BLOCK = 512


def _half_tanh(x):
    """The logistic function of x, in place."""
    np.tanh(np.multiply(x, np.float32(0.5), out=x), out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def _times(u, s):
    """u @ s with columns that don't depend on their place, as those of a BLAS product do in the last bit."""
    return np.einsum("ij,jb->ib", u, s)


class BiGRU:
    """Reads bytes both ways, across spaces; every byte position gets class probabilities from both states.

    Arrays are (features, batch), so that each step works on whole rows. Outside a text the state does not move, so
    what stands beside a text in a block, or pads it, has no effect on its probabilities.
    """

    def __init__(self, classes: list[str], hidden: int = 8, seed: int = 0):
        r = np.random.default_rng(seed)
        h, k = hidden, len(classes)
        self.classes, self.h = classes, h
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": r.normal(0, 0.3, (3 * h, 256)), f"u{d}": r.normal(0, h**-0.5, (3 * h, h)), f"c{d}": np.zeros((3 * h, 1))}
        self.p |= {"o": r.normal(0, 0.3, (k, 2 * h)), "ob": np.zeros((k, 1))}
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}

    def _run(self, x, inside, d, keep):
        """x, inside: (T, B) bytes in reading order and whether they are text. States (T, h, B), and what the way back needs."""
        h, u = self.h, self.p[f"u{d}"]
        table = self.p[f"x{d}"] + self.p[f"c{d}"]
        s = np.zeros((h, x.shape[1]), table.dtype)
        states, notes, whole = np.empty((len(x), h, x.shape[1]), table.dtype), [], inside.all(1)
        for t in range(len(x)):
            a, g = np.take(table, x[t], axis=1, mode="clip"), _times(u, s)
            zr = _half_tanh(a[: 2 * h] + g[: 2 * h])
            z, r = zr[:h], zr[h:]
            n = np.tanh(a[2 * h :] + r * g[2 * h :])
            if keep:
                notes.append((s, z, r, n, g[2 * h :]))
            new = n + z * (s - n)
            states[t] = new if whole[t] else np.where(inside[t], new, s)
            s = states[t]
        return states, notes

    def positions(self, x, inside, keep=False):
        """Class probabilities of each position: (T, k, B)."""
        x = x.astype(np.intp)
        f, fn = self._run(x, inside, "f", keep)
        b, bn = self._run(x[::-1], inside[::-1], "b", keep)
        both = np.concatenate([f, b[::-1]], axis=1)
        logit = np.einsum("kj,tjb->tkb", self.p["o"], both) + self.p["ob"]
        logit -= logit.max(axis=1, keepdims=True)
        prob = np.exp(logit, out=logit)
        prob /= prob.sum(axis=1, keepdims=True)
        return (prob, both, fn, bn) if keep else prob

    def gradients(self, x, mask, y):
        """Backpropagation through time of the mean cross-entropy over the positions of mask (T, B), which are the text."""
        prob, both, fn, bn = self.positions(x, mask, keep=True)
        h, n, cols = self.h, mask.sum(), np.arange(len(y))
        loss = -np.log(prob[:, y, cols] + 1e-9)[mask].sum() / n
        d = prob.copy()
        d[:, y, cols] -= 1
        d *= mask[:, None, :] / np.float32(n)
        g = {"o": np.einsum("tkb,tjb->kj", d, both, optimize=True), "ob": d.sum((0, 2))[:, None]}
        ds = self.p["o"].T @ d
        for way, notes, xs, own, out in (("f", fn, x, mask, ds[:, :h]), ("b", bn, x[::-1], mask[::-1], ds[::-1, h:])):
            gx, gu, u = np.zeros((256, 3 * h), np.float32), np.zeros_like(self.p[f"u{way}"]), self.p[f"u{way}"]
            carry = np.zeros((h, x.shape[1]), np.float32)
            for t in range(len(xs) - 1, -1, -1):
                s, z, r, c, gn = notes[t]
                all_ = out[t] + carry
                dh = np.where(own[t], all_, np.float32(0))
                dn = dh * (1 - z) * (1 - c * c)
                dz = dh * (s - c) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                pre = np.concatenate([dz, dr, dn])
                rec = np.concatenate([dz, dr, dn * r])
                np.add.at(gx, xs[t], pre.T)
                gu += rec @ s.T
                carry = np.where(own[t], dh * z + u.T @ rec, all_)
            g |= {f"x{way}": gx.T, f"u{way}": gu, f"c{way}": gx.sum(0)[:, None]}
        return loss, g

    def fit(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, steps: int = 300, batch: int = 128, rate: float = 0.02, seed: int = 1):
        """Adam over random batches of windows: x and mask (T, N), y (N)."""
        r, m, v = np.random.default_rng(seed), {}, {}
        for step in range(1, steps + 1):
            at = r.integers(0, len(y), batch)
            _, g = self.gradients(x[:, at], mask[:, at], y[at])
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for n, d in g.items():
                m[n] = 0.9 * m.get(n, 0) + 0.1 * d
                v[n] = 0.99 * v.get(n, 0) + 0.01 * d * d
                self.p[n] = (self.p[n] - lr * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, classes): probabilities summed over all byte positions of each text.

        Every text is read in segments of SEGMENT bytes with CONTEXT bytes of it on both sides, whatever its length or
        characters. The sums of a text are the same, bit by bit, alone or among others: segments stand in blocks of one
        width, states outside the text don't move, and places are added one after the other.
        """
        size = np.diff(offsets)
        many = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(size)), many)
        start = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * SEGMENT
        # whole segments first, then the last ones of texts by length: a text's own stay in order, and short ones stand together
        order = np.argsort(-np.minimum(SEGMENT, offsets[doc + 1] - start), kind="stable")
        doc, start = doc[order], start[order]
        out = np.zeros((len(size), len(self.classes)))
        for a in range(0, len(doc), BLOCK):
            own, first, last = np.zeros((3, BLOCK), np.int64)
            n = len(start[a : a + BLOCK])
            own[:n], first[:n], last[:n] = start[a : a + BLOCK], offsets[doc[a : a + BLOCK]], offsets[doc[a : a + BLOCK] + 1]
            place = own[None, :] + np.arange(-CONTEXT, min(SEGMENT, int((last - own).max())) + CONTEXT)[:, None]
            inside = (place >= first) & (place < last)
            x = np.where(inside, data[np.clip(place, 0, len(data) - 1)], 0)
            prob = self.positions(x, inside)[CONTEXT : CONTEXT + SEGMENT]
            pooled = (prob * inside[CONTEXT : CONTEXT + SEGMENT, None, :]).sum(0)
            np.add.at(out, doc[a : a + BLOCK], pooled.T[:n])
        return out


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """lang, text, h of at most `rows` labelled rows of every label: those with the smallest hash of doc_id.

    Counts by label and 10 bits of the hash, and inside the bucket that reaches the bound by 10 more, come first, so rows
    beyond it are never sorted and no task sees more than 1024 counts of a label.
    """
    labelled = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id").alias("h"))
    upto = Window.partitionBy("lang").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)

    def join(df: DataFrame, by_label: DataFrame) -> DataFrame:
        return df.join(F.broadcast(by_label) if by_label.count() <= 10_000 else by_label, "lang")

    def bound(counts: DataFrame) -> DataFrame:
        """(lang, b, base): the last bucket that begins below the bound, and what lies before it."""
        before = F.col("base") + F.coalesce(F.sum("n").over(upto), F.lit(0))
        some = counts.withColumn("before", before).where(F.col("before") < rows)
        return materialize(some.groupBy("lang").agg(F.max(F.struct("b", "before")).alias("m")).select("lang", "m.b", F.col("m.before").alias("base")))

    high, fine = F.shiftright("h", 54), F.shiftright("h", 44)
    first = bound(labelled.groupBy("lang", high.alias("b")).agg(F.count("*").alias("n")).withColumn("base", F.lit(0).cast("long")))
    inside = join(labelled.select("lang", "h"), first.withColumnRenamed("b", "edge")).where(high == F.col("edge"))
    last = bound(inside.groupBy("lang", fine.alias("b"), "base").agg(F.count("*").alias("n")))
    near = join(labelled, last.select("lang", "b")).where(fine <= F.col("b"))
    return near.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("i") <= rows).select("lang", "text", "h")


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, draws: int = DRAWS, steps: int = 300, hidden: int = 8) -> BiGRU | None:
    """Fit on at most `rows` labelled rows of every label; None without labels.

    Each step needs windows at random places: they are drawn where the rows lie, anywhere in the whole texts, as many
    from a text as its share of all bytes of its label, so every byte is as likely to be read as any other. The driver
    gets (draws + 1) * rows windows of TRAINED bytes for a label at most; a model grows with its labels.
    """

    def draw(batches):
        for batch in chunks(batches):
            data, offsets = bytes_of(batch.column(batch.schema.get_field_index("text")))
            picked = []
            for a, b, h, rate in zip(offsets[:-1].tolist(), offsets[1:].tolist(), *(c.to_pylist() for c in pick(batch, "h", "rate"))):
                at = np.random.default_rng(h % 2**63).integers(a, max(a, b - TRAINED) + 1, int(np.ceil((b - a) * rate)))
                picked.append([data[i : min(b, i + TRAINED)].tobytes() for i in at.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("lang")), pa.array(picked, pa.list_(pa.binary()))], ["lang", "windows"])

    some = materialize(sample(docs, rows))
    rates = some.groupBy("lang").agg((F.count("*") * draws / F.greatest(F.lit(1), F.sum(F.octet_length("text")))).alias("rate"))
    got = map_batches(some.join(rates, "lang"), draw, "lang string, windows array<binary>").collect()
    classes = sorted({r.lang for r in got})
    if not classes:
        return None
    pairs = sorted((r.lang, bytes(w)) for r in got for w in r.windows)
    model = BiGRU(classes, hidden)
    if len(classes) > 1 and pairs:
        x, mask = np.zeros((TRAINED, len(pairs)), np.uint8), np.zeros((TRAINED, len(pairs)), bool)
        for j, (_, w) in enumerate(pairs):
            x[: len(w), j] = np.frombuffer(w, np.uint8)
            mask[: len(w), j] = True
        model.fit(x, mask, np.array([classes.index(c) for c, _ in pairs]), steps)
    return model


def predict(docs: DataFrame, model: BiGRU | None, keep: bool = False) -> DataFrame:
    """doc_id (keep: all columns), lang_pred, score for every row: the class with the largest mean probability over all byte positions.

    und with score 0 if the text is null or has no letter, or nothing could be learned. The text alone decides, whole.
    Columns of docs that are named lang_pred or score are replaced; repeated rows repeat; an empty table gives no rows.
    """
    names = [n for n in docs.columns if n not in ("lang_pred", "score")] if keep else ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((model.classes, model.p) if model else None)

    def run(batches):
        if shared.value is None:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*pick(batch, *names), pa.array(["und"] * batch.num_rows, pa.string()), pa.array([0.0] * batch.num_rows)], [*names, "lang_pred", "score"])
            return
        classes, weights = shared.value
        net = BiGRU(classes, weights["uf"].shape[1])
        net.p = weights
        for batch in chunks(batches, most=1 << 19):
            texts = batch.column(batch.schema.get_field_index("text"))
            data, offsets = bytes_of(texts)
            pooled = net.sums(data, offsets) / np.maximum(1, np.diff(offsets))[:, None]
            best, score = pooled.argmax(1), pooled.max(1)
            letter = [t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*pick(batch, *names), pa.array([classes[b] if ok else "und" for b, ok in zip(best, letter)], pa.string()), pa.array(np.where(letter, np.clip(score, 0, 1), 0.0), pa.float64())],
                [*names, "lang_pred", "score"],
            )

    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return map_batches(docs.select(*dict.fromkeys([*names, "text"])), run, f"{schema}, lang_pred string, score double")
