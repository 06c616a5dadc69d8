"""Operator 1, language ID by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of WINDOW bytes. A gated recurrent unit reads a window from either end; a
softmax over both states labels every position. A document's probabilities are the mean over all of
its positions. The network is trained here, by backpropagation through time in numpy, on a bounded
sample of labelled texts. Short windows occur in training as they do at the end of texts.

Training sample: SAMPLE_TEXTS different texts of each language at most, drawn by the hash of the
text, and of each a piece of PIECE characters. Everything else covers whole texts and all rows.

Defined cases: null texts and texts without a letter are `und` with score 0; if no labelled text is
left for training every document is `und`; a single learned language is predicted with score 1;
copies get equal results; empty tables give empty results; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .simhash import _joined

WINDOW = 64
HIDDEN = 8
SAMPLE_TEXTS = 300
PIECE = 1024
STEPS = 400
BATCH = 256
RATE = 0.02
#: Byte values, and the symbol that fills windows up.
PAD = 256
#: Windows that are read at a time.
BLOCK = 1024


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


class ByteNetwork:
    """Weights of both directions, stacked: E (2, 257, 3H), U (2, H, 3H), V (2, H, K), c (K)."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        k = len(labels)
        self.labels, self.hidden = labels, hidden
        scale = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
        self.w = {"E": scale(2, 257, 3 * hidden, by=0.3), "U": scale(2, hidden, 3 * hidden, by=0.3), "V": scale(2, hidden, k, by=0.3), "c": np.zeros(k, np.float32)}

    def states(self, x: np.ndarray, keep: bool = False):
        """x: (n, T) symbols. States (2, T, n, H) in reading positions; with keep, what training needs."""
        n, t_max = x.shape
        h_size = self.hidden
        out = np.empty((2, t_max, n, h_size), np.float32)
        trail = []
        columns = np.ascontiguousarray(x.T)
        for d in range(2):
            e, u = self.w["E"][d], self.w["U"][d]
            u_gate, u_new = np.ascontiguousarray(u[:, : 2 * h_size]), np.ascontiguousarray(u[:, 2 * h_size :])
            h = np.zeros((n, h_size), np.float32)
            for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
                a = e.take(columns[t], axis=0)
                gate = h @ u_gate
                gate += a[:, : 2 * h_size]
                np.negative(gate, out=gate)
                np.exp(gate, out=gate)
                gate += 1.0
                np.reciprocal(gate, out=gate)
                z, r = gate[:, :h_size], gate[:, h_size:]
                rh = r * h
                c = rh @ u_new
                c += a[:, 2 * h_size :]
                np.tanh(c, out=c)
                if keep:
                    trail.append((d, t, h, z, r, c))
                h = h + z * (c - h)
                out[d, t] = h
        return (out, trail) if keep else out

    def logits(self, out: np.ndarray) -> np.ndarray:
        """(T, n, K) from states."""
        t, n, h = out.shape[1:]
        return (out[0].reshape(-1, h) @ self.w["V"][0] + out[1].reshape(-1, h) @ self.w["V"][1] + self.w["c"]).reshape(t, n, -1)

    def position_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(K, T, n) from (n, T) symbols. Features come first here, so every step runs over whole rows."""
        n, t_max = x.shape
        hs, k = self.hidden, len(self.labels)
        columns = np.ascontiguousarray(x.T)
        score = np.empty((t_max, k, n), np.float32)
        a, gate = np.empty((3 * hs, n), np.float32), np.empty((2 * hs, n), np.float32)
        new, held, part = np.empty((hs, n), np.float32), np.empty((hs, n), np.float32), np.empty((k, n), np.float32)
        for d in range(2):
            # a gate is (tanh(x / 2) + 1) / 2
            half = np.repeat(np.array([0.5, 1.0], np.float32), (2 * hs, hs))
            e = np.ascontiguousarray((self.w["E"][d] * half).T)
            u_gate = np.ascontiguousarray(self.w["U"][d][:, : 2 * hs].T) * np.float32(0.5)
            u_new, v = np.ascontiguousarray(self.w["U"][d][:, 2 * hs :].T), np.ascontiguousarray(self.w["V"][d].T)
            h = np.zeros((hs, n), np.float32)
            for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
                np.take(e, columns[t], axis=1, out=a, mode="clip")
                np.matmul(u_gate, h, out=gate)
                gate += a[: 2 * hs]
                np.tanh(gate, out=gate)
                gate += 1.0
                gate *= 0.5
                np.multiply(gate[hs:], h, out=held)
                np.matmul(u_new, held, out=new)
                new += a[2 * hs :]
                np.tanh(new, out=new)
                new -= h
                new *= gate[:hs]
                h += new
                if d == 0:
                    np.matmul(v, h, out=score[t])
                else:
                    np.matmul(v, h, out=part)
                    score[t] += part
        score += self.w["c"][:, None]
        score -= score.max(axis=1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(axis=1, keepdims=True)
        return score.transpose(1, 0, 2)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions that are not padding, and its gradients."""
        out, trail = self.states(x, keep=True)
        logits = self.logits(out)
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        real = (x.T != PAD)[:, :, None].astype(np.float32)
        total = max(1.0, float(real.sum()))
        rows = np.arange(x.shape[0])
        loss = float(-(np.log(p[:, rows, y] + 1e-12) * real[:, :, 0]).sum() / total)
        d_logit = p
        d_logit[:, rows, y] -= 1.0
        d_logit *= real / total
        k, hs = d_logit.shape[2], self.hidden
        flat = d_logit.reshape(-1, k)
        g = {n: np.zeros_like(v) for n, v in self.w.items()}
        g["c"] = flat.sum(axis=0)
        d_out = np.empty_like(out)
        for d in range(2):
            g["V"][d] = out[d].reshape(-1, hs).T @ flat
            d_out[d] = (flat @ self.w["V"][d].T).reshape(out[d].shape)
        d_h = [np.zeros((x.shape[0], hs), np.float32) for _ in range(2)]
        for d, t, h, z, r, c in reversed(trail):
            u = self.w["U"][d]
            dh = d_h[d] + d_out[d, t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            drh = dc @ u[:, 2 * hs :].T
            dr = drh * h * r * (1 - r)
            da = np.concatenate([dz, dr, dc], axis=1)
            np.add.at(g["E"][d], x[:, t], da)
            g["U"][d][:, : 2 * hs] += h.T @ da[:, : 2 * hs]
            g["U"][d][:, 2 * hs :] += (r * h).T @ dc
            d_h[d] = dh * (1 - z) + drh * r + da[:, : 2 * hs] @ u[:, : 2 * hs].T
        return loss, g

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, window: int = WINDOW, rate: float = RATE, seed: int = 2) -> list[float]:
        """Adam over windows that are drawn evenly from the languages."""
        rng = np.random.default_rng(seed)
        by_label = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        m, v, losses = {n: np.zeros_like(w) for n, w in self.w.items()}, {n: np.zeros_like(w) for n, w in self.w.items()}, []
        for step in range(1, steps + 1):
            want = rng.integers(0, len(self.labels), batch)
            x = np.full((batch, window), PAD, np.int64)
            for i, k in enumerate(want):
                t = texts[by_label[k][rng.integers(len(by_label[k]))]]
                size = window if rng.random() < 0.7 else int(rng.integers(2, window + 1))
                at = int(rng.integers(0, max(1, len(t) - size + 1)))
                piece = t[at : at + size]
                x[i, : len(piece)] = np.frombuffer(piece, np.uint8)
            loss, g = self.gradients(x, want)
            losses.append(loss)
            slow = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            clip = min(1.0, 1.0 / (norm + 1e-9))
            for n, w in self.w.items():
                a = g[n] * clip
                m[n] += 0.1 * (a - m[n])
                v[n] += 0.01 * (a * a - v[n])
                w -= slow * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)
        return losses

    def document_probabilities(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Mean of the position probabilities of each of the joined texts; zeros for empty ones."""
        n = len(offsets) - 1
        total = np.zeros((n, len(self.labels)))
        count = -(-np.diff(offsets) // window)
        doc = np.repeat(np.arange(n), count)
        begin = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * window
        size = np.minimum(window, offsets[1:][doc] - begin)
        step = np.arange(window)
        for a in range(0, len(doc), BLOCK):
            d, b, s = doc[a : a + BLOCK], begin[a : a + BLOCK], size[a : a + BLOCK]
            inside = step[None, :] < s[:, None]
            x = np.where(inside, data[np.minimum(b[:, None] + step, len(data) - 1)].astype(np.int64), PAD)  # PAD is no byte
            p = self.position_probabilities(x)
            real = inside.T.astype(np.float32)
            for k in range(len(p)):
                total[:, k] += np.bincount(d, weights=np.einsum("tn,tn->n", p[k], real), minlength=n)
        return total / np.maximum(np.diff(offsets), 1)[:, None]


def training_rows(docs: DataFrame, text: str, lang: str, texts: int = SAMPLE_TEXTS, piece: int = PIECE) -> tuple[list[bytes], np.ndarray, list[str]]:
    """A bounded sample: `texts` different texts at most of each language, a piece of each.

    Draws by the hash of the text, so copies count once. The languages are assumed to be few; their
    number is what the result's size grows with.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    rates = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    part = F.pmod(F.col("h"), F.lit(1 << 24))
    offset = 1 + F.pmod(F.shiftright("h", 24), F.greatest(F.lit(1), F.length("text") - piece + 1))
    drawn = labelled.join(F.broadcast(rates), "lang").where(part < F.least(F.lit(1.0), 1.5 * texts / F.col("n")) * (1 << 24))
    drawn = drawn.select("lang", "h", F.expr(f"substring(text, cast({1} + pmod(shiftright(h, 24), greatest(1, length(text) - {piece} + 1)) as int), {piece})").alias("piece"))
    rows = drawn.dropDuplicates(["lang", "h"]).collect()
    rows.sort(key=lambda r: (r.lang, r.h))
    labels = sorted({r.lang for r in rows})
    seen: dict[str, int] = {}
    kept = [r for r in rows if seen.setdefault(r.lang, 0) < texts and not seen.update({r.lang: seen[r.lang] + 1})]
    return [r.piece.encode() for r in kept], np.array([labels.index(r.lang) for r in kept], np.int64), labels


def train(docs: DataFrame, text: str = "text", lang: str = "lang", **options) -> ByteNetwork | None:
    texts, y, labels = training_rows(docs, text, lang)
    if not labels:
        return None
    net = ByteNetwork(labels)
    if len(labels) > 1:
        net.fit(texts, y, **options)
    return net


def identify(docs: DataFrame, net: ByteNetwork | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns: the predicted language and its pooled probability.

    The row's own columns pass through; of its text only bytes reach the network.
    """
    spark = docs.sparkSession
    if net is None:
        return docs.withColumns({pred: F.lit("und"), score: F.lit(0.0)})
    shipped = spark.sparkContext.broadcast((net.labels, net.hidden, net.w))

    @F.arrow_udf("pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        labels, hidden, w = shipped.value
        own = ByteNetwork.__new__(ByteNetwork)
        own.labels, own.hidden, own.w = labels, hidden, w
        p = own.document_probabilities(*_joined(texts))  # the bytes stay where Arrow has them
        best = p.argmax(axis=1) if len(p) else np.empty(0, int)
        C.give_back()
        return pa.StructArray.from_arrays([pa.array(labels).take(pa.array(best)), pa.array(np.clip(p[np.arange(len(p)), best], 0.0, 1.0))], ["pred", "score"])

    readable = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    guess = "__guess" if "__guess" not in docs.columns else "__guess_of_text"
    # a filter on the result would else be pushed below the projection, with a second run of the network in workers of its own
    out = docs.withColumn(guess, predict.asNondeterministic()(F.when(readable, F.col(text).cast("binary"))))
    named: dict[str, Column] = {pred: F.when(readable, F.col(guess)["pred"]).otherwise("und"), score: F.when(readable, F.col(guess)["score"]).otherwise(0.0)}
    return out.withColumns(named).drop(guess)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs.where(~held_out("doc_id")))
    return identify(docs, net).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
