"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in both directions and gives every position a
probability for each label; a document's probabilities are the mean over the positions of its
letters. It runs over all bytes of whole texts, across words: texts are cut into segments at character
bounds, and a segment is read with ``MARGIN`` bytes of what stands around it on both sides, whose
positions count in the segments they belong to.

It is trained here, in numpy, by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import parts, released, table, text_of

#: Bytes of a segment, and of its surroundings on each side that are read with it.
SEGMENT, MARGIN = 224, 16
#: Segments that are read side by side, and bytes of text that are cut at a time.
COLUMNS, SLICE = 2048, 1 << 20
#: Label of texts without a letter.
UNKNOWN = "und"


def squash(x: np.ndarray) -> np.ndarray:
    """From -1 to 1; a gate is half of it and a half. Its slope is (1 - |squash|)^2."""
    return x / (1 + np.abs(x))


class ByteGru:
    """Embedding, one gated recurrent layer for each direction, and a softmax at every position."""

    def __init__(self, labels: list[str], size: int = 16, embedding: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels, self.size = labels, size
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": init(256, embedding) * 4, "c": np.zeros(len(labels), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": init(embedding, 3 * size), f"U{d}": init(size, 3 * size), f"b{d}": np.zeros(3 * size, np.float32), f"O{d}": init(size, len(labels))}

    def _run(self, d: str, x: np.ndarray, keep: bool):
        """States over time of one direction; x is (time, batch). ``keep``: what the way back needs too."""
        h, size = np.zeros((x.shape[1], self.size), np.float32), self.size
        inputs, u = self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"], self.p[f"U{d}"]
        states, kept = [], []
        for t in range(len(x)):
            a, s = inputs[x[t]], h @ u
            zr = 0.5 + 0.5 * squash(a[:, : 2 * size] + s[:, : 2 * size])
            z, r, sn = zr[:, :size], zr[:, size:], s[:, 2 * size :]
            n = squash(a[:, 2 * size :] + r * sn)
            if keep:
                kept.append((h, z, r, sn, n))
            h = n + z * (h - n)
            states.append(h)
        return np.stack(states), kept

    @staticmethod
    def _turned(lengths: np.ndarray, steps: int) -> np.ndarray:
        """Index (time, batch) that reverses each segment inside its own length."""
        t = np.arange(steps)[:, None]
        return np.where(t < lengths, lengths - 1 - t, t)

    def _positions(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        turn, cols = self._turned(lengths, len(x)), np.arange(x.shape[1])
        back = x[turn, cols]
        hf, kf = self._run("f", x, keep)
        hb, kb = self._run("b", back, keep)
        logits = hf @ self.p["Of"] + (hb @ self.p["Ob"])[turn, cols] + self.p["c"]
        e = np.exp(logits - logits.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True), (back, turn, cols, hf, hb, kf, kb)

    def _back(self, d: str, x: np.ndarray, dh_out: np.ndarray, kept, grads: dict) -> None:
        u, size = self.p[f"U{d}"], self.size
        gate = lambda g: 0.5 * (1 - np.abs(2 * g - 1)) ** 2
        steps = np.empty((*x.shape, 3 * size), dh_out.dtype)
        dh = np.zeros_like(dh_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, sn, n = kept[t]
            dh = dh + dh_out[t]
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            dz = dh * (h - n) * gate(z)
            dr = dn * sn * gate(r)
            steps[t, :, :size], steps[t, :, size : 2 * size], steps[t, :, 2 * size :] = dz, dr, dn
            ds = np.concatenate([dz, dr, dn * r], axis=1)
            grads[f"U{d}"] += h.T @ ds
            dh = dh * z + ds @ u.T
        order = np.argsort(x, axis=None, kind="stable")
        met, first = np.unique(x.reshape(-1)[order], return_index=True)
        by_byte = np.zeros((256, 3 * size), dh_out.dtype)
        by_byte[met] = np.add.reduceat(steps.reshape(-1, 3 * size)[order], first, axis=0)
        grads[f"b{d}"] += by_byte.sum(0)
        grads[f"W{d}"] += self.p["E"].T @ by_byte
        grads["E"] += by_byte @ self.p[f"W{d}"].T

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions, and its gradient."""
        probs, (back, turn, cols, hf, hb, kf, kb) = self._positions(x, lengths, keep=True)
        inside = np.arange(len(x))[:, None] < lengths
        total = inside.sum()
        loss = -np.log(probs[:, cols, y][inside] + 1e-9).mean()
        dl = probs.copy()
        dl[:, cols, y] -= 1
        dl *= (inside / total)[..., None].astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        turned = dl[turn, cols]
        grads["c"] = dl.sum((0, 1))
        grads["Of"] = np.tensordot(hf, dl, ((0, 1), (0, 1)))
        grads["Ob"] = np.tensordot(hb, turned, ((0, 1), (0, 1)))
        self._back("f", x, dl @ self.p["Of"].T, kf, grads)
        self._back("b", back, turned @ self.p["Ob"].T, kb, grads)
        return float(loss), grads

    def fit(self, segments: list[bytes], y: np.ndarray, steps: int = 240, batch: int = 128, rate: float = 0.01, seed: int = 5) -> None:
        """About ``steps`` batches, in whole passes over all segments."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        batch = max(1, min(batch, len(segments) // 8))
        each = -(-len(segments) // batch)
        epochs = -(-steps // each)
        step, steps = 0, epochs * each
        for _ in range(epochs):
            # Batches of segments of like length, in random order.
            order = np.argsort(np.array([len(s) for s in segments]) + rng.random(len(segments)) * 2, kind="stable")
            cuts = [order[i : i + batch] for i in range(0, len(order), batch)]
            for i in rng.permutation(len(cuts)):
                x, lengths = padded([segments[k] for k in cuts[i]])
                _, grads = self.gradients(x, lengths, y[cuts[i]])
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def _logits(self, d: str, x: np.ndarray, live: list[int], out: np.ndarray) -> None:
        """Add one direction's part of the logits to ``out`` (label, time, segment).

        Segments stand by falling length, so at time t the first ``live[t]`` of them have a byte.
        """
        size, n = self.size, x.shape[1]
        inputs, u = (self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]).astype(np.float32), self.p[f"U{d}"].astype(np.float32)
        tz, tr, tn = (np.ascontiguousarray(inputs[:, k * size : (k + 1) * size]) for k in range(3))
        # The reset gate is a half and half of r below, so the candidate's weights are halved once.
        uz, ur, un = (np.ascontiguousarray(u[:, k * size : (k + 1) * size]) * np.float32(f) for k, f in enumerate((1, 1, 0.5)))
        o = np.ascontiguousarray(self.p[f"O{d}"].T.astype(np.float32))
        h, z, r, c, s = (np.zeros((n, size), np.float32) for _ in range(5))

        def gather(table: np.ndarray, now: np.ndarray, to: np.ndarray, add: np.ndarray, scratch: np.ndarray) -> None:
            np.take(table, now, axis=0, out=to, mode="clip")
            to += add
            np.abs(to, out=scratch)
            scratch += np.float32(1)
            to /= scratch

        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            m = live[t]
            now, hm, zm, rm, cm, sm = x[t, :m], h[:m], z[:m], r[:m], c[:m], s[:m]
            gather(tz, now, zm, np.matmul(hm, uz, out=sm), sm)
            gather(tr, now, rm, np.matmul(hm, ur, out=sm), sm)
            np.matmul(hm, un, out=sm)
            rm *= sm
            rm += sm
            gather(tn, now, cm, rm, sm)
            hm -= cm
            zm *= hm
            zm += hm
            zm *= np.float32(0.5)
            np.add(cm, zm, out=hm)
            out[:, t, :m] += o @ hm.T

    def totals(self, x: np.ndarray, lengths: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """For each segment (a column of x, by falling length) the sum of the probabilities at its ``counted`` positions."""
        live = np.searchsorted(-lengths, -np.arange(len(x)), side="left").tolist()
        logits = np.empty((len(self.labels), *x.shape), np.float32)
        logits[:] = self.p["c"].astype(np.float32)[:, None, None]
        for d in "fb":
            self._logits(d, x, live, logits)
        np.clip(logits, -40, 40, out=logits)
        np.exp(logits, out=logits)
        logits *= counted / logits.sum(0)
        return logits.sum(1, dtype=np.float64).T


def padded(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes by time and segment, lengths)."""
    lengths = np.array([len(s) for s in segments])
    longest = int(lengths.max())
    flat = np.frombuffer(b"".join(s.ljust(longest, b"\0") for s in segments), np.uint8)
    return np.ascontiguousarray(flat.reshape(len(segments), longest).T), lengths


#: Bytes in letters: ASCII letters, and all bytes of other characters.
LETTER_BYTES = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def segments(data: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, from, to, first counted, past last counted) of all segments of texts that lie in ``data`` from ``firsts`` to ``ends``.

    Bounds move back to the start of the character they fall in.
    """
    many = -(-(ends - firsts) // SEGMENT)
    text = np.repeat(np.arange(len(firsts)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    lo, hi = firsts[text], ends[text]

    def bound(at: np.ndarray) -> np.ndarray:
        at = np.clip(at, lo, hi)
        for _ in range(3):
            inner = (at < hi) & (at > lo)
            inner[inner] = (data[at[inner]] & 0xC0) == 0x80
            at = at - inner
        return at

    begin, end = bound(lo + k * SEGMENT), bound(lo + (k + 1) * SEGMENT)
    return text, bound(begin - MARGIN), bound(end + MARGIN), begin, end


class Predictor:
    """Pools document probabilities."""

    def __init__(self, model: ByteGru | None):
        self.model = model

    def sums(self, texts: list[str]) -> np.ndarray:
        """For each text the sums of the probabilities at the positions of its letters."""
        out = np.zeros((len(texts), len(self.model.labels)))
        raw = [t.encode("utf-8", "replace") for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw) + bytes(SEGMENT + 2 * MARGIN + 4), np.uint8)
        ends = np.cumsum(sizes)
        text, start, stop, begin, end = segments(data, ends - sizes, ends)
        order = np.argsort(start - stop, kind="stable")  # by falling length
        columns = max(1, min(COLUMNS, (1 << 23) // ((SEGMENT + 2 * MARGIN) * len(self.model.labels))))
        for lo in range(0, len(order), columns):
            own = order[lo : lo + columns]
            lengths = (stop - start)[own]
            at = start[own] + np.arange(int(lengths[0]))[:, None]
            x = data[at]
            counted = LETTER_BYTES[x] & (at >= begin[own]) & (at < end[own])
            np.add.at(out, text[own], self.model.totals(x, lengths, counted.astype(np.float32)))
        return out

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        own = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.model else []
        for i, pooled in zip(own, self.sums([texts[i] for i in own]) if own else (), strict=True):
            best, total = int(np.argmax(pooled)), pooled.sum()
            labels[i], scores[i] = self.model.labels[best], min(1.0, round(float(pooled[best] / total), 6))
        return labels, scores


def labelled_sample(docs: DataFrame, text: str, label: str, per_label: int, per_text: int, size: int) -> list[tuple[list[str], str]]:
    """Passages of at most ``per_label`` texts of each label, the same however rows are dealt.

    Rows of a label fall into ``per_label`` buckets by a hash of the text, and each
    bucket gives the text of the least hash: sums of a row each, whatever the label's
    share. Of a text at most ``per_text`` passages of ``size`` characters come, at even distances. Null
    labels and null texts don't count.
    """
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("text"))
    least = rows.groupBy("label", F.pmod("h", F.lit(per_label)).alias("bucket")).agg(F.min("h").alias("h"))
    # At most per_label rows of two short columns for each label: a bounded broadcast.
    chosen = rows.join(F.broadcast(least.select("label", "h")), ["label", "h"]).groupBy("label", "h").agg(F.min("text").alias("text"))
    n = F.least(F.lit(per_text), F.ceil(F.length("text") / size)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: (i * F.greatest(F.length("text") - size, F.lit(0)) / F.greatest(n - 1, F.lit(1))).cast("int") + 1)
    few = chosen.select("label", "h", F.transform(starts, lambda i: F.col("text").substr(i, F.lit(size))).alias("parts"))
    return [(r["parts"], r["label"]) for r in sorted(few.collect(), key=lambda r: (r["label"], r["h"]))]


def fit(docs: DataFrame, *, text: str = "text", label: str = "lang", per_label: int = 256, per_text: int = 5, size: int = 96, steps: int = 240, seed: int = 3) -> ByteGru | None:
    """Train on at most ``per_label`` documents of each label, and ``per_text`` passages of ``size`` characters of each.

    Without any labelled text that has a letter, None.
    """
    passages: list[bytes] = []
    names: list[str] = []
    for cut, name in labelled_sample(docs, text, label, per_label, per_text, size):
        some = [p.encode("utf-8", "replace") for p in cut if has_letter(p)]
        passages += some
        names += [name] * len(some)
    labels = sorted(set(names))
    if not labels:
        return None
    model = ByteGru(labels, seed=seed)
    model.fit(passages, np.array([labels.index(n) for n in names]), steps=steps)
    return model


PREDICTED = T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType())


def predicted(model: ByteGru | None, text: Column) -> Column:
    """Struct (lang_pred, score) for a text column.

    Null, empty and letterless texts are ``und`` with score 0, as is everything
    without a model. Equal texts get equal results.
    """

    @F.arrow_udf(PREDICTED)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pool = Predictor(model)
        for texts in parts(batches, SLICE):
            labels, scores = pool(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=PREDICTED.names)
        released()

    # Else a filter on the result and its use would each run the network.
    return predict.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def op1_byte_gru_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the labels of those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(model, text_of()).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


QUERIES = {"op1_byte_gru_language": op1_byte_gru_language}
ORACLES: dict[str, str] = {}
