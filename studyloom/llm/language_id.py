"""Language identification by a bidirectional gated recurrent network over bytes.

The network is written in numpy and trained here by backpropagation through time: each byte picks a row of a gate table
for each direction, two recurrent units of ``HIDDEN`` cells read the text from both ends, and a softmax over both
states labels every byte.  A document's probabilities are the mean over all its bytes.  Texts are read in stretches of
``STRETCH`` bytes, each from a zero state, so that thousands of them run side by side at any text length.

Training takes a bounded, documented sample: about ``SAMPLE_DOCS`` documents of each language, those whose id and text
have a hash below the share that this number is of the language, besides the one of the least hash, and
``SAMPLE_WINDOWS`` stretches of each.  Beyond a hundred languages each has fewer, though one at least, so that all together
are about ``SAMPLE_TOTAL``; of more languages than that the most frequent are learned.  Everything else reads whole texts.

Defined cases: a null text or one without a letter is ``und`` with score 0; null ids hash as the empty string; rows
without a language train nothing; with no row to learn from, all is ``und``; repeated rows each get their result; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm.shared import col, freed, written

#: Bytes of a stretch, cells of each direction, stretches that run side by side.
STRETCH, HIDDEN, BATCH = 64, 8, 4096
#: The training sample: documents of each language, of all together, and stretches of each document.
SAMPLE_DOCS, SAMPLE_TOTAL, SAMPLE_WINDOWS = 500, 50_000, 2
#: Passes over the sample, stretches in a step, step size.
EPOCHS, STEP_ROWS, RATE = 6, 128, 0.02
UNKNOWN = "und"


class ByteGRU:
    """Weights: gates x (2, 3H, 256), recurrent u (2, 3H, H), bias of the candidate's recurrent part c (2, H), output w (C, 2H) and b (C)."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"x": draw(2, 3 * hidden, 256, scale=0.3), "u": draw(2, 3 * hidden, hidden, scale=0.4), "c": np.zeros((2, hidden, 1), np.float32), "w": draw(len(langs), 2 * hidden, scale=0.3), "b": np.zeros((len(langs), 1), np.float32)}

    def states(self, data: np.ndarray, real: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
        """Both directions' states (T, 2, H, B), each at the step it was made; ``data``: bytes (T, B); ``real``: 0 where a byte is padding."""
        t_all, rows = data.shape
        n, p = self.hidden, self.p
        h = np.zeros((2, n, rows), np.float32)
        out = np.empty((t_all, 2, n, rows), np.float32)
        gates = np.empty((2, 3 * n, rows), np.float32)
        for t in range(t_all):
            back = t_all - 1 - t
            np.take(p["x"][0], data[t], axis=1, out=gates[0], mode="clip")
            np.take(p["x"][1], data[back], axis=1, out=gates[1], mode="clip")
            rec = np.matmul(p["u"], h)
            zr = gates[:, : 2 * n]
            zr += rec[:, : 2 * n]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :n], zr[:, n:]
            q = rec[:, 2 * n :]
            q += p["c"]
            cand = gates[:, 2 * n :]
            cand += r * q
            np.tanh(cand, out=cand)
            if keep is not None:
                keep.append((h, z.copy(), r.copy(), q.copy(), cand.copy()))
            h = cand + z * (h - cand)
            if real is not None:
                h[0] *= real[t]
                h[1] *= real[back]
            out[t] = h
        return out

    def joined(self, states: np.ndarray) -> np.ndarray:
        """(2H, T, B): both states of each position."""
        n = self.hidden
        t_all, _, _, rows = states.shape
        both = np.empty((2 * n, t_all, rows), np.float32)
        both[:n] = states[:, 0].transpose(1, 0, 2)
        both[n:] = states[::-1, 1].transpose(1, 0, 2)
        return both

    def probabilities(self, both: np.ndarray) -> np.ndarray:
        """(C, T, B)"""
        logits = np.matmul(self.p["w"], both.reshape(len(both), -1))
        logits += self.p["b"]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits.reshape(-1, *both.shape[1:])

    def gradients(self, data: np.ndarray, real: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over real positions, and its gradient by backpropagation through time."""
        n, p = self.hidden, self.p
        t_all, rows = data.shape
        keep: list = []
        states = self.states(data, real, keep)
        both = self.joined(states)
        prob = self.probabilities(both)
        total = real.sum()
        picked = np.take_along_axis(prob, labels[None, None, :].repeat(t_all, 1), axis=0)[0]
        loss = float(-(np.log(picked + 1e-9) * real).sum() / total)
        d = prob.copy()
        d[labels, :, np.arange(rows)] -= 1
        d *= real / total
        flat = d.reshape(len(d), -1)
        g = {"w": flat @ both.reshape(2 * n, -1).T, "b": flat.sum(axis=1, keepdims=True), "x": np.zeros_like(p["x"]), "u": np.zeros_like(p["u"]), "c": np.zeros_like(p["c"])}
        d_both = (p["w"].T @ flat).reshape(2 * n, t_all, rows)
        d_h = np.zeros((2, n, rows), np.float32)
        for t in reversed(range(t_all)):
            back = t_all - 1 - t
            d_h[0] += d_both[:n, t]
            d_h[1] += d_both[n:, back]
            d_h[0] *= real[t]
            d_h[1] *= real[back]
            h, z, r, q, cand = keep[t]
            d_cand = d_h * (1 - z) * (1 - cand * cand)
            d_z = d_h * (h - cand) * z * (1 - z)
            d_q = d_cand * r
            d_r = d_cand * q * r * (1 - r)
            d_rec = np.concatenate([d_z, d_r, d_q], axis=1)
            d_gate = np.concatenate([d_z, d_r, d_cand], axis=1)
            g["u"] += d_rec @ h.transpose(0, 2, 1)
            g["c"] += d_q.sum(axis=2, keepdims=True)
            for k, at in ((0, t), (1, back)):
                np.add.at(g["x"][k].T, data[at], d_gate[k].T)
            d_h = d_h * z + p["u"].transpose(0, 2, 1) @ d_rec
        return loss, g

    def fit(self, windows: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> list[float]:
        """Adam over shuffled stretches, all languages weighing the same; returns the mean loss of each pass."""
        rng = np.random.default_rng(seed)
        data, lengths = stretches(windows, STRETCH)
        target = np.repeat(np.array(labels), lengths)
        real = (data != 0).astype(np.float32)
        groups = [np.flatnonzero(target == k) for k in range(len(self.langs))]
        most = max(map(len, groups))
        m, v, step, losses = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0, []
        for epoch in range(epochs):
            order = np.concatenate([rng.permutation(np.resize(rng.permutation(x), most)) for x in groups if len(x)])
            rng.shuffle(order)
            seen = []
            for at in range(0, len(order), STEP_ROWS):
                own = order[at : at + STEP_ROWS]
                loss, g = self.gradients(np.ascontiguousarray(data[own].T), np.ascontiguousarray(real[own].T), target[own])
                seen.append(loss)
                step += 1
                rate = RATE * (1 - 0.9 * epoch / max(1, epochs - 1))
                for k, x in self.p.items():
                    grad = np.clip(g[k], -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    x -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses

    def positions(self, text: str) -> np.ndarray:
        """The language index of every byte of the text."""
        raw = text.encode()
        data, _ = stretches([raw], STRETCH)
        labels = [self.probabilities(self.joined(self.states(np.ascontiguousarray(d.T), np.ascontiguousarray((d != 0).T.astype(np.float32))))).argmax(axis=0).T.ravel() for d in np.array_split(data, max(1, len(data) // BATCH + 1)) if len(d)]
        return np.concatenate([*labels, np.empty(0, int)])[: len(raw)]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(documents, C): the mean probability over all bytes of each text (texts of one byte or more)."""
        data, counts = stretches(texts, STRETCH)
        sums = np.empty((len(data), len(self.langs)), np.float32)
        full = data[:, -1] != 0
        for own in (np.flatnonzero(full), np.flatnonzero(~full)):
            for at in range(0, len(own), BATCH):
                some = own[at : at + BATCH]
                bytes_ = np.ascontiguousarray(data[some].T)
                real = None if full[some[0]] else (bytes_ != 0).astype(np.float32)
                prob = self.probabilities(self.joined(self.states(bytes_, real)))
                sums[some] = (prob if real is None else prob * real).sum(axis=1).T
        first = np.cumsum(counts) - counts
        pooled = np.add.reduceat(sums, first, axis=0)
        return pooled / pooled.sum(axis=1, keepdims=True)


def stretches(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (rows, width), the last row of each text padded with 0 (a 0 in a text reads as a blank), and the rows of each text."""
    padded = [(t.replace(b"\0", b" ") if b"\0" in t else t) + b"\0" * (-len(t) % width) for t in texts]
    return np.frombuffer(b"".join(padded), np.uint8).reshape(-1, width), np.array([len(p) // width for p in padded], dtype=np.int64)


def held_out(key: Column) -> Column:
    """True for the third of ids that teach nothing: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, epochs: int = EPOCHS) -> ByteGRU | None:
    """A model from the rows of ``docs`` that have a language; None if there are none."""
    text = col(text_col).cast("string")
    own = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("key"), col(lang_col).cast("string").alias("lang"), text.alias("text"))
    own = own.where(F.col("lang").isNotNull() & (F.char_length(F.trim("text")) > 0))
    sizes = written(own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_TOTAL), "language-sizes")
    known = sizes.count()
    if not known:
        return None
    # rows whose hash lies below their language's share: no task gathers a language, whatever part of the rows it has
    share = sizes.select(F.col("lang").alias("_lang"), (F.lit(float(max(1, min(sample_docs, SAMPLE_TOTAL // known)))) / F.col("n")).alias("share"))
    some = own.join(F.broadcast(share), F.col("lang") == F.col("_lang"))  # SAMPLE_TOTAL rows at most
    cuts = F.array(*[F.substring("text", F.pmod(F.xxhash64("key", F.lit(k)), F.greatest(F.char_length("text") - STRETCH, F.lit(1))).cast("int") + 1, F.lit(STRETCH)) for k in range(SAMPLE_WINDOWS)])
    drawn = some.select("lang", "share", F.xxhash64("key", "text").alias("h"), cuts.alias("cuts"))
    least = drawn.groupBy("lang").agg(F.min(F.struct("h", "cuts")).alias("r")).select("lang", "r.h", "r.cuts")
    below = drawn.where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "h", "cuts")
    rows = below.union(least).groupBy("h", "lang").agg(F.min("cuts").alias("cuts")).collect()  # about sample_docs rows of each language
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    # each stretch also in capitals, so that capitals alone don't mislead
    pairs = sorted((r["lang"], r["h"], x.encode()[:STRETCH]) for r in rows for c in r["cuts"] if c for x in (c, c.upper()))
    model = ByteGRU(langs)
    model.fit([c for *_, c in pairs], [langs.index(x) for x, *_ in pairs], epochs)
    return model


def predict(docs: DataFrame, model: ByteGRU | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            held, size = [], 0

            def flush() -> None:
                if held:
                    prob = model.pooled([t for _, t in held])
                    best = prob.argmax(axis=1)
                    for (k, _), lang, p in zip(held, best.tolist(), prob.max(axis=1).tolist(), strict=True):
                        preds[k], scores[k] = model.langs[lang], min(1.0, p)
                    held.clear()

            for k, value in enumerate(batch.column(1)):
                text = value.as_py()
                if model is not None and text and any(map(str.isalpha, text)):
                    held.append((k, text.encode()))
                    size += len(held[-1][1])
                    if size >= BATCH * STRETCH:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(freed(run), "doc_id long, lang_pred string, score double")


def op8_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
