"""Language identification with a byte convolutional network.

Filters of several byte widths run over the whole text; the largest response of each filter in every
fixed-length window feeds a softmax, and the windows' probabilities are averaged.  The network is
trained in numpy on a bounded sample of labelled windows and applied to all texts in batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import add_columns
from .common import HASH_RANGE

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
PAD = max(WIDTHS) - 1
UNKNOWN = "und"


@dataclass
class ByteNet:
    """``filters[k][j]``: weights (256 bytes x filters) of byte j of width k; ``bias``; ``dense`` and ``out`` feed the softmax."""

    langs: list[str]
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    out: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """The filters of two neighbouring bytes as one table of 65,536 rows: half as many look-ups."""
        made = []
        for t in self.filters:
            steps = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, len(t) - 1, 2)]
            made.append(steps + ([t[-1]] if len(t) % 2 else []))
        return made

    def windows(self, x: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
        """Probabilities (windows x languages) of bytes ``x``, WINDOW * n + PAD long."""
        n = (len(x) - PAD) // WINDOW
        p = np.empty((n, len(self.langs)))
        for at in range(0, n, 128):
            m = min(128, n - at)
            part = x[at * WINDOW:(at + m) * WINDOW + PAD].astype(np.int32)
            two, size, pooled = part[:-1] * 256 + part[1:], m * WINDOW, []
            for steps, bias in zip(pairs, self.bias):
                y = None
                for j, t in enumerate(steps):
                    seen = t.take((two if len(t) > 256 else part)[2 * j:2 * j + size], axis=0)
                    y = seen if y is None else np.add(y, seen, out=y)
                pooled.append(np.maximum(y.reshape(m, WINDOW, -1).max(axis=1) + bias, 0))
            z = np.concatenate(pooled, axis=1) @ self.dense + self.out
            z = np.exp(z - z.max(axis=1, keepdims=True))
            p[at:at + m] = z / z.sum(axis=1, keepdims=True)
        return p


def encode(text: str) -> bytes:
    """Bytes that the network sees: UTF-8 with A-Z lowered."""
    return text.encode().lower()


def train(texts: list[str], langs: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.004, seed: int = 7) -> ByteNet:
    """Fit the network on one window (the first WINDOW bytes) of each given passage by Adam on the cross-entropy."""
    names, rng = sorted(set(langs)), np.random.default_rng(seed)
    label = np.array([names.index(x) for x in langs])
    x = np.full((len(texts), WINDOW + PAD), 32, np.uint8)
    for i, t in enumerate(texts):
        b = np.frombuffer(encode(t)[:WINDOW + PAD], np.uint8)
        x[i, :len(b)] = b
    total = FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS] + [np.zeros(FILTERS) for _ in WIDTHS]
    params += [rng.normal(0, 0.3, (total, len(names))), np.zeros(len(names))]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at:at + batch]
            b, m = x[rows].astype(np.int64), len(rows)
            pooled, where = [], []
            for k, w in enumerate(WIDTHS):
                y = sum(params[k][j][b[:, j:j + WINDOW]] for j in range(w)) + params[len(WIDTHS) + k]
                top = y.argmax(axis=1)
                where.append(top)
                pooled.append(np.maximum(np.take_along_axis(y, top[:, None, :], axis=1)[:, 0], 0))
            h = np.concatenate(pooled, axis=1)
            z = h @ params[-2] + params[-1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = z / z.sum(axis=1, keepdims=True)
            dz[np.arange(m), label[rows]] -= 1
            dz /= m
            dh = (dz @ params[-2].T) * (h > 0)
            grads = [np.zeros_like(p) for p in params]
            grads[-2], grads[-1] = h.T @ dz, dz.sum(axis=0)
            for k, w in enumerate(WIDTHS):
                g = dh[:, k * FILTERS:(k + 1) * FILTERS]
                grads[len(WIDTHS) + k] = g.sum(axis=0)
                for j in range(w):
                    seen = np.take_along_axis(b, where[k] + j, axis=1)
                    np.add.at(grads[k][j], (seen, np.broadcast_to(np.arange(FILTERS), seen.shape)), g)
            step += 1
            for p, g, u, v in zip(params, grads, first, second):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                p -= rate * (u / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    k = len(WIDTHS)
    f32 = [p.astype(np.float32) for p in params]
    return ByteNet(names, f32[:k], f32[k:2 * k], f32[-2], f32[-1])


def labelled_windows(labelled: DataFrame, per_lang: int = 1000, windows: int = 3) -> tuple[list[str], list[str]]:
    """The bounded training sample: passages of up to ``per_lang`` documents of each language, ``windows`` from each.

    Documents are taken in the order of a hash of their id, passages start at hashed places anywhere in
    the text.  At most ``per_lang * windows`` short passages of each language reach the driver.
    """
    d = labelled.where("text is not null and lang is not null and length(text) > 0")
    # documents of each language: as many numbers as the network has outputs
    size = d.groupBy("lang").count().collect()
    if not size:
        return [], []
    h = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(HASH_RANGE))
    # below this share of the hash range lie about twice as many documents as are wanted
    below = F.create_map(*[F.lit(v) for r in size for v in (r["lang"], min(1.0, (2 * per_lang + 100) / r["count"]) * HASH_RANGE)])
    d = d.where(h < below[F.col("lang")]).select("lang", h.alias("_h"), F.expr(
        f"transform(sequence(1, {windows}), i -> substring(text, 1 + cast(pmod(xxhash64(doc_id, i), "
        f"greatest(1, char_length(text) - {WINDOW} + 1)) as int), {WINDOW + PAD}))").alias("_w"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "_w"))).where(F.col("_r") <= per_lang)
    rows = sorted((r.lang, r._r, r._w) for r in d.select("lang", "_r", "_w").collect())
    pairs = [(w, lang) for lang, _, ws in rows for w in ws if any(map(str.isalpha, w))]
    return [w for w, _ in pairs], [lang for _, lang in pairs]


def predict(docs: DataFrame, net: ByteNet | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``keep``, ``lang_pred`` and ``score`` of every whole text.

    A text that is null or has no letter gets ``und`` with score 0, and so does every text when there
    was nothing to learn from (``net`` None).  Only the text is looked at.
    """
    made: dict[str, list] = {}

    def work(texts: list) -> dict[str, list]:
        pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        live = [i for i, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
        if live:
            if "pairs" not in made:
                made["pairs"] = net.pairs()
            parts, starts, n = [], [], 0
            for i in live:
                b = encode(texts[i])
                fill = -(-(len(b) + PAD) // WINDOW)
                parts.append(b + b" " * (fill * WINDOW - len(b)))
                starts.append(n)
                n += fill
            x = np.frombuffer(b"".join(parts) + b" " * PAD, np.uint8)
            p = np.add.reduceat(net.windows(x, made["pairs"]), starts, axis=0)
            p /= p.sum(axis=1, keepdims=True)
            for i, best, s in zip(live, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                pred[i], score[i] = net.langs[best], min(1.0, s)
        return {"lang_pred": pred, "score": score}

    return add_columns(docs, [key, *keep], text, "lang_pred string, score double", work)


def learn(labelled: DataFrame) -> ByteNet | None:
    """A network from ``doc_id, text, lang`` rows; None when no row has both a text with letters and a language."""
    texts, langs = labelled_windows(labelled)
    return train(texts, langs) if texts else None
