"""Language identification by a byte convolutional network, in numpy.

A window of WINDOW bytes goes through filters of several widths over one-hot
bytes, max pooling over the window and a softmax. A convolution over one-hot
bytes is a sum of table rows, one table per byte of the filter's width. The
network is trained on a bounded sample of labelled windows; a prediction runs
over all windows of a whole text and averages their log-probabilities, weighted
by the bytes they hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, columns_only, stored

WINDOW = 96
WIDTHS = (2, 3, 4)
FILTERS = 12
#: At most so many labelled texts are fitted, about equally many per language,
#: from each one window's bytes. This bounds what reaches the driver.
SAMPLE = 8000
EPOCHS = 12
UNDECIDED = "und"


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def has_letter(text: str) -> bool:
    """Whether some character is of the Unicode category L, as ``isalpha`` has it."""
    return any(map(str.isalpha, text))


def to_bytes(text: str) -> np.ndarray:
    """Lower-cased UTF-8; digits are one symbol, white space another."""
    folded = re.sub(r"\s+", " ", re.sub(r"\d", "0", text.lower()))
    return np.frombuffer(folded.encode("utf-8", "replace"), np.uint8)


def windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last one filled with zeros, and the bytes in each."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = data
    held = np.full(n, WINDOW, np.float32)
    held[-1] = len(data) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), held


@dataclass
class Network:
    labels: list[str]
    tables: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray  # (filters of all widths, labels)
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        parts, where = [], []
        for table, bias in zip(self.tables, self.bias, strict=True):
            width = len(table)
            n = x.shape[1] - width + 1
            conv = table[0].take(x[:, :n], axis=0)
            for k in range(1, width):
                conv += table[k].take(x[:, k : k + n], axis=0)
            best = conv.argmax(axis=1)
            where.append(best)
            parts.append(np.take_along_axis(conv, best[:, None, :], axis=1)[:, 0, :] + bias)
        return np.concatenate(parts, axis=1), where

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(x)[0], 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on the cross-entropy; gradients reach the tables through each filter's best place."""
    r = np.random.default_rng(seed)
    tables = [r.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    for t in tables:
        t[:, 0, :] = 0
    wide = FILTERS * len(WIDTHS)
    net = Network(
        labels, tables, [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        r.normal(0, 0.1, (wide, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32),
    )
    params = [*net.tables, *net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = r.permutation(len(x))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            xb, yb = x[rows], y[rows]
            hidden, where = net.pooled(xb)
            active = np.maximum(hidden, 0)
            z = active @ net.out + net.out_bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            grads_out, grads_bias = active.T @ p, p.sum(axis=0)
            back = (p @ net.out.T) * (hidden > 0)
            grads_tables, grads_b = [], []
            for w, best in enumerate(where):
                own = back[:, w * FILTERS : (w + 1) * FILTERS]
                g = np.zeros_like(net.tables[w])
                for k in range(WIDTHS[w]):
                    np.add.at(g[k], (np.take_along_axis(xb, best + k, axis=1), np.arange(FILTERS)[None, :]), own)
                grads_tables.append(g)
                grads_b.append(own.sum(axis=0))
            step += 1
            for i, (param, g) in enumerate(zip(params, [*grads_tables, *grads_b, grads_out, grads_bias], strict=True)):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                param -= 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, size: int) -> list[tuple[str, str]]:
    """At most ``size`` pairs of label and text part, about as many for each label.

    Rows are chosen by a hash of their id, parts by another, so the choice
    doesn't depend on partitions. Held-out rows aren't read. More labels than
    ``size`` are an error, so what reaches the driver is bounded by it.
    """
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~is_held_out(id_col))
    usable = usable.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col), F.col(lang_col).alias("lang"))
    counts = stored(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "labels")
    labels = counts.count()
    if labels > size:
        raise ValueError(f"{labels} labels are more than the {size} texts of a sample")
    each = max(1, size // max(1, labels))
    usable = usable.join(F.broadcast(counts), "lang")  # at most ``size`` rows
    share = F.least(F.lit(1.0), F.lit(float(each)) / F.col("_n"))
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    length = F.length(text_col)
    start = F.pmod(F.xxhash64(F.col(id_col), F.lit(2)), F.greatest(length - 60, F.lit(1))) + 1
    part = F.substring(F.col(text_col), start.cast("int"), F.lit(2 * WINDOW))
    chosen = usable.filter(h < share).select("lang", part.alias("part"), F.xxhash64(id_col).alias("h"))
    rows = chosen.orderBy("h", "lang", "part").limit(size).collect()
    return [(r["lang"], r["part"]) for r in rows if has_letter(r["part"])]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SAMPLE) -> Network | None:
    sample = labelled_sample(docs, id_col, text_col, lang_col, size)
    labels = sorted({lang for lang, _ in sample})
    if not labels:
        return None
    r = np.random.default_rng(3)
    x, y = [], []
    for lang, part in sample:
        data = to_bytes(part)
        # Some windows are short, as the last of a text and all of a short text are.
        keep = WINDOW if r.random() < 0.7 else int(r.integers(4, WINDOW))
        x.append(windows(data[:keep])[0][0])
        y.append(labels.index(lang))
    return train(np.array(x), np.array(y), labels)


def _predictor(net: Network | None):
    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNDECIDED] * len(texts), [0.0] * len(texts)
        if net is None:
            return names, scores
        kept = [i for i, t in enumerate(texts) if t and has_letter(t)]
        total = np.zeros((len(kept), len(net.labels)), np.float64)
        weight = np.zeros(len(kept), np.float64)
        part_x, part_of, part_held, rows = [], [], [], 0

        def flush() -> None:
            x, of, held = np.concatenate(part_x), np.concatenate(part_of), np.concatenate(part_held)
            np.add.at(total, of, net.log_probabilities(x) * held[:, None])
            np.add.at(weight, of, held)

        for k, i in enumerate(kept):
            x, held = windows(to_bytes(texts[i]))
            for at in range(0, len(x), 1024):
                part_x.append(x[at : at + 1024])
                part_held.append(held[at : at + 1024])
                part_of.append(np.full(len(part_x[-1]), k))
                rows += len(part_x[-1])
                if rows >= 1024:
                    flush()
                    part_x, part_of, part_held, rows = [], [], [], 0
        if rows:
            flush()
        if kept:
            mean = total / np.maximum(weight, 1)[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for k, i in enumerate(kept):
                names[i], scores[i] = net.labels[best[k]], float(p[k, best[k]])
        return names, scores

    return predict


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, [kept columns,] lang_pred, score`` for every row, from its text alone.

    ``und`` with score 0 for a null text, one without a letter, and for all
    rows if nothing was labelled. Texts of any length are read whole, 1,024
    windows at a time. Repeated rows are predicted each; an empty table stays
    empty; columns other than the named ones aren't read.
    """
    named = bounded_batches(columns_only(docs, *dict.fromkeys((id_col, text_col, *keep))))
    at = named.columns.index(text_col)
    out = [c for c in named.columns if c in (id_col, *keep)]
    places = [named.columns.index(c) for c in out]
    predict = _predictor(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column(at).to_pylist())
            columns = [batch.column(i) for i in places]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*out, "lang_pred", "score"]
            )

    kinds = dict(named.dtypes)
    return named.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in out) + ", lang_pred string, score double")
