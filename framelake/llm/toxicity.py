"""Toxicity of texts: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A text's words (lower case, without the signs around them) are read in overlapping windows. A word's input is the embedding of the
word (by a hash) beside the mean embedding of its runs of four characters, its borders included, so an unknown form of a known
stem is known by its characters. Two GRUs read a window forward and backward; attention weighs their states, and the weighted
sum gives the window's probability. A text's score is that of its most toxic window, so a passage counts wherever it stands, and
all windows of the whole text are scored.

Labels tell of whole texts. In training, each text is scored with the present weights, and learns at its highest window (and one of
the others, if it isn't toxic). The first component of each embedding starts from the log odds of its hash in the sample. Most words of a
batch are read by their characters alone, so that a text isn't learned by heart by its rare words; in scoring, all of both is read.

The network is fitted on the driver, on at most SAMPLE labelled texts of each class, of SAMPLE_CHARS characters together at most:
those least by a hash of their id, each whole, up to the first that goes beyond. The weights, of a fixed size, are sent to the workers.

Defined results: a null text counts as empty; a text without words has the score 0; if the sample lacks a class, the score of any text
is 0 (no toxic one) or 1 (toxic ones alone); repeated rows give repeated results; labels that are null or of unknown ids aren't used. Texts of any length are scored whole. An
empty table gives an empty result; other columns are never read by the scan; rejecting() keeps them as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import batches_of, release, spread, table, texts

SAMPLE = 3000
SAMPLE_CHARS = 8_000_000
WINDOW, STRIDE = 24, 12
HIDDEN, WORD_DIMS, CHAR_DIMS = 8, 8, 8
BUCKETS = 1 << 14
EPOCHS, BATCH, RATE = 4, 64, 0.01
#: Embeddings learn so many times more slowly: they begin with what the whole sample tells of each hash.
SLOWER = 0.4
#: A small sample is read more often, until so many steps are done.
LEAST_STEPS = 300
#: The share of a batch's distinct words that are read by their characters alone, so that a text isn't learned by heart by its rare words.
DROPPED = 0.8
THRESHOLD = 0.7
SCORED_BYTES = 1 << 20
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…¡¿"
Weights = dict[str, np.ndarray]


class Words:
    """The distinct words of some texts: bucket of each, and buckets of its runs of four characters."""

    def __init__(self, names: list[str]):
        plain = [w.strip(SIGNS).encode() for w in names]
        self.word = np.array([zlib.crc32(w) & (BUCKETS - 1) for w in plain], np.int64)
        marked = [b"^" + w + b"$$"[: max(1, 3 - len(w))] for w in plain]  # four bytes at least
        sizes = np.array([len(w) for w in marked], np.int64)
        data = np.frombuffer(b"".join(marked) + b"\0\0\0", np.uint8).astype(np.uint64)
        four = data[:-3] | data[1:-2] << np.uint64(8) | data[2:-1] << np.uint64(16) | data[3:] << np.uint64(24)
        four = (four * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
        begins = np.cumsum(sizes) - sizes
        inside = np.ones(len(four) + 1, bool)
        for k in (1, 2, 3):
            inside[begins + sizes - k] = sizes < k
        self.grams = four[inside[: len(four)]].astype(np.int64)
        counts = np.maximum(sizes - 3, 0)
        self.count = np.maximum(counts, 1)
        self.owner = np.repeat(np.arange(len(names)), counts)
        self.begin = np.cumsum(counts) - counts

    def mean(self, embedding: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.word), embedding.shape[1]), embedding.dtype)
        some = np.flatnonzero(np.diff(np.append(self.begin, len(self.grams))) > 0)
        if len(some):
            out[some] = np.add.reduceat(embedding[self.grams], self.begin[some], axis=0)
        return out / self.count[:, None].astype(embedding.dtype)


def read(texts_: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
    """(distinct words, the words of all texts, how many each has)."""
    known: dict[str, int] = {}
    at: list[int] = []
    lengths = np.empty(len(texts_), np.int64)
    put = known.setdefault
    for k, text in enumerate(texts_):
        words = text.lower().split()
        lengths[k] = len(words)
        at += [put(w, len(known)) for w in words]
    return Words(list(known) or [""]), np.array(at, np.int64), lengths


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all overlapping windows of texts one after another."""
    many = np.where(lengths > 0, np.maximum(0, -(-(lengths - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(lengths)), many)
    within = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return text, np.repeat(np.cumsum(lengths) - lengths, many) + within, np.minimum(WINDOW, lengths[text] - within)


def new_weights(seed: int = 11) -> Weights:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    d, h = WORD_DIMS + CHAR_DIMS, HIDDEN
    w: Weights = {"word": draw(BUCKETS, WORD_DIMS, scale=0.05), "char": draw(BUCKETS, CHAR_DIMS, scale=0.05), "out": draw(2 * h, scale=0.3), "bias": np.zeros(1, np.float32), "look": draw(2 * h, scale=0.3)}
    for side in "fb":
        w |= {f"x{side}": draw(d, 3 * h, scale=0.4), f"b{side}": np.zeros(3 * h, np.float32), f"h{side}": draw(h, 3 * h, scale=0.3)}
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def inputs(w: Weights, words: Words) -> np.ndarray:
    return np.concatenate([w["word"][words.word], words.mean(w["char"])], axis=1)


def recur(p: np.ndarray, u: np.ndarray, at: np.ndarray, mask: np.ndarray, backward: bool, states: np.ndarray, kept: list | None = None) -> None:
    """A GRU over the columns of at (rows of p, the words' input products); states: gets the state after each word."""
    n = u.shape[0]
    h = np.zeros((len(at), n), u.dtype)
    for t in range(at.shape[1] - 1, -1, -1) if backward else range(at.shape[1]):
        a, b = p[at[:, t]], h @ u
        gates = sigmoid(a[:, : 2 * n] + b[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        c = np.tanh(a[:, 2 * n :] + r * b[:, 2 * n :])
        m = mask[:, t : t + 1]
        new = h + m * (1 - z) * (c - h)
        if kept is not None:
            kept.append((t, h, z, r, c, b[:, 2 * n :]))
        states[:, t] = h = new


def attend(w: Weights, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits, attention, weighted sums)."""
    look = states @ w["look"] + (mask - 1) * 1e4
    look = np.exp(look - look.max(axis=1, keepdims=True))
    look /= look.sum(axis=1, keepdims=True)
    pooled = (look[:, :, None] * states).sum(axis=1)
    return pooled @ w["out"] + w["bias"][0], look, pooled


def logits(w: Weights, x: np.ndarray, flat: np.ndarray, first: np.ndarray, size: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Of each window, given the distinct words' inputs x."""
    p = {s: x @ w[f"x{s}"] + w[f"b{s}"] for s in "fb"}
    out = np.empty(len(first), np.float32)
    for k in range(0, len(first), rows):
        at, mask = gather(flat, first[k : k + rows], size[k : k + rows])
        states = np.empty((len(at), WINDOW, 2 * HIDDEN), np.float32)
        recur(p["f"], w["hf"], at, mask, False, states[:, :, :HIDDEN])
        recur(p["b"], w["hb"], at, mask, True, states[:, :, HIDDEN:])
        out[k : k + rows] = attend(w, states, mask)[0]
    return out


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.arange(WINDOW)
    return flat[np.minimum(first[:, None] + place, len(flat) - 1)], (place < size[:, None]).astype(np.float32)


def gradients(w: Weights, words: Words, at: np.ndarray, mask: np.ndarray, target: np.ndarray, dropped: np.ndarray | None = None) -> tuple[float, Weights]:
    """(mean cross entropy, its gradients) of windows with targets; dropped: words that are read by their characters alone."""
    n, x = HIDDEN, inputs(w, words)
    if dropped is not None:
        x[dropped, :WORD_DIMS] = 0
    states = np.zeros((*at.shape, 2 * n), x.dtype)
    kept: dict[str, list] = {"f": [], "b": []}
    for s, part in (("f", states[:, :, :n]), ("b", states[:, :, n:])):
        recur(x @ w[f"x{s}"] + w[f"b{s}"], w[f"h{s}"], at, mask, s == "b", part, kept[s])
    logit, look, pooled = attend(w, states, mask)
    prob = sigmoid(logit)
    loss = float(-(target * np.log(prob + 1e-12) + (1 - target) * np.log(1 - prob + 1e-12)).mean())
    d = (prob - target) / len(target)
    g: Weights = {"out": pooled.T @ d, "bias": np.array([d.sum()], x.dtype)}
    d_pooled = d[:, None] * w["out"]
    d_look = (states * d_pooled[:, None]).sum(axis=2)
    d_look = look * (d_look - (look * d_look).sum(axis=1, keepdims=True))
    d_states = look[:, :, None] * d_pooled[:, None] + d_look[:, :, None] * w["look"]
    g["look"] = (d_look[:, :, None] * states).sum(axis=(0, 1))
    d_x = np.zeros_like(x)
    for s, part in (("f", d_states[:, :, :n]), ("b", d_states[:, :, n:])):
        u = w[f"h{s}"]
        d_p, d_u, d_h = np.zeros((len(x), 3 * n), x.dtype), np.zeros_like(u), np.zeros((len(at), n), x.dtype)
        for t, h, z, r, c, b in reversed(kept[s]):
            d_h = d_h + part[:, t]
            m = mask[:, t : t + 1]
            d_c = d_h * m * (1 - z) * (1 - c * c)
            d_z = -d_h * m * (c - h) * z * (1 - z)
            d_r = d_c * b * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_c], axis=1)
            d_b = np.concatenate([d_z, d_r, d_c * r], axis=1)
            np.add.at(d_p, at[:, t], d_a)
            d_u += h.T @ d_b
            d_h = d_h * (1 - m * (1 - z)) + d_b @ u.T
        g |= {f"h{s}": d_u, f"x{s}": x.T @ d_p, f"b{s}": d_p.sum(axis=0)}
        d_x += d_p @ w[f"x{s}"].T
    g["word"], g["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
    if dropped is not None:
        d_x[dropped, :WORD_DIMS] = 0
    np.add.at(g["word"], words.word, d_x[:, :WORD_DIMS])
    np.add.at(g["char"], words.grams, (d_x[:, WORD_DIMS:] / words.count[:, None])[words.owner])
    return loss, g


def log_odds(buckets: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Of each bucket, how much likelier it is in a toxic text, drawn to 0 where it is rare."""
    seen = np.zeros((2, BUCKETS))
    for b, y in zip(buckets, toxic):
        seen[int(y), b] += 1
    totals = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    rate = (seen + 0.5) / (totals[:, None] + 1)
    n = seen.sum(axis=0)
    return np.log(rate[1] / rate[0]) * n / (n + 10)


def fit(texts_: list[str], toxic: np.ndarray, *, epochs: int = EPOCHS, seed: int = 11) -> Weights | float:
    """Weights; or the score of all texts, where a class is missing."""
    if not len(toxic) or toxic.min() == toxic.max():
        return float(toxic.max()) if len(toxic) else 0.0
    w, rng = new_weights(seed), np.random.default_rng(seed)
    words, flat, lengths = read(texts_)
    ends = np.cumsum(lengths)
    own = [np.unique(flat[e - n : e]) for e, n in zip(ends, lengths)]
    gram_ends = np.append(words.begin[1:], len(words.grams))
    of_words = [np.unique(words.word[u]) for u in own]
    of_chars = [np.unique(np.concatenate([words.grams[words.begin[i] : gram_ends[i]] for i in u] or [words.grams[:0]])) for u in own]
    w["word"][:, 0] = log_odds(of_words, toxic)
    w["char"][:, 0] = log_odds(of_chars, toxic)
    text, first, size = windows(lengths)
    begin = np.searchsorted(text, np.arange(len(lengths)))
    end = np.searchsorted(text, np.arange(len(lengths)), side="right")
    usable = np.flatnonzero(end > begin)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(usable) // BATCH)))
    highest = begin.copy()
    for epoch in range(epochs):
        order = rng.permutation(usable)
        renew = epoch % max(1, epochs // 10) == 0  # the highest windows are found again ten times at most
        for k in range(0, len(order), BATCH * 8):
            part = order[k : k + BATCH * 8]
            if renew:
                all_ = np.concatenate([np.arange(begin[i], end[i]) for i in part])
                scored = logits(w, inputs(w, words), flat, first[all_], size[all_])
                bounds = np.cumsum([0, *(end[part] - begin[part])])
                highest[part] = [begin[i] + int(np.argmax(scored[a:b])) for i, a, b in zip(part, bounds, bounds[1:])]
            best, other = highest[part], rng.integers(begin[part], end[part])
            for j in range(0, len(part), BATCH):
                some = slice(j, j + BATCH)
                clean = toxic[part[some]] == 0
                picked = np.concatenate([best[some], other[some][clean]])
                target = np.concatenate([toxic[part[some]], np.zeros(int(clean.sum()))]).astype(np.float32)
                at, mask = gather(flat, first[picked], size[picked])
                used, local = np.unique(at, return_inverse=True)
                _, g = gradients(w, subset(words, used), local.reshape(at.shape), mask, target, rng.random(len(used)) < DROPPED)
                step += 1
                rate = RATE * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for name in w:
                    m[name] += 0.1 * (g[name] - m[name])
                    v[name] += 0.001 * (g[name] ** 2 - v[name])
                    own_rate = rate * (SLOWER if name in ("word", "char") else 1)
                    w[name] -= (own_rate * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32)
    return w


def subset(words: Words, used: np.ndarray) -> Words:
    out = object.__new__(Words)
    out.word, out.count = words.word[used], words.count[used]
    ends = np.append(words.begin[1:], len(words.grams))
    counts = (ends - words.begin)[used]
    out.begin = np.cumsum(counts) - counts
    out.owner = np.repeat(np.arange(len(used)), counts)
    out.grams = words.grams[np.repeat(words.begin[used] - out.begin, counts) + np.arange(int(counts.sum()))]
    return out


def score_texts(w: Weights | float, texts_: list[str]) -> np.ndarray:
    """The highest window's probability of each text."""
    words, flat, lengths = read(texts_)
    if isinstance(w, float) or not len(flat):
        return np.where(lengths > 0, w if isinstance(w, float) else 0.0, 0.0)
    text, first, size = windows(lengths)
    found = logits(w, inputs(w, words), flat, first, size)
    best = np.full(len(texts_), -np.inf)
    begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    best[text[begins]] = np.maximum.reduceat(found, begins)
    return np.where(lengths > 0, 1 / (1 + np.exp(-np.clip(best, -500, 500))), 0.0)


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 3


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Weights | float:
    """Fits on labelled texts whose remainder isn't 1: of each class at most sample, and at most sample_chars characters but for the first text."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(remainder(F.col("doc_id")) != 1)
    plain = texts(docs)
    known = plain.where("text <> ''").select("doc_id").distinct()
    once = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(known, "doc_id", "left_semi")
    picked = [once.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    drawn = F.broadcast(picked[0].union(picked[1]))  # 2 * sample rows at most
    found = plain.where("text <> ''").join(drawn, "doc_id").withColumn("order", F.xxhash64("doc_id"))
    in_class = Window.partitionBy("toxic").orderBy("order", "doc_id", "text")
    sized = found.select("toxic", "order", "doc_id", "text", F.row_number().over(in_class).alias("nth"), F.sum(F.char_length("text").cast("long")).over(in_class.rowsBetween(Window.unboundedPreceding, 0)).alias("chars"))
    rows = sized.where(f"nth = 1 OR nth <= {sample} AND chars <= {sample_chars}").orderBy("toxic", "nth").collect()
    return fit([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.int64))


def score(docs: DataFrame, weights: Weights | float, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB, as the constants fix it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held in batches_of(batches, SCORED_BYTES):
            with np.errstate(over="ignore"):
                found = score_texts(sent.value, [t.decode("utf-8", "replace") for t in held])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.float64())], ["doc_id", "score"])
        release()

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def rejecting(docs: DataFrame, weights: Weights | float, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            held = part.fillna("").tolist()
            out: list[np.ndarray] = []
            begin, size = 0, 0
            with np.errstate(over="ignore"):
                for k, t in enumerate(held):
                    size += len(t)
                    if size > SCORED_BYTES or k == len(held) - 1:
                        out.append(score_texts(sent.value, held[begin : k + 1]))
                        begin, size = k + 1, 0
            del held, part
            yield pd.Series(np.concatenate(out) if out else np.empty(0))
        release()

    return docs.where(scored("text") < threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(spread(docs), learn(docs, table(spark, sf_dir, "labels")))
