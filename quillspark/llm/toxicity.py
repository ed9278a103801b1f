"""Toxicity by a convolutional text classifier in numpy.

Words (runs of letters and digits, A-Z lower-cased) and their first PREFIX bytes are hashed to rows of an embedding
table, and the two rows added, so that inflected forms share what they begin with; filters of several widths
slide over the whole text, the strongest response of each filter is kept, and a logistic layer scores them. Training is
by Adagrad on a bounded sample of labelled rows (`per_class` of each label, by order of a hash of the id, and four fifths
of it at most). One threshold per language is calibrated on all labelled rows outside that sample, which are scored in a
distributed pass and counted by score; both classes weigh as in the corpus, so the threshold doesn't depend on the
sample's bound. Languages with few examples take the common one. Labels, language, source and id are no inputs.

Cases: null texts count as empty; a text without words scores by the bias alone. Repeated rows are scored alike. An id
with several labels counts as toxic if one says so; null labels are none. Without examples of both labels every score is
the share of label 1 (0 without labels). Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.common import remainder, tidy

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
#: Labelled rows of each class that training takes at most.
PER_CLASS = 3000
PAD, PREFIX = max(WIDTHS) - 1, 4
#: Steps of the score histograms for each unit of the logit.
BINS = 256


def word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows (of the word and of its beginning) of all words, with PAD empty ones (number BUCKETS) after each text, and where each text starts (their end at last)."""
    b = W.split(column, W.SIGNS)
    both = W.xxh64(b.data, b.start, b.end), W.xxh64(b.data, b.start, np.minimum(b.end, b.start + PREFIX), seed=7)
    rows = (np.stack(both, axis=1) & np.uint64(BUCKETS - 1)).astype(np.int32)
    out = np.full((len(rows) + PAD * b.docs, 2), BUCKETS, dtype=np.int32)
    out[np.arange(len(rows)) + PAD * b.doc] = rows
    return out, b.first + PAD * np.arange(b.docs + 1)


@dataclass
class Model:
    """table: embedding rows. filters: for each width an array of width x DIM x FILTERS. thresholds: by language, "" for others."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=lambda: {"": 0.5})

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        table = r.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
        table[BUCKETS] = 0
        filters = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(table, filters, np.zeros(n, np.float32), r.normal(0, 0.1, n).astype(np.float32), 0.0)

    def prepare(self) -> list[np.ndarray]:
        """What each embedding row adds to each filter at each place of its window: rows x (width x FILTERS)."""
        return [np.concatenate([self.table @ f[j] for j in range(len(f))], axis=1) for f in self.filters]

    def scores(self, words: np.ndarray, first: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
        """Scores of texts as word_buckets() gives them."""
        pooled = []
        n = len(words)
        for w, part in zip(WIDTHS, parts, strict=True):
            every = part[words[:, 0]] + part[words[:, 1]]
            y = every[:, :FILTERS]
            for j in range(1, w):
                y[: n - j] += every[j:, j * FILTERS : (j + 1) * FILTERS]  # past the end there is only padding, which adds nothing
            pooled.append(np.maximum.reduceat(y, first[:-1], axis=0) if len(first) > 1 else np.zeros((0, FILTERS), np.float32))
        strongest = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        return 1 / (1 + np.exp(-(strongest.astype(np.float64) @ self.out + self.out_bias)))


def fit(texts: list[np.ndarray], labels: np.ndarray, shares: tuple[float, float], epochs: int | None = None, batch: int = 32, rate: float = 0.1, seed: int = 7) -> Model:
    """texts: each with its padding. shares: rows in the corpus for each row in the sample, of label 0 and 1."""
    m, r = Model.fresh(seed), np.random.default_rng(seed)
    epochs = epochs or int(np.clip(800 * batch / len(texts), 6, 40))  # few texts are seen more often
    sums = {k: np.full(v.shape, 1e-4, np.float32) for k, v in {"table": m.table, "bias": m.bias, "out": m.out, **{f"f{w}": f for w, f in zip(WIDTHS, m.filters, strict=True)}}.items()}
    bias_sum = 1e-4
    weight = np.where(labels == 1, len(labels) / max(1, 2 * labels.sum()), len(labels) / max(1, 2 * (1 - labels).sum())).astype(np.float32)
    places = [np.arange(w) for w in WIDTHS]

    def step(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        sums[name] += grad * grad
        value -= rate * grad / np.sqrt(sums[name])

    for epoch in range(epochs):
        for chosen in np.array_split(r.permutation(len(texts)), max(1, len(texts) // batch)):
            n = len(chosen)
            windows, inputs, pooled = [], [], np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
            sizes = np.array([len(texts[i]) for i in chosen])
            first = np.concatenate([[0], np.cumsum(sizes)])
            words = np.concatenate([*(texts[i] for i in chosen), np.full((PAD, 2), BUCKETS, np.int32)])
            e = m.table[words[:, 0]] + m.table[words[:, 1]]
            for g, (w, f) in enumerate(zip(WIDTHS, m.filters, strict=True)):
                y = e[: first[-1]] @ f[0]
                for j in range(1, w):
                    y += e[j : j + first[-1]] @ f[j]
                at = np.stack([y[first[i] : first[i + 1]].argmax(axis=0) + first[i] for i in range(n)])
                pooled[:, g * FILTERS : (g + 1) * FILTERS] = np.take_along_axis(y, at.reshape(-1, FILTERS), axis=0)
                windows.append(words[at[:, :, None] + places[g]])
                inputs.append(e[at[:, :, None] + places[g]])
            active = pooled + m.bias > 0
            strongest = np.where(active, pooled + m.bias, 0)
            keep = (r.random(strongest.shape) > 0.2) / np.float32(0.8)
            p = 1 / (1 + np.exp(-((strongest * keep) @ m.out + m.out_bias)))
            g_out = ((p - labels[chosen]) * weight[chosen] / n).astype(np.float32)
            g_pool = np.where(active, g_out[:, None] * m.out * keep, 0).astype(np.float32)
            step("out", m.out, (strongest * keep).T @ g_out + 1e-4 * m.out)
            bias_sum += float(g_out.sum()) ** 2
            m.out_bias -= rate * float(g_out.sum()) / bias_sum**0.5
            step("bias", m.bias, g_pool.sum(axis=0))
            rows, grads = [], []
            for g, (w, f) in enumerate(zip(WIDTHS, m.filters, strict=True)):
                own = g_pool[:, g * FILTERS : (g + 1) * FILTERS]
                grad = (own[:, :, None, None] * f.transpose(2, 0, 1)[None]).reshape(-1, DIM)
                rows += [windows[g][..., 0].reshape(-1), windows[g][..., 1].reshape(-1)]
                grads += [grad, grad]
                step(f"f{w}", f, np.einsum("nf,nfwd->wdf", own, inputs[g]))
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            live = (rows < BUCKETS) & np.any(grads != 0, axis=1)
            used, where = np.unique(rows[live], return_inverse=True)
            total = np.zeros((len(used), DIM), np.float32)
            np.add.at(total, where, grads[live])
            sums["table"][used] += total * total
            m.table[used] -= rate * total / np.sqrt(sums["table"][used])
    n1, n0 = max(1, labels.sum()), max(1, (1 - labels).sum())
    m.out_bias += float(np.log(shares[1] * n1 / n0 / shares[0]))  # trained as if both classes were as frequent
    return m


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The middle of the cut that makes F1 largest, where each score counts as often as its weight says."""
    order = np.argsort(-scores, kind="stable")
    s, hits, taken = scores[order], np.cumsum((labels * weights)[order]), np.cumsum(weights[order])
    f1 = 2 * hits / (taken + (labels * weights).sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores stand on one side
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k]) / 2


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: np.ndarray, counts: np.ndarray, weights: np.ndarray, fewest: int = 15) -> dict[str, float]:
    """counts: rows of each score, label and language. weights: what such rows stand for in the corpus."""
    out = {"": best_threshold(scores, labels, weights)}
    for lang in sorted(set(langs.tolist()) - {""}):
        own = langs == lang
        if min(counts[own & (labels == c)].sum() for c in (0, 1)) >= fewest:
            out[lang] = best_threshold(scores[own], labels[own], weights[own])
    return out


def histogram(docs: DataFrame, given: DataFrame, fitted: DataFrame, m: Model, id_col: str, text_col: str, lang_col: str) -> list:
    """Rows of lang, bin (of the logit), toxic and n: how the labelled rows outside the fitted sample score."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = m.prepare()
        for batch in batches:
            at = 0
            for part in W.chunks(batch.column(2)):
                s = np.clip(m.scores(*word_buckets(part), parts), 1e-12, 1 - 1e-12)
                bins = np.floor(np.log(s / (1 - s)) * BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(bins)], names=["labelled", "lang", "bin"])
                at += len(part)

    # all texts are scored where they lie, so that only ids and bins are shuffled
    texts = docs.select(F.col(id_col).alias("labelled"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), text_col)
    scored = texts.mapInArrow(run, f"labelled {dict(docs.dtypes)[id_col]}, lang string, bin int")
    rest = given.withColumnRenamed(id_col, "labelled").where("toxic in (0, 1)").join(F.broadcast(fitted.select("labelled")), "labelled", "left_anti")
    return scored.join(rest, "labelled").groupBy("lang", "bin", F.col("toxic").cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, learned: object = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """learned: a condition on labels; rows outside it are not looked at."""
    given = labels.where("toxic is not null" if learned is None else F.col("toxic").isNotNull() & learned).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in given.groupBy("toxic").count().collect() if r[0] in (0, 1)}
    some = [given.where(F.col("toxic") == c).orderBy(F.xxhash64(id_col), id_col).limit(min(per_class, counts.get(c, 0) - counts.get(c, 0) // 5)) for c in (0, 1)]
    sample = some[0].union(some[1]).withColumnRenamed(id_col, "labelled")

    @tidy
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                words, first = word_buckets(part.column(3))
                texts = [words[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(texts, pa.binary())], names=["id", "toxic", "lang", "words"])

    texts = docs.select(id_col, F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), text_col)
    joined = texts.join(F.broadcast(sample), texts[id_col] == sample["labelled"]).select("labelled", F.col("toxic").cast("int").alias("toxic"), "lang", text_col)
    rows = sorted(joined.mapInArrow(hashed, f"id {dict(docs.dtypes)[id_col]}, toxic int, lang string, words binary").collect(), key=lambda r: (r["id"], r["words"]))
    y = np.array([r["toxic"] for r in rows], dtype=np.float32)
    total = sum(counts.values())
    if not len(y) or y.min() == y.max():
        m = Model.fresh()
        share = counts.get(1, 0) / total if total else 0.0
        m.out[:], m.out_bias = 0, float(np.clip(np.log(max(share, 1e-300) / max(1 - share, 1e-300)), -700, 700))
        return m
    texts = [np.frombuffer(r["words"], np.int32).reshape(-1, 2) for r in rows]
    shares = (counts.get(0, 0) / max(1, (1 - y).sum()), counts.get(1, 0) / max(1, y.sum()))
    m = fit(texts, y, shares)
    rows = histogram(docs, given, sample, m, id_col, text_col, lang_col)
    toxic, n = np.array([r["toxic"] for r in rows]), np.array([r["n"] for r in rows])
    if len(set(toxic.tolist())) == 2:
        # a class that the sample takes less of has more rows outside it; both are weighed as in the corpus
        whole = [(y == c).sum() + n[toxic == c].sum() for c in (0, 1)]
        weights = n * np.where(toxic == 1, whole[1] / n[toxic == 1].sum(), whole[0] / n[toxic == 0].sum())
        scores = 1 / (1 + np.exp(-(np.array([r["bin"] for r in rows]) + 0.5) / BINS))
        cuts = calibrate(scores, toxic, np.array([r["lang"] for r in rows]), n, weights)
        # move the common threshold to a score of 0.5
        logit = {k: float(np.log(t / (1 - t))) for k, t in ((k, np.clip(t, 1e-9, 1 - 1e-9)) for k, t in cuts.items())}
        m.out_bias -= logit[""]
        m.thresholds = {k: float(1 / (1 + np.exp(logit[""] - t))) for k, t in logit.items()}
    return m


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Adds score, predicted (at 0.5), threshold (of the language) and flagged to whole rows of docs; columns of these names are replaced."""
    schema = docs.schema
    names = [c for c in docs.columns if c not in ("score", "predicted", "threshold", "flagged")]
    kept = docs.select(*names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = model.prepare()
        for batch in batches:
            at = 0
            column = batch.column(names.index(text_col))
            for part in W.chunks(column):
                words, first = word_buckets(part)
                s = model.scores(words, first, parts)
                rows = batch.slice(at, len(part))
                at += len(part)
                langs = rows.column(names.index(lang_col)).to_pylist() if lang_col in names else [""] * len(part)
                cut = np.array([model.thresholds.get(x or "", model.thresholds[""]) for x in langs])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(cut), pa.array(s >= cut)], names=[*names, "score", "predicted", "threshold", "flagged"])

    from pyspark.sql import types as T

    out = T.StructType([*(schema[c] for c in names), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("threshold", T.DoubleType()), T.StructField("flagged", T.BooleanType())])
    return kept.mapInArrow(run, out)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Whole rows of docs with scores; rows whose crc32(doc_id as text) mod 5 is 0 are held out from learning."""
    model = train(docs, labels, per_class, learned=remainder("doc_id") != 0)
    return score(docs, model).withColumn("held_out", remainder("doc_id") == 0)


def reject(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Whole rows of docs, without those that reach their language's threshold."""
    model = train(docs, labels, per_class, learned=remainder("doc_id") != 0)
    at_text, at_lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = model.prepare()
        for batch in batches:
            at = 0
            for part in W.chunks(batch.column(at_text)):
                s = model.scores(*word_buckets(part), parts)
                rows = batch.slice(at, len(part))
                at += len(part)
                cut = np.array([model.thresholds.get(x or "", model.thresholds[""]) for x in rows.column(at_lang).to_pylist()])
                yield rows.filter(pa.array(s < cut))

    return docs.mapInArrow(run, docs.schema)
