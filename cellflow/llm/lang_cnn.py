"""Language identification by a small byte convolutional network, trained in numpy.

Texts become fixed-length windows of byte codes; filters of widths 2, 3 and 4 over byte embeddings, max pooling and a softmax give each
window's languages, and a text's are the mean over its windows by their letters. After training, embeddings and filters are folded into
tables for pairs of codes, so that a window costs a few gathers a byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import label_fold, pick, ship
from .shingles import chunks

WINDOW, WIDTHS, FILTERS, DIM = 128, (2, 3, 4), 12, 8
#: The sample that is fitted on: about so many documents a language, chosen by hash, and of all windows of their whole texts at most so many
#: a language, chosen by hash too.
TRAIN_DOCS, TRAIN_WINDOWS = 400, 2_000
#: More values of lang than this are an error: a softmax has one output for each.
MOST_LANGS = 10_000
#: 0 for a space and all that is no letter, 1 to 26 for a-z, 27 on for the bytes of other characters.
CODES = 27 + 128
_ORDER = np.zeros(256, np.int64)
_ORDER[97:123] = np.arange(1, 27)
_ORDER[65:91] = np.arange(1, 27)
_ORDER[128:] = np.arange(27, CODES)


def codes(raw: bytes) -> np.ndarray:
    """Codes of a text's bytes, capitals (A-Z, and À-Þ in UTF-8) as small letters."""
    b = np.frombuffer(raw, np.uint8)
    out = _ORDER[b]
    if len(b) > 1:
        up = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
        out[up] += 0x20
    return out


def windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts (the last of each filled up with 0), and how many each text has (one at least)."""
    count = np.array([max(1, -(-len(b) // WINDOW)) for b in raw])
    out = np.zeros(count.sum() * WINDOW, np.int64)
    at = np.concatenate(([0], np.cumsum(count)[:-1])) * WINDOW
    for a, b in zip(at.tolist(), raw, strict=True):
        out[a : a + len(b)] = codes(b)
    return out.reshape(-1, WINDOW), count


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # (width * DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    pairs: list | None = None

    def fold(self) -> Net:
        """Tables of pair and single contributions for each width."""
        self.pairs = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            part = [(self.embed @ f[k * DIM : (k + 1) * DIM]).astype(np.float32) for k in range(w)]
            both = lambda a, b: (a[:, None] + b[None]).reshape(CODES * CODES, FILTERS)
            self.pairs.append([(0, both(part[0], part[1])), *([(2, part[2])] if w == 3 else [(2, both(part[2], part[3]))] if w == 4 else [])])
        return self

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each window, from the tables."""
        pair, out = x[:, :-1] * CODES + x[:, 1:], []
        for w, tables, b in zip(WIDTHS, self.pairs, self.bias, strict=True):
            n = WINDOW - w + 1
            total = 0
            for shift, t in tables:
                total = total + np.take(t, (x if len(t) == CODES else pair)[:, shift : shift + n], axis=0)
            out.append(np.maximum(total.max(axis=1) + b, 0))
        return np.concatenate(out, 1)

    def predict(self, x: np.ndarray, step: int = 512) -> np.ndarray:
        out = [softmax(self.pooled(x[k : k + step]) @ self.out + self.out_bias) for k in range(0, len(x), step)]
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)))


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def letters(x: np.ndarray) -> np.ndarray:
    """Letters of each window."""
    return (x > 0).sum(1)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 5, batch: int = 64, rate: float = 0.004, seed: int = 7) -> Net:
    """Adam on windows x with language numbers y, each weighed by its letters. Gradients pass through the pooled positions alone."""
    rng = np.random.default_rng(seed)
    net = Net(langs, rng.normal(0, 0.5, (CODES, DIM)), [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))), np.zeros(len(langs)))
    state: dict[int, list] = {}
    turn, weight = 0, letters(x).astype(float)
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            c, turn = x[chosen], turn + 1
            e = net.embed[c]
            columns, places, pooled = [], [], []
            for w, f, b in zip(WIDTHS, net.filters, net.bias, strict=True):
                col = np.concatenate([e[:, k : WINDOW - w + 1 + k] for k in range(w)], 2)
                z = col @ f + b
                places.append(z.argmax(1))
                columns.append(col)
                pooled.append(np.maximum(z.max(1), 0))
            h = np.concatenate(pooled, 1)
            p = softmax(h @ net.out + net.out_bias)
            p[np.arange(len(c)), y[chosen]] -= 1
            p *= (weight[chosen] / max(weight[chosen].sum(), 1e-9))[:, None]
            grads = [(net.out, h.T @ p), (net.out_bias, p.sum(0))]
            back, ge, rows = (p @ net.out.T) * (h > 0), np.zeros_like(net.embed), np.arange(len(c))[:, None]
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                at = columns[k][rows, places[k]]  # (batch, FILTERS, width * DIM)
                grads += [(net.filters[k], np.einsum("bf,bfd->df", g, at)), (net.bias[k], g.sum(0))]
                down = g[:, :, None] * net.filters[k].T[None]
                for j in range(w):
                    np.add.at(ge, c[rows, places[k] + j], down[:, :, j * DIM : (j + 1) * DIM])
            for v, g in [*grads, (net.embed, ge)]:
                m, s = state.setdefault(id(v), [np.zeros_like(v), np.zeros_like(v)])
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.999**turn)) + 1e-8)
    return net.fold()


def fit_language(docs: DataFrame, per_lang: int = TRAIN_DOCS, windows_per_lang: int = TRAIN_WINDOWS) -> Net | None:
    """Fitted on about per_lang documents of each language outside the held-out fold; None if no document has a language.

    Texts are cut into windows on the executors; the driver gets about windows_per_lang windows of WINDOW bytes a language (twice as many at
    most), chosen by a hash of their places, whatever the texts' lengths. Windows without a letter teach nothing and are left out.
    """
    known = pick(docs, doc_id="long", text="string", lang="string").where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(label_fold(F.col("doc_id"), 4) != 2)
    size = F.ceil(F.octet_length("text") / WINDOW)
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(size).alias("w")).limit(MOST_LANGS + 1).collect()
    langs = sorted(r["lang"] for r in found)
    if len(langs) > MOST_LANGS:
        raise ValueError(f"lang has more than {MOST_LANGS} values")
    if not langs:
        return None
    # Shares of documents, and then of the windows that are to be expected in those.
    share = {r["lang"]: min(1.0, per_lang / r["n"]) for r in found}
    part = {r["lang"]: min(1.0, windows_per_lang / max(1.0, r["w"] * share[r["lang"]])) for r in found}
    of = lambda shares: F.try_element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, shares[k])]), "lang")
    under = lambda h, shares: F.pmod(h, F.lit(1 << 20)) < of(shares) * (1 << 20)
    chosen = known.where(under(F.xxhash64("doc_id", F.lit(4)), share)).withColumn("raw", F.encode("text", "utf-8"))
    cut = chosen.where(F.octet_length("raw") > 0).select("doc_id", "lang", "raw", F.explode(F.sequence(F.lit(0), F.ceil(F.octet_length("raw") / WINDOW).cast("int") - 1)).alias("k"))
    some = cut.where(under(F.xxhash64("doc_id", "k", F.lit(5)), part)).select("lang", F.xxhash64("doc_id", "k").alias("h"), F.substring("raw", F.col("k") * WINDOW + 1, F.lit(WINDOW)).alias("piece"))
    sample = [(r["lang"], bytes(r["piece"])) for r in some.orderBy("h", "lang", "piece").limit(2 * windows_per_lang * len(langs)).collect()]
    x, _ = windows([b for _, b in sample]) if sample else (np.zeros((0, WINDOW), np.int64), None)
    taught = letters(x) > 0
    if not taught.any():
        return None
    y = np.array([langs.index(k) for k, _ in sample])
    return train(x[taught], y[taught], langs)


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out (its fold of four is 2), lang_pred, score (the mean probability of lang_pred).

    A text that is null or has no letter is `und` with score 0. Other letters than the learned languages use still get the likeliest of them.
    Repeated rows are judged alike. If no document has a language (or none with one has a letter), all are `und`.
    """
    net = fit_language(docs)

    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for _, raw in chunks(texts.tolist()):
            x, count = windows(raw)
            p = net.predict(x) * (letters(x)[:, None] + 1e-6)
            mean = np.add.reduceat(p, np.concatenate(([0], np.cumsum(count)[:-1])), axis=0)
            mean /= mean.sum(1, keepdims=True)
            best = mean.argmax(1)
            langs += [net.langs[k] for k in best]
            scores += mean[np.arange(len(best)), best].tolist()
        return pd.DataFrame({"lang": langs, "score": scores})

    rows = pick(docs, doc_id="long", text="string").withColumn("held_out", label_fold(F.col("doc_id"), 4) == 2)
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    udf = F.pandas_udf(predict, "lang string, score double", F.PandasUDFType.SCALAR)
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has")
    told = rows.select("doc_id", "held_out", has, udf("text").alias("p"))
    return told.select("doc_id", "held_out", F.when(F.col("has"), F.col("p.lang")).otherwise("und").alias("lang_pred"), F.when(F.col("has"), F.least(F.lit(1.0), F.col("p.score"))).otherwise(0.0).alias("score"))


ship(__name__)
