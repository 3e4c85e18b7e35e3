"""Toxicity by a learned lexicon that is matched with spelling mistakes, and by what stands around each match.

The lexicon's whole words become Levenshtein automata (distance 1) and its stems plain prefixes. Intersected with the trie of the lexicon
they make one deterministic automaton over byte classes, which runs over all words of many texts at once: each step is a table lookup for
the words that are still alive. A match counts as quoted if a quotation mark or a word that reports speech stands in the window of words
around it; quoted and other matches, exact ones and misspelt ones are separate inputs of a logistic score.

Labelled texts hold hardly any true misspelling, so the weight of misspelt matches is learned from copies of the toxic texts whose lexicon
words are misspelt. Near-words that texts with label 0 hold are words of their own, not misspellings.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import label_fold, pick, ship
from .shingles import chunks

#: Labelled rows of each label that are learned from at most (those whose ids hash lowest).
TRAIN_ROWS = 2_000
#: The shortest word that may be misspelt and the lengths of stems, in bytes; words on each side of a match.
FUZZY_FROM, STEM, CONTEXT = 5, (5, 10), 6
#: An entry is found so many times as often in texts with label 1 as in the others, and in so many of the former: four, or one in fifty.
RATE, LEAST, SHARE = 8, 4, 50
#: Words that report what others say, and quotation marks (UTF-8).
REPORTS = [b"said", b"says", b"quote", b"quoted", b"called", b"wrote", b"dit", b"sagte", b"dijo"]
QUOTES = ['"', "“", "”", "«", "»", "„"]
EXACT, FUZZY, PREFIX = 1, 2, 3
FEATURES = 8

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def normal(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts with small letters, starts and ends of words (runs of letters and digits), and the texts' first words."""
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    low = _LOW[data]
    up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[up] += 0x20
    word = _IN_WORD[data]
    # Typographic quotation marks are no letters.
    for mark in QUOTES[1:]:
        b = np.frombuffer(mark.encode(), np.uint8)
        at = np.flatnonzero(data[: len(data) - len(b) + 1] == b[0])
        for k in range(1, len(b)):
            at = at[data[at + k] == b[k]]
        for k in range(len(b)):
            word[at + k] = False
    starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    return low, starts, ends, np.searchsorted(starts, np.cumsum([0, *[len(b) + 1 for b in raw]]))


@dataclass
class Matcher:
    """table: (state, byte class) to state, 0 is dead; accept: what a word that ends in a state is; regular: near-words that are no misspellings."""

    classes: np.ndarray
    table: np.ndarray
    accept: np.ndarray
    regular: frozenset = frozenset()

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word EXACT, FUZZY, PREFIX or 0."""
        out = np.zeros(len(starts), np.uint8)
        alive, state, step = np.arange(len(starts)), np.ones(len(starts), np.int32), 0
        while len(alive):
            done = starts[alive] + step >= ends[alive]
            out[alive[done]] = self.accept[state[done]]
            alive, state = alive[~done], state[~done]
            state = self.table[state, self.classes[data[starts[alive] + step]]]
            alive, state, step = alive[state > 0], state[state > 0], step + 1
        return out


def compile_lexicon(words: list[bytes], stems: list[bytes]) -> Matcher:
    """The subset construction over states (entry, place, mistakes), reached from the trie's root; matched stems absorb the rest of a word."""
    classes = np.zeros(256, np.int64)
    for k, b in enumerate(sorted({b for w in [*words, *stems] for b in w}), 1):
        classes[b] = k
    n = int(classes.max()) + 1
    entries = [([int(classes[b]) for b in w], 1 if len(w) >= FUZZY_FROM else 0) for w in words] + [([int(classes[b]) for b in s], -1) for s in stems]

    def closed(states: set[tuple[int, int, int]]) -> frozenset:
        """With letters of the entry left out; of two states at a place the one with fewer mistakes."""
        grown = set(states)
        for e, at, wrong in states:
            if wrong < entries[e][1] and at < len(entries[e][0]):
                grown.add((e, at + 1, wrong + 1))
        return frozenset(s for s in grown if (s[0], s[1], s[2] - 1) not in grown)

    def after(states: frozenset, c: int) -> frozenset:
        out = set()
        for e, at, wrong in states:
            letters, may = entries[e]
            if at < len(letters) and letters[at] == c:
                out.add((e, at + 1, wrong))
            elif may < 0 and at == len(letters):
                out.add((e, at, wrong))
            if wrong < may:
                out.add((e, at, wrong + 1))  # a letter too many
                if at < len(letters):
                    out.add((e, at + 1, wrong + 1))  # another letter
        return closed(out)

    def accepts(states: frozenset) -> int:
        ends = {EXACT if entries[e][1] >= 0 and not wrong else FUZZY if entries[e][1] >= 0 else PREFIX for e, at, wrong in states if at == len(entries[e][0])}
        return EXACT if EXACT in ends else PREFIX if PREFIX in ends else FUZZY if FUZZY in ends else 0

    start = closed({(e, 0, 0) for e in range(len(entries))})
    number, todo, table, accept = {frozenset(): 0, start: 1}, [start], [[0] * n], [0]
    while todo:
        states, row = todo.pop(0), []
        for c in range(n):
            to = after(states, c)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table.append(row)
        accept.append(accepts(states))
    return Matcher(classes, np.array(table, np.int32), np.array(accept, np.uint8))


def learn_lexicon(toxic: list[bytes], other: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """All whole words and stems that texts with label 1 have RATE times as often as the others. Each is in a SHARE-th of the former at least, so
    there are at most SHARE times as many as such a text has on average."""

    def words(raw: bytes) -> set[bytes]:
        low, starts, ends, _ = normal([raw])
        whole = low.tobytes()
        return {whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a >= 3}

    def keys(found: set[bytes]) -> set[tuple[bytes, bool]]:
        return {(w, False) for w in found} | {(w[:k], True) for w in found for k in range(STEM[0], min(STEM[1], len(w)) + 1)}

    p, n = Counter(), Counter()
    for raw in toxic:
        p.update(keys(words(raw)))
    few = max(LEAST, len(toxic) // SHARE)
    p = Counter({k: v for k, v in p.items() if v >= few})
    for raw in other:
        n.update(k for k in keys(words(raw)) if k in p)
    rate = {k: ((v + 0.5) / (len(toxic) + 1)) / ((n[k] + 0.5) / (len(other) + 1)) for k, v in p.items()}
    ranked = sorted((k for k in p if rate[k] >= RATE), key=lambda k: (-p[k] * np.log(rate[k]), k[1], -len(k[0]), k[0]))
    chosen: list[tuple[bytes, bool]] = []
    for word, stem in ranked:
        if not any(word.startswith(w) and (s or w == word) for w, s in chosen) and not any(stem and w.startswith(word) for w, s in chosen):
            chosen.append((word, stem))
    return [w for w, s in chosen if not s], [w for w, s in chosen if s]


def near_words(raw: list[bytes], matcher: Matcher) -> frozenset:
    """The words of texts that match the lexicon with a mistake."""
    data, starts, ends, _ = normal(raw)
    whole, hits = data.tobytes(), np.flatnonzero(matcher.run(data, starts, ends) == FUZZY)
    return frozenset(whole[starts[k] : ends[k]] for k in hits)


def misspelt(raw: bytes, matcher: Matcher) -> bytes:
    """The text with one mistake in each exact match that may be misspelt: in turn a letter twice, one left out, two kinds of another one."""
    data, starts, ends, _ = normal([raw])
    hits = np.flatnonzero((matcher.run(data, starts, ends) == EXACT) & (ends - starts >= FUZZY_FROM))
    out, done = [], 0
    for turn, k in enumerate(hits):
        ascii_at = [i for i in range(starts[k] + 1, ends[k]) if raw[i] < 128 and raw[i - 1] < 128]
        if not ascii_at:
            continue
        at = ascii_at[(7 * turn + ends[k] - starts[k]) % len(ascii_at)]
        letter = raw[at : at + 1]
        out += [raw[done:at], (letter * 2, b"", b"0", b"x" if letter != b"x" else b"y")[turn % 4]]
        done = at + 1
    return b"".join([*out, raw[done:]])


def features(raw: list[bytes], matcher: Matcher) -> np.ndarray:
    """For each text: logarithms of its counts of exact, misspelt and stem matches, each not quoted and quoted, of all that aren't quoted for 100 words, and of its words."""
    data, starts, ends, first = normal(raw)
    kind = matcher.run(data, starts, ends)
    if matcher.regular:
        whole = data.tobytes()
        kind[[k for k in np.flatnonzero(kind == FUZZY) if whole[starts[k] : ends[k]] in matcher.regular]] = 0
    hits = np.flatnonzero(kind)
    text = np.searchsorted(first, hits, "right") - 1
    out = np.zeros((len(raw), FEATURES))
    n = np.diff(first)
    if len(hits):
        mark = (data == 0x22).astype(np.int32)
        for q in QUOTES[1:]:
            b = np.frombuffer(q.encode(), np.uint8)
            at = np.flatnonzero(data[: len(data) - len(b) + 1] == b[0])
            for k in range(1, len(b)):
                at = at[data[at + k] == b[k]]
            mark[at] = 1
        marks = np.concatenate(([0], np.cumsum(mark)))
        a, b = np.maximum(hits - CONTEXT, first[text]), np.minimum(hits + CONTEXT, first[text + 1] - 1)
        quoted = marks[ends[b]] - marks[np.maximum(starts[a] - 3, 0)] > 0
        whole = data.tobytes()
        for k in np.flatnonzero(~quoted):
            quoted[k] = any(whole[starts[w] : ends[w]] in REPORTS for w in range(a[k], b[k] + 1))
        np.add.at(out, (text, 2 * (kind[hits] - 1) + quoted), 1.0)
    clear = out[:, 0] + out[:, 2] + out[:, 4]
    out[:, :6] = np.log1p(out[:, :6])
    out[:, 6], out[:, 7] = np.log1p(100 * clear / np.maximum(n, 1)), np.log1p(n) / 10
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Newton's steps for a logistic loss with a ridge on all but the constant, which comes last."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    matcher: Matcher
    weights: np.ndarray

    def score(self, raw: list[bytes]) -> np.ndarray:
        x = features(raw, self.matcher)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_matches(matcher: Matcher, toxic: list[bytes], other: list[bytes]) -> Model:
    """Weights from the labelled texts and from misspelt copies of the toxic ones that have an exact match. For the weights each half of the
    others is read with the near-words of the other half, as unseen texts are; the model has those of all."""
    halves = [other[0::2], other[1::2]]
    known = [near_words(h, matcher) if h else frozenset() for h in halves]
    seen = set(toxic)
    copies = [c for c in (misspelt(b, matcher) for b in toxic) if c not in seen]
    full = replace(matcher, regular=known[0] | known[1])
    parts = [features(toxic + copies, full), *[features(h, replace(matcher, regular=k)) for h, k in zip(halves, known[::-1], strict=True) if h]]
    w = fit_logistic(np.concatenate(parts), np.repeat([1.0, 0.0], [len(toxic) + len(copies), len(other)]))
    w[[2 * (k - 1) for k in (EXACT, FUZZY, PREFIX)]] = np.maximum(w[[2 * (k - 1) for k in (EXACT, FUZZY, PREFIX)]], 0)
    return Model(full, w)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fitted on at most `rows` labelled rows of each label whose fold of five isn't 0. All of them give both the lexicon and the weights.
    Of rows that share an id the one with the largest text counts, so 2 * rows texts reach the driver at most."""
    known = pick(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic in (0, 1)").where(label_fold(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    one = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = one(0).unionByName(one(1))  # 2 * rows ids at most
    texts = pick(docs, doc_id="long", text="string").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    sample = sorted(texts.collect(), key=lambda r: r["doc_id"])
    raw, y = [(r["text"] or "").encode("utf-8", "replace") for r in sample], np.array([r["y"] for r in sample], float)
    toxic, other = [b for b, k in zip(raw, y, strict=True) if k], [b for b, k in zip(raw, y, strict=True) if not k]
    matcher = compile_lexicon(*learn_lexicon(toxic, other))
    if not toxic or not other:
        return Model(matcher, np.append(np.zeros(FEATURES), 4.0 if toxic else -4.0))
    return fit_matches(matcher, toxic, other)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out (its fold of five is 0), score of label 1, predicted (score >= 0.5).

    Null and empty texts score as texts without words. A null id is not held out. Repeated rows are scored alike. Without labels of both
    classes all texts score alike.
    """
    model = fit_toxicity(docs, labels)

    def scored(texts: pd.Series) -> pd.Series:
        parts = [model.score(raw) for _, raw in chunks(texts.tolist())]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    udf = F.pandas_udf(scored, "double", F.PandasUDFType.SCALAR)
    rows = pick(docs, doc_id="long", text="string")
    return rows.select("doc_id", (label_fold(F.col("doc_id"), 5) == 0).alias("held_out"), udf("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


ship(__name__)
