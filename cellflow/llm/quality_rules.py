"""Learned decision lists: sequential covering grows and prunes threshold conjunctions from labelled statistics.

Everything is DataFrame aggregation. A grow step is one aggregate of (feature, bin, part, label) counts, at most
features x bins x 4 rows whatever the input; the driver only reads those counts and picks the next condition.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep, pick, rows_where, small
from .textstats import FEATURES, text_stats


@dataclass(frozen=True)
class Condition:
    """feature > cut (above) or feature <= cut."""

    feature: str
    cut: float
    above: bool

    def expr(self) -> Column:
        return F.col(self.feature) > F.lit(self.cut) if self.above else F.col(self.feature) <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.expr() for c in rule], F.lit(True))


def decision(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds, or null where none does."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        out = F.when(holds(rules[k]), F.lit(k)).otherwise(out)
    return out


def learn(labelled: DataFrame, features: list[str] = FEATURES, bins: int = 16, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.9, min_cover: int = 5) -> list[Rule]:
    """Rules for the rows whose column bad is 1, from the columns features, bad (0 or 1) and part (0 grow, 1 prune).

    Rows with a null feature or label are left out. Without rows of both kinds there are no rules. Ties between conditions go to the
    first feature, then the lower cut. A rule enters if on the prune part (on both, where that has under min_cover rows) its precision is
    min_precision at least and it covers min_cover bad rows over both parts.
    """
    rows = labelled.select("bad", "part", *features).dropna()
    shares = [(k + 1) / bins for k in range(bins - 1)]
    first = rows.agg(F.sum("bad").alias("p"), F.count("*").alias("n"), *[F.percentile_approx(f, shares, 10_000).alias(f) for f in features]).first()
    if not first["p"] or first["p"] == first["n"]:
        return []
    # Cuts from the bad rows too: they are few, and quantiles of all rows may all lie among the good ones.
    bad = rows.where("bad = 1").agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in features]).first()
    cuts = {f: sorted({float(x) for x in [*first[f], *bad[f]]}) for f in features}

    def binned(f: str) -> Column:
        """How many cuts lie below the value: bin k holds cut[k-1] < x <= cut[k]."""
        return F.size(F.filter(F.array(*[F.lit(x) for x in cuts[f]]), lambda x: x < F.col(f)))

    with Scratch(rows.sparkSession) as scratch:
        return _cover(scratch.keep(rows.select("*", F.array(*[binned(f) for f in features]).alias("_bins")), "rules"), cuts, max_rules, max_conditions, min_precision, min_cover)


def _cover(coded: DataFrame, cuts: dict[str, list[float]], max_rules: int, max_conditions: int, min_precision: float, min_cover: int) -> list[Rule]:
    """Sequential covering: a rule is grown and pruned on the rows that no earlier rule covers."""
    features, rules = list(cuts), []
    while len(rules) < max_rules:
        left = coded.where(~reduce(lambda a, b: a | b, [holds(r) for r in rules], F.lit(False)))
        rule: Rule = ()
        while len(rule) < max_conditions:
            seen = left.where(holds(rule)).select("bad", "part", F.posexplode("_bins").alias("f", "b")).groupBy("f", "b").agg(
                *[F.count(F.when((F.col("bad") == y) & (F.col("part") == 0), 1)).alias(f"n{y}") for y in (0, 1)]).collect()
            best = _best(seen, features, cuts)
            if best is None:
                break
            rule = (*rule, best)
        rule, enough = _prune(left, rule, min_precision, min_cover)
        if not enough:
            break
        rules.append(rule)
    return rules


def _best(seen: list, features: list[str], cuts: dict[str, list[float]]) -> Condition | None:
    """The condition with the largest FOIL gain, if any gains."""
    total = {y: sum(r[f"n{y}"] for r in seen if r["f"] == 0) for y in (0, 1)}
    if not total[1] or not total[0]:
        return None
    info = math.log2(total[1] / (total[0] + total[1]))
    found: tuple[float, Condition | None] = (1e-9, None)
    for k, f in enumerate(features):
        per = {r["b"]: (r["n0"], r["n1"]) for r in seen if r["f"] == k}
        below = [0, 0]
        for b, cut in enumerate(cuts[f]):
            n0, n1 = per.get(b, (0, 0))
            below = [below[0] + n0, below[1] + n1]
            for above, (neg, pos) in ((False, below), (True, [total[0] - below[0], total[1] - below[1]])):
                if pos:
                    gain = pos * (math.log2(pos / (pos + neg)) - info)
                    if gain > found[0] + 1e-9:
                        found = (gain, Condition(f, cut, above))
    return found[1]


def _prune(left: DataFrame, rule: Rule, min_precision: float, min_cover: int) -> tuple[Rule, bool]:
    """The prefix of the rule that does best on the prune part, and whether it may enter the list."""
    if not rule:
        return rule, False
    counts = left.agg(*[F.count(F.when(holds(rule[: k + 1]) & (F.col("bad") == y) & (F.col("part") == part), 1)).alias(f"c{k}_{y}_{part}") for k in range(len(rule)) for y in (0, 1) for part in (0, 1)]).first()

    def worth(k: int) -> tuple[float, int]:
        neg, pos = counts[f"c{k}_0_1"], counts[f"c{k}_1_1"]
        if pos + neg < min_cover:
            neg, pos = neg + counts[f"c{k}_0_0"], pos + counts[f"c{k}_1_0"]
        return (pos / (pos + neg) if pos + neg else 0.0), pos

    # The shortest prefix whose precision suffices covers most; else the most precise one is tried and refused below.
    k = next((k for k in range(len(rule)) if worth(k)[0] >= min_precision), max(range(len(rule)), key=lambda k: worth(k)[0]))
    cover = counts[f"c{k}_1_0"] + counts[f"c{k}_1_1"]
    return rule[: k + 1], worth(k)[0] >= min_precision and cover >= min_cover


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the ids with a quality label, each once; of different labels the larger counts."""
    return pick(labels, doc_id="long", quality="int").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def learn_from(stats: DataFrame, known: DataFrame) -> list[Rule]:
    """Rules against quality = 0 from stats (doc_id and statistics) of all labelled rows; a third of the ids prunes."""
    return learn(stats.join(known, "doc_id").select((1 - F.col("quality")).alias("bad"), F.pmod(F.xxhash64("doc_id"), F.lit(3)).isin(0).cast("int").alias("part"), *FEATURES))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, rule (number of the first rule that rejects it, or null), kept.

    A null or empty text has no words and fails the base. Repeated rows are judged one by one. Without labels the base alone decides.
    """
    stats = keep(text_stats(pick(docs, doc_id="long", text="string"), "doc_id"), "stats")
    rules = learn_from(stats, labelled(labels))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), decision(rules).alias("rule")).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that quality_rules keeps, with their columns. The labelled texts are read first, to learn from; then one pass over
    all rows decides, without an exchange and without a written copy."""
    with Scratch(docs.sparkSession) as scratch:
        known = scratch.keep(labelled(labels), "known")
        texts = pick(docs, doc_id="long", text="string").join(small(known.select("doc_id")), "doc_id", "left_semi")
        rules = learn_from(scratch.keep(text_stats(texts, "doc_id"), "stats"), known)
    whole = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text"))
    return rows_where(text_stats(whole, "_row"), ~base_failed() & decision(rules).isNull())
