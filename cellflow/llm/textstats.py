"""Statistics of whole texts as Spark expressions, for the quality rules and the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: The columns that a quality model may look at.
FEATURES = ["n_words", "word_len", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mark_ratio", "distinct_ratio"]
#: Fixed value: characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


def text_stats(docs: DataFrame, *carry: str) -> DataFrame:
    """The columns carry, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and FEATURES (double).

    docs has text; a null text has no words and all counts are 0. Windows of five words are compared within a text by a 64-bit hash.
    One projection over each text, no exchange. Each projection uses what the one before made at least twice, which keeps Catalyst from
    inlining it into the lambdas.
    """
    out = list(carry)
    text = F.coalesce("text", F.lit(""))
    a = docs.select(*out, text.alias("_t"), words_of(text).alias("_w"), F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    n = F.size("_w")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)])))
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
    b = a.select(
        *out,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").alias("_lines"),
        count(r"\p{Lu}").alias("_upper"),
        count(r"[!?]").alias("_marks"),
        F.size(F.array_distinct("_w")).alias("_distinct"),
        F.coalesce(hashes, F.array().cast("array<bigint>")).alias("_h"),
    )
    passed = [c for c in b.columns if c != "_h"]
    # Few texts repeat a window; only theirs are sorted to find where.
    c = b.select(*passed, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    same = lambda k: F.get("_s", k)["h"] == F.get("_s", k + 1)["h"]
    again = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda k: F.coalesce(same(k), F.lit(False)) | F.coalesce(F.when(k > 0, same(k - 1)), F.lit(False)))
    d = c.select(*passed, F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(again, lambda k: F.get("_s", k)["i"]))).alias("_p"))
    step = lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW)))
    covered = F.coalesce(F.when(F.size("_p") > 0, F.aggregate(F.transform("_p", step), F.lit(0), lambda x, y: x + y)), F.lit(0))
    e = d.select(*passed, covered.cast("long").alias("n_repeat_words"))
    per = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0)).cast("double")
    return e.select(
        *out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per("word_chars", "n_words").alias("word_len"), per("n_symbols", "n_words").alias("symbol_ratio"), per("n_dup_lines", "_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"), per("_upper", "word_chars").alias("upper_ratio"), per("_marks", "n_words").alias("mark_ratio"), per("_distinct", "n_words").alias("distinct_ratio"),
    )
