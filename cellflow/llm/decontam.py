"""Benchmark decontamination by a distributed positional inverted index.

Test items are cut into passages of so many words that a long has a bit for each. A window's rarest terms by corpus count are looked up: the
index stores their postings (term, document, position). A posting moved back by its term's offset says where in the document the passage would
begin; postings that agree on (document, passage, beginning) are an intersection of offset-adjusted lists, and the bits of their offsets tell
whether all the rarest terms of some window agree. A near match is a window that some words changed, put in or left out (NEAR at most) turn
into words of the document. Any such window keeps two of its NEAR + 2 rarest terms, at beginnings that differ by NEAR at most: those lists are
intersected with that slack, window by window. Alignments that are left are compared word by word with the piece of the document that they
point to, one row for each, for near matches, if enough words are there, by a banded edit distance that starts and ends anywhere. Every step is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, fits, keep, pick, small

WINDOW = 10
#: Words of a window that may be changed, put in or left out in a near match.
NEAR = 2
#: Of a window's terms the lists of so many, the rarest, are intersected for exact phrases.
RAREST = 3
#: Words of a passage; longer items are cut into overlapping passages, so that no row grows with an item.
PASSAGE = 63
#: Fixed value: characters that separate words, all of ASCII but digits and letters.
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_UPPER = "".join(chr(c) for c in range(65, 91))


def words_of(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z; null has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), _UPPER + _SEPARATORS, _UPPER.lower() + " " * len(_SEPARATORS))
    return F.array_remove(F.split(flat, " "), "")


def passages(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sid, item_id, words, size, different): overlapping passages of each item; size is the window's length, less in an item of fewer words,
    different the least number of different words in a window."""
    items = pick(benchmark, item_id="string", text="string").select("item_id", words_of(F.col("text")).alias("all")).where(F.size("all") > 0)
    begins = F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)), F.lit(PASSAGE - window + 1)))
    cut = items.select("item_id", "all", F.least(F.lit(window), F.size("all")).alias("size"), begins.alias("begin"))
    named = cut.select(F.monotonically_increasing_id().alias("sid"), "item_id", F.slice("all", F.col("begin") + 1, F.lit(PASSAGE)).alias("words"), "size")
    different = F.transform(F.sequence(F.lit(0), F.size("words") - F.col("size")), lambda w: F.size(F.array_distinct(F.slice("words", w + 1, F.col("size")))))
    return named.withColumn("different", F.array_min(different))


def text_key(text: Column) -> Column:
    """With the id, what names a document's text: rows that share an id but not the text are documents of their own."""
    return F.xxhash64(text)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def lookups(passage: DataFrame, words: DataFrame, window: int, near: int, scratch: Scratch) -> DataFrame:
    """(sid, term, place, needs): the places of each window's rarest terms by corpus count, ties to the first: RAREST for exact matches, near + 2
    for near ones. needs: for each window the bits of its own; none of a window with more than `near` words that never occur."""
    terms = scratch.keep(passage.select(F.explode("words").alias("term")).distinct(), "terms")
    every = words.select(F.explode("words").alias("term"))
    if fits(terms, F.length("term") + 16):
        counts = every.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("found"))
    else:  # counted first, so that no term is a large group of the join
        counts = every.groupBy("term").agg(F.count("*").alias("found")).join(terms, "term")
    placed = passage.select("sid", "size", F.posexplode("words").alias("place", "term")).join(scratch.keep(counts, "counts"), "term", "left")
    per = placed.groupBy("sid", "size").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("found", F.lit(0)).alias("found"), "term"))).alias("t"))
    full = (F.col("size") == window) & F.lit(near > 0)

    def rarest(w: Column) -> Column:
        ranked = F.sort_array(F.transform(F.filter(F.slice("t", w + 1, F.col("size")), lambda x: x["found"] > 0), lambda x: F.struct(x["found"].alias("found"), x["place"].alias("place"), x["term"].alias("term"))))
        return F.when(F.size(ranked) >= F.col("size") - F.when(full, near).otherwise(0), F.slice(ranked, F.lit(1), F.when(full, near + 2).otherwise(RAREST))).otherwise(F.slice(ranked, 1, 0))

    windows = per.select("sid", F.transform(F.sequence(F.lit(0), F.size("t") - F.col("size")), rarest).alias("w"))
    bits = F.array_distinct(F.transform(F.filter("w", lambda x: F.size(x) > 0), lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda m, y: m.bitwiseOR(_bit(y["place"])))))
    return scratch.keep(windows.select("sid", bits.alias("needs"), F.explode(F.array_distinct(F.flatten("w"))).alias("a")).select("sid", "a.term", "a.place", "needs"), "lookups")


def alignments(docs: DataFrame, passage: DataFrame, window: int, near: int, scratch: Scratch) -> DataFrame:
    """(doc_id, key, sid, begin): where documents (doc_id, key, text) may hold test passages; begin may be below 0."""
    words = docs.select("doc_id", "key", words_of(F.col("text")).alias("words"))
    look = lookups(passage, words, window, near, scratch)
    terms = scratch.keep(look.select("term").distinct(), "index-terms")
    index = scratch.keep(words.select("doc_id", "key", F.posexplode("words").alias("position", "term")).join(small(terms, F.length("term") + 16), "term"), "index")
    offsets = look.select("term", "sid", "place")
    starts = index.join(small(scratch.keep(offsets, "offsets"), F.length("term") + 32), "term").select("doc_id", "key", "sid", "place", (F.col("position") - F.col("place")).alias("begin"))
    needs = scratch.keep(look.join(passage.select("sid", "size"), "sid").select("sid", "needs", "size").distinct(), "needs")
    needs = small(needs, 8 * F.size("needs") + 32)
    if near:
        # Of whole windows only beginnings go on about which two places of one window agree.
        about = Window.partitionBy("doc_id", "key", "sid").orderBy("begin").rangeBetween(-near, near)
        slack = starts.withColumn("about", F.bit_or(_bit(F.col("place"))).over(about)).join(needs, "sid")
        two = F.exists("needs", lambda m: (m.bitwiseAND(_bit(F.col("place"))) != 0) & (F.bit_count(m.bitwiseAND(F.col("about"))) > 1))
        starts = slack.where((F.col("size") < window) | (F.bit_count("about") > 1) & two).drop("about", "needs", "size")
    agreed = starts.groupBy("doc_id", "key", "sid", "begin").agg(F.bit_or(_bit(F.col("place"))).alias("bits")).join(needs, "sid")
    exact = F.exists("needs", lambda m: F.col("bits").bitwiseAND(m) == m)
    agreed = agreed.where((F.col("size") == window) | exact if near else exact)
    return scratch.keep(agreed.select("doc_id", "key", "sid", "begin"), "alignments")


def _same_document(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join on doc_id (nulls are equal) and key, whose columns in `other` are _id and _key."""
    return df.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), how)


def matches(docs: DataFrame, benchmark: DataFrame, window: int, near: int, scratch: Scratch) -> DataFrame:
    """(doc_id, key, item_id, spans, size, near): for documents (doc_id, key, text) and each passage found in them where exactly matched windows
    begin, and whether a window is matched but for `near` words changed, put in or left out (items of fewer words than a window: exactly)."""
    passage = scratch.keep(passages(benchmark, window), "passages")
    found = alignments(docs, passage, window, near, scratch)
    at = scratch.keep(found.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("sid", "begin")).alias("at")), "aligned")
    rows = _same_document(docs, small(at, 16 * F.size("at") + 24), "inner").select("doc_id", "key", "at", words_of(F.col("text")).alias("words"))
    each = rows.select("doc_id", "key", "words", F.explode("at").alias("a")).select("doc_id", "key", "words", "a.sid", "a.begin", F.greatest(F.col("a.begin") - near, F.lit(0)).alias("from"))
    pieces = scratch.keep(each.select("doc_id", "key", "sid", "begin", "from", F.slice("words", F.col("from") + 1, F.lit(PASSAGE + 3 * near)).alias("piece")), "pieces")
    aligned = pieces.join(small(passage, F.length(F.array_join("words", " ")) + 40), "sid")
    there = lambda k: F.get("piece", F.col("begin") - F.col("from") + k)
    same = F.transform("words", lambda w, k: F.when(there(k) == w, 1).otherwise(0))
    # Before any distance: near windows have all but `near` of their words on a diagonal of the band, so as many different ones in the piece.
    may_differ = F.when(F.col("size") == window, near).otherwise(0)
    places = F.sequence(F.lit(0), F.size("words") - F.col("size"))
    on = F.transform("words", lambda w, k: F.when(F.array_contains(F.slice("piece", F.greatest(F.col("begin") - F.col("from") + k - near, F.lit(0)) + 1, F.lit(2 * near + 1)), w), _bit(k)).otherwise(F.lit(0).cast("long")))
    bits = F.aggregate(on, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x))
    enough = F.exists(places, lambda w: F.bit_count(F.call_function("shiftright", F.col("bits"), w).bitwiseAND(_bit(F.col("size")) - 1)) >= F.col("size") - may_differ)
    aligned = aligned.where(F.size(F.array_intersect("words", "piece")) >= F.col("different") - may_differ)
    # The bits come out of a generator: Catalyst would push a filter on a plain column below it and find all bits again for each window.
    aligned = aligned.withColumn("bits", F.explode(F.array(bits))).where(enough)
    # For each word of the passage 0 or 1, whether it differs from the document's, on each diagonal of the band.
    off = F.transform("words", lambda w, k: F.array(*[F.when(there(k + d) == w, 0).otherwise(1) for d in range(-near, near + 1)]))
    compared = aligned.select("doc_id", "key", "item_id", "size", "begin", same.alias("same"), *([off.alias("off")] if near else []))
    places = F.sequence(F.lit(0), F.size("same") - F.col("size"))
    spans = F.filter(places, lambda w: F.aggregate(F.slice("same", w + 1, F.col("size")), F.lit(0), lambda x, y: x + y) >= F.col("size"))

    def step(cost: Column, row: Column) -> Column:
        to = []
        for i in range(2 * near + 1):
            ways = [cost[i] + row[i], *([cost[i + 1] + 1] if i < 2 * near else []), *([to[-1] + 1] if i else [])]
            to.append(F.least(*ways))
        return F.array(*to)

    if near:
        part = lambda w: F.slice("off", w + 1, F.col("size"))
        may = lambda w: F.aggregate(part(w), F.lit(0), lambda x, row: x + F.array_min(row)) <= near
        distance = lambda w: F.array_min(F.aggregate(part(w), F.array(*[F.lit(0)] * (2 * near + 1)), step))
        is_near = (F.col("size") == window) & F.exists(places, lambda w: may(w) & (distance(w) <= near))
    else:
        is_near = F.lit(False)
    told = compared.select("doc_id", "key", "item_id", "size", F.transform(spans, lambda w: w + F.col("begin")).alias("spans"), is_near.alias("near"))
    return scratch.keep(told.withColumn("near", F.col("near") | (F.size("spans") > 0)), "matches")


def _keyed(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="long", text="string").select("doc_id", text_key(F.col("text")).alias("key"), "text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, near: int = NEAR) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items (long), items_sha256, contaminated, n_near_items (items of which a window is
    matched but for `near` words), near_items_sha256.

    Null or empty text has no words and no hit; items without words match nothing; an item with a null id hits but isn't counted or listed.
    Rows that share an id but not the text are judged by their own texts; repeated rows alike.
    """
    rows = _keyed(docs)
    of = [F.col("doc_id").alias("_id"), F.col("key").alias("_key")]
    with Scratch(docs.sparkSession) as scratch:
        m = matches(rows, benchmark, WINDOW, near, scratch)
        exact = m.where(F.size("spans") > 0)
        words = exact.select(*of, "size", F.explode("spans").alias("w")).select("_id", "_key", F.explode(F.sequence(F.col("w"), F.col("w") + F.col("size") - 1)).alias("position")).distinct()
        items = lambda df, name: df.select(*of, "item_id").distinct().groupBy("_id", "_key").agg(F.sort_array(F.collect_list("item_id")).alias(name))
        kinds = [words.groupBy("_id", "_key").agg(F.count("*").alias("n_hit")).select("_id", "_key", "n_hit", F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<string>").alias("near_items")),
                 items(exact, "items").select("_id", "_key", F.lit(None).cast("long").alias("n_hit"), "items", F.lit(None).cast("array<string>").alias("near_items")),
                 items(m.where("near"), "near_items").select("_id", "_key", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"), "near_items")]
        told = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("_id", "_key").agg(*[F.max(c).alias(c) for c in ("n_hit", "items", "near_items")])
        told = keep(told, "hits")
    joined = _same_document(rows.select("doc_id", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_words")), small(told, 48 * (1 + F.size("items") + F.size("near_items"))), "left")
    none = F.array().cast("array<string>")
    out = joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"), F.sha2(F.concat_ws(",", "near_items"), 256).alias("near_items_sha256"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents without any exact window, with their columns. Ids and hashes of texts decide; texts are exchanged only if the hit
    documents are too many to broadcast."""
    with Scratch(docs.sparkSession) as scratch:
        hit = keep(matches(_keyed(docs), benchmark, WINDOW, 0, scratch).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text").cast("string")).alias("key"))
    return _same_document(rows, small(hit), "left_anti").select("_row.*")


def oracle_sql(window: int = WINDOW) -> str:
    """Windows of items and of documents meet as strings."""
    words = lambda of: f"list_filter(regexp_split_to_array(translate(coalesce({of}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least({window}, len(w)) AS size, array_to_string(w[b:b + least({window}, len(w)) - 1], ' ') AS phrase
       FROM i, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) AS u(b) WHERE len(w) > 0),
d AS (SELECT doc_id, {words("text")} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, b, array_to_string(w[b:b + size - 1], ' ') AS phrase FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(b)),
hits AS (SELECT doc_id, size, b, item_id FROM dw JOIN iw USING (size, phrase)),
pos AS (SELECT doc_id, count(DISTINCT b + k) AS n_hit FROM (SELECT DISTINCT doc_id, size, b FROM hits), unnest(range(0, size)) AS u(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


def near_sql(window: int = WINDOW, near: int = NEAR) -> str:
    """Windows of whole length by edit distance: a document's words near a diagonal with enough words in common become letters (the place of
    the word in the window, z for others), and every piece of them is compared with the window. Shorter items exactly, as above."""
    words = lambda of: f"list_filter(regexp_split_to_array(translate(coalesce({of}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
WITH exact AS ({oracle_sql(window).strip()}),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words("text")} AS w FROM benchmark),
d AS (SELECT doc_id, {words("text")} AS w FROM documents),
iw AS (SELECT row_number() OVER () AS win, item_id, w[b:b + {window - 1}] AS ws FROM i, unnest(range(1, len(w) - {window} + 2)) AS u(b) WHERE len(w) >= {window}),
pw AS (SELECT win, k, ws[k] AS word FROM iw, unnest(range(1, {window + 1})) AS u(k)),
dp AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
m AS (SELECT DISTINCT doc_id, win, k, p - k AS diag FROM pw JOIN dp USING (word)),
g AS (SELECT doc_id, win, diag + s AS diag, count(DISTINCT k) AS n FROM m, unnest(range(-{near}, {near + 1})) AS u(s) GROUP BY 1, 2, 3 HAVING count(DISTINCT k) >= {window - near}),
c AS (SELECT doc_id, win, item_id, ws, list_transform(w[greatest(diag + 1 - {near}, 1):diag + {window + near}], lambda x: CASE WHEN list_contains(ws, x) THEN chr(CAST(96 + list_position(ws, x) AS INTEGER)) ELSE 'z' END) AS piece FROM g JOIN iw USING (win) JOIN d USING (doc_id)),
t AS (SELECT doc_id, item_id, array_to_string(list_transform(ws, lambda x: chr(CAST(96 + list_position(ws, x) AS INTEGER))), '') AS a, array_to_string(piece, '') AS b FROM c),
h AS (SELECT DISTINCT doc_id, item_id FROM t, unnest(range(1, {2 * near + 2 + near})) AS u(s), unnest(range({window - near}, {window + near + 1})) AS v(n) WHERE levenshtein(a, substr(b, s, n)) <= {near}),
sw AS (SELECT DISTINCT item_id, len(w) AS size, array_to_string(w, ' ') AS phrase FROM i WHERE len(w) > 0 AND len(w) < {window}),
sh AS (SELECT DISTINCT doc_id, item_id FROM d, (SELECT DISTINCT size FROM sw) z, unnest(range(1, len(w) - size + 2)) AS u(b) JOIN sw ON sw.size = z.size AND sw.phrase = array_to_string(w[b:b + z.size - 1], ' ')),
ni AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM (SELECT * FROM h UNION SELECT * FROM sh) GROUP BY 1)
SELECT exact.*, coalesce(ni.n, 0) AS n_near_items, sha256(coalesce(ni.items, '')) AS near_items_sha256 FROM exact LEFT JOIN ni USING (doc_id)"""
