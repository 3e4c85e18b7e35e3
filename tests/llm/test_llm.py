"""Edge cases of each operator on small tables, and brute-force versions where SQL has none."""

import collections
import gzip
import hashlib
import os
import re
import time

import numpy as np
import pytest

from cellflow.llm import common, decontam, gbdt_quality, jaccard_join, lang_cnn, mixing, pii, quality_rules, queries, sharding, toxicity, warc

LONG = " ".join(f"w{k % 977}" for k in range(30_000))
BASE = " ".join(f"alpha{k}" for k in range(60))
ROWS = [
    (1, BASE, "en", "a", "x"), (2, BASE, "en", "a", "x"), (3, BASE.replace("alpha30 ", "beta "), None, None, None), (4, None, "en", "a", None), (5, "", None, None, None), (6, "one two", "en", "b", None),
    (7, LONG, "en", "b", None), (None, BASE, "en", "a", None), (2, BASE, "en", "a", "x"), (8, "same words " * 40, "en", "b", None), (9, "ONE Two", "en", "b", None), (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_words string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def collect(df):
    return [r.asDict() for r in df.collect()]


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = collections.Counter(win)
    repeated = len({i + k for i, x in enumerate(win) if many[x] > 1 for k in range(5)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, len(w) < 10 or 100 * repeated > 20 * len(w)


def test_quality_rules_base(spark, docs):
    """Each row by itself, all five counts and the verdict of the base, beside clashing columns."""
    odd = [(20, "a #b\n\n a #b\nline\nline\n \nline", "en", "a", None), (21, "x\u00a0y \u2003 z\x0bq\x85r $$ <é>", None, None, None), (22, "one two three four five " * 3, "en", "b", "clash")]
    d = spark.createDataFrame(ROWS + odd, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (6, None, None)], LABELS)
    out = collect(quality_rules.quality_rules(d, labels))
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out)
    assert got == collections.Counter((r[0], *brute_counts(r[1])) for r in ROWS + odd)
    assert all(r["kept"] != r["base_failed"] for r in out)  # labels of one kind teach no rule
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0
    assert quality_rules.keep_good(docs, labels).columns == docs.columns and quality_rules.keep_good(docs.limit(0), labels).count() == 0


def test_rules_are_learned(spark):
    good = [(k, " ".join(f"v{(k * 31 + j * j) % 997}" for j in range(40))) for k in range(200)]
    bad = [(1000 + k, " ".join(f"v{(k * 17 + j * j) % 991}###" for j in range(40))) for k in range(60)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], LABELS)
    out = {r["doc_id"]: r["kept"] for r in collect(quality_rules.quality_rules(d, labels))}
    assert all(out[i] for i, _ in good) and not any(out[i] for i, _ in bad)


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids and sets[i] else doc))
    return sorted(out, key=str)


def same_components(df, rows):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in collect(jaccard_join.jaccard_components(df))), key=str)
    assert got == brute_components(rows)


def test_jaccard_edges(spark, docs):
    same_components(docs, [r[:2] for r in ROWS])
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    left = collect(jaccard_join.one_of_each(docs))
    assert sorted(r["doc_id"] for r in left if r["doc_id"] and r["text"]) == [1, 6, 7, 8]


@pytest.mark.parametrize("limits", [{}, {"HEAVY_FROM": 8}, {"BOUND": 6, "BLOCK": 4}, {"BUCKET": 0.01, "POSTED": 50}])
def test_jaccard_chains(spark, monkeypatch, limits):
    """Chains of families, also with regions that are split again and blocks of few texts, and with buckets of more than 16 bits."""
    for name, value in limits.items():
        monkeypatch.setattr(jaccard_join, name, value)
    if "BOUND" in limits:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for family in range(12):
        words = [f"f{family}w{j}" for j in range(rng.integers(12, 80))]
        for _ in range(rng.integers(2, 25)):
            words = list(words)
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(len(words))] = f"n{k}x{rng.integers(99)}"
            rows.append((k, " ".join(words + [f"tail{j}" for j in range(6)])))
            k += 1
    same_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_jaccard_regions_are_split(spark, monkeypatch):
    """One cell (a shared template) of many small families: it is split about pivots, again and again, and no link is lost."""
    for name, value in {"BOUND": 12, "BLOCK": 5}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng, rows = np.random.default_rng(8), []
    for family in range(25):
        own = [f"f{family}w{j}" for j in range(30)]
        for _ in range(4):
            words = list(own)
            words[rng.integers(30)] = f"n{len(rows)}"
            rows.append((len(rows), " ".join([*words, *[f"t{j}" for j in range(14)]])))
    depth = []
    split = jaccard_join._split
    monkeypatch.setattr(jaccard_join, "_split", lambda *a: (depth.append(a[3]), split(*a))[1])
    monkeypatch.setattr(jaccard_join, "need", lambda n: 1)  # shared templates are then in no one's rarest shingles, but all texts meet in a cell
    same_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)
    assert max(depth) >= 2


def test_jaccard_links(spark, docs, monkeypatch):
    """Each linked pair once and each row's number of links, over families larger than a block."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = np.random.default_rng(7)
    rows = [(k, f"f{k % 3}x " + " ".join(f"f{k % 3}w{j}" if j not in cut else f"n{k}" for j in range(40))) for k, cut in enumerate(rng.integers(0, 60, (60, 2)).tolist())]
    rows += [(100 + k, rows[k][1]) for k in range(0, 12, 2)] + [(None, rows[0][1]), (None, rows[1][1] + " more"), (200, ""), (201, None), (202, "one two"), (203, "One two")]
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["n_links"]) for r in collect(jaccard_join.jaccard_degrees(d))), key=str)
    want = sorted(((rows[i][0], len(x), sum(near(x, y) for j, y in enumerate(sets) if i != j)) for i, x in enumerate(sets)), key=str)
    assert got == want and max(n for *_, n in want) > jaccard_join.BLOCK
    named = {}
    for (doc, _), x in zip(rows, sets, strict=True):
        if x and doc is not None:
            named[frozenset(x)] = min(doc, named.get(frozenset(x), doc))
    pairs = [(r["a"], r["b"]) for r in collect(jaccard_join.jaccard_links(d))]
    assert len(pairs) == len(set(pairs))
    assert {p for p in pairs if p[1] < jaccard_join.NAMELESS} == {(p, q) for x, p in named.items() for y, q in named.items() if p < q and near(x, y)}


def test_decontamination_edges(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(f"ALPHA{k}" for k in range(5, 18))), (2, "One. Two!"), (3, None), (None, "same words same"), (4, "...")], "item_id long, text string")
    out = collect(decontam.decontaminate(docs, bench))
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(ROWS) and by[1]["n_hit"] == 13 and by[1]["n_items"] == 1 and by[6]["n_hit"] == by[9]["n_hit"] == 2 and by[8]["n_hit"] == 79 and by[8]["n_items"] == 0
    assert by[1]["items_sha256"] == hashlib.sha256(b"1").hexdigest() and by[4]["items_sha256"] == hashlib.sha256(b"").hexdigest() and by[7]["n_words"] == 30_000 and not by[7]["contaminated"]
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns


def test_near_match(spark):
    """One word of ten changed, at every place (the changed word is then the rarest in the corpus or absent from it)."""
    w = [f"q{k}" for k in range(10)]
    d = spark.createDataFrame([(k, " ".join([*w[:k], "other", *w[k + 1 :]])) for k in range(10)] + [(99, "q0 q0 q0")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in collect(decontam.decontaminate(d, spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")))}
    assert all(out[k]["n_hit"] == 0 and out[k]["n_near_items"] == 1 for k in range(10)) and out[99]["n_near_items"] == 0


def brute_near(doc, item, near=decontam.NEAR, size=decontam.WINDOW):
    """Whether a window of the item is within `near` edits of words of the document, by Sellers' method; shorter items exactly."""
    if len(item) < size:
        return any(doc[i : i + len(item)] == item for i in range(len(doc) - len(item) + 1))
    for b in range(len(item) - size + 1):
        row = [0] * (len(doc) + 1)
        for k, w in enumerate(item[b : b + size], 1):
            new = [k]
            for j, x in enumerate(doc, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != w)))
            row = new
        if min(row) <= near:
            return True
    return False


@pytest.mark.parametrize("broadcast", [True, False])
def test_near_matches_as_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(6)
    items = [[f"v{k}" for k in rng.integers(0, 60, rng.integers(4, 90))] for _ in range(15)]
    docs = []
    for k in range(150):
        item = items[rng.integers(len(items))]
        a = rng.integers(max(1, len(item) - 11))
        copy = list(item[a : a + rng.integers(8, 14)])
        for _ in range(rng.integers(0, 5)):
            at, how = rng.integers(len(copy)), rng.integers(3)
            copy[at : at + int(how != 0)] = [] if how == 2 else [f"n{k}"]
            copy = copy or ["x"]
        docs.append((k, [*[f"v{j}" for j in rng.integers(0, 60, rng.integers(0, 20))], *copy, *[f"u{j}" for j in rng.integers(0, 60, rng.integers(0, 20))]]))
    # A word put in before every seventh word, and one that no document has.
    docs.append((900, [w for j, x in enumerate(items[0] * 3) for w in ([f"f{j}", x] if j % 7 == 0 else [x])]))
    items.append([f"z{j}" for j in range(9)] + ["absent"])
    docs.append((901, [f"z{j}" for j in range(9)]))
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_near_items"], r["near_items_sha256"]) for r in collect(decontam.decontaminate(d, b))}
    for k, words in docs:
        want = sorted(str(i) for i, item in enumerate(items) if brute_near(words, item))
        assert got[k] == (len(want), hashlib.sha256(",".join(want).encode()).hexdigest()), (k, want)
    assert got[901][0] == 1 and 20 < sum(n > 0 for n, _ in got.values()) < len(docs)


def test_decontamination_query_matches_near(spark, tmp_path, monkeypatch):
    """The query's rows come through the method with its proximity matches, and only windows that may match reach the edit distance."""
    w = [f"q{k}" for k in range(30)]
    docs = [(1, " ".join(w[:12])), (2, " ".join([*w[:4], "other", *w[5:12]])), (3, f"{w[3]} " + "u " * 24 + w[28]), (4, f"{w[0]} {w[1]} {w[2]} u u u u {w[7]}"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, " ".join(w))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    near, rows, inner = [], [], decontam.matches
    monkeypatch.setattr(decontam, "matches", lambda *a: (near.append(a[3]), inner(*a))[1].transform(lambda m: (rows.extend((r["doc_id"], len(r["spans"]) > 0, r["near"]) for r in m.collect()), m)[1]))
    out = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in collect(queries.op10_decontamination(spark, str(tmp_path)))}
    assert out == {1: (12, 1, True), 2: (0, 0, False), 3: (0, 0, False), 4: (0, 0, False), 5: (0, 0, False)}
    assert near == [decontam.NEAR] and {r for r in rows if r[0] == 2} == {(2, False, True)} and {r[0] for r in rows} == {1, 2}


@pytest.mark.parametrize("near", [0, decontam.NEAR])
def test_shared_words_are_found_once_for_all_windows(spark, monkeypatch, near):
    """Which words of a passage a piece shares is found once for an alignment, not again in the test of each of its windows."""
    plans, write = {}, common._write
    monkeypatch.setattr(common, "_write", lambda df, name: (plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}), write(df, name))[1])
    words = " ".join(f"q{k}" for k in range(30))
    d, b = spark.createDataFrame([(1, words)], "doc_id long, text string"), spark.createDataFrame([(7, words)], "item_id long, text string")
    with common.Scratch(spark) as scratch:
        assert [len(r["spans"]) for r in collect(decontam.matches(decontam._keyed(d), b, decontam.WINDOW, near, scratch))] == [21]
    found = [x for x in plans["matches"].splitlines() if "array_contains(slice(piece" in x]
    assert len(found) == 1 and found[0].count("array_contains(") == 1 and "exists(" not in found[0]


def test_pfair_deviation():
    share = mixing.shares({"a": 5, "b": 3, "c": 1, "d": 0}, 97)
    assert sum(share.values()) == 97 and share["d"] == 1
    done = collections.Counter()
    for t, (s, k) in enumerate(mixing.schedule(share), 1):
        assert k == done[s]
        done[s] += 1
        assert all(abs(done[x] - share[x] * t / 97) < 1 for x in share)


def test_schedule_as_plain_search():
    """The heaps give what looking at every source in every slot gives."""
    rng = np.random.default_rng(9)
    for _ in range(30):
        share = {f"s{k:02d}": int(n) for k, n in enumerate(rng.integers(1, 40, rng.integers(1, 12)))}
        period, done, want = sum(share.values()), dict.fromkeys(sorted(share), 0), []
        for t in range(period):
            _, s = min((-(-(k + 1) * period // share[s]), s) for s, k in done.items() if k < share[s] and k * period // share[s] <= t)
            want.append((s, done[s]))
            done[s] += 1
        assert mixing.schedule(share) == want


def test_mixing_edges(spark, docs):
    out = collect(mixing.mix_sources(docs))
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS) and len({r["position"] for r in out}) == len(out)
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == len(ROWS)


def test_mixing_clashing_columns_and_order(spark, docs, tmp_path, monkeypatch):
    """Columns named as the operator's are replaced; rows without ids or alike have places of their own; files give the order back."""
    clash = docs.selectExpr("*", "'s' AS slot", "'b' AS block", "'p' AS position", "map('a', 1) AS m")
    out = collect(mixing.mix_order(clash))
    assert all(isinstance(r[c], int) for r in out for c in ("slot", "block", "position")) and len({r["position"] for r in out}) == len(ROWS) and out[0]["m"] == {"a": 1}
    again = collect(mixing.mix_order(clash.repartition(3)))
    key = lambda rows: sorted((r["position"], str(r["doc_id"]), str(r["text"])[:30]) for r in rows)
    assert key(out) == key(again)
    assert mixing.mixed(clash).columns == clash.columns and mixing.mixed(clash).count() == len(ROWS)
    plain = collect(mixing.mix_order(docs))
    for parts in (1, 3, 40):
        mixing.mixed(docs.repartition(2), parts=parts).write.parquet(f"{tmp_path}/mixed{parts}")
        back = collect(mixing.laid_out(spark.read.parquet(f"{tmp_path}/mixed{parts}")))
        assert [str(r["doc_id"]) for r in sorted(back, key=lambda r: r["position"])] == [str(r["doc_id"]) for r in sorted(plain, key=lambda r: r["position"])]
        assert sorted(r["position"] for r in back) == list(range(len(ROWS)))
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    with pytest.raises(ValueError):
        mixing.mix_sources(docs)


def test_sharding(spark, docs):
    names = [f"s{k}" for k in range(7)]
    a, b = sharding.lookup_table(names, 4099), sharding.lookup_table(names[:-1], 4099)
    sizes = collections.Counter(a)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sum(x != y for x, y in zip(a, b, strict=True) if x != 6) < 0.15 * 4099
    clash = docs.withColumnRenamed("n_words", "slot")
    out = collect(sharding.assign_shards(clash, shards=names, slots=4099))
    assert len(out) == len(ROWS) and all(r["shard"] == a[r["slot"]] for r in out) and sharding.assign_shards(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 4096)


def test_language(spark, docs):
    words = {"en": ["the", "thing", "where", "with"], "de": ["über", "nicht", "schön", "straße"]}
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(words[x], 60)), x) for k in range(160) for x in ["en", "de"][k % 2 : k % 2 + 1]]
    d = spark.createDataFrame([*rows, (900, None, "en"), (901, "", "de"), (902, "123 !!", "en")], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in collect(lang_cnn.identify(d))}
    assert np.mean([out[k]["lang_pred"] == x for k, _, x in rows if out[k]["held_out"]]) > 0.95
    assert all(out[k]["lang_pred"] == "und" for k in (900, 901, 902)) and all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["lang_pred"] for r in collect(lang_cnn.identify(docs.drop("lang")))} == {"und"}


def test_language_short_texts_and_edges(spark, docs):
    """Short texts alone teach too; a very long text is read; repeated rows, null ids, empty tables and other columns of clashing names."""
    rows = [(k, ["the cat sat", "der Hund lief"][k % 2], ["en", "de"][k % 2]) for k in range(400)]
    d = spark.createDataFrame([*rows, (900, "der Hund lief schnell " * 9_000, None), (901, "the cat sat there " * 9_000, None), (None, "the cat", "en"), (0, "the cat sat", "en")], "doc_id long, text string, lang string")
    out = collect(lang_cnn.identify(d.selectExpr("*", "'x' AS score", "1 AS held_out", "2 AS p")))
    by = {r["doc_id"]: r["lang_pred"] for r in out}
    assert len(out) == 404 and by[900] == "de" and by[901] == "en" and np.mean([by[k] == x for k, _, x in rows]) > 0.95
    assert lang_cnn.identify(d.limit(0)).count() == 0
    assert {r["lang_pred"] for r in collect(lang_cnn.identify(spark.createDataFrame([(1, "", "en"), (2, "...", "de")], "doc_id long, text string, lang string")))} == {"und"}


def test_language_net_as_direct_convolution():
    """The folded tables against filters that slide over the embedded bytes."""
    rng = np.random.default_rng(4)
    net = lang_cnn.train(rng.integers(0, lang_cnn.CODES, (40, lang_cnn.WINDOW)), rng.integers(0, 3, 40), ["a", "b", "c"], epochs=1)
    raw = ["Über straße, ÉTÉ 12 the".encode(), b"x" * 300, b""]
    x, count = lang_cnn.windows(raw)
    assert count.tolist() == [1, 3, 1]
    want = []
    for row in x:
        pooled = []
        for w, f, b in zip(lang_cnn.WIDTHS, net.filters, net.bias, strict=True):
            z = [np.concatenate([net.embed[c] for c in row[k : k + w]]) @ f + b for k in range(lang_cnn.WINDOW - w + 1)]
            pooled.append(np.maximum(np.max(z, axis=0), 0))
        z = np.concatenate(pooled) @ net.out + net.out_bias
        want.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert np.allclose(net.predict(x), want, atol=1e-4)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_toxicity_automaton_as_edit_distance():
    """Every word against every entry, by the table of edit distances."""
    rng = np.random.default_rng(11)
    make = lambda n: "".join(rng.choice(list("abc"), n))
    words, stems = sorted({make(rng.integers(3, 9)) for _ in range(25)}), sorted({make(5) for _ in range(4)})
    m = toxicity.compile_lexicon([w.encode() for w in words], [s.encode() for s in stems])
    texts = list({make(rng.integers(1, 11)) for _ in range(2_000)} | set(words) | {w + "z" for w in words} | {w[1:] for w in words})
    got = m.run(*toxicity.normal([" ".join(texts).encode()])[:3]).tolist()
    for text, kind in zip(texts, got, strict=True):
        exact, stem = text in words, any(text.startswith(s) for s in stems)
        near = any(len(w) >= toxicity.FUZZY_FROM and edits(w, text) <= 1 for w in words)
        assert kind == (toxicity.EXACT if exact else toxicity.PREFIX if stem else toxicity.FUZZY if near else 0), text
    assert {0, 1, 2, 3} <= set(got)


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0)], LABELS)
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    clash = docs.selectExpr("*", "1 AS score", "2 AS y", "3 AS predicted")
    out = collect(toxicity.score_toxicity(clash, labels.limit(0)))
    assert len(out) == len(ROWS) and len({r["score"] for r in out}) == 1


def test_toxicity(spark, docs):
    m = toxicity.compile_lexicon([b"idiot", b"scum"], [b"vile"])

    def kinds(text):
        return m.run(*toxicity.normal([text.encode()])[:3]).tolist()

    assert kinds("Idiot idi0t idiott idot idit scum scun vileness villain clean") == [1, 2, 2, 2, 2, 1, 0, 3, 0, 0]
    plain, quoted = toxicity.features([b"you are an idiot", b'he said "idiot" then'], m)
    assert plain[0] > 0 and plain[1] == 0 and quoted[0] == 0 and quoted[1] > 0
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1)], LABELS)
    out = collect(toxicity.score_toxicity(docs, labels))
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in out)


def test_misspelt_words_reach_the_verdict():
    rng = np.random.default_rng(4)
    plain = lambda n: [f"w{k}" for k in rng.integers(0, 400, n)]
    bad = ["idiot", "moron", "stupid", "worthless"]

    def with_words(n, words):
        text = plain(n)
        for w in words:
            text.insert(rng.integers(len(text) + 1), w)
        return " ".join(text).encode()

    # A chance near-word in clean texts, and toxic texts without any misspelling.
    other = [with_words(60, ["oron"] * int(k % 4 == 0)) for k in range(300)]
    toxic = [with_words(60, rng.choice(bad, 3).tolist()) for k in range(120)]
    matcher = toxicity.compile_lexicon(*toxicity.learn_lexicon(toxic, other))
    assert toxicity.misspelt(b"you idiot", matcher) != b"you idiot" and toxicity.misspelt(b"you there", matcher) == b"you there"
    model = toxicity.fit_matches(matcher, toxic, other)
    found = model.score([with_words(60, ["idiott", "stupidd", "moronn"]) for _ in range(50)])
    clean = model.score([with_words(60, ["oron", "oron"] * int(k % 2)) for k in range(50)])
    assert (found >= 0.5).all() and (clean < 0.5).all()


def test_quality_classifier(spark, docs):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    f = gbdt_quality.fit(x[:400], y[:400])
    assert ((f.score(x[400:]) > 0.5) == y[400:]).mean() > 0.95
    one = f.score(x[:1])[0]
    total = f.bias
    for a, c, v in zip(f.feature, f.cut, f.leaf, strict=True):
        n = 0
        while n < 7:
            n = 2 * n + 1 + int(x[0, a[n]] > c[n])
        total += v[n - 7]
    assert abs(one - 1 / (1 + np.exp(-total))) < 1e-12
    out = collect(gbdt_quality.score_quality(docs, spark.createDataFrame([(1, 1, 0), (6, 0, 0)], LABELS)))
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)


def test_quality_classifier_first_split_as_brute_force():
    """The first tree's root is the split of the largest gain over all features and cuts."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    y = ((x[:, 2] > 6) ^ (rng.random(300) < 0.1)).astype(float)
    f = gbdt_quality.fit(x, y, trees=1, depth=1, bins=64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    g, h = y - share, np.full(len(y), share * (1 - share))
    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    every = {(k, c): worth(x[:, k] <= c) + worth(x[:, k] > c) for k in range(4) for c in range(11)}
    root = int(f.feature[0, 0]), int(np.floor(f.cut[0, 0]))
    assert abs(every[root] - max(every.values())) < 1e-9
    left, right = x[:, root[0]] <= root[1], x[:, root[0]] > root[1]
    assert np.allclose(f.leaf[0], [0.2 * g[m].sum() / (h[m].sum() + 1) for m in (left, right)])


def test_quality_classifier_scores_as_model(spark, docs):
    """score_quality's column is the model's score of each row's statistics; empty tables and clashing columns."""
    from cellflow.llm.textstats import FEATURES, text_stats

    labels = spark.createDataFrame([(k, k % 2, 0) for k in (1, 2, 3, 6, 7, 8)], LABELS)
    stats = text_stats(common.pick(docs, doc_id="long", text="string"), "doc_id")
    forest = gbdt_quality.fit_quality(stats, labels)
    rows = stats.collect()
    want = forest.score(np.array([[r[c] for c in FEATURES] for r in rows], float))
    got = sorted((str(r["doc_id"]), round(r["score"], 9)) for r in collect(gbdt_quality.score_quality(docs.selectExpr("*", "1 AS score", "2 AS h"), labels)))
    assert got == sorted((str(r["doc_id"]), round(s, 9)) for r, s in zip(rows, want.tolist(), strict=True))
    assert gbdt_quality.score_quality(docs.limit(0), labels).count() == 0


PII = [
    (1, "mail a.b+c@ex-1.co.uk, x@y@z.com a@b c@d.e@f.g"), (2, "ip 1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 01.002.3.4"), (3, "card 4111 1111 1111 1111 4111-1111-1111-1112 é 4111111111111111"), (4, "+1 (017) 555-7713 +12 +49.30.1234567- x"),
    (5, None), (6, ""), (7, "see https://ex.com/a?b=1. and iban DE89370400440532013000"), (8, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1.1.1.1"),
]


def brute_pii(t):
    luhn = lambda s: sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if k % 2 else int(c) for k, c in enumerate(reversed(s))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "email", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "ip", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        (r"[0-9]([\x20-]?[0-9])+", "card", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))), (r"\+[0-9][\x20().0-9-]+[0-9]", "phone", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    spans = [(m.start(), k, name, m.end()) for k, (p, name, ok) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(m)]
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(spans))


def test_pii(spark):
    out = {r["doc_id"]: r for r in collect(pii.find_pii(spark.createDataFrame(PII, "doc_id long, text string")))}
    for i, t in PII:
        assert out[i]["base_sha256"] == hashlib.sha256(brute_pii(t).encode()).hexdigest(), (t, brute_pii(t), out[i]["spans"])
    assert "url:4:" in out[7]["spans"] and "iban:" in out[7]["spans"]


def test_pii_edges(spark):
    """A very long text, repeated rows, a null id, an empty table and clashing columns."""
    long = "word " * 60_000 + "a@b.cd " + "1.2.3.4 " * 2_000
    d = spark.createDataFrame([(1, long, 5), (1, long, 6), (None, "a@b.cd", None), (2, None, None)], "doc_id long, text string, n_email int")
    out = sorted(((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["base_sha256"]) for r in collect(pii.find_pii(d))), key=str)
    sha = lambda t: hashlib.sha256(brute_pii(t).encode()).hexdigest()
    assert out == sorted([(0, 1, 0, sha("a@b.cd")), (1, 1, 2_000, sha(long)), (1, 1, 2_000, sha(long)), (2, 0, 0, sha(""))], key=str)
    assert pii.find_pii(d.limit(0)).count() == 0


def test_pii_random():
    rng, finder = np.random.default_rng(5), pii.automaton()
    for _ in range(3000):
        t = "".join(rng.choice(list("0123456789.@+- ()ab1"), rng.integers(1, 40)))
        got = ",".join(f"{k}:{a}:{b}" for a, b, k in pii.spans_of(t, finder) if k in pii.BASE)
        assert got == brute_pii(t), t


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, "short"), (4, "http://c", "short"), (5, "http://d", None), (1, "http://b2", big), (6, "u", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for run in ("one", "two"):
        manifest = warc.write_warc(pages, f"file://{tmp_path}/{run}", partitions=2, roll=700)
        out = sorted(collect(warc.read_warc(spark, f"file://{tmp_path}/{run}", manifest)), key=lambda r: (r["page_id"], r["record_type"]))
        assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in out] == [(1, "response", None), (1, "revisit", 1), (2, "response", None), (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None)]
        assert all(r["payload_bytes"] == len((h or "").encode()) for r in out for p, _, h in rows if p == r["page_id"])
    files = sorted(p.name for p in (tmp_path / "one").glob("*.warc.gz"))
    assert len(files) > 2 and all((tmp_path / "one" / f).read_bytes() == (tmp_path / "two" / f).read_bytes() for f in files) and (tmp_path / "one/manifest.json").exists()
    assert gzip.decompress((tmp_path / "one" / files[0]).read_bytes()).startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_edges(spark, tmp_path):
    """A payload that is read in many blocks, a null page_id and its copy, clashing columns."""
    long = "".join(f"<p>{k}</p>" for k in range(900_000))
    rows = [(None, "u", "y" * 200, 1), (7, "u", "y" * 200, 2), (8, "v", long, 3), (9, "v", long, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    out = {r["page_id"]: r for r in collect(warc.round_trip(pages))}
    assert out[None]["record_type"] == "response" and (out[7]["record_type"], out[7]["refers_to"]) == ("revisit", None)
    assert out[8]["payload_bytes"] == len(long) and (out[9]["record_type"], out[9]["refers_to"]) == ("revisit", 8)
    assert out[8]["payload_digest"] == out[9]["payload_digest"] == hashlib.sha256(long.encode()).hexdigest()


def test_warc_parse_is_linear():
    """8,000 records of 4 KB, in blocks that end inside records."""
    rng = np.random.default_rng(1)
    payloads = [rng.integers(32, 127, 4_000, np.uint8).tobytes() for _ in range(50)]
    one = [warc.member(warc.record(k, "u", payloads[k % 50], 4_000, hashlib.sha256(payloads[k % 50]).hexdigest(), None)) for k in range(8_000)]
    data, begin = b"".join(one), time.perf_counter()
    ids = [r["page_id"] for r in warc.parse(data[k : k + 1_000_003] for k in range(0, len(data), 1_000_003))]
    assert ids == list(range(8_000)) and time.perf_counter() - begin < 5
    with pytest.raises(ValueError):
        list(warc.parse([data[:-3]]))


def test_pipeline_small(spark, docs, tmp_path):
    import corpus_pipeline

    (docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # Base: 1, 2, 2, 3 and a copy without id pass; 7 repeats itself. One of the copies is left, and no benchmark passage.
    assert {r["doc_id"] for r in collect(corpus_pipeline.run(spark, str(tmp_path)))} <= {1, None}


def brute_pipeline(rows, rules, items):
    """(doc_id, source, position, slot, shard) that the five stages leave of rows (doc_id, text, source), in plain Python. rules: the learned decision list."""
    import regex

    def good(text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many = collections.Counter(win)
        repeated = len({i + k for i, x in enumerate(win) if many[x] > 1 for k in range(5)})
        if len(w) < 10 or 100 * repeated > 20 * len(w):
            return False
        chars = sum(map(len, w))
        stats = {
            "n_words": len(w), "word_len": chars / len(w), "symbol_ratio": len(re.findall(r"[#*$%&|<>]", text)) / len(w), "dup_line_ratio": (len(lines) - len(set(lines))) / len(lines),
            "repeat_ratio": repeated / len(w), "upper_ratio": len(regex.findall(r"\p{Lu}", text)) / chars, "mark_ratio": len(re.findall(r"[!?]", text)) / len(w), "distinct_ratio": len(set(w)) / len(w),
        }
        return not any(all((stats[c.feature] > c.cut) == c.above for c in rule) for rule in rules)

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})))

    left = [r for r in rows if good(r[1])]
    first = {doc for doc, _, component in brute_components([(r[0], r[1]) for r in left]) if doc == component}
    windows = {tuple(w[i : i + 10]) for t in items if (w := words(t)) for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    table = sharding.lookup_table([f"shard-{k:05d}" for k in range(sharding.SHARDS)])
    slot = lambda doc: int(hashlib.md5(str(doc).encode()).hexdigest()[:8], 16) % sharding.SLOTS
    last = [(doc, source or "", source) for doc, text, source in left if doc in first and clean(words(text))]
    place = lambda doc: int(hashlib.md5(str(doc).encode()).hexdigest()[:8], 16)
    share = mixing.shares(mixing.tempered(collections.Counter(key for _, key, _ in last)))
    period = sum(share.values())
    at = {(s, k): t for t, (s, k) in enumerate(mixing.schedule(share))}
    ordered = []
    for s in share:
        for k, (_, doc, source) in enumerate(sorted((place(doc), doc, source) for doc, key, source in last if key == s)):
            block = k // mixing.BLOCK
            ordered.append(((block // share[s] * period + at[s, block % share[s]]) * mixing.BLOCK + k % mixing.BLOCK, doc, source))
    return sorted((doc, source, position, slot(doc), table[slot(doc)]) for position, (_, doc, source) in enumerate(sorted(ordered)))


@pytest.mark.parametrize("with_labels", [True, False])
def test_pipeline_as_brute_force(spark, tmp_path, with_labels):
    """All five stages over the smallest tables, with learned rules and (without labels) with none; each stage takes something away."""
    import corpus_pipeline
    from cellflow.llm.common import pick, table
    from cellflow.llm.textstats import text_stats

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    if not with_labels:
        labels = labels.limit(0)
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", table(spark, d, "benchmark"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    rules = quality_rules.learn_from(text_stats(pick(docs, doc_id="long", text="string"), "doc_id"), quality_rules.labelled(labels))
    assert bool(rules) == with_labels
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    want = brute_pipeline(rows, rules, [r["text"] for r in table(spark, d, "benchmark").collect()])
    got = sorted((r["doc_id"], r["source"], r["position"], r["slot"], r["shard"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and 0 < len(want) < len(rows)
