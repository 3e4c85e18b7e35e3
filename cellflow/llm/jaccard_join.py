"""Exact Jaccard join of documents on five-word shingles, as a join in the metric space d = 1 - Jaccard.

Equal sets are joined first: a set is kept once, under its smallest doc_id. A first split by shingles then makes cells, because unrelated
texts lie at distance 1 from every text: a text belongs to the cells of its rarest shingles, as many as a partner may miss (with size n and
3/4 similarity, a partner has all but n - ceil(3n/4) of its shingles). Shingles that one text alone has make no cell. Of the texts that share
a rare shingle the one whose shingles are the most common becomes the cell's pivot, and cells of one pivot are one.

From there on pivots are texts and all is metric. A step takes cells and their pivots, computes each text's distances to them, and makes a
region for each pivot: a text's home is that of its nearest pivot within RADIUS. With links up to T = 1/4, a partner of a text at home with p
is at RADIUS + T from p at most, and no more than 2 T farther from p than from its own nearest pivot; texts in that window are replicated
into p's region. Texts without a pivot within RADIUS make a region of their own. So linked texts meet in a region. Regions above BOUND texts
get pivots of their own and are split again, until none is, or splitting one doesn't make it smaller. What is left is compared in blocks, by
bands of the distance to the region's pivot: linked texts' bands are the same or neighbours (triangle inequality), other blocks never meet.

For components only pairs of different components are compared: the texts linked to a region's pivot are one already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep, pick, ship, small, small_batches
from .components import components
from .shingles import chunks, digest, shingle_sets

#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Postings that one reducer's bucket should hold.
BUCKET = 2_000_000
#: Shingles found this often are ordered last by a table of at most HEAVY_ROWS of them, and their postings aren't exchanged.
HEAVY_FROM, HEAVY_ROWS = 5_000, 16_384
#: Postings that a task packs at a time.
POSTED = 400_000
#: Texts that a block holds, and texts that a task handles.
BLOCK, TASK = 128, 256
#: The largest distance of linked texts, and that of a text from the pivot of its home.
T, RADIUS = 1 - PERCENT / 100, 0.5
#: A region of more texts is split by pivots of its own, PIVOTS at most; so many times at most.
BOUND, PIVOTS, DEPTH = 1024, 16, 6
#: The pivot of a region of texts that are far from all pivots.
FAR = -(1 << 62)
#: Stands for a null doc_id on the way through Python, and sets that only null ids have get names from NAMELESS on.
NO_ID, NAMELESS = -(1 << 63), 1 << 62
_POSTING = np.dtype([("key", "<i8"), ("rank", "u1")])


def need(n: int) -> int:
    """The fewest shingles that a set of n shares with any partner: its size times the similarity, rounded up."""
    return -(-PERCENT * n // 100)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """kind 0: a document's id, set size and digest. kind 1: a shingle and in how many texts of these it is, if in many."""
    for pdf in batches:
        for first, raw in chunks(pdf["text"].tolist()):
            sets = shingle_sets(raw)
            ids = pdf["doc_id"].iloc[first : first + len(raw)].to_numpy()
            yield pd.DataFrame({"kind": 0, "doc_id": ids, "n": [len(s) for s in sets], "digest": [digest(s) if len(s) else 0 for s in sets]})
            different = {digest(s): s for s in sets if len(s)}
            if different:
                keys, counts = np.unique(np.concatenate(list(different.values())), return_counts=True)
                often = counts >= max(4, len(different) // 100)
                if often.any():
                    yield pd.DataFrame({"kind": 1, "doc_id": NO_ID, "n": counts[often], "digest": keys[often].view(np.int64)})


def _low(bits: int) -> int:
    """Bits of a shingle's hash that a posting sends beside its bucket: 48, or the fewer that the bucket doesn't tell. With 2 ** bits buckets a
    shingle is 48 + bits bits, so that what tells shingles apart grows with their number."""
    return min(48, 64 - bits)


def _poster(bits: int, heavy: np.ndarray):
    """Postings of different sets, packed into one row for each bucket; those of heavy shingles go, ranked last, to any bucket. A row has the
    texts' digests, how many postings each has (255 at most, then it is named again), and the postings' low 48 bits (heavy ones': all)."""

    def pack(different: dict[int, np.ndarray]) -> pd.DataFrame:
        ids = np.fromiter(different, np.int64, len(different))
        keys, owner = np.concatenate(list(different.values())), np.repeat(np.arange(len(ids), dtype=np.int32), [len(s) for s in different.values()])
        bucket = (keys >> np.uint64(64 - bits)).astype(np.int32)
        hot = np.isin(keys, heavy) if len(heavy) else np.zeros(len(keys), bool)
        rows = []
        for is_hot in (False, True):
            sel = np.flatnonzero(hot == is_hot)
            if not len(sel):
                continue
            if is_hot:
                # A text's heavy shingles stay together, and its copies in other tasks meet them there.
                bucket[sel] = (ids.view(np.uint64)[owner[sel]] % np.uint64(1 << bits)).astype(np.int32)
            sel = sel[np.argsort(bucket[sel], kind="stable")]
            cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket[sel])) + 1, [len(sel)]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                part = sel[a:b]
                own, count = np.unique(owner[part], return_counts=True)
                times = -(-count // 255)
                if times.max() > 1:
                    own, last = np.repeat(own, times), np.cumsum(times) - 1
                    split = np.full(len(own), 255)
                    split[last] = count - 255 * (times - 1)
                    count = split
                low = keys[part].astype("<u8").view(np.uint8).reshape(-1, 8)
                rows.append((int(bucket[part[0]]), is_hot, ids[own].tobytes(), count.astype(np.uint8).tobytes(), low[:, : 8 if is_hot else 6].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "heavy", "ids", "counts", "keys"])

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        different, size = {}, 0
        for pdf in batches:
            for _, raw in chunks(pdf["text"].tolist()):
                for s in shingle_sets(raw):
                    if len(s) and (name := digest(s)) not in different:
                        different[name] = s
                        size += len(s)
                if size >= POSTED:
                    yield pack(different)
                    different, size = {}, 0
        if different:
            yield pack(different)

    return post


def _collector(bits: int):
    """Of a bucket's postings those whose shingle two texts or more have, one packed row for each text."""
    kept = _low(bits)
    mask = np.uint64((1 << kept) - 1)

    def collect(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for is_hot, part in pdf.groupby("heavy"):
            ids = np.concatenate([np.frombuffer(x, np.int64) for x in part["ids"]])
            counts = np.concatenate([np.frombuffer(x, np.uint8) for x in part["counts"]])
            if is_hot:
                keys = np.concatenate([np.frombuffer(x, "<u8") for x in part["keys"]])
                keys = (keys & mask) | ((keys >> np.uint64(64 - bits)) << np.uint64(kept))
            else:
                low = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 6) for x in part["keys"]])
                keys = np.zeros((len(low), 8), np.uint8)
                keys[:, :6] = low
                del low
                keys = (keys.view("<u8").ravel() & mask) | (np.uint64(key[0]) << np.uint64(kept))
            texts, code = np.unique(ids, return_inverse=True)
            owner = np.repeat(code.astype(np.int32), counts)
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            new_key = np.concatenate(([True], keys[1:] != keys[:-1]))
            once = new_key | np.concatenate(([True], owner[1:] != owner[:-1]))  # copies of a text in other tasks
            keys, owner, new_key = keys[once], owner[once], new_key[once]
            group = np.cumsum(new_key) - 1
            found = np.bincount(group)[group]
            sel = np.flatnonzero((found >= 2) | is_hot)
            packed = np.empty(len(sel), _POSTING)
            packed["key"] = keys[sel].view(np.int64)
            packed["rank"] = 255 if is_hot else np.minimum(254, (4 * np.log2(found[sel])).astype(int))
            owner = owner[sel]
            order = np.argsort(owner, kind="stable")
            packed, owner = packed[order], owner[order]
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            out += [(int(texts[t]), packed[a:b].tobytes(), int(b - a)) for t, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
        return pd.DataFrame(out, columns=["digest", "packed", "shared"])

    return collect


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A text's shared shingles; the rarest of them, of which any partner has one; and how common its shingles are (for the choice of pivots)."""
    for pdf in batches:
        out = []
        for text, n, parts in zip(pdf["rep"], pdf["n"], pdf["parts"], strict=True):
            p = np.frombuffer(b"".join(parts), _POSTING)
            order = np.lexsort((p["key"], p["rank"]))[: max(0, len(p) - need(n) + 1)]
            out.append((text, n, np.sort(p["key"]), p["key"][order], float(p["rank"].astype(float).sum() / n)))
        yield pd.DataFrame(out, columns=["rep", "n", "keys", "rare", "common"])


def linked(common: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int):
    """Whether sets of n and m with `common` shared shingles are linked."""
    return 100 * common >= PERCENT * (n + m - common)


def _inverted(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All values of the arrays in order, and the array that each is of."""
    values, owner = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
    order = np.argsort(values, kind="stable")
    return values[order], owner[order]


def _meets(own: np.ndarray, values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The arrays in which each value of `own` is found, and that value."""
    a, b = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
    at = np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a) + np.arange((b - a).sum())
    return owner[at], np.repeat(own, b - a)


def _regions(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each text of the task's blocks the regions that it belongs to: its home, and those whose window it is in."""
    out = []
    for (cell, _), block in pdf.groupby(["cell", "block"]):
        centre = block[block["is_pivot"]].sort_values("rep")
        ids, m = centre["rep"].to_numpy(), centre["n"].to_numpy()
        index = _inverted(centre["keys"].tolist())
        for row in block[~block["is_pivot"]].itertuples():
            common = np.bincount(_meets(row.keys, *index)[0], minlength=len(ids))
            d = 1 - common / (row.n + m - common)
            least = d.min()
            home = int(d.argmin()) if least <= RADIUS else -1
            for j in np.flatnonzero((d <= min(least + 2 * T, RADIUS + T) + 1e-9) | (np.arange(len(ids)) == home)):
                out.append((cell, row.rep, int(ids[j]), float(d[j]), bool(j == home), bool(linked(common[j], m[j], row.n))))
            if home < 0:
                out.append((cell, row.rep, FAR, 1.0, True, False))
    return pd.DataFrame(out, columns=["cell", "rep", "pivot", "distance", "home", "linked"])


def _compared(pdf: pd.DataFrame, every: bool) -> Iterator[tuple[pd.DataFrame, int, np.ndarray, np.ndarray]]:
    """In each block, for its outside texts k the members j that are linked with k; of two outside texts the smaller is k.
    every: all pairs; else of different components, one of them at home."""
    for _, block in pdf.groupby(["region", "m_band", "m_block", "o_band", "o_block"]):
        block = block.reset_index(drop=True)
        rep, n, comp, dist, home, pivot, role, out = (block[c].to_numpy() for c in ("rep", "n", "component", "distance", "home", "pivot", "role", "outside"))
        if role.all() or not role.any():
            continue
        index = _inverted(block["keys"].tolist())
        for k in np.flatnonzero(role):
            common = np.bincount(_meets(block["keys"].iloc[k], *index)[0], minlength=len(block))
            hit = ~role & (comp != comp[k]) & (~out | (rep > rep[k])) & ((np.abs(dist - dist[k]) <= T + 1e-9) | (pivot == FAR)) & linked(common, n, n[k])
            if not every:
                hit &= home | home[k]
            if hit.any():
                yield block, int(k), np.flatnonzero(hit), comp


def _across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between components: one for each outside text and component, which is enough to join them."""
    out = []
    for block, k, hit, comp in _compared(pdf, False):
        _, one = np.unique(comp[hit], return_index=True)
        out += [(int(block["rep"].iloc[k]), int(block["rep"].iloc[j])) for j in hit[one]]
    return pd.DataFrame(out, columns=["a", "b"])


def _pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """All linked pairs of the task's blocks. A pair that meets in several regions is reported in the smallest one."""
    out = []
    for block, k, hit, _ in _compared(pdf, True):
        rep, copies, region = block["rep"], block["copies"], block["region"].iloc[0]
        for j in hit:
            if np.intersect1d(block["regions"].iloc[k], block["regions"].iloc[j]).min() == region:
                out.append((int(rep[k]), int(rep[j]), int(copies[k]), int(copies[j])))
    return pd.DataFrame(out, columns=["a", "b", "a_copies", "b_copies"])


def _link_counts(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each set the rows that the task's pairs link with it."""
    p = _pairs(key, pdf)
    ends = pd.DataFrame({"rep": np.concatenate([p["a"], p["b"]]).astype(np.int64), "more": np.concatenate([p["b_copies"], p["a_copies"]]).astype(np.int64)})
    return ends.groupby("rep", as_index=False)["more"].sum()


def _tasks(rows: DataFrame, *by: str) -> DataFrame:
    """The column task: blocks dealt to about one task for TASK rows. rows is a kept table, so that counting it is cheap."""
    return rows.withColumn("task", F.pmod(F.xxhash64(*by), F.lit(max(1, math.ceil(rows.count() / TASK)))))


def _cells(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, n, digest), their different sets (digest, n, least, copies, rep), sets' shared shingles and cells (cell, rep); a cell is named by its pivot."""
    rows = pick(docs, doc_id="long", text="string").withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    with small_batches(docs.sparkSession):
        scanned = scratch.keep(rows.mapInPandas(_scan, "kind int, doc_id long, n long, digest long"), "scan")
    per_doc = scanned.where("kind = 0").select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n", "digest")
    sets = scratch.keep(per_doc.where("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.coalesce("least", NAMELESS + F.pmod("digest", F.lit(NAMELESS - 1)))), "sets")

    heavy = scanned.where("kind = 1").groupBy("digest").agg(F.sum("n").alias("found")).where(F.col("found") >= HEAVY_FROM).orderBy(F.desc("found"), "digest").limit(HEAVY_ROWS)
    heavy_keys = np.sort(np.array([r["digest"] for r in heavy.collect()], np.int64).view(np.uint64))
    total = per_doc.agg(F.sum("n")).first()[0] or 0
    bits = max(6, math.ceil(math.log2(max(1, total / BUCKET))))  # 64 buckets at least, so that many tasks share the work

    posted = rows.mapInPandas(_poster(bits, heavy_keys), "bucket long, heavy boolean, ids binary, counts binary, keys binary")
    shared = posted.groupBy("bucket").applyInPandas(_collector(bits), "digest long, packed binary, shared long")
    per_set = shared.groupBy("digest").agg(F.collect_list("packed").alias("parts"), F.sum("shared").alias("shared"))
    # Texts that share too few of their shingles with any other have no partner.
    enough = per_set.join(sets.select("digest", "n", "rep"), "digest").where(100 * F.col("shared") >= PERCENT * F.col("n")).select("rep", "n", "parts")
    with small_batches(docs.sparkSession):
        near = scratch.keep(enough.mapInPandas(_choose, "rep long, n long, keys array<bigint>, rare array<bigint>, common double"), "near")

    rare = scratch.keep(near.select(F.explode("rare").alias("key"), "rep", "n", "common"), "rare")
    pivots = rare.groupBy("key").agg(F.max(F.struct("common", -F.col("rep"), "n")).alias("p"), F.count("*").alias("texts")).where("texts > 1").select("key", (-F.col("p.col2")).alias("cell"))
    return per_doc, sets, near, scratch.keep(rare.join(pivots, "key").select("cell", "rep").distinct(), "cells")


def _split(cells: DataFrame, centres: DataFrame, near: DataFrame, level: int, scratch: Scratch) -> DataFrame:
    """Regions of cells (cell, rep) about their centres (cell, rep): (cell, region, rep, pivot, distance, home, linked)."""
    sizes = scratch.keep(cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "sizes")
    blocks = small(sizes)
    members = cells.join(blocks, "cell").select("cell", "rep", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), F.lit(False).alias("is_pivot"))
    pivots = centres.join(blocks, "cell").select("cell", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_pivot"))
    rows = scratch.keep(members.unionByName(pivots), "blocks")
    placed = _tasks(rows, "cell", "block").join(near.select("rep", "n", "keys"), "rep").groupBy("task").applyInPandas(_regions, "cell long, rep long, pivot long, distance double, home boolean, linked boolean")
    return scratch.keep(placed.withColumn("region", F.xxhash64("cell", "pivot", F.lit(level))), "regions")


def _of_pivots(placed: DataFrame) -> DataFrame:
    """Links (a, b) of texts with pivots."""
    return placed.where("linked and rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))


def _open(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of regions in which more than one component is left, with the region's number of texts."""
    sizes = scratch.keep(rows.groupBy("region").agg(F.count("*").alias("texts"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("region", "texts"), "open")
    return rows.join(small(sizes), "region")


def _recurse(placed: DataFrame, component: DataFrame | None, near: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Regions that are split no more (region, rep, pivot, distance, home, component), and the links found on the way.
    component: (node, component) as known; None: each text is one of its own."""
    columns = ["region", "rep", "pivot", "distance", "home", "component"]
    if component is None:
        told = placed.withColumn("component", F.col("rep"))
    else:
        told = placed.join(component, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    todo, done, links = scratch.keep(_open(told.select(*columns), scratch), "todo"), [], []
    for level in range(1, DEPTH + 1):
        large = todo.where(F.col("texts") > BOUND)
        if level == DEPTH or large.isEmpty():
            break
        # A pivot for each slot of a region, by hash, from the texts at home there.
        slots = F.least(F.lit(PIVOTS), F.ceil(4 * F.col("texts") / BOUND))
        centres = large.where("home").withColumn("slot", F.pmod(F.xxhash64("rep", F.lit(level)), slots)).groupBy("region", "slot").agg(F.min(F.struct(F.xxhash64("rep", F.lit(level), F.lit(1)).alias("h"), "rep")).alias("c")).select(F.col("region").alias("cell"), "c.rep")
        parts = _split(large.select(F.col("region").alias("cell"), "rep"), centres, near, level, scratch)
        links.append(_of_pivots(parts))
        # A split counts if the largest region is smaller by a quarter and not too many texts were replicated.
        each = parts.groupBy("cell", "region").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max("n").alias("largest"), F.sum("n").alias("all"))
        facts = large.select(F.col("region").alias("cell"), "texts").distinct()
        good = scratch.keep(each.join(facts, "cell").where("4 * largest <= 3 * texts and all <= 2 * texts").select("cell"), "good")
        of = large.select(F.col("region").alias("cell"), "rep", "component").distinct()
        inside = parts.join(small(good), "cell").join(of, ["cell", "rep"])
        stuck = large.join(small(good.select(F.col("cell").alias("region"))), "region", "left_anti")
        done.append(scratch.keep(todo.where(F.col("texts") <= BOUND).select(*columns).unionByName(stuck.select(*columns)), "done"))
        todo = scratch.keep(_open(inside.select(*columns), scratch), "todo")
    out = todo.select(*columns)
    for more in done:
        out = out.unionByName(more)
    return scratch.keep(out, "leaves"), links


def _leaf_tasks(leaves: DataFrame, near: DataFrame, every: bool, scratch: Scratch):
    """Regions dealt to tasks in pairs of blocks: outside texts (every: all) meet members of their band and its neighbours."""
    bands = math.ceil(1 / T) + 1
    banded = leaves.withColumn("band", F.when(F.col("pivot") == FAR, 0).otherwise(F.floor((F.col("distance") + 1e-9) / T)).cast("int"))
    main = banded.groupBy("region").agg(F.min(F.struct("distance", "rep", "component")).alias("m")).select("region", F.col("m.component").alias("main"))
    outside = F.lit(True) if every else F.col("component") != F.col("main")
    told = scratch.keep(banded.join(small(scratch.keep(main, "main")), "region").withColumn("outside", outside), "told")
    count = lambda c, what: F.array(*[F.ceil(F.count_if((F.col("band") == k) & c) / BLOCK) for k in range(bands)]).alias(what)
    facts = scratch.keep(told.groupBy("region").agg(count(F.lit(True), "members"), count(F.col("outside"), "outsiders")), "facts")
    rows = told.join(small(facts, 120), "region")

    def others(counts: str):
        near_bands = F.sequence(F.greatest(F.col("band") - 1, F.lit(0)), F.least(F.col("band") + 1, F.lit(bands - 1)))
        return F.explode(F.flatten(F.transform(near_bands, lambda b: F.when(F.get(counts, b) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.get(counts, b) - 1), lambda k: F.struct(b.alias("band"), k.alias("block")))).otherwise(F.array().cast("array<struct<band:int,block:bigint>>")))))

    own = lambda counts, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.get(counts, F.col("band")))
    slim = ["region", "rep", "pivot", "distance", "home", "component", "outside"]
    as_member = rows.select(*slim, F.col("band").alias("m_band"), own("members", 0).alias("m_block"), others("outsiders").alias("o"), F.lit(False).alias("role")).select(*slim, "m_band", "m_block", F.col("o.band").alias("o_band"), F.col("o.block").alias("o_block"), "role")
    as_outside = rows.where("outside").select(*slim, F.col("band").alias("o_band"), own("outsiders", 1).alias("o_block"), others("members").alias("m"), F.lit(True).alias("role")).select(*slim, F.col("m.band").alias("m_band"), F.col("m.block").alias("m_block"), "o_band", "o_block", "role")
    pairs = scratch.keep(as_member.unionByName(as_outside), "pair-blocks")
    return _tasks(pairs, "region", "m_band", "m_block", "o_band", "o_block").join(near, "rep").groupBy("task")


def _all_pairs(docs: DataFrame, scratch: Scratch):
    """Documents, sets, and the tasks that find all pairs."""
    per_doc, sets, near, cells = _cells(docs, scratch)
    leaves, _ = _recurse(_split(cells, cells.select("cell", F.col("cell").alias("rep")).distinct(), near, 0, scratch), None, near, scratch)
    regions = leaves.groupBy("rep").agg(F.collect_set("region").alias("regions"))
    facts = near.join(sets.select("rep", "copies"), "rep").join(regions, "rep").select("rep", "n", "keys", "copies", "regions")
    return per_doc, sets, _leaf_tasks(leaves, facts, True, scratch)


def jaccard_links(docs: DataFrame) -> DataFrame:
    """(a, b), a < b: each linked pair of different sets once. A set stands for its copies under their smallest doc_id (if only null ids have it,
    under a number from NAMELESS on)."""
    with Scratch(docs.sparkSession) as scratch:
        _, _, tasks = _all_pairs(docs, scratch)
        return keep(tasks.applyInPandas(_pairs, "a long, b long, a_copies long, b_copies long").select("a", "b"), "links")


def jaccard_degrees(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_links (long): how many other rows are linked with it, copies of it included. Texts without shingles have none."""
    with Scratch(docs.sparkSession) as scratch:
        per_doc, sets, tasks = _all_pairs(docs, scratch)
        ends = tasks.applyInPandas(_link_counts, "rep long, more long")
        degree = sets.join(ends.groupBy("rep").agg(F.sum("more").alias("more")), "rep", "left").select("digest", "n", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
        return keep(per_doc.join(degree, ["digest", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "degrees")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles (long), component_id (the smallest doc_id that links reach, itself included).

    Null or empty text: no shingles, linked with nothing, its own component. Repeated rows are copies. A row with a null doc_id takes part;
    its component is that of its copies and partners with ids, or null where no id is reachable.
    """
    with Scratch(docs.sparkSession) as scratch:
        per_doc, sets, near, cells = _cells(docs, scratch)
        placed = _split(cells, cells.select("cell", F.col("cell").alias("rep")).distinct(), near, 0, scratch)
        links = _of_pivots(placed)
        known = scratch.keep(components(links), "known")
        leaves, more = _recurse(placed, known, near, scratch)
        more.append(scratch.keep(_leaf_tasks(leaves, near.select("rep", "n", "keys"), False, scratch).applyInPandas(_across, "a long, b long"), "across"))
        final = known
        if any(not m.isEmpty() for m in more):
            for m in more:
                links = links.unionByName(m)
            final = components(links)
        placed_sets = sets.join(final, F.col("rep") == F.col("node"), "left").select("digest", "n", F.coalesce("component", "rep").alias("c"))
        out = placed_sets.select("digest", "n", F.when(F.col("c") < NAMELESS, F.col("c")).alias("component_id"))
        return keep(per_doc.join(out, ["digest", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "verdict")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, with all columns. Rows without an id or without words stay.
    Of repeated rows with that id one stays (any: rows of one id count as one document). Ids decide; texts are exchanged only if the ids that
    go are too many to broadcast, and the rows of repeated ids."""
    verdict = jaccard_components(docs)
    gone = small(keep(verdict.where("doc_id <> component_id").select("doc_id").distinct(), "gone"))
    again = keep(verdict.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if again.isEmpty():
        return left
    again = small(again)
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))


def _pairs_sql() -> str:
    """Shingles as strings, and all linked pairs of documents by counting the shingles that they share."""
    return f"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)"""


def oracle_sql() -> str:
    """Components by following links from every document (ids are unique here)."""
    return f"""WITH RECURSIVE {_pairs_sql()},
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1"""


def links_sql() -> str:
    return f"""WITH {_pairs_sql()}, k AS (SELECT a AS doc_id, count(*) AS k FROM e GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(k, 0) AS n_links FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""


ship(__name__)
