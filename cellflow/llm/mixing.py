"""Mixing sources to target weights by Pfair scheduling.

A source's documents are dealt into blocks. In a period of `period` slots a source with share a has a blocks; its k-th block (from 0) is
released at floor(k * period / a) and due at ceil((k + 1) * period / a). Earliest deadline first among released blocks fills every slot and
keeps each source less than one block from its ideal share at every slot. The period's table has `period` rows whatever the data; the
periods repeat, and a source that runs out leaves its slots empty, so that the others keep their proportions.

Nothing is dropped or repeated. Numbers within a source come from small cells of it (by hash), whose sizes are added up first, so a source
with a third of all rows is many groups.
"""

from __future__ import annotations

import heapq
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep, pick, small

BLOCK = 16
PERIOD = 1000
#: Documents that a cell of a source holds on average.
CELL = 4096
#: More sources than this are an error: the schedule has a share for each, and is made on the driver.
MOST_SOURCES = 10_000


def shares(weights: dict[str, int], period: int = PERIOD) -> dict[str, int]:
    """Whole shares of the period in proportion to whole weights, one at least; what is left goes to the largest remainders, ties by name."""
    names, total = sorted(weights), sum(weights.values())
    if not names:
        return {}
    if len(names) > period or total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must be whole, not below 0 and not all 0, and the period no shorter than their number")
    spare = period - len(names)
    out = {s: 1 + spare * weights[s] // total for s in names}
    for s in sorted(names, key=lambda s: (-(spare * weights[s] % total), s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def schedule(share: dict[str, int]) -> list[tuple[str, int]]:
    """The period's slots as (source, number of its block): earliest deadline first among released blocks, ties by name. Two heaps hold each
    source's next block, by release until it is released and then by deadline."""
    period = sum(share.values())
    waiting, ready, slots = [(0, s, 0) for s in sorted(share) if share[s]], [], []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // share[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots.append((s, k))
        if k + 1 < share[s]:
            heapq.heappush(waiting, ((k + 1) * period // share[s], s, k + 1))
    return slots


def tempered(counts: dict[str, int]) -> dict[str, int]:
    """The default target: thousandths of the square root of a source's size, which lifts small sources."""
    return {s: isqrt(n * 1_000_000) for s, n in counts.items()}


def place(doc_id: Column) -> Column:
    """A document's place in its source, before ties: the first 8 hex digits of its id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


class _Mix:
    """The mix of one table: its schedule as two literal tables (for each source its share and number of cells, for each slot its source and
    block), and the steps from a row to its place in it."""

    def __init__(self, docs: DataFrame, weights: dict[str, int] | None, block: int, period: int):
        spark = docs.sparkSession
        found = {r["s"]: r["n"] for r in docs.select(F.coalesce("source", F.lit("")).alias("s")).groupBy("s").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
        if len(found) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        target = tempered(found) if weights is None else {s: weights.get(s, 0) for s in found}
        self.block, self.period = block, max(period, 2 * len(found))
        share = shares(target, self.period)
        code = {s: k for k, s in enumerate(share)}
        ints = lambda xs: (F.split(F.lit(",".join(map(str, xs))), ",") if xs else F.array()).cast("array<long>")
        turns = schedule(share)
        self.slots = F.broadcast(spark.range(1).select(F.posexplode(F.arrays_zip(ints([code[s] for s, _ in turns]).alias("s"), ints([k for _, k in turns]).alias("k"))).alias("slot_in", "x")).select("x.s", "x.k", "slot_in"))
        self.sources = F.broadcast(spark.createDataFrame([(s, code[s], share[s], ceil(found[s] / CELL)) for s in share] or [("", 0, 1, 1)], "_source string, s long, share long, cells long"))

    def celled(self, rows: DataFrame) -> DataFrame:
        """rows (_id, _source, _tie and others) with s, share, _place and cell."""
        at = F.when(F.col("_id").isNull(), F.pmod(F.col("_tie"), F.lit(1 << 32))).otherwise(place(F.col("_id")))
        return rows.withColumn("_place", at).join(self.sources, "_source").withColumn("cell", F.floor(F.col("_place") * F.col("cells") / (1 << 32))).drop("cells")

    def starts(self, celled: DataFrame) -> DataFrame:
        """(s, cell, start): the number of rows of the source in the cells before."""
        before = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        sizes = celled.groupBy("s", "cell").agg(F.count("*").alias("n"))
        return keep(sizes.select("s", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "cells")

    def placed(self, rows: DataFrame, rank: Column) -> DataFrame:
        """rows (s, share) with block, slot and position of that rank in the source."""
        blocked = rows.withColumn("_k", rank).withColumn("block", F.floor(F.col("_k") / self.block))
        slotted = blocked.withColumn("k", F.col("block") % F.col("share")).join(self.slots, ["s", "k"])
        slot = F.floor(F.col("block") / F.col("share")) * self.period + F.col("slot_in")
        return slotted.withColumn("slot", slot).withColumn("position", F.col("slot") * self.block + F.col("_k") % self.block)


_ORDER = ("_place", "_id", "_tie")


def _rows(docs: DataFrame, carried: list[str]) -> DataFrame:
    """docs as _row (the carried columns), _id, _source and _tie: a hash of them that orders rows of one id (maps have no hash)."""
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if c in carried and "map<" not in kind])
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"), F.col("doc_id").alias("_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), tie.alias("_tie"))


def mix_order(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """All columns of docs, then block (of its source), slot and position (long), which replace columns of those names; rows in order of position have the target mix.

    weights: whole numbers by source; a source without one counts as 0 and gets one block a period; None: tempered. A null source is a source
    of its own (weights name it ""). The period is `period` slots, or twice the number of sources where that is more. Rows that share an id are
    in the order of a hash of their other columns (rows alike in all are interchangeable); a row without an id takes its place by that hash.
    """
    mix = _Mix(docs, weights, block, period)
    celled = mix.celled(_rows(docs, [c for c in docs.columns if c not in ("block", "slot", "position")]))
    numbered = celled.join(mix.starts(celled), ["s", "cell"])
    rank = F.col("start") + F.row_number().over(Window.partitionBy("s", "cell").orderBy(*_ORDER)) - 1
    return mix.placed(numbered, rank).select("_row.*", "block", "slot", "position")


def mix_sources(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, source, block, slot, position) of every document."""
    return mix_order(pick(docs, doc_id="long", source="string"), weights)


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, parts: int | None = None) -> DataFrame:
    """All rows of docs, with their columns, laid out in mixed order: partitions, and the rows in each, ascend by position (rows that are alike in
    all columns stay in one partition). parts: about how many partitions, else the session's number of shuffle partitions.

    Ids, sources and hashes are numbered first. A partition is a range of positions, and so of each source's order: the first keys of its ranges,
    by cell, tell which partition a row goes to, so whole rows are exchanged once and numbered where they land.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mix = _Mix(docs, weights, BLOCK, PERIOD)
    rows = _rows(docs, docs.columns)
    celled = mix.celled(rows.drop("_row"))
    in_cell = Window.partitionBy("s", "cell").orderBy(*_ORDER)
    numbered = celled.join(mix.starts(celled), ["s", "cell"]).withColumn("_n", F.col("start") + F.row_number().over(in_cell) - 1)
    told = mix.placed(numbered.withColumn("_r", F.col("start") + F.rank().over(in_cell) - 1), F.col("_r"))  # ties are placed as their first
    told = keep(told.select("s", "cell", *_ORDER, "_n", "position"), "positions")
    width = -(-((told.agg(F.max("position")).first()[0] or 0) + 1) // parts)
    key = F.struct(*[F.col(c) for c in _ORDER])
    part = F.floor(F.col("position") / width).cast("int")
    firsts = told.groupBy("s", "cell", part.alias("part")).agg(F.min(key).alias("first"), F.min("_n").alias("_n"))
    # Where a source's numbers begin in a partition: in the first of its cells there.
    begin = firsts.groupBy("s", "part").agg(F.min("_n").alias("begin"))
    ranges = keep(firsts.join(begin, ["s", "part"]).groupBy("s", "cell").agg(F.sort_array(F.collect_list(F.struct("first", "part", "begin"))).alias("ranges")), "ranges")
    found = F.element_at(F.filter("ranges", lambda r: r["first"] <= key), -1)
    dealt = mix.celled(rows).join(small(ranges, 64 * F.size("ranges") + 32), ["s", "cell"]).withColumn("_to", found).withColumn("part", F.col("_to.part"))
    landed = dealt.repartitionByRange(parts, "part")
    rank = F.col("_to.begin") + F.row_number().over(Window.partitionBy("part", "s").orderBy(*_ORDER)) - 1
    return mix.placed(landed, rank).sortWithinPartitions("part", "position").select("_row.*")


def laid_out(rows: DataFrame) -> DataFrame:
    """rows, read from the files that mixed() was written to, with position (long): the row's place in the mixed order, from 0 without gaps.

    A writer's files are numbered by partition, so the order is that of the files' numbers and of the rows in each. The table of files has a
    row for each and is numbered in one task.
    """
    of = F.element_at(F.split("_metadata.file_path", "/"), -1)
    number = [F.regexp_extract("_file", pattern, 1).cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)\.")]
    placed = rows.select(F.struct("*").alias("_kept"), of.alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = placed.groupBy("_file").agg(F.count("*").alias("n"))
    before = Window.orderBy(*number, "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = keep(files.select("_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")), "files")
    return placed.join(small(starts, 120), "_file").select("_kept.*", (F.col("_start") + F.col("_at")).alias("position"))


def oracle_sql(block: int = BLOCK, period: int = PERIOD) -> str:
    """The same schedule by recursion over the period's slots (up to period / 2 sources)."""
    return f"""
WITH RECURSIVE c AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT source, n, CAST(floor(sqrt(n * 1000000)) AS BIGINT) AS w, sum(CAST(floor(sqrt(n * 1000000)) AS BIGINT)) OVER () AS total, {period} - count(*) OVER () AS spare FROM c),
f AS (SELECT source, 1 + spare * w // total AS base, row_number() OVER (ORDER BY spare * w % total DESC, source) AS r, {period} - sum(1 + spare * w // total) OVER () AS remaining FROM w),
a AS (SELECT source, CAST(base + CASE WHEN r <= remaining THEN 1 ELSE 0 END AS BIGINT) AS share, row_number() OVER (ORDER BY source) AS s FROM f),
l AS (SELECT list(share ORDER BY s) AS shares, count(*) AS m FROM a),
e(t, pick, nth, done) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), list_transform(shares, lambda x: CAST(0 AS BIGINT)) FROM l
  UNION ALL
  SELECT t + 1, p, done[p], list_transform(done, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END)
  FROM (SELECT t, done, list_min(list_transform(done, lambda x, i: CASE WHEN x < shares[i] AND x * {period} // shares[i] <= t + 1 THEN (((x + 1) * {period} + shares[i] - 1) // shares[i]) * 100000 + i ELSE 1000000000000 END)) % 100000 AS p
        FROM e, l WHERE t < {period} - 1)),
k AS (SELECT doc_id, source, coalesce(source, '') AS key, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT, doc_id) - 1 AS k FROM documents)
SELECT doc_id, k.source, CAST(k.k // {block} AS BIGINT) AS block, CAST((k.k // {block}) // share * {period} + e.t AS BIGINT) AS slot, CAST(((k.k // {block}) // share * {period} + e.t) * {block} + k.k % {block} AS BIGINT) AS position
FROM k JOIN a ON a.source = k.key JOIN e ON e.pick = a.s AND e.nth = (k.k // {block}) % share AND e.t >= 0"""
