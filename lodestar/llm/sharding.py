"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by a uniform 62-bit hash of their text, then by doc_id: equal texts stand side by side, so a group of
copies stays in one shard unless a boundary has to fall inside it. The boundaries (splitters) are found as histogram
sort does: each round places probes in every interval that still holds a boundary, counts the exact bytes and rows
below each probe in one pass over the narrow key table, and keeps the probe interval that brackets the target. An
interval that has shrunk to a single hash is one group of equal texts; if cutting beside the group misses the target by
more than the tolerance, the same search goes on over the doc_ids in the group. Then the rows are exchanged once.

Probes lie on a dyadic grid over the keys, so a row's cell is a shift of its key, and the cells that still hold a boundary
are a small table, joined. The driver holds only probe counts: about PROBED rows a round or as many as there are open
cells, whatever the input's size. A shard that is too large for a task is made of several buckets, whose rows are counted
by the same histogram, so that numbering the rows needs no second exchange. Tables of boundaries are broadcast; they have
a few rows for each bucket, and a bucket has millions of rows.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

KEY_BITS = 62
#: Cells that a round of the search may look at, if there are not more open ones.
PROBED = 1 << 16
BEFORE_ALL = -(2**63)


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of the driver's, without an RDD."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _search(rows: DataFrame, bits: int, targets: list[tuple[int, int, int, int, float]], probes: int) -> list[dict]:
    """For each target (g, weight, weight below g, rows below g, tolerance): the key in g with about `weight` below it.

    rows: (g, u, key, size); within a g, u is 0 .. 2 ** bits - 1 and orders the rows as key does (but for the last bit).
    Returns per target {at, weight, count, group}: weight and rows with key < at; group is None, or the
    (key, weight, count) of the single key whose rows straddle the target."""
    state = [{"p": 0, "w": w, "c": c} for _, _, w, c, _ in targets]
    done: list[dict | None] = [None] * len(targets)
    shift = bits
    while waiting := [i for i, d in enumerate(done) if d is None]:
        parents = sorted({(targets[i][0], state[i]["p"]) for i in waiting})
        step = max(1, min((PROBED // len(parents)).bit_length() - 1, max(probes, 4 * len(waiting) // len(parents)).bit_length()))
        below = max(0, shift - step)
        here = rows
        if shift < bits or len(parents) < len({t[0] for t in targets}):
            few = _table(rows.sparkSession, [{"g": g, "p": p} for g, p in parents], "g int, p long")
            here = rows.withColumn("p", F.shiftright("u", shift)).join(F.broadcast(few), ["g", "p"], "left_semi")
        cells: dict[tuple[int, int], list] = {}
        counted = here.groupBy("g", F.shiftright("u", below).alias("cell")).agg(F.sum("size").alias("w"), F.count("*").alias("c"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        for r in counted.collect():
            cells.setdefault((r["g"], r["cell"] >> (shift - below)), []).append((r["cell"], r["w"], r["c"], r["lo"], r["hi"]))
        sums: dict[tuple[int, int], tuple[list, list]] = {}
        for k, found in cells.items():
            found.sort()
            w, c = [0], [0]
            for x in found:
                w.append(w[-1] + x[1])
                c.append(c[-1] + x[2])
            sums[k] = w, c
        for i in waiting:
            g, target, _, _, tolerance = targets[i]
            key = g, state[i]["p"]
            found, (ws, cs) = cells.get(key, []), sums.get(key, ([0], [0]))
            w0, c0 = state[i]["w"], state[i]["c"]
            k = bisect_left(ws, target - w0) - 1  # the cell in which the weight reaches the target
            if k < 0 or k >= len(found):
                k = max(0, min(k, len(found)))
                at = found[0][3] if k == 0 and found else found[-1][4] + 1 if found else BEFORE_ALL
                done[i] = {"at": at, "weight": w0 + ws[k], "count": c0 + cs[k], "group": None}
                continue
            cell, dw, dc, lo, hi = found[k]
            w, c = w0 + ws[k], c0 + cs[k]
            if abs(w - target) <= tolerance:
                done[i] = {"at": lo, "weight": w, "count": c, "group": None}
            elif abs(w + dw - target) <= tolerance:
                done[i] = {"at": hi + 1, "weight": w + dw, "count": c + dc, "group": None}
            elif lo == hi or below == 0:
                done[i] = {"at": lo, "weight": w, "count": c, "group": (hi, dw, dc)}
            else:
                state[i] = {"p": cell, "w": w, "c": c}
        shift = below
    return done


def _nearest(found: dict, target: int) -> tuple[int, int, int]:
    """The better of the two cuts beside a key."""
    if found["group"] and found["weight"] + found["group"][1] - target < target - found["weight"]:
        key, w, c = found["group"]
        return key + 1, found["weight"] + w, found["count"] + c
    return found["at"], found["weight"], found["count"]


def splitters(keys: DataFrame, buckets: int, exact_every: int, rel_tolerance: float, probes: int) -> tuple[list[tuple[int, int]], list[int]]:
    """The (hash, doc_id) boundaries between buckets, and the rows below each. keys: (h, d, size)."""
    total, n = keys.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    if not n or buckets < 2:
        return [], []
    targets = [total * i // buckets for i in range(1, buckets)]
    shard = total * exact_every / buckets
    tolerance = [min(rel_tolerance * shard if i % exact_every == 0 else 0.05 * shard, 0.25 * total / buckets) for i in range(1, buckets)]
    rows = keys.select(F.lit(0).alias("g"), F.col("h").alias("u"), F.col("h").alias("key"), "size")
    found = _search(rows, KEY_BITS, [(0, t, 0, 0, e) for t, e in zip(targets, tolerance, strict=True)], probes)
    out: list[tuple[int, int, int]] = []
    inside: dict[int, list[int]] = {}
    for i, (f, t) in enumerate(zip(found, targets, strict=True)):
        at, _, count = _nearest(f, t)
        out.append((at, BEFORE_ALL, count))
        if f["group"] and f["group"][2] > 1:
            inside.setdefault(f["group"][0], []).append(i)
    if inside:  # all groups at once: boundaries inside a group of equal texts, by doc_id
        number = {h: g for g, h in enumerate(sorted(inside))}
        groups = _table(keys.sparkSession, [{"h": h, "g": g} for h, g in number.items()], "h long, g int")
        members = materialise(keys.join(F.broadcast(groups), "h").select("g", "d", "size"), "straddling")
        least = members.groupBy("g").agg(F.min("d").alias("least"))
        rows = members.join(F.broadcast(least), "g").select("g", (F.shiftright("d", 1) - F.shiftright("least", 1)).alias("u"), F.col("d").alias("key"), "size")
        which = [i for h in sorted(inside) for i in inside[h]]
        wanted = [(number[found[i]["group"][0]], targets[i], found[i]["weight"], found[i]["count"], tolerance[i]) for i in which]
        for i, f in zip(which, _search(rows, 63, wanted, probes), strict=True):
            at, _, count = _nearest(f, targets[i])
            out[i] = (found[i]["group"][0], at, count)
    out.sort()
    return [(h, d) for h, d, _ in out], [c for *_, c in out]


def _grid_table(bounds: list[tuple[int, int]], low: int, high: int, half: int = 0) -> tuple[int, list[dict]]:
    """(shift, rows): ascending bounds (key, weight) by cells of a dyadic grid over low <= key >> half < high. A row: the
    cell, the weight of all bounds in earlier cells (before), and the keys and weights of its own."""
    shift = max(0, (high - low).bit_length() - (4 * len(bounds)).bit_length())
    places = [(k >> half) - low for k, _ in bounds]
    sums = [0]
    for _, w in bounds:
        sums.append(sums[-1] + w)
    rows = []
    for cell in range((high - 1 - low >> shift) + 1):
        a, b = bisect_left(places, cell << shift), bisect_left(places, cell + 1 << shift)
        rows.append({"cell": cell, "before": sums[a], "at": [k for k, _ in bounds[a:b]], "weight": [w for _, w in bounds[a:b]]})
    return shift, rows


def _passed(key: str) -> Column:
    """The weight of the bounds up to a row's key, from its cell's row."""
    weights = F.zip_with("at", "weight", lambda x, w: F.when(x <= F.col(key), w).otherwise(F.lit(0)))
    return F.col("before") + F.aggregate(weights, F.lit(0), lambda s, w: s + w)


def _with_bucket(keys: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """keys with the number of bounds up to its (h, d), by lookups in small tables of cells."""
    if not bounds:
        return keys.withColumn("bucket", F.lit(0))
    spark, schema = keys.sparkSession, "cell long, before int, at array<long>, weight array<int>"
    inner: dict[int, list[int]] = {}
    for h, d in bounds:
        if d != BEFORE_ALL:
            inner.setdefault(h, []).append(d)
    weighted: dict[int, int] = {}
    for h, d in bounds:  # a bound inside a group counts in full from the next hash on
        k = h if d == BEFORE_ALL else h + 1
        weighted[k] = weighted.get(k, 0) + 1
    shift, rows = _grid_table(sorted(weighted.items()), 0, 2**KEY_BITS)
    out = keys.withColumn("cell", F.shiftright("h", shift)).join(F.broadcast(_table(spark, rows, schema)), "cell", "left")
    out = out.withColumn("bucket", F.coalesce(_passed("h"), F.lit(0))).drop("cell", "before", "at", "weight")
    if inner:
        groups, cells = [], []
        for h, ds in inner.items():
            low, high = ds[0] >> 1, (ds[-1] >> 1) + 1
            s, rows = _grid_table([(d, 1) for d in ds], low, high, 1)
            groups.append({"h": h, "low": low, "high": high, "s": s})
            cells += [r | {"h": h} for r in rows]
        out = out.join(F.broadcast(_table(spark, groups, "h long, low long, high long, s int")), "h", "left")
        cell = F.expr("shiftright(greatest(least(shiftright(d, 1), high - 1), low) - low, s)")
        out = out.withColumn("cell", cell).join(F.broadcast(_table(spark, cells, "h long, " + schema)), ["h", "cell"], "left")
        out = out.withColumn("bucket", F.col("bucket") + F.coalesce(_passed("d"), F.lit(0))).drop("cell", "before", "at", "weight", "low", "high", "s")
    return out


def shard_documents(docs: DataFrame, shards: int = 24, rel_tolerance: float = 0.0005, probes: int = 32, rows_per_task: int = 2_000_000) -> DataFrame:
    """Deal all rows to `shards` shards of nearly equal bytes; law `bytes`.

    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard, in key order), grown_shard (null).
    size: UTF-8 bytes of the text plus 8. A null text counts as empty, a null doc_id as the least id; repeated rows get
    a slot each (all in one task if they share text and doc_id). Very long texts are measured, not moved; other columns
    of docs, whatever their names, are not looked at. With fewer rows than shards some shards stay empty; an empty table gives an empty result. Shards differ
    by the tolerance (of a shard's mean bytes) or, where single documents are larger than that, by about one document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("h"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1)).alias("d"),
        ),
        "shard-keys",
    )
    per_shard = max(1, -(-keys.count() // (shards * rows_per_task)))
    bounds, below = splitters(keys, shards * per_shard, per_shard, rel_tolerance, probes)
    below = [0, *below]
    offsets = _table(docs.sparkSession, [{"bucket": b, "first": n - below[b - b % per_shard]} for b, n in enumerate(below)], "bucket int, first long")
    order = Window.partitionBy("bucket").orderBy("h", "d", "text_crc32")
    numbered = _with_bucket(keys, bounds).withColumn("n", F.row_number().over(order).cast("long") - 1).join(F.broadcast(offsets), "bucket")
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("bucket") / per_shard).cast("int").alias("shard"),
        (F.col("n") + F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
