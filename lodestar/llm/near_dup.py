"""Near-duplicate classes with BagMinHash.

1. Exact copies collapse to one node (the MD5 of the text); only nodes go on.
2. A node's signature has `components` BagMinHash values of its 5-word shingles with their counts, one byte each. Bands
   of `rows` bytes are the bucket keys. With 28 bands of 5, a pair of similarity 0.8 shares no bucket with probability
   1.5e-5, one of 0.85 with 7e-8.
3. Every node is verified against one neighbour: of its buckets' leaders the most central one (whose buckets are the
   fullest). Verified pairs are links, and linked nodes form classes, so a group of near copies costs one pair a member.
4. Buckets that still hold nodes of different classes are searched in full: the nodes outside a bucket's largest class
   against all its nodes, in blocks of bounded rows and bytes. A block first names the nodes that have a partner (in
   another class, with signatures that agree on at least 0.7, 4 standard deviations under 0.8, in no earlier band); then
   it gets their bags, each once, verifies the pairs and gives the links that join two classes, fewer than its nodes. No
   list of pairs leaves a task.
5. Classes are the connected components of all links; the smallest doc_id of a class is its id.

Verification counts the exact multiset overlap of the shingles (40-bit hashes; within a pair a false match has
probability 1e-6). Two nodes are linked if sum min / sum max >= threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bagminhash import signatures
from .common import NULL_ID, U64, blocks, fresh, materialise, narrow, raw_parts, run_hashes, word_hashes, word_spans
from .components import components
from .joins import hot_keys, salted, spread_join

SHINGLE = 5
BLOCK_BYTES = 2 << 20
#: What names a task of the full search: the bucket, a part of its nodes outside the largest class, a part of all.
BLOCK = ["key", "bo", "bi"]


def shingles(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle: 5 words, or all words of a shorter text; a text without words has none."""
    starts, ends, row = word_spans(body, offsets)
    h = word_hashes(body, starts, ends)
    n = len(offsets) - 1
    words = np.bincount(row, minlength=n)[:n]
    first = np.cumsum(words) - words
    grams = run_hashes(h, SHINGLE)
    at = np.flatnonzero(row[SHINGLE - 1 :] == row[: len(grams)]) if len(grams) else np.zeros(0, np.int64)
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    extra = np.array([run_hashes(h[first[r] : first[r] + words[r]], int(words[r]))[0] for r in short], U64)
    rows = np.concatenate([row[at], short])
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate([grams[at], extra])[order]


def bags(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles."""
    row, h = shingles(body, offsets)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], h[first], np.diff(np.append(first, len(h)))


def _sign(components_: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = raw_parts(batch["raw"])
            for i, j in blocks(offsets, BLOCK_BYTES):
                row, h, count = bags(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sig = (signatures(row, h, count, j - i, components_) >> U64(24)).astype(np.uint8)
                items = np.bincount(row, count, j - i).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), batch["v"].slice(i, j - i), pa.array([s.tobytes() if k else None for s, k in zip(sig, items, strict=True)], pa.binary()), pa.array(items)], ["doc_id", "v", "sig", "items"])

    return f


def _bag_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bag as a sorted set of 40-bit items: the k-th copy of a shingle is an item of its own."""
    for batch in batches:
        body, offsets = raw_parts(batch["raw"])
        for i, j in blocks(offsets, BLOCK_BYTES):
            row, h, count = bags(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            rows = np.repeat(row, count)
            copy = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            items = (np.repeat(h, count) + copy.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(24)
            order = np.lexsort((items, rows))
            cut = np.searchsorted(rows[order], np.arange(j - i + 1))
            packed = np.ascontiguousarray(items[order].view(np.uint8).reshape(-1, 8)[:, :5])
            yield pa.RecordBatch.from_arrays([batch["v"].slice(i, j - i), pa.array([packed[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["v", "bag"])


def _items(bag: bytes) -> np.ndarray:
    wide = np.zeros((len(bag) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(bag, np.uint8).reshape(-1, 5)
    return wide.view(U64)[:, 0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Multiset Jaccard of two sorted item sets."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[at] == a))
    return both / (len(a) + len(b) - both)


def _star(threshold: float):
    def f(t: pa.Table) -> pa.Table:
        """A group: one leader's bag and some members' bags; the links between them."""
        lead = t.filter(t["is_leader"])
        out = []
        if lead.num_rows:
            leader, own = lead["v"][0].as_py(), _items(lead["bag"][0].as_py())
            members = t.filter(pc.invert(t["is_leader"]))
            for v, bag in zip(members["v"], members["bag"], strict=True):
                n = len(bag.as_py()) // 5
                if min(n, len(own)) >= threshold * max(n, len(own)) and similarity(_items(bag.as_py()), own) >= threshold:
                    out.append(v.as_py())
            return pa.table([pa.array(out, pa.binary()), pa.array([leader] * len(out), pa.binary())], ["a", "b"])
        return pa.table([pa.array([], pa.binary())] * 2, ["a", "b"])

    return f


def _partners(v: np.ndarray, comp: np.ndarray, other: np.ndarray, sig: np.ndarray, band: int, main: bytes, rows: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For the nodes of a block that lie outside the main class (other: True), the places of their partners."""
    classes, inv = np.unique(np.append(comp, main), return_inverse=True)
    inv, main_class = inv[:-1], inv[-1]
    right = np.flatnonzero(~other)
    for x in np.flatnonzero(other).tolist():
        # a pair outside the main class is met from both of its ends: the lesser one counts
        y = right[(inv[right] != inv[x]) & ((inv[right] == main_class) | (v[right] > v[x]))]
        same = sig[y] == sig[x]
        good = same.mean(1) >= least
        if band and good.any():
            good[good] = ~same[good][:, : band * rows].reshape(int(good.sum()), band, rows).all(2).any(1)
        if good.any():
            yield x, y[good]


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    v, comp = (np.array(t[c].to_pylist(), object) for c in ("v", "comp"))
    return v, comp, t["other"].to_numpy(zero_copy_only=False), np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(v), -1)


def _wanted(rows: int, least: float):
    names = [*BLOCK, "v", "other", "comp", "sig"]

    def f(key: tuple, t: pa.Table) -> pa.Table:
        """The rows of a block that have a partner or are one."""
        v, comp, other, sig = _columns(t)
        need = np.zeros(len(v), bool)
        for x, found in _partners(v, comp, other, sig, t["band"][0].as_py(), t["main"][0].as_py(), rows, least):
            need[x] = True
            need[found] = True
        return t.filter(pa.array(need)).select([*names, "band", "main"])

    return f


def _verify(rows: int, least: float, threshold: float):
    def f(t: pa.Table, bag: pa.Table) -> pa.Table:
        """The links of a block that join two classes, by the exact similarity of their bags."""
        out: tuple[list, list] = ([], [])
        joined: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (y := joined.get(x, x)) != x:
                joined[x] = joined.get(y, y)
                x = y
            return x

        if t.num_rows and bag.num_rows:
            items = {v: _items(b) for v, b in zip(bag["own_v"].to_pylist(), bag["bag"].to_pylist(), strict=True)}
            v, comp, other, sig = _columns(t)
            for x, found in _partners(v, comp, other, sig, t["band"][0].as_py(), t["main"][0].as_py(), rows, least):
                for y in found.tolist():
                    if (a := root(comp[x])) != (b := root(comp[y])) and similarity(items[v[x]], items[v[y]]) >= threshold:
                        joined[a] = b
                        out[0].append(v[x])
                        out[1].append(v[y])
        return pa.table([pa.array(x, pa.binary()) for x in out], ["a", "b"])

    return f


def _keyed(docs: DataFrame) -> DataFrame:
    return narrow(docs).withColumn("v", F.unhex(F.md5("raw")))


def _bags(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, bag) of the given nodes (v, doc_id): each is read from its row with the least doc_id."""
    d = F.coalesce("doc_id", F.lit(NULL_ID + 1)).alias("d")
    # by merging at every size; rows that repeat an id and a text lie side by side then, and one of them stays
    found = _keyed(docs).select(d, "v", "raw").join(nodes.select(d, "v").hint("merge"), ["d", "v"], "left_semi").dropDuplicates(["d", "v"])
    return found.select("v", "raw").mapInArrow(_bag_items, "v binary, bag binary")


def _share(rows: Column, size: Column, most_rows: int, most_bytes: int) -> Column:
    """How many parts of bounded rows and bytes there must be."""
    return (F.greatest(F.floor(rows / most_rows), F.floor(size / most_bytes)) + 1).cast("int")


def near_duplicate_links(docs: DataFrame, threshold: float = 0.8, bands: int = 28, rows: int = 5, components_: int = 256, members: int = 256, block: int = 2048, block_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed, roots, links): the nodes of all rows (doc_id, v); (node, root) of those nodes that are linked; the
    verified links (a, b). members, block and block_bytes bound a task's rows and bytes (a longer single text excepted);
    they change no result."""
    margin = 4 * (threshold * (1 - threshold) / components_) ** 0.5
    signed = materialise(_keyed(docs).mapInArrow(_sign(components_), "doc_id long, v binary, sig binary, items long"), "signatures")
    nodes = signed.where("sig is not null").groupBy("v").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("items").alias("items"))
    nodes = materialise(nodes, "nodes")
    band_keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * rows + 1, rows)) for i in range(bands)])
    keyed = nodes.select("v", F.posexplode(band_keys).alias("band", "key"))
    hot = hot_keys(keyed, F.col("key"))
    dealt = salted(keyed, F.col("key"), F.col("v"), hot).repartition("key", "_salt")
    counts = dealt.groupBy("key", "_salt").agg(F.count("*").alias("n")).where("n > 1")
    bucketed = materialise(dealt.join(counts, ["key", "_salt"]).drop("_salt"), "buckets")  # n of a hot bucket: of its part
    # the leader of a bucket: the node whose buckets hold the most
    central = materialise(bucketed.groupBy("v").agg(F.sum("n").alias("degree")).join(nodes.select("v", "doc_id", "items"), "v"), "degrees")
    ranked = materialise(bucketed.select("v", "key").join(central.select("v", "degree"), "v"), "ranked")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("degree", "v")).alias("leader"))
    first = spread_join(ranked, leaders, "key", "v").groupBy("v").agg(F.max("leader").alias("leader")).where("leader.v <> v").select("v", F.col("leader.v").alias("leader"))
    stars = materialise(first.join(central.select("v", "items"), "v"), "stars")
    bag = materialise(_bags(docs, central), "bags")
    salts = materialise(stars.groupBy("leader").agg(_share(F.count("*"), F.sum("items") * 5, members, block_bytes).alias("salts")), "salts")
    member_rows = spread_join(stars, salts, "leader", "v").select("v", "leader", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("is_leader"))
    leader_rows = salts.select(F.col("leader").alias("v"), "leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("is_leader"))
    groups = member_rows.unionByName(leader_rows).join(bag, "v")
    links = materialise(groups.groupBy("leader", "salt").applyInArrow(_star(threshold), "a binary, b binary"), "links")
    roots = components(links)
    # buckets that still hold several classes
    at = materialise(bucketed.select("v", "key", "band").join(roots.withColumnRenamed("node", "v"), "v", "left").join(central.select("v", "items"), "v").select("v", "key", "band", "items", F.coalesce("root", "v").alias("comp")), "classes")
    per_class = at.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("items").alias("items"))
    mixed = per_class.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("items").alias("items"), F.max(F.struct("n", "comp", "items")).alias("largest")).where("classes > 1")
    rest_n, rest_items = F.col("n") - F.col("largest.n"), F.col("items") - F.col("largest.items")
    cuts = mixed.select("key", F.col("largest.comp").alias("main"), _share(rest_n, rest_items * 5, block, block_bytes).alias("outer"), _share(F.col("n"), F.col("items") * 5, block, block_bytes).alias("inner"))
    rest = spread_join(at, materialise(cuts, "mixed"), "key", "v").join(nodes.select("v", "sig"), "v")
    part = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of_all = rest.select("key", every("outer").alias("bo"), part(1, "inner").alias("bi"), "v", F.lit(False).alias("other"), "comp", "sig", "band", "main")
    outside = rest.where("comp <> main").select("key", part(2, "outer").alias("bo"), every("inner").alias("bi"), "v", F.lit(True).alias("other"), "comp", "sig", "band", "main")
    schema = "key long, bo int, bi int, v binary, other boolean, comp binary, sig binary, band int, main binary"
    wanted = materialise(of_all.unionByName(outside).groupBy(*BLOCK).applyInArrow(_wanted(rows, threshold - margin), schema), "wanted")
    asked = [F.col(c).alias(f"own_{c}") for c in [*BLOCK, "v"]]
    bags_of = wanted.select(*asked).distinct().join(bag.withColumnRenamed("v", "own_v"), "own_v").groupBy(*[f"own_{c}" for c in BLOCK])
    more = wanted.groupBy(*BLOCK).cogroup(bags_of).applyInArrow(_verify(rows, threshold - margin, threshold), "a binary, b binary")
    more = materialise(more, "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links)
    return signed.select("doc_id", "v"), roots, links


def _classes(docs: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(signed, classes): (doc_id, v) of every row, and per node v its root, the rows and the links of its class, and
    the class's first row: (none, doc_id, v), those without a doc_id last."""
    signed, roots, links = near_duplicate_links(docs, **kw)
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "v")
    of_v = signed.groupBy("v").agg(F.count("*").alias("n"), F.min(least).alias("first"))
    nodes = materialise(of_v.join(roots.withColumnRenamed("node", "v"), "v", "left").select("v", "n", "first", F.coalesce("root", "v").alias("root")), "class-nodes")
    by_root = nodes.groupBy("root").agg(F.sum("n").alias("class_size"), F.min("first").alias("first"))
    links = links.select(F.least("a", "b").alias("node"), F.greatest("a", "b").alias("b")).distinct()
    linked = spread_join(links, roots, "node", "b").groupBy("root").agg(F.count("*").alias("n_links"))
    by_root = materialise(by_root.join(linked, "root", "left").select("root", "class_size", "first", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "classes")
    return signed, materialise(spread_join(nodes.select("v", "root"), by_root, "root", "v"), "classes-of-nodes")


def near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the row's class), class_size (rows) and n_links (the class's verified
    links between different texts, as many as it takes to connect them or more), a row per row of docs.

    A null text counts as empty; texts without words are in a class only with equal texts. Null doc_ids are never the
    smallest unless a class has no other (then class_id is null). Very long texts are compared whole. An empty table
    gives an empty result; columns other than doc_id and text are not looked at."""
    signed, classes = _classes(docs, **kw)
    return spread_join(signed, classes, "v", "doc_id").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "n_links")


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs, all their columns, that represent their class: one row each, that of the smallest doc_id (a
    null one counts as the largest), of equal ones that of the least MD5 of its text, and of rows that repeat both the
    one whose columns have the least hash. Null, empty and very long texts as in near_duplicates()."""
    _, classes = _classes(docs, **kw)
    d, v, nd, nv, row, own = fresh(docs, "_d", "_v", "_nd", "_nv", "_row", "_own")
    chosen = materialise(classes.where("first.v = v").select(F.col("first.doc_id").alias(d), F.col("v").alias(v)), "chosen")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    marked = docs.select(F.struct(*columns).alias(row), order.alias(own), F.unhex(F.md5(raw)).alias(nv), F.col("doc_id").cast("long").alias(nd))
    kept = marked.join(chosen, (F.col(nv) == F.col(v)) & F.col(nd).eqNullSafe(F.col(d)), "left_semi")
    return kept.groupBy(nv, nd).agg(F.min_by(row, own).alias(row)).select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])
