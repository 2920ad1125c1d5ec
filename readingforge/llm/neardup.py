"""Near-duplicate groups by circulant MinHash.

A document's set is its distinct five-word shingles as 64-bit hashes.  Two permutations make all
coordinates of its signature: the first (`mix64`, cut to a ring of 2**32 places) breaks the order
of the shingles, the second is applied to the ring shifted by 1, 2, ... places, and the smallest
value under each shift is one coordinate.  Four coordinates make a band.  Documents with equal
sets are one class; classes that share a band are candidates, and a pair is linked only if the
full sets have 100 * intersection >= 75 * union.

Buckets are settled in steps; only components are returned, so pairs within one need no comparison.
1. Every bucket's members are compared with one leader, which then leaves the bucket.
2. Buckets of few members that still hold several components: their pairs across components.
3. The others, which may be huge: shingles are counted among the classes that are left.  A class can
   be linked only through shingles that others have too, so most classes leave.  The rest are
   compared with one more leader, the one with the fewest rare shingles.
4. What is left is settled exactly by those counts: a pair can be linked only if the frequent
   shingles of both alone are enough, and such pairs are compared within their buckets, in salted
   blocks; or if it shares a rare shingle among the first of each set in the order of rarity (a
   prefix filter), and a rare shingle has few owners.
Before full sets are compared, a pair's signatures are: at similarity 0.75 fewer than AGREE of
the 128 coordinates agree with probability 2e-7.

Defined results: null and empty texts and texts without words have an empty set, stay and are
linked with nothing; a text of fewer than five words has one shingle, all of it; equal texts are
one class, whatever their ids; a null id is higher than any other as a component's smallest id;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filed, join_checked, keep_rows, kept, picked, scratch, small_batches, written
from .textscan import LOWER, NOT_BLANK, SCAN_BYTES, U, mix64, pieces, slices, text_bytes, word_hashes, words

SHINGLE, PERCENT = 5, 75
BANDS, BAND_ROWS = 32, 4
#: Coordinates that agree between the signatures of a pair whose full sets are compared, at least.
AGREE = 70
#: Members of a bucket whose pairs are listed, at most, and that one task pairs with as many others.
FEW, BLOCK = 16, 256
#: Open classes that have a rare shingle, at most.
RARE = 32

#: Multipliers of the second permutation (the 32-bit finaliser of MurmurHash3).
M1, M2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


_ODD = [U(0x9E3779B97F4A7C15 + 2 * 0xD1B54A32D192ED03 * (k + 1) & (2**64 - 1)) for k in range(64)]


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` word hashes."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    full = h[: len(h) - size + 1] * _ODD[0]
    for k in range(1, size):
        full = mix64(full) + h[k : len(h) - size + 1 + k] * _ODD[k]
    return mix64(full)


def _short(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text of few words."""
    one = np.zeros(min(1, len(h)), np.uint64)
    for k in range(len(h)):
        one = mix64(one + U(len(h))) + h[k : k + 1] * _ODD[k]
    return mix64(one) if len(h) else one


def _hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends, first = words(data, bounds, NOT_BLANK)
    return word_hashes(data, starts, ends), first


def long_set(data: np.ndarray, size: int = SHINGLE, piece: int = SCAN_BYTES) -> np.ndarray:
    """The set of one long text, a piece at a time: beside the set itself, memory is that of a piece."""
    held, sets, kept = np.zeros(0, np.uint64), [], 0
    for part in pieces(data, NOT_BLANK, piece):
        h = np.concatenate([held, _hashes(part, np.array([0, len(part)]))[0]])
        sets.append(np.unique(_rolled(h, size)))
        held = h[max(0, len(h) - size + 1) :]
        kept += len(sets[-1])
        if kept > 4 * len(sets[0]) + (1 << 20):  # repeats of earlier pieces go now and then
            sets = [np.unique(np.concatenate(sets))]
            kept = 0
    out = np.unique(np.concatenate(sets)) if sets else held
    return out if len(out) else _short(held)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    if len(bounds) == 2 and len(data) > SCAN_BYTES:
        return [long_set(data, size)]
    h, first = _hashes(data, bounds)
    full, out = _rolled(h, size), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(full[a : b - size + 1]) if b - a >= size else _short(h[a:b]))
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """The circulant MinHash coordinates of non-empty sets: one row for each set."""
    cuts = np.cumsum([0] + [len(s) for s in sets])
    ring = (mix64(np.concatenate(sets)) >> U(32)).astype(np.uint32)
    out = np.empty((len(sets), coordinates), np.uint32)
    y, t = np.empty_like(ring), np.empty_like(ring)
    for k in range(coordinates):
        np.subtract(ring, np.uint32(k), out=y)
        for shift, factor in ((16, M1), (13, M2)):
            np.right_shift(y, np.uint32(shift), out=t)
            np.bitwise_xor(y, t, out=y)
            np.multiply(y, factor, out=y)
        np.right_shift(y, np.uint32(16), out=t)
        np.bitwise_xor(y, t, out=y)
        out[:, k] = np.minimum.reduceat(y, cuts[:-1])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), U(b + 1))
        for r in range(rows):
            key = mix64(key + signature[:, b * rows + r])
        out[:, b] = key
    return out.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        for i, j in slices(bounds):
            sets = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            full = [k for k, s in enumerate(sets) if len(s)]
            bands: list = [[] for _ in sets]
            if full:
                keys = band_keys(signatures([sets[k] for k in full], BANDS * BAND_ROWS), BANDS, BAND_ROWS)
                for k, row in zip(full, keys, strict=True):
                    bands[k] = row
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("rf_file"), part.column("rf_row"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ], names=["id", "rf_file", "rf_row", "n", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        for i, j in slices(bounds):
            sets = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            marks = signatures(sets, BANDS * BAND_ROWS).view(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.slice(i, j - i).column("cid"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array(list(marks), pa.list_(pa.int32())),
            ], names=["cid", "members", "marks"])


def _with_both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The pairs (a, b) with sa and sb, the `column` of either."""
    ends = written(pairs.select(F.col("a").alias("cid")).distinct().union(pairs.select("b").distinct()).distinct(), "ends")
    own = join_checked(sets.select("cid", column), ends, ["cid"], "left_semi")
    side = lambda end: own.select(F.col("cid").alias(end), F.col(column).alias(f"s{end}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; `sets` has cid, members, marks."""
    pairs = written(pairs.distinct(), "pairs")
    agreeing = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    close = written(_with_both(pairs, sets, "marks").filter(agreeing >= AGREE).select("a", "b"), "close")
    both = F.size(F.array_intersect("sa", "sb"))
    return written(_with_both(close, sets, "members").filter(
        100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label for the nodes of `edges` (a, b): label is the smallest node reachable.  Each
    round takes the smallest label among the neighbours and then the label's own label."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        low = labels.join(near, "node").select("node", F.least("label", "other").alias("label"), F.col("label").alias("was"))
        step = written(low, name)
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = written(step.join(jump, "label", "left").select(
            "node", F.least("label", F.coalesce("further", "label")).alias("label"), "was"), name)
        changed = step.filter("label <> was").limit(1).count()
        labels = step.select("node", "label")
        labels.rf_path = step.rf_path
        if not changed:
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """`labels` (node, label) of all linked nodes once the `links` (a, b) are added; only components
    that a link joins are worked on."""
    if labels is None:
        return components(links)
    at = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
    ends = written(links.join(at("a"), "a", "left").join(at("b"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")), "joined")
    moved = components(ends.filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    new = ends.select(F.col("a").alias("node")).distinct().union(ends.select("b").distinct()).distinct().join(labels, "node", "left_anti")
    every = labels.select("node", "label").unionByName(new.select("node", F.col("node").alias("label")))
    return written(every.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def _may_link(x: str, y: str, most: str):
    """Whether sizes allow a link, if the intersection has at most the `most` of either class."""
    both = F.least(f"{x}.{most}", f"{y}.{most}")
    return 100 * both >= PERCENT * (F.col(f"{x}.n") + F.col(f"{y}.n") - both)


def _mixed(members: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    keys = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    return written(members.join(written(keys, "open-keys"), "key", "left_semi"), "open")


def _relabelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    new = labels.select(F.col("node").alias("cid"), F.col("label").alias("to"))
    return written(members.join(new, "cid", "left").withColumn("label", F.coalesce("to", "label")).drop("to"), "marked")


def _stars(left: DataFrame, most: str, *order) -> tuple[DataFrame, DataFrame]:
    """Pairs of each bucket's first member by `order` with its others, and the members without it."""
    first = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "cid", "n", "label", *([most] if most != "n" else [])))
    leader = written(left.groupBy("key").agg(first.alias("y")), "leaders")
    star = left.alias("x").join(leader, "key")
    pairs = star.filter((F.col("x.label") != F.col("y.label")) & _may_link("x", "y", most))
    return pairs.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")), star.filter("x.cid <> y.cid").drop("y")


def _few(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of different components in buckets of at most FEW members, and the members of the others."""
    sizes = written(left.groupBy("key").agg(F.count(F.lit(1)).alias("k")), "sizes")
    few = left.join(sizes.filter(F.col("k") <= FEW).select("key"), "key", "left_semi")
    apart = (F.col("x.cid") < F.col("y.cid")) & (F.col("x.label") != F.col("y.label"))
    pairs = few.alias("x").join(few.alias("y"), "key").filter(apart & _may_link("x", "y", "n")).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    return pairs, left.join(sizes.filter(F.col("k") > FEW).select("key"), "key", "left_semi")


def _counted(left: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`left` with common (shingles of a class that another class left
    has too) and frequent (those that many have), without classes that can be linked with none; and
    for each class its rare shingles, rarest first.  The counts stay bounds while more classes leave."""
    classes = written(left.select("cid").distinct(), "classes-left")
    shingles = join_checked(sets.select("cid", "members"), classes, ["cid"], "left_semi").select("cid", F.explode("members").alias("s"))
    shared = written(shingles.groupBy("s").agg(F.count(F.lit(1)).alias("owners")).filter("owners > 1"), "shared-shingles")
    rare = F.when(F.col("owners") <= RARE, F.struct("owners", "s"))
    facts = written(shingles.join(shared, "s").groupBy("cid").agg(
        F.count(F.lit(1)).alias("common"), F.count_if(F.col("owners") > RARE).alias("frequent"), F.sort_array(F.collect_list(rare)).alias("rare")), "facts")
    left = left.join(facts.select("cid", "common", "frequent"), "cid").filter(100 * F.col("common") >= PERCENT * F.col("n"))
    return _mixed(written(left, "counted")), facts


def _rest(left: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (a, b) of open members that may still be linked."""
    able = left.filter(100 * F.col("frequent") >= PERCENT * F.col("n"))
    in_key = written(able.groupBy("key").agg(F.count(F.lit(1)).alias("in_key")), "able-keys")
    able = written(able.join(able.groupBy("cid").agg(F.collect_set("key").alias("keys")), "cid").join(in_key, "key"), "able")
    blocks = F.ceil(F.col("in_key") / BLOCK).cast("int")
    once = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("key")  # a pair is met in one of its buckets
    one = able.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    two = able.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    apart = (F.col("x.cid") < F.col("y.cid")) & (F.col("x.label") != F.col("y.label"))
    ends = [F.col("x.cid").alias("a"), F.col("y.cid").alias("b")]
    by_frequent = one.alias("x").join(two.alias("y"), ["key", "block"]).filter(apart & _may_link("x", "y", "frequent") & once).select(*ends)
    # A pair that frequent shingles don't suffice for shares so many rare ones at least.
    least = F.greatest(F.lit(1), F.ceil(F.lit(PERCENT) * F.col("n") / 100) - F.col("frequent"))
    classes = left.select("cid", "n", "label", "common", "frequent").distinct().join(facts.select("cid", "rare"), "cid")
    firsts = F.filter("rare", lambda r, i: i < F.size("rare") - least + 1)
    prefix = written(classes.select("cid", "n", "label", "common", F.explode(firsts).alias("r")).select("cid", "n", "label", "common", "r.s"), "prefixes")
    by_rare = prefix.alias("x").join(prefix.alias("y"), "s").filter(apart & _may_link("x", "y", "common")).select(*ends)
    return by_frequent.unionByName(by_rare)


def _settled(members: DataFrame, sets: DataFrame) -> DataFrame:
    """node, label of all linked classes; `members` has key, cid, n."""
    left, labels, facts = members.withColumn("label", F.col("cid")), None, None
    for step in range(4):
        if step == 0:
            pairs, rest = _stars(left, "n", F.xxhash64("cid"))
        elif step == 1:
            pairs, rest = _few(left)
        elif step == 2:
            left, facts = _counted(left, sets)
            pairs, rest = _stars(left, "common", F.col("n") - F.col("frequent"), F.xxhash64("cid"))
        else:
            pairs, rest = _rest(left, facts), None
        labels = merged(labels, linked(pairs, sets))
        if rest is None:
            break
        left = _mixed(_relabelled(rest, labels))
        if not left.limit(1).count():
            break
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, first (whether the row is the one of its component
    that stays), rf_file, rf_row."""
    rows = picked(docs, id=F.col(id_col).cast("long"), text=F.col(text_col).cast("string"))
    with scratch(docs.sparkSession), small_batches(docs.sparkSession):
        sketch = written(rows.select("id", "text", "rf_file", "rf_row").mapInArrow(
            _sketch, "id bigint, rf_file string, rf_row bigint, n bigint, digest binary, bands array<bigint>"), "sketch")
        # Nulls last: a struct with a flag first orders them so.
        place = F.struct(F.col("id").isNull().alias("no_id"), "id", "rf_file", "rf_row")
        classes = written(sketch.filter("n > 0").groupBy("digest", "n").agg(F.min(place).alias("place"), F.first("bands").alias("bands")).withColumn(
            "cid", F.monotonically_increasing_id()), "classes")
        banded = classes.select(F.explode("bands").alias("key"), "cid", "n")
        # Small tables are written before a join by key, so that the join can split a hot bucket.
        shared = written(banded.groupBy("key").agg(F.count(F.lit(1)).alias("in_key")).filter("in_key > 1").select("key"), "buckets")
        members = written(banded.join(shared, "key"), "members")
        chosen = written(classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "place.rf_file", "place.rf_row"), "candidates")
        sets = written(join_checked(rows.select("text", "rf_file", "rf_row"), chosen, ["rf_file", "rf_row"], "inner").select("cid", "text").mapInArrow(
            _sets, "cid bigint, members array<bigint>, marks array<int>"), "sets")
        labels = _settled(members, sets)
        ends = labels.select(F.col("node").alias("cid"), "label")
        lowest = written(ends.join(classes.select("cid", "place"), "cid").groupBy("label").agg(F.min("place").alias("lowest")), "lowest")
        named = classes.select("digest", "n", "place", "cid").join(ends.join(lowest, "label").select("cid", "lowest"), "cid", "left")
        named = named.select("digest", "n", F.coalesce("lowest", "place").alias("lowest"))
        kept(sketch, classes, labels, lowest)
    out = sketch.select("id", "n", "digest", "rf_file", "rf_row").join(named, ["digest", "n"], "left")
    out = out.withColumn("lowest", F.coalesce("lowest", place))
    return out.select(
        "id", F.col("n").alias("n_shingles"), F.col("lowest.id").alias("component_id"),
        ((F.col("lowest.rf_file") == F.col("rf_file")) & (F.col("lowest.rf_row") == F.col("rf_row"))).alias("first"), "rf_file", "rf_row",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that with the smallest id, with the columns of `docs`."""
    docs = filed(docs)
    with scratch(docs.sparkSession):
        gone = written(near_duplicates(docs, id_col, text_col).filter("NOT first").select("rf_file", "rf_row"), "near-copies")
        kept(gone)
    return keep_rows(docs, gone, "left_anti")
