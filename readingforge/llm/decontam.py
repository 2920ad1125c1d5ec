"""Benchmark decontamination with a positional inverted index that is spread over segments.

The index: documents are cut into segments of bounded size.  A segment holds its dictionary (the
distinct words in the order of their hashes), for each word the ascending list of its positions, and
the bounds of its documents; it is one row of a Parquet table, so the index is built, stored and
searched without a shuffle.  Numbers are stored as differences in planes of bytes, which compress
well.  Positions number the segment's words, with a gap between documents so that no phrase runs
across one.

The search: phrases go to all segments in blocks of bounded size, with one scan of the index for a
block.  For each phrase, a segment intersects the position lists shifted by the words' offsets, from
the word that is rarest there, and stops at the first empty intersection.  With slop 0 the matches
are exact phrases; with slop s a document matches at a place of it if each word lies up to s words
from where the phrase at that place would have it (proximity).

Defined results: a null text has no words; a benchmark item that is null or without words is
ignored; a null item id counts as the word `null`; repeated rows are documents and items of their
own, but item ids are reported once; empty tables give results without hits; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filed, keep_rows, kept, picked, scratch, settings, small_batches, written
from .textscan import ALNUM, LOWER, parts, same_bytes, slices, text_bytes, word_hashes, words

WINDOW = 10
#: Phrases in a block of the search.
BLOCK_PHRASES = 50_000
#: Bytes of text in a segment, unless one document is longer.
SEGMENT_BYTES = 1 << 20

INDEX = "ids array<bigint>, files array<string>, rows array<bigint>, begins binary, counts binary, seed int, spell binary, spelled binary, lists binary, positions binary"
#: A record of the index is some megabytes, so few are read at once.
SCAN = {"spark.sql.parquet.columnarReaderBatchSize": "8", "spark.sql.execution.arrow.maxRecordsPerBatch": "4"}


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as their differences, all first bytes before all second ones and so on."""
    steps = np.diff(numbers.astype(np.uint32), prepend=np.uint32(0))
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def numbers(data: bytes) -> np.ndarray:
    """What `planes` was given."""
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32).astype(np.int64)


def scan(data: np.ndarray, bounds: np.ndarray):
    """Word starts, ends, first word of each text, hashes, such that equal hashes are equal words."""
    starts, ends, first = words(data, bounds, ALNUM)
    for seed in range(1, 100):
        h = word_hashes(data, starts, ends, seed)
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h) else order
        lengths = ends - starts
        if (lengths[order] == lengths[lead]).all() and same_bytes(data, starts[order], lengths[order], starts[lead]):
            return starts, ends, first, h, order, new, seed
    raise AssertionError("words can't be told apart")


def segment(data: np.ndarray, bounds: np.ndarray) -> dict:
    """The index of some texts (lower-cased bytes)."""
    starts, ends, first, h, order, new, seed = scan(data, bounds)
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    positions = (np.arange(len(h)) + docs)[order].astype(np.uint32)  # a gap of one between documents
    heads = np.flatnonzero(new)
    lead = order[heads]
    spelled = np.concatenate([[0], np.cumsum(ends[lead] - starts[lead])]).astype(np.int64)
    spell = data[np.repeat(starts[lead] - spelled[:-1], np.diff(spelled)) + np.arange(int(spelled[-1]))]
    return {
        "begins": (first[:-1] + np.arange(len(bounds) - 1)).astype(np.uint32).tobytes(), "counts": np.diff(first).astype(np.uint32).tobytes(),
        "seed": seed, "spell": spell.tobytes(), "spelled": planes(spelled), "lists": planes(np.append(heads, len(h))), "positions": planes(positions),
    }


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"ids": pa.list_(pa.int64()), "files": pa.list_(pa.string()), "rows": pa.list_(pa.int64()), "seed": pa.int32()}
    names = [x.strip().split(" ")[0] for x in INDEX.split(",")]
    held, size = [], 0

    def flush():
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, bounds = text_bytes(batch.column("text"))
        for i, j in slices(bounds, SEGMENT_BYTES):
            made = segment(LOWER[data[bounds[i] : bounds[j]]], bounds[i : j + 1] - bounds[i])
            own = batch.slice(i, j - i)
            made |= {n: own.column(c).to_pylist() for n, c in (("ids", "id"), ("files", "rf_file"), ("rows", "rf_row"))}
            yield pa.RecordBatch.from_arrays([pa.array([made[n]], kinds.get(n, pa.binary())) for n in names], names=names)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SEGMENT_BYTES:
            yield from flush()
            held, size = [], 0
    if size and sum(len(b) for b in held):
        yield from flush()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents, written to the shared folder."""
    spark = docs.sparkSession
    rows = picked(docs, id=F.col(id_col).cast("long"), text=F.col(text_col).cast("string"))
    with small_batches(spark), settings(spark, {"spark.sql.parquet.compression.codec": "zstd"}):
        return written(rows.mapInArrow(_build, INDEX), "index")


def split_words(text: str | None) -> list[bytes]:
    """The words of one text."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def phrases(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """The windows of the items, each with the ids of its items."""
    out: dict[tuple[bytes, ...], list[str]] = {}
    for name, text in items:
        w = split_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            own = out.setdefault(tuple(w[i : i + window]), [])
            if name not in own:
                own.append(name)
    return out


class Query:
    """A block of phrases over a vocabulary."""

    def __init__(self, block: list[tuple[tuple[bytes, ...], list[str]]]):
        self.vocab = sorted({w for p, _ in block for w in p})
        at = {w: k for k, w in enumerate(self.vocab)}
        self.phrases = [np.array([at[w] for w in p]) for p, _ in block]
        self.items = [names for _, names in block]
        width = max(map(len, self.phrases))
        self.grid = np.array([np.pad(p, (0, width - len(p)), mode="edge") for p in self.phrases])

    def hashes(self, seed: int) -> np.ndarray:
        data = np.frombuffer(b"".join(self.vocab), np.uint8)
        ends = np.cumsum([len(w) for w in self.vocab])
        return word_hashes(data, ends - [len(w) for w in self.vocab], ends, seed)


def slots(query: Query, seed: int, spell: bytes, spelled: np.ndarray) -> np.ndarray:
    """For each word of the query its place in a segment's dictionary, or -1."""
    wanted = query.hashes(seed)
    if len(spelled) < 2:
        return np.full(len(wanted), -1)
    own = word_hashes(np.frombuffer(spell, np.uint8), spelled[:-1], spelled[1:], seed)
    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
    out = np.where(own[at] == wanted, at, -1)
    for k in np.flatnonzero(out >= 0):  # by bytes
        if spell[spelled[out[k]] : spelled[out[k] + 1]] != query.vocab[k]:
            out[k] = -1
    return out


def occurrences(phrase: np.ndarray, at: np.ndarray, lists: np.ndarray, positions: np.ndarray, slop: int) -> np.ndarray:
    """Positions where the phrase starts; the word with the shortest list comes first."""
    starts, own = None, at[phrase]
    for o in np.argsort(lists[own + 1] - lists[own], kind="stable"):
        s = at[phrase[o]]
        own = positions[lists[s] : lists[s + 1]] - o
        if starts is None:
            starts = np.unique((own[:, None] + np.arange(-slop, slop + 1)).ravel())
            starts = starts[starts >= 0]
        else:
            low = np.searchsorted(own, starts - slop)
            near = own[np.minimum(low, len(own) - 1)]
            starts = starts[(low < len(own)) & (near <= starts + slop)]
        if not len(starts):
            break
    return starts


def _search(shared, slop: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    query = shared.value
    for batch in parts(batches, 1):
        for row in batch.to_pylist():
            counts, begins = np.frombuffer(row["counts"], np.uint32).astype(np.int64), np.frombuffer(row["begins"], np.uint32).astype(np.int64)
            lists, positions = numbers(row["lists"]), numbers(row["positions"])
            at = slots(query, row["seed"], row["spell"], numbers(row["spelled"]))
            names: list[set] = [set() for _ in counts]
            spans: list[list] = [[] for _ in counts]
            for k in np.flatnonzero((at[query.grid] >= 0).all(axis=1)):
                found = occurrences(query.phrases[k], at, lists, positions, slop)
                if not len(found):
                    continue
                n = len(query.phrases[k])
                # Empty documents share a place; the last document that begins there holds the words.
                owner = np.searchsorted(begins, found, "right") - 1
                begin, end = begins[owner], begins[owner] + counts[owner]
                if slop:
                    inside = _within(query.phrases[k], at, lists, positions, found, slop, begin, end)
                else:
                    inside = found + n <= end
                low, high = np.maximum(found - slop, begin), np.minimum(found + n + slop, end)
                for d, a, b in zip(owner[inside], low[inside] - begins[owner[inside]], high[inside] - begins[owner[inside]], strict=True):
                    names[d].update(query.items[k])
                    spans[d].append((int(a), int(b)))
            yield pa.RecordBatch.from_arrays([
                pa.array(row["ids"], pa.int64()), pa.array(row["files"], pa.string()), pa.array(row["rows"], pa.int64()), pa.array(counts, pa.int64()),
                pa.array([merged(s) for s in spans], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(s) for s in names], pa.list_(pa.string())),
            ], names=["id", "rf_file", "rf_row", "n_words", "spans", "items"])


def _within(phrase, at, lists, positions, found, slop, begin, end) -> np.ndarray:
    """Which sloppy starts lie in a document that has all the words near them."""
    ok = found < end
    for o, w in enumerate(phrase):
        own = positions[lists[at[w]] : lists[at[w] + 1]]
        k = np.searchsorted(own, np.maximum(found + o - slop, begin))
        ok &= (k < len(own)) & (own[np.minimum(k, len(own) - 1)] <= np.minimum(found + o + slop, end - 1))
    return ok


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """The union of intervals as disjoint intervals in order."""
    out: list[list[int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_MATCH = "id bigint, rf_file string, rf_row bigint, n_words bigint, spans array<array<bigint>>, items array<string>"

#: The union of intervals that several blocks of phrases found, as SQL over the sorted `spans`.
_UNION = """aggregate(array_sort(flatten(spans)), cast(array() as array<array<bigint>>), (held, x) ->
  case when size(held) > 0 and x[0] <= element_at(held, -1)[1]
       then concat(slice(held, 1, size(held) - 1), array(array(element_at(held, -1)[0], greatest(element_at(held, -1)[1], x[1]))))
       else concat(held, array(x)) end)"""


def search(index: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per document: id, n_words, spans (disjoint word intervals inside occurrences), items (ids
    of the items with an occurrence), rf_file, rf_row."""
    spark = index.sparkSession
    found, count = None, 0
    for block in blocks(benchmark, id_col, text_col, window):
        hits = index.mapInArrow(partial(_search, spark.sparkContext.broadcast(Query(block)), slop), _MATCH)
        found = hits if found is None else found.unionByName(hits)
        count += 1
    if found is None:
        empty = F.expr("cast(array() as array<array<bigint>>)")
        docs = index.select(F.expr("explode(arrays_zip(ids, files, rows, sequence(1, size(ids)))) as d"), "counts")
        n = F.conv(F.expr("hex(reverse(substring(counts, 4 * d.`3` - 3, 4)))"), 16, 10).cast("bigint")
        found = docs.select(F.col("d.ids").alias("id"), F.col("d.files").alias("rf_file"), F.col("d.rows").alias("rf_row"), n.alias("n_words"), empty.alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    if count > 1:
        found = found.groupBy("rf_file", "rf_row").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        ).withColumn("spans", F.expr(_UNION)).select("id", "rf_file", "rf_row", "n_words", "spans", "items")
    with settings(spark, SCAN):
        return written(found, "matches")


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[list]:
    """The benchmark's phrases in blocks, read one partition of the benchmark at a time."""
    held: dict[tuple[bytes, ...], list[str]] = {}
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("string").alias("t"))
    for r in items.toLocalIterator():
        for p, names in phrases([(r.i, r.t)], window).items():
            own = held.setdefault(p, [])
            own.extend(n for n in names if n not in own)
        if len(held) >= BLOCK_PHRASES:
            yield list(held.items())
            held = {}
    if held:
        yield list(held.items())


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", slop: int = 0) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items, contaminated, rf_file, rf_row."""
    with scratch(docs.sparkSession):  # the index goes once the matches are written
        found = search(build_index(docs, id_col, text_col), benchmark, slop=slop)
        kept(found)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s[1] - s[0])
    return found.select("id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.size("items") > 0).alias("contaminated"), "rf_file", "rf_row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without a passage of the benchmark, with its columns."""
    docs = filed(docs)
    with scratch(docs.sparkSession):
        gone = written(decontaminate(docs, benchmark, id_col, text_col).filter("contaminated").select("rf_file", "rf_row"), "contaminated")
        kept(gone)
    return keep_rows(docs, gone, "left_anti")
