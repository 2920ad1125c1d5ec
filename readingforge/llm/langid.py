"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (one to three symbols; letters in lower case,
each word between two word bounds), ranked by count.  A document's profile is compared with each
language's by out-of-place distance: the sum of the rank differences, where an n-gram that the
language lacks counts as the full length of a profile.  The nearest language wins.

Defined results: null texts and texts without letters are `und` with score 0, and so are all
texts where nothing could be learned; ties go to the first language in order; a null id counts as
the empty text, by which it is held out; rows that repeat are rows of their own; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches
from .textscan import U, parts, slices, text_bytes

#: n-grams in a profile.
PROFILE = 300
#: Documents that a language is learned from, about: the bound of the training sample.
TRAIN_DOCS = 1500
#: Symbols: 0 word bound, 1 a letter that no profile has, then the letters of the profiles.  Bits of
#: a symbol, if that is enough for the letters.
SYMBOL_BITS = 10
#: Characters of a text that is counted in one go; longer ones are counted in pieces.
LONG = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str], codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one stream of symbols, each text begun by a word bound and the stream ended by
    one, and the place where each text begins.  Without `codes`, letters are code points."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([0] + [len(t) for t in low])
    is_letter = letters()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of other characters is the bound
    value = np.where(is_letter, points if codes is None else codes[points], 0).astype(np.uint64)
    kept = np.concatenate([[0], np.cumsum(keep)])[ends]
    begins = kept[:-1] + np.arange(len(texts))
    stream = np.zeros(int(kept[-1]) + len(texts) + 1, np.uint64)
    place = np.ones(len(stream), bool)
    place[begins] = False
    place[-1] = False
    stream[place] = value[keep]
    return stream, begins


def grams(stream: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and codes of the n-grams: of one letter, of two symbols not both bounds, of three
    symbols without a bound in the middle."""
    b = U(bits)
    one = np.flatnonzero(stream)
    two = np.flatnonzero((stream[:-1] > 0) | (stream[1:] > 0))
    three = np.flatnonzero((stream[1:-1] > 0) & ((stream[:-2] > 0) | (stream[2:] > 0)))
    # A one in the top place tells lengths apart where a bound would vanish.
    codes = [stream[one] << (b + b), (stream[two] << b) | stream[two + 1], (stream[three] << (b + b)) | (stream[three + 1] << b) | stream[three + 2]]
    marks = [U(0), U(1), U(2)]
    return np.concatenate([one, two, three]), np.concatenate([(c << U(2)) | m for c, m in zip(codes, marks, strict=True)])


#: While learning, symbols are code points, squeezed into 20 bits: letters beyond take part as one.
_WIDE = 20


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            stream, _ = symbols([t or "" for t, own in zip(texts, langs, strict=True) if own == lang], None)
            _, codes = grams(np.minimum(stream, U((1 << _WIDE) - 1)), _WIDE)
            code, count = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(count, pa.int64())], names=["lang", "code", "n"])


class Profiles:
    """The languages' profiles over a small alphabet."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        mask = (1 << _WIDE) - 1
        parts = {c: ((c >> 2) >> (2 * _WIDE) & mask, (c >> 2) >> _WIDE & mask, (c >> 2) & mask) for _, c, _ in rows}
        alphabet = sorted({s for p in parts.values() for s in p if s})
        self.bits = max(SYMBOL_BITS, (len(alphabet) + 1).bit_length())
        self.codes = np.ones(0x110000, np.uint16 if self.bits <= 16 else np.uint32)
        self.codes[alphabet] = np.arange(2, len(alphabet) + 2)
        small = {s: k + 2 for k, s in enumerate(alphabet)} | {0: 0}
        table: dict[int, np.ndarray] = {}
        for lang, c, rank in rows:
            a, b, d = (small.get(s, 1) for s in parts[c])
            code = (a << 2 * self.bits | b << self.bits | d) << 2 | c & 3
            table.setdefault(code, np.full(len(self.langs), -1))[self.langs.index(lang)] = rank
        self.known = np.array(sorted(table), np.uint64)
        self.ranks = np.array([table[int(c)] for c in self.known]) if table else np.zeros((0, 0))

    def distances(self, texts: list[str], length: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: its distance to each language and the largest it could have; 0 for no letters."""
        code_bits = U(3 * self.bits + 2)
        room = 1 << (64 - int(code_bits))  # documents that have a number beside a code
        if len(texts) > room:
            parts = [self.distances(texts[i : i + room], length) for i in range(0, len(texts), room)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if len(texts) == 1 and len(texts[0]) > LONG:
            low, counts = self.long_counts(texts[0])
            d = np.zeros(len(low), np.uint64)
        else:
            stream, begins = symbols(texts, self.codes)
            at, codes = grams(stream, self.bits)
            doc = np.searchsorted(begins, at, "right").astype(np.uint64) - U(1)
            keys = np.sort((doc << code_bits) | codes)
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            heads = np.flatnonzero(new)
            counts = np.diff(np.append(heads, len(keys)))
            keys = keys[heads]
            # By document, count from high to low, code; the document's bits lie above both.
            low = keys & ((U(1) << code_bits) - U(1))
            d = keys >> code_bits
        order = np.lexsort((-counts, d))  # stable: codes ascend where both are equal
        d, low = d[order].astype(np.int64), low[order]
        rank = np.arange(len(d)) - np.searchsorted(d, d)
        top = rank < length
        d, low, rank = d[top], low[top], rank[top]
        best = np.zeros((len(texts), len(self.langs)))
        k = np.minimum(np.searchsorted(self.known, low), len(self.known) - 1)
        found = self.known[k] == low
        for j in range(len(self.langs)):
            own = np.where(found, self.ranks[k, j], -1)
            best[:, j] = np.bincount(d, np.where(own >= 0, np.abs(rank - own), length), len(texts))
        return best, np.bincount(d, minlength=len(texts)) * length

    def long_counts(self, text: str, piece: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of one long text and their counts, a piece at a time; no piece cuts a word."""
        codes, counts, a, piece = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, piece or LONG
        while a < len(text):
            b = min(len(text), a + piece)
            while b < len(text) and text[b].isalpha():
                b += 1
            _, own = grams(symbols([text[a:b]], self.codes)[0], self.bits)
            new, n = np.unique(own, return_counts=True)
            codes, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(codes)).astype(np.int64)
            a = b
        return codes, counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        far, most = self.distances(texts)
        at = far.argmin(axis=1)
        score = np.where(most > 0, 1 - far.min(axis=1) / np.maximum(most, 1), 0.0)
        return [self.langs[k] if m else "und" for k, m in zip(at, most, strict=True)], np.clip(score, 0, 1)


def held_out(doc_id: Column) -> Column:
    """One document in five is kept from training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def bounded_sample(labelled: DataFrame, label: str, key: Column, bound: int) -> DataFrame:
    """About `bound` rows of each label (a class or a language, so few), chosen by a hash of `key`."""
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == value, min(1.0, bound / n)).otherwise(share)
    return labelled.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share * (1 << 20))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = TRAIN_DOCS) -> Profiles:
    """The profiles of all languages of a bounded sample of the labelled documents that aren't held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = bounded_sample(rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"))), "lang", F.col("id"), bound)
    counts = rows.select("text", "lang").mapInArrow(_learn, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")) - 1
    top = counts.withColumn("rank", place).filter(F.col("rank") < PROFILE)
    with small_batches(docs.sparkSession):
        return Profiles([(r.lang, r.code, r.rank) for r in top.select("lang", "code", "rank").collect()])


def _predictions(profiles: Profiles, column: pa.Array) -> tuple[list[str], list[float]]:
    names: list[str] = []
    scores: list[float] = []
    _, bounds = text_bytes(column)
    texts = column.to_pylist()
    for i, j in slices(bounds):
        got, score = profiles.predict([t or "" for t in texts[i:j]])
        names += got
        scores += score.tolist()
    return names, scores


def _predict(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        names, scores = _predictions(shared.value, batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred, score (1 less the distance's share of the largest possible)."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_predict, shared), "id bigint, held_out boolean, lang_pred string, score double")


def _label(shared, text: int, lang: int, wanted: set[str] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        names, _ = _predictions(shared.value, batch.column(text).cast(pa.string()))
        own = batch.column(lang)
        filled = pc.coalesce(own, pa.array(names, pa.string()).cast(own.type))
        named = pa.array([n != "und" and (wanted is None or n in wanted) for n in names], pa.bool_())
        yield batch.set_column(lang, batch.schema.field(lang), filled).filter(named)


def label_languages(docs: DataFrame, profiles: Profiles, wanted: set[str] | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text is in one of the `wanted` languages (in any that was learned, if None), with
    the columns of `docs`; where `lang_col` is null it gets the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    at = docs.columns.index
    return docs.mapInArrow(partial(_label, shared, at(text_col), at(lang_col), wanted), docs.schema)
