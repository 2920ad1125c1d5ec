"""Token counts with a digest cache.

The digest of the normalised text and the digest of the tokenizer's version (its file) are the
key of a stored table of counts.  Documents are joined to it; of the digests that it lacks, one
document each is encoded, and the new counts are appended.

Counts are those of the library that reads the vocabulary file (tokenizers for .json,
sentencepiece for .model), without added tokens.  Where `ranks` gives the same byte-level
vocabulary as tiktoken ranks, texts whose characters all libraries class alike are counted by
tiktoken, which gives the same numbers faster; others, and those with a special token's string,
always go to the first library.

Defined results: a null text counts as empty, an empty text has no tokens; equal texts are encoded
once, whatever their ids; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_checked, picked, shared_path, small_batches, written

#: The pre-tokenizer pattern of byte-level BPE vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters beyond these are left to the reference library: Unicode versions may class them differently.
_UNUSUAL = re.compile("[^\x00-ɏ]")
#: Texts longer than this go to the reference library.
_LONG = 1 << 20

COUNTS = "digest binary, n_tokens bigint"


@lru_cache(maxsize=4)
def counter(path: str, ranks: str | None = None) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, made once in each Python worker."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()

    def plain(texts: list[str]) -> list[int]:
        return [len(x) for x in slow.encode_batch_fast(texts, add_special_tokens=False)]

    if not ranks:
        return plain
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def count(text: str) -> int:
        if len(text) > _LONG or _UNUSUAL.search(text) or any(s in text for s in special):
            return plain([text])[0]
        return len(fast.encode_ordinary(text))

    return lambda texts: [count(t) for t in texts]


def version(path: str) -> str:
    """The digest of a tokenizer's file, which names its part of the cache."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(path: str, ranks: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = counter(path, ranks)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary()), pa.array(count(texts), pa.int64())], names=["digest", "n_tokens"])


def cached(spark: SparkSession, cache_dir: str, tokenizer: str) -> DataFrame:
    """The stored counts of one tokenizer version; a count that two runs appended is one."""
    try:
        held = spark.read.schema(COUNTS).parquet(f"{cache_dir}/version={tokenizer}")
    except AnalysisException:
        return spark.createDataFrame([], COUNTS)
    return held.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, ranks: str | None = None, cache_dir: str | None = None, normalise=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens."""
    spark = docs.sparkSession
    cache_dir, own = cache_dir or shared_path(spark, "token-cache"), version(path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = picked(docs, id=F.col(id_col).cast("long"), text=normalise(text) if normalise else text)
    digests = written(rows.select("id", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), "rf_file", "rf_row"), "digests")
    misses = digests.groupBy("digest").agg(F.min(F.struct("rf_file", "rf_row")).alias("one")).join(cached(spark, cache_dir, own), "digest", "left_anti")
    wanted = written(misses.select("one.rf_file", "one.rf_row"), "misses")
    n, n_wanted = digests.count(), wanted.count()
    if n_wanted:
        if n - n_wanted <= min(n_wanted, BROADCAST_ROWS):
            # Fewer rows to leave out than to take.
            rest = written(digests.select("rf_file", "rf_row").join(wanted, ["rf_file", "rf_row"], "left_anti"), "hits")
            todo = join_checked(rows, rest, ["rf_file", "rf_row"], "left_anti")
        else:
            todo = join_checked(rows, wanted, ["rf_file", "rf_row"], "left_semi")
        with small_batches(spark):
            todo.select("text").mapInArrow(partial(_encode, path, ranks), COUNTS).write.mode("append").parquet(f"{cache_dir}/version={own}")
    # Written first, so that the join can split a digest that many rows have.
    counts = written(cached(spark, cache_dir, own).join(digests.select("digest").distinct(), "digest", "left_semi"), "counts")
    return digests.join(counts, "digest").select("id", "n_bytes", "n_tokens")
