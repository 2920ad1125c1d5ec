"""Secret scans: a random forest removes false positives among candidates, in DataFrame
expressions and Spark's own forest only.

A candidate is a run of at least twelve letters, digits and signs of encodings that has a digit (or begins as a key id does); the
whole run is the candidate, however long it is.
Its features: length, character transitions (changes between kinds of characters, distinct
characters, shares of digits and capitals, hexadecimal or not), dictionary coverage (the share of
its characters in common words), path (whether the document's path speaks of tests or examples),
and the neighbouring words (whether they speak of secrets, or of things that look like them).  A
neighbour is the word that ends one to four signs before the candidate, or begins as close after
it, on the same line, and isn't part of another candidate.

`train` takes labelled findings as a table; `sample_findings` makes some by rule, for corpora that
have none.

Defined results: null and empty texts have no candidates; the path may be null; candidates that
repeat are findings of their own, numbered in each row; repeated rows are rows of their own; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=AKIA[A-Z]{16}|[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}"
#: The word just before a candidate, at the end of what precedes it, and the one just after.  No word
#: that means anything here has more than NEAR letters, so longer ones are none.
NEAR = 32
BEFORE = rf"(?<![A-Za-z_])([A-Za-z_]{{1,{NEAR}}})[^A-Za-z0-9\n]{{1,4}}\z"
AFTER = rf"\A[^A-Za-z0-9\n]{{1,4}}([A-Za-z_]{{1,{NEAR}}})(?![A-Za-z_])"

# Words near secrets, words near values that look like secrets, signs of test
# paths, and common words and parts of identifiers.
SECRET_WORDS = ["token", "secret", "password", "passwd", "pwd", "key", "api_key", "apikey", "access_key", "auth", "bearer", "credential", "credentials", "private_key", "client_secret"]
HARMLESS_WORDS = ["sha", "sha1", "sha256", "md5", "checksum", "digest", "commit", "revision", "hash", "uuid", "guid", "id", "version", "example", "sample", "card", "phone", "account", "order", "ref", "build", "integrity", "etag"]
TEST_PATHS = ["test", "example", "sample", "fixture", "mock", "demo"]
COMMON = ["version", "configuration", "config", "example", "sample", "test", "your", "here", "token", "secret", "password", "change", "default", "value", "name", "user", "admin", "server", "client", "service", "http", "https", "index", "page", "image", "data", "file", "file", "path", "node", "item", "list", "time", "date", "january", "february", "model", "release", "build", "report", "number", "section", "chapter", "figure", "table", "class", "type", "string", "color", "button", "header", "footer", "content", "placeholder", "insert", "dummy", "temp", "xxxx", "0000", "1234", "abcd"]

FEATURES = ["length", "changes", "distinct", "digits", "capitals", "hexadecimal", "covered", "test_path", "near_secret", "near_harmless"]
TREES, DEPTH, THRESHOLD = 20, 6, 0.5
#: Labelled findings of the built-in sample: the bound of what the forest is fitted on.
SAMPLE = 3000


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def featured(findings: DataFrame) -> DataFrame:
    """`findings` (candidate, before, after, path) with the features."""
    c = F.col("candidate")
    n = F.length(c)
    kinds = F.translate(c, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    low = F.lower(c)
    near = [F.lower(F.coalesce(F.col(k), F.lit(""))) for k in ("before", "after")]
    path = F.lower(F.coalesce(F.col("path"), F.lit("")))
    return findings.withColumns({
        "length": n.cast("double"),
        # A run of one kind is one character once its repeats are gone.
        "changes": _ratio(F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1, n - 1),
        "distinct": _ratio(F.size(F.array_distinct(F.split(c, ""))), n),
        "digits": _ratio(F.length(F.regexp_replace(c, "[^0-9]", "")), n),
        "capitals": _ratio(F.length(F.regexp_replace(c, "[^A-Z]", "")), n),
        "hexadecimal": c.rlike("^[0-9a-f]+$").cast("double"),
        "covered": _ratio(n - F.length(F.regexp_replace(low, "|".join(sorted(set(COMMON), key=lambda w: (-len(w), w))), "")), n),
        "test_path": path.rlike("|".join(TEST_PATHS)).cast("double"),
        "near_secret": near[0].isin(SECRET_WORDS).cast("double"),
        "near_harmless": (near[0].isin(HARMLESS_WORDS) | near[1].isin(HARMLESS_WORDS)).cast("double"),
    })


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Per candidate: id, n (its number in the row), candidate, before, after, path."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        (F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")).alias("path"),
    ).filter(F.col("text").rlike("[0-9]|AKIA"))
    found = rows.withColumn("candidates", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).filter(F.size("candidates") > 0)
    # What lies between the candidates: one part more than they are.  Its ends hold the neighbours.
    gaps, reach = F.split("text", CANDIDATE, -1), NEAR + 5
    tail = lambda g: F.nullif(F.regexp_extract(F.right(g, F.lit(reach)), BEFORE, 1), F.lit(""))
    head = lambda g: F.nullif(F.regexp_extract(F.left(g, F.lit(reach)), AFTER, 1), F.lit(""))
    found = found.select("id", "path", "candidates", gaps.alias("gaps"))
    listed = F.transform("candidates", lambda c, i: F.struct(c.alias("candidate"), tail(F.get("gaps", i)).alias("before"), head(F.get("gaps", i + 1)).alias("after")))
    return found.select("id", "path", F.posexplode(listed).alias("n", "f")).select(
        "id", F.col("n").cast("long").alias("n"), F.col("f.candidate").alias("candidate"), F.col("f.before").alias("before"), F.col("f.after").alias("after"), "path")


def sample_findings(spark: SparkSession, n: int = SAMPLE) -> DataFrame:
    """Labelled findings made by rule: candidate, before, after, path, label."""
    h = lambda k: F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{k}")))
    pick = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int"))
    base64 = F.regexp_replace(F.base64(F.unhex(F.concat(h(1), h(2)))), "[^A-Za-z0-9]", "")
    some = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(22)).cast("int")
    kinds = [
        # secrets
        (F.substr(F.concat(h(1), h(2)), F.lit(1), some + 18), pick(SECRET_WORDS, 4), 1),
        (F.concat(F.lit("AKIA"), F.substr(F.upper(base64), F.lit(1), F.lit(16))), pick(["", "with", "the", *SECRET_WORDS], 4), 1),
        (F.substr(base64, F.lit(1), some + 18), pick(["", "is", *SECRET_WORDS], 4), 1),
        (F.concat(F.lit("ghp_"), F.substr(base64, F.lit(1), F.lit(36))), pick(["", "use", *SECRET_WORDS], 4), 1),
        # what looks like them
        (F.concat(h(1), F.substr(h(2), F.lit(1), some)), pick(HARMLESS_WORDS, 4), 0),
        (F.concat_ws("_", pick(COMMON, 5), pick(COMMON, 6), pick(COMMON, 7), F.pmod("id", F.lit(100)).cast("string")), pick(["", "the", "of", *SECRET_WORDS], 4), 0),
        (F.concat(F.lit("4"), F.regexp_replace(F.translate(h(1), "abcdef", "012345"), "^(.{15}).*", "$1")), pick(["", "the", "and", "card"], 4), 0),
        (F.regexp_replace(h(1), "^(.{8})(.{4})(.{4})(.{4})(.*)$", "$1-$2-$3-$4-$5"), pick(["", "uuid", "id", "guid"], 4), 0),
        (F.concat(F.lit("20"), F.substr(F.translate(h(1), "abcdef", "012012"), F.lit(1), F.lit(2)), F.lit("-01-02/"), pick(COMMON, 5), F.lit("-1")), pick(["", "on", "see"], 4), 0),
        (F.concat(F.repeat(pick(["x", "0", "a", "1"], 5), some + 12), F.lit("0")), pick(["", *SECRET_WORDS], 4), 0),
    ]
    out = F.lit(None)
    for k, (candidate, before, label) in enumerate(kinds):
        one = F.struct(candidate.alias("candidate"), before.alias("before"), F.lit(label).cast("double").alias("label"))
        out = one if k == 0 else F.when(F.pmod("id", F.lit(len(kinds))) == k, one).otherwise(out)
    rows = spark.range(0, n, 1, 4).withColumn("f", out)
    return rows.select("f.candidate", "f.before", pick(["", "the", "of", "is"], 8).alias("after"), pick(["src0", "src1", "tests", "main"], 9).alias("path"), "f.label")


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """The forest of labelled findings (candidate, before, after, path, label 0 or 1), which must be
    bounded, as `sample_findings` is."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(findings))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=5, labelCol="label").fit(rows.select("features", "label"))


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Per candidate: id, n, candidate, before, after, path, score, is_secret."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(candidates(docs, id_col, text_col, path_col)))
    score = vector_to_array(F.col("probability"))[1]
    return model.transform(rows).select("id", "n", "candidate", "before", "after", "path", score.alias("score"), (score >= THRESHOLD).alias("is_secret"))
