import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from readingforge.llm import decontam, exact_dedup, mixing, neardup
from readingforge.llm.common import shared_path, written

from . import cases


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_exact_dedup_of_edge_rows(spark):
    got = exact_dedup.exact_dedup(cases.docs(spark, cases.edge_rows())).collect()
    texts = [t or "" for _, t, _, _ in cases.edge_rows()]
    ids = [i for i, *_ in cases.edge_rows()]
    want = collections.Counter()
    for i, t in zip(ids, texts):
        own = [j for j, u in zip(ids, texts) if u == t]
        want[(i, max((j for j in own if j is not None), default=None), len(own), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert collections.Counter((r.id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got) == want
    kept = collections.Counter(bytes(r.digest) for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(set(texts))


def test_exact_dedup_tells_clashing_digests_apart(spark):
    docs = cases.docs(spark, [(1, "a", "en", "s"), (2, "b", "en", "s"), (3, "a", "en", "s"), (4, "cc", "en", "s")])
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, digest=weak).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True)}


def weak(text):
    """A digest that texts of one length share."""
    return F.encode(F.length(text).cast("string"), "UTF-8")


def test_exact_dedup_state_grows_over_calls(spark):
    path = shared_path(spark, "test-state")
    call = lambda *rows: {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(cases.docs(spark, [(i, t, "en", "s") for i, t in rows]), state_dir=path, files_per_batch=1).collect()}
    assert call((1, "x"), (2, "y")) == {1: (1, 1, True), 2: (2, 1, True)}
    assert call((3, "x")) == {3: (3, 2, True)}
    assert call((4, "z"), (0, "y")) == {4: (4, 1, True), 0: (2, 2, False)}
    # The same rows again change nothing.
    assert call((4, "z"), (0, "y")) == {4: (4, 1, True), 0: (2, 2, False)}
    assert call((1, "x"), (2, "y")) == {1: (3, 2, False), 2: (2, 2, True)}


def test_exact_dedup_compares_bytes_across_calls(spark):
    path = shared_path(spark, "test-clash")
    call = lambda *rows: {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(cases.docs(spark, [(i, t, "en", "s") for i, t in rows]), digest=weak, state_dir=path).collect()}
    assert call((1, "a"), (9, "long")) == {1: (1, 1, True), 9: (9, 1, True)}
    assert call((2, "b"), (3, "c"), (4, "b")) == {2: (4, 2, False), 3: (3, 1, True), 4: (4, 2, True)}
    assert call((5, "c"), (6, "a"), (7, "d"), (8, None)) == {5: (5, 2, True), 6: (6, 2, True), 7: (7, 1, True), 8: (8, 1, True)}


def test_a_batch_lands_once(spark):
    path = shared_path(spark, "test-batch")
    docs = cases.docs(spark, [(1, "x", "en", "s"), (2, "x", "en", "s")])
    for _ in range(2):
        got = exact_dedup.exact_dedup(docs, state_dir=path, batch="monday").collect()
        assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 2, 2, False), (2, 2, 2, True)]
    got = exact_dedup.exact_dedup(docs, state_dir=path, batch="tuesday").collect()
    assert {r.group_size for r in got} == {4} and sum(r.kept for r in got) <= 1


@pytest.mark.parametrize("step", [exact_dedup.drop_copies, neardup.drop_near_duplicates])
def test_filters_return_the_columns_of_documents(spark, step):
    docs = cases.docs(spark, cases.edge_rows())
    out = step(docs)
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    assert cases.edge_rows()[9][1] in texts
    assert step(docs.limit(0)).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rows = cases.edge_rows()
    for k in range(12):
        words = cases.prose(5, 200).split()
        for i in range(k):
            words[15 * i + 3] = f"new{k}-{i}"
        rows.append((100 - k, " ".join(words), "en", "s"))
    rows += [(200 + k, cases.prose(5, 200) + " " + cases.prose(50 + k, 20 + 12 * k), "en", "s") for k in range(10)]
    want, sizes = cases.near_groups(rows)
    got = neardup.near_duplicates(cases.docs(spark, rows)).collect()
    assert collections.Counter((r.id, r.component_id, r.n_shingles) for r in got) == collections.Counter((r[0], w, n) for r, w, n in zip(rows, want, sizes))


def test_near_duplicates_in_a_bucket_of_several_groups(spark):
    """A passage that many texts share makes candidates that aren't linked; no link gets lost."""
    shared = cases.prose(9, 120)
    rows = [(k, shared + " " + cases.prose(1000 + k // 3, 45) + f" end{k}", "en", "s") for k in range(60)]
    want, _ = cases.near_groups(rows)
    got = {r.id: r.component_id for r in neardup.near_duplicates(cases.docs(spark, rows)).collect()}
    assert got == {r[0]: w for r, w in zip(rows, want)}


def test_signatures_estimate_similarity():
    import numpy as np

    r = np.random.Generator(np.random.PCG64(3))
    x = r.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[500:2500])
    s = neardup.signatures([a, b], 512)
    assert abs((s[0] == s[1]).mean() - 1500 / 2500) < 0.07


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 101), (103, 101)], "a bigint, b bigint")
    got = dict(rows_of(neardup.components(edges)))
    assert got == {k: 0 for k in range(n + 1)} | {100: 100, 101: 100, 103: 100}


ITEMS = [(1, cases.prose(77, 25)), (2, "alpha1 beta2"), (3, None), (4, " !"), (10, cases.prose(78, 12)), (10, cases.prose(78, 12))]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")


def leaking_rows():
    p = ITEMS[0][1]
    cut = " ".join(p.split()[3:15])
    return cases.edge_rows() + [
        (50, cases.prose(3, 30) + " " + p.upper() + ", " + cases.prose(4, 5), "en", "s"), (51, "pre " + cut.replace(" ", "; "), "en", "s"),
        (52, " ".join(p.split()[:9]), "en", "s"), (53, "x Alpha1--BETA2 alpha1 beta2", "en", "s"), (54, cases.prose(78, 12), "en", "s"), (55, " ".join(p.split()[:5]), "en", "s"),
        (56, " ".join(p.split()[5:10]), "en", "s"),
    ]


@pytest.mark.parametrize("size", [50_000, 3])
def test_decontamination_against_plain_search(spark, monkeypatch, size):
    monkeypatch.setattr(decontam, "BLOCK_PHRASES", size)
    rows = leaking_rows()
    got = decontam.decontaminate(cases.docs(spark, rows), benchmark(spark)).collect()
    want = collections.Counter((i, *map(str, cases.leak(t, ITEMS))) for i, t, _, _ in rows)
    assert collections.Counter((r.id, str(r.n_words), str(r.n_hit), str(r["items"])) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)


def test_decontamination_without_items_or_documents(spark):
    docs = cases.docs(spark, leaking_rows())
    got = decontam.decontaminate(docs, benchmark(spark, [(3, None)])).collect()
    assert collections.Counter((r.id, r.n_words) for r in got) == collections.Counter((i, len(cases.alnum_words(t))) for i, t, _, _ in leaking_rows())
    assert not any(r.contaminated for r in got)
    assert decontam.decontaminate(docs.limit(0), benchmark(spark)).count() == 0
    assert decontam.drop_contaminated(docs, benchmark(spark)).columns == docs.columns


def test_planes_of_numbers():
    import numpy as np

    for x in ([], [0], [7, 3, 2**32 - 1, 0, 5], list(range(100_000))):
        assert decontam.numbers(decontam.planes(np.array(x, np.int64))).tolist() == x


def test_settings_and_scopes_are_the_callers(spark):
    """Operators leave the session as it was, and threads don't remove each other's tables."""
    import os
    import threading

    from readingforge.llm.common import scratch

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = cases.docs(spark, cases.edge_rows())
    decontam.decontaminate(docs, benchmark(spark)).count()
    neardup.near_duplicates(docs).count()
    assert spark.conf.get(name) == before
    made = {}
    opened, done = threading.Event(), threading.Event()

    def other():
        with scratch(spark):
            opened.set()
            done.wait(60)

    thread = threading.Thread(target=other)
    with scratch(spark):
        thread.start()
        opened.wait(60)
        made["own"] = written(spark.range(2), "own").rf_path.removeprefix("file:")
        done.set()
        thread.join()
        assert os.path.isdir(made["own"].replace("//", "/"))
    assert not os.path.exists(made["own"].replace("//", "/"))


def test_rows_of_limits_and_samples_are_written(spark, tmp_path):
    from readingforge.llm.common import filed

    spark.range(100).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    assert filed(t) is t and not hasattr(filed(t.filter("id > 3").select("id")), "rf_path")
    for odd in (t.limit(5), t.filter(F.rand() < 0.5), t.sample(0.5), t.union(t), t.withColumn("x", F.rand())):
        assert hasattr(filed(odd), "rf_path")


def test_sides_beyond_the_bounds_are_joined_by_shuffles(spark, monkeypatch):
    """Without a broadcast everything is as with one."""
    from readingforge.llm import common

    rows = cases.edge_rows() + [(100 + k, cases.prose(5, 60) + f" end{k}", "en", "s") for k in range(6)]
    docs = cases.docs(spark, rows)
    runs = lambda: [sorted(map(str, df.collect())) for df in (
        neardup.near_duplicates(docs).select("id", "n_shingles", "component_id"), exact_dedup.exact_dedup(docs).select("id", "keep_id", "group_size"), exact_dedup.drop_copies(docs).select("doc_id"),
        neardup.drop_near_duplicates(docs).select("doc_id"), decontam.drop_contaminated(docs, benchmark(spark)).select("doc_id"))]
    small = runs()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert runs() == small


def test_proximity_matches(spark):
    items = [(1, "red green blue white")]
    rows = [(1, "red green blue white", "en", "s"), (2, "red green x blue white", "en", "s"), (3, "green red blue white", "en", "s"), (4, "red x y z green blue white", "en", "s"), (5, "red green", "en", "s"), (6, "blue white", "en", "s")]
    index = decontam.build_index(cases.docs(spark, rows))
    near = lambda slop: {r.id for r in decontam.search(index, benchmark(spark, items), slop=slop).collect() if r["items"]}
    assert near(0) == {1} and near(1) == {1, 2, 3} and 4 in near(3) and not {5, 6} & near(3)


def test_mix_meets_targets(spark):
    rows = cases.edge_rows() + [(1000 + k, cases.prose(k, 5 + k % 37), "en", f"s{k % 5}") for k in range(600)]
    got = mixing.mix(cases.docs(spark, rows)).collect()
    assert collections.Counter((r.id, r.source, r.size) for r in got) == collections.Counter((i, s, len(cases.blank_words(t))) for i, t, _, s in rows)
    sizes, targets, taken = collections.Counter(), {}, collections.Counter()
    for r in got:
        sizes[r.source] += r.size
        targets[r.source] = r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert all(r.source_size == sizes[r.source] for r in got)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    want, free = {}, set(order)
    while True:
        rest = sum(sizes.values()) - sum(want.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        want |= {s: 3 * sizes[s] for s in over}
        free -= over
    want |= share
    for s in order:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - targets[s]) <= max(2, 0.02 * targets[s])
    again = mixing.mix(cases.docs(spark, rows[::-1]).repartition(3)).collect()
    unique = collections.Counter(i for i, *_ in rows)
    assert {r.id: r.taken for r in got if unique[r.id] == 1} == {r.id: r.taken for r in again if unique[r.id] == 1}


def test_mix_of_nothing(spark):
    assert mixing.mix(cases.docs(spark, [])).count() == 0
    got = mixing.mix(cases.docs(spark, [(1, None, None, None), (2, "", None, "a")])).collect()
    assert {(r.id, r.size, r.target, r.taken) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_apportionment_gives_highest_quotients(spark):
    shares = [53.0, 24.0, 23.0, 1.0, 0.0]
    for seats in (0, 1, 5, 10, 101):
        rows = spark.createDataFrame([(k, x, seats) for k, x in enumerate(shares)], "k int, share double, seats bigint")
        got = {r.k: r.quota for r in mixing.apportion(rows, [], "share", "seats", [F.col("k")]).collect()}
        ranked = sorted(((-x / (2 * j + 1), k) for k, x in enumerate(shares) if x for j in range(seats)))[:seats]
        assert got == {k: sum(1 for _, i in ranked if i == k) for k in range(len(shares))}


def test_written_tables_survive(spark):
    df = written(spark.range(3).withColumn("x", F.lit("a")), "t")
    assert df.count() == 3
