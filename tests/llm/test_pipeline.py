import collections

import corpus_pipeline
from readingforge.llm import langid

from . import cases


def write(spark, tmp_path, rows, items):
    cases.docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")


def test_pipeline_against_brute_force(spark, tmp_path):
    item = cases.prose(77, 25)
    rows = cases.edge_rows() + [(100 + k, cases.prose(500 + k, 30 + k), "en", f"s{k % 3}") for k in range(30)]
    rows += [(200, cases.prose(1, 5) + " " + item, "en", "s1"), (201, cases.prose(500, 30) + " tail", "en", "s1")]
    write(spark, tmp_path, rows, [(1, item)])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    last = {}
    for r in left:
        if r[1] not in last or (r[0] or -1) > (last[r[1]][0] or -1):
            last[r[1]] = r
    left = [r for r in left if last[r[1]] is r]
    near, _ = cases.near_groups(left)
    left = [r for r, c in zip(left, near) if r[0] == c or r[0] is None]
    left = [r for r in left if not cases.leak(r[1], [(1, item)])[1]]
    assert set(got) <= {r[0] for r in left}
    sizes = collections.Counter()
    for r in left:
        sizes[r[3]] += len(cases.blank_words(r[1]))
    for r in left:
        if r[0] in got:
            assert got[r[0]].size == len(cases.blank_words(r[1])) and got[r[0]].source_size == sizes[r[3]] and 0 < got[r[0]].taken <= 3 * got[r[0]].size
    for s, n in sizes.items():
        own = [x for x in got.values() if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= max(2, 0.02 * own[0].target)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    write(spark, tmp_path, cases.edge_rows(), [(1, cases.prose(77, 25))])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "benchmark_leaks", "mix"]
    assert langid.learn(docs).langs == ["en"]
