"""Queries over all of their rows: fixtures whose rows a prefix or a filter would leave out."""

import datetime

from readingforge.plans import queries


def written(df, folder, name):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def normalised(text):
    """The rule, one character at a time."""
    meant = dict(zip("OoQIl|,·•_", "000111....", strict=True))
    t = [c for c in (meant.get(c, c) for c in text or "") if c in "0123456789.-"]
    out, dot = "-" if t[:1] == ["-"] else "", False
    for c in t:
        if c != "-" and not (c == "." and dot):
            out, dot = out + c, dot or c == "."
    return out


def test_normalize_reads_whole_texts(spark, tmp_path):
    rows = [(1, "x" * 400 + "-4l,5.2"), (2, "-7" + " word" * 5000 + " 8,5.1Q-"), (3, None), (4, ""), (5, "_" * 500 + "9"), (6, "é中" * 300 + "O|")]
    written(spark.createDataFrame(rows, "doc_id bigint, text string"), tmp_path, "documents")
    got = {r.doc_id: r.head for r in queries.reading_normalize(spark, str(tmp_path)).collect()}
    assert got == {i: normalised(t) for i, t in rows}


def month(spark, folder):
    """Day d of January 1995 has all cells and one order, 3d if d is a multiple of five (so that it is not
    confirmed) and 3d + 1 if not.  Returns the cells of the patches by order."""
    orders = [(o, o % 8, datetime.date(1995, 1, d)) for d in range(1, 21) for o in [3 * d + (0 if d % 5 == 0 else 1)]]
    written(spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate date"), folder, "orders")
    lines = [(datetime.date(1995, 1, d), p, k, 20.0) for d in range(1, 21) for p in range(8) for k in (1, 2)]
    written(spark.createDataFrame(lines, "l_shipdate date, l_suppkey bigint, l_linenumber int, l_quantity double"), folder, "lineitem")
    return {o: (day.day, cust % 8 + 1, "temperature" if o % 2 == 0 else "humidity") for o, cust, day in orders}


def test_next_day_of_all_confirmed_days(spark, tmp_path):
    done = sorted({d for o, (d, _, _) in month(spark, tmp_path).items() if o % 3})
    got = sorted((r.day, r.next, r.previous) for r in queries.next_day(spark, str(tmp_path)).collect())
    ahead = lambda day: next(d for d in [(day + k - 1) % 31 + 1 for k in range(1, 32)] if d not in done)
    assert got == [(d, ahead(d), max(d - 1, 1)) for d in done] and {d % 2 for d in done} == {0, 1}


def test_every_patch_invalidates_its_day(spark, tmp_path):
    orders = month(spark, tmp_path)
    done = {d for o, (d, _, _) in orders.items() if o % 3}
    touched = {r.day for r in queries.apply_patches(spark, str(tmp_path)).collect() if r.touched}
    # Without the days that only patches of other numbers than multiples of 16 touch, more days were left.
    assert done & {d for o, (d, _, _) in orders.items() if d in touched and o % 16}
    assert {r.day for r in queries.invalidated_days(spark, str(tmp_path)).collect()} == done - touched


def test_labels_of_every_sheet_are_checked(spark, tmp_path):
    """Two sheets; the missing labels are four planted ones and those of a day that one month lacks."""
    cells = {(m, d, p, k) for m in (3, 4) for d in range(1, 32 - (m == 4)) for p in range(1, 9) for k in (1, 2)}
    gone = {(3, 5, 1, 1), (3, 9, 8, 2), (4, 1, 1, 2), (4, 30, 4, 1)}
    lines = [(datetime.date(1995, m, d), p - 1, k, 70.0) for m, d, p, k in sorted(cells - gone)]
    written(spark.createDataFrame(lines, "l_shipdate date, l_suppkey bigint, l_linenumber int, l_quantity double"), tmp_path, "lineitem")
    want = []
    for m in (3, 4):
        for d, p, k in [(d, p, k) for d in range(1, 32) for p in range(1, 9) for k in (1, 2)]:
            kind = "temperature" if k == 2 else "humidity"
            name = f"1995-{m:02}__day_{d:02}_point_{p:02}_{kind}.png"
            mark = 7 * d + 3 * p + m + (k == 2)
            if (m, d, p, k) not in cells - gone:
                want.append((name, "missing"))
            elif mark % 11 == 0 and mark % 13 != 2:
                want.append((name, "value and blank"))
            elif mark % 11 and mark % 13 == 2:
                want.append((name, "no label"))
            elif mark % 11 and (mark % 13 in (0, 1) or kind == "temperature"):
                want.append((name, "invalid value"))
    got = [(r.filename, r.error) for r in queries.label_errors(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {x[0][:7] for x in got} == {"1995-03", "1995-04"}
