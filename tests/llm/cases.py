"""Brute-force versions and edge cases that the tests of this folder share."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rf_file string, rf_row string, id string, size int"
NAMES = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); the further columns clash with names used inside."""
    return spark.createDataFrame([(i, t, g, s, None, "x", "y", "z", 7) for i, t, g, s in rows], SCHEMA)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def edge_rows():
    base = prose(1, 60)
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " more", "en", None), (4, None, None, "a"), (5, "", "en", "b"),
        (None, "a text without id", "en", "b"), (7, " \t\n", "en", "b"), (7, " \t\n", "en", "b"), (8, "one two", "en", None),
        (9, prose(2, 30_000), "en", "c"), (10, base.upper(), "en", "a"), (11, "é ü 中文 字", "en", "a"), (12, "12345 !!", "en", "a"), (None, None, None, None),
    ]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def blank_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))


def shingles(t):
    w = blank_words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(rows):
    """component id of each row by comparing all pairs; nodes are (id, place)."""
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                label[root(i)] = root(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append(min(ids) if ids else None)
    return out, [len(s) for s in sets]


def leak(text, items, window=10):
    """(words, words hit, items) of one text."""
    w = alnum_words(text)
    hit, names = set(), set()
    for name, t in items:
        iw = alnum_words(t)
        for i in range(max(1, len(iw) - window + 1) if iw else 0):
            p = iw[i : i + window]
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)
