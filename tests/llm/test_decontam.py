"""Decontamination against alignment of every item with every text, by plain dynamic programming."""

from collections import Counter
from random import Random

import pytest
from ledgerspark.llm import decontam

DOC = "doc_id long, text string, hits long, `row` long, found string"


def normal(text):
    """Lower case, letters and digits, one blank between words: by hand."""
    out = []
    for c in (text or "").lower():
        if c.isalnum():
            out.append(c)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out).strip(" ")


def fewest_edits(item, text):
    """Fewest edits that turn item into a stretch of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def brute(rows, items):
    out = Counter()
    for i, t in rows:
        a, hits = normal(t), []
        for k, x in items:
            b = normal(x)
            if len(b) < 8:
                if b and a == b:
                    hits.append((k, 0))
            elif len(a) >= 8:
                e = fewest_edits(b, a)
                if e <= min(len(b) // 10, (len(b) - 8) // 8):
                    hits.append((k, e))
        hits.sort(key=lambda h: (h[0] is not None, h[0] or 0, h[1]))
        out[i, bool(hits), tuple(k for k, _ in hits), tuple(e for _, e in hits)] += 1
    return out


@pytest.mark.parametrize("pass_chars", [1_000_000, 400])
def test_against_all_alignments(spark, pass_chars):
    random = Random(11)
    words = ["river", "stone", "of", "the", "quick", "seven", "night", "a", "boiling", "salts", "engine", "é", "n0", "42"]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            k = random.randrange(len(t))
            random.choice([lambda: t.pop(k), lambda: t.insert(k, "z"), lambda: t.__setitem__(k, "Q")])()  # noqa: B023
        return "".join(t)

    items = [(k, text(random.randint(2, 25))) for k in range(25)] + [(30, None), (31, ""), (32, "tiny"), (33, " ?! "), (34, "la la la la la la la la la la la"), (3, "same id, other words here"), (5, None), (None, "an item without an id stands here"), (7, "The quick seven, of the NIGHT!"), (7, "The quick seven, of the NIGHT!")]
    rows = []
    for k in range(70):
        x = random.choice(items)[1] or ""
        rows.append((k, f"{text(random.randint(0, 8))}, {edited(x, random.randint(0, 8)) if x else x} {text(random.randint(0, 8))}"))
    rows += [(100, None), (101, ""), (102, "Tiny!"), (103, "tiny one"), (104, "la " * 40), (105, items[0][1][: len(items[0][1]) // 2]), (106, items[0][1]), (106, items[0][1]), (None, items[1][1]), (107, text(300) + items[2][1].upper().replace(" ", " -- "))]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], DOC).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench, pass_chars=pass_chars).collect()
    want = brute(rows, items)
    assert Counter((r.doc_id, r.contaminated, tuple(r.item_ids), tuple(r.edits)) for r in got) == want
    kept = decontam.clean(docs, bench, pass_chars=pass_chars)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: n for (i, bad, _, _), n in want.items() if not bad})


def test_empty_benchmark_and_long_text(spark):
    docs = spark.createDataFrame([(1, "some text that is clean", 1, 2, "x"), (2, "w" * 1_000_000, 1, 2, "x"), (3, "la " * 300_000, 1, 2, "x")], DOC)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontam.contamination(docs, none).collect()} == {False}
    assert decontam.clean(docs, none).count() == 3
    some = spark.createDataFrame([(1, "la la la la la la la la la la la la la la")], "item_id long, text string")
    assert {r.doc_id for r in decontam.contamination(docs, some).where("contaminated").collect()} == {3}
    assert decontam.clean(docs.where("false"), some).count() == 0
