"""Repeated passages that no span starting inside them covers."""

import time
from random import Random

from ledgerspark.llm import spans


def left(spark, rows):
    return {r.doc_id: r.text.strip() for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_one_long_sentence(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    got = left(spark, [(1, f"First neighbour here.\n{passage}\nAnd one after."), (2, f"Another neighbour there.\n{passage}\nSomething else follows."), (3, " ".join(passage.split()[:49]))])
    assert got[1].count(passage) == 1 and got[2] == "Another neighbour there.\nSomething else follows." and len(got[3].split()) == 49


def test_short_last_sentences(spark):
    passage = "This passage opens with a sentence that has rather more than sixteen words in it, so the spans from it end soon. Then one that is of middling length stands here too. Short one. The end."
    got = left(spark, [(1, f"Before it. {passage} Mine follows."), (2, f"Ahead of it. {passage} Yours is another.")])
    assert got[1].endswith("The end. Mine follows.") and got[2] == "Ahead of it. Yours is another."


def test_other_marks():
    assert [len(spans.sentences(t)) for t in ("पहला वाक्य। दूसरा वाक्य॥ तीसरा", "هل هذا؟ نعم", "یہ ہے۔ اور")] == [3, 2, 2]


def naive_sentences(text):
    """Sentences character by character: closing marks before white space, or a line's end, with the white space after."""
    marks, closing, out, k, begin = ".!?…。！？।॥؟۔", "\"'”’)]", [], 0, 0
    while k < len(text):
        if text[k] == "\n":
            end = k + 1
        elif text[k] in marks:
            end = k
            while end < len(text) and text[end] in marks:
                end += 1
            after = end
            while end < len(text) and text[end] in closing:
                end += 1
            if end < len(text) and not text[end].isspace():
                k = after
                continue
        else:
            k += 1
            continue
        while end < len(text) and text[end].isspace():
            end += 1
        out.append(text[begin:end])
        begin = k = end
    return out + [text[begin:]] * (begin < len(text))


def brute(rows):
    """{(doc_id, text): numbers of removed sentences} by comparing all spans as lists of words."""
    found = {}
    for i, text in dict.fromkeys(rows):
        words = [s.split() for s in naive_sentences(text or "")]
        n = len(words)
        size = lambda j, k: sum(map(len, words[j:k]))  # noqa: B023, E731
        spans = set()
        for j in range(n):
            spans |= {(j, k) for k in range(j + 2, n + 1) if size(j, k) >= 16 and (k == j + 2 or size(j, k - 1) < 16)}
            spans |= {(j, k) for k in range(j + 2, n + 1) if size(j, k) >= 16 and (k == j + 2 or size(j + 1, k) < 16)}
            if len(words[j]) >= 50:
                spans.add((j, j + 1))
        for j, k in spans:
            if words[j]:
                found.setdefault(tuple(w for s in words[j:k] for w in s), []).append(((i is None, i or 0), (i, text), j, k - j))
    gone = {}
    for places in found.values():
        places.sort(key=lambda x: (x[0], x[1][1], x[2], x[3]))
        for _, row, j, n in places[1:]:
            gone.setdefault(row, set()).update(range(j, j + n))
    return gone


def test_against_all_spans(spark):
    random = Random(4)
    word = lambda: random.choice("abcdefgh") + str(random.randrange(40))
    sentence = lambda: " ".join(word() for _ in range(random.randint(1, 12))) + random.choice([". ", ".\n", "? ", "...\n\n", '." ', "\n"])
    shared = ["".join(sentence() for _ in range(random.randint(2, 6))) for _ in range(8)] + [" ".join(word() for _ in range(55)) + ".\n"]
    rows = []
    for k in range(60):
        parts = [sentence() for _ in range(random.randint(0, 8))]
        for _ in range(random.randint(0, 2)):
            parts.insert(random.randint(0, len(parts)), random.choice(shared))
        rows.append((k, "".join(parts)))
    rows += [(100, rows[0][1] + shared[0]), (101, rows[0][1] + shared[0]), (101, rows[0][1] + shared[0]), (102, None), (103, ""), (104, " \n\n . \n"), (105, shared[1] + shared[1]), (None, shared[2]), (106, "w " * 200_000), (107, "." * 100_000 + "x"), (108, "x" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS `row`", "2 AS `key`", "3 AS spans").repartition(3)
    want = brute(rows)
    got = spans.dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        assert set(r.removed) == want.get((r.doc_id, text), set()), r.doc_id
        parts = naive_sentences(text or "")
        assert r.text == (text if not r.removed else "".join(p for j, p in enumerate(parts) if j not in set(r.removed)))
        assert r.n_sentences == len(parts) and r.n_removed == len(r.removed)
    assert spans.dedup(docs.where("false")).count() == 0


def test_marks_take_linear_time():
    began = time.process_time()
    for text in ("." * 300_000, "." * 300_000 + "x", '."' * 200_000, "x" * 1_000_000, " \n" * 200_000, "a. " * 200_000):
        assert "".join(spans.sentences(text)) == text
    assert time.process_time() - began < 5
