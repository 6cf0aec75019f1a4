"""Line dedup against edit distances of all pairs, hot lines, and the rows that dedup() leaves."""

from collections import Counter
from itertools import combinations
from random import Random

from ledgerspark.llm import line_edit

KIND = "doc_id long, text string, id long, `row` long, gone string, _id long"


def docs_of(spark, rows):
    """Further columns have names that the operator uses inside."""
    return spark.createDataFrame([(i, t, 7, 8, "x", 9) for i, t in rows], KIND).repartition(3)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(rows):
    """Rows as near_lines() gives them, without the last column."""
    seen = {x.strip() for _, t in rows for x in (t or "").split("\n") if x.strip()}
    budget = lambda n: 2 if n >= 20 else 1 if n >= 8 else 0
    near = [(a, b) for a, b in combinations(sorted(seen), 2) if abs(len(a) - len(b)) <= 2 and distance(a, b) <= budget(min(len(a), len(b)))]
    ids = {x: line_edit.line_id(x) for x in seen}
    up = {x: x for x in seen}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        up[find(a)] = find(b)
    root = {x: min(ids[y] for y in seen if find(y) == find(x)) for x in seen}
    n = Counter(x for link in near for x in link)
    out, first = [], {}
    for i, t in dict.fromkeys(rows):
        for k, x in enumerate((t or "").split("\n")):
            if x.strip():
                x = x.strip()
                out.append((i, k, ids[x], root[x], n[x]))
                place = (i is None, i or 0, k)
                first[root[x]] = min(first.get(root[x], place), place)
    copies = Counter(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    want = Counter()
    for i, k, x, c, links in out:
        want[i, k, x, c, links, (i is None, i or 0, k) == first[c]] += copies[i, texts[i]]
    return want


def test_all_pairs(spark):
    random = Random(9)
    base = ["".join(random.choice("abcdefgh ") for _ in range(random.randint(6, 45))).strip() or "x" for _ in range(40)]
    lines = list(base)
    for x in base:
        for edits in (1, 2, 3):
            y = list(x)
            for _ in range(edits):
                k = random.randrange(len(y))
                random.choice([lambda: y.pop(k), lambda: y.insert(k, "z"), lambda: y.__setitem__(k, "é")])() if len(y) > 1 else None  # noqa: B023
            lines.append("".join(y).strip())
    rows = [(k, "\n".join(random.sample(lines, 6) + ["", "short", "\t "])) for k in range(60)] + [(90, None), (91, ""), (92, " \n\n "), (None, lines[0]), (5000, lines[3]), (5000, lines[3])]
    got = Counter((r.doc_id, r.line_no, r.line_id, r.class_id, r.n_links, r.kept) for r in line_edit.near_lines(docs_of(spark, rows)).collect())
    assert got == brute(rows)


def test_repeated_id_with_other_text(spark):
    rows = [(1, "the same line of text in both rows\nfirst has one more"), (1, "the same line of text in both rows")]
    got = line_edit.near_lines(docs_of(spark, rows)).where("kept").collect()
    assert len(got) == 2 and len({r.line_id for r in got}) == 2


def test_hot_line_has_its_keys_once(spark):
    hot = "a line of boilerplate that stands in every document"
    rows = [(k, f"{hot}\nline of its own, with the number {k:05d} in words {k * 7919}") for k in range(3000)]
    docs = docs_of(spark, rows)
    found = line_edit.occurrences(docs.selectExpr("1L AS `row`", "doc_id", "text"))
    keyed = line_edit.line_keys(docs, found).collect()
    assert len(keyed) == 3001 and len({r.id for r in keyed}) == 3001
    assert sum(r.id == line_edit.line_id(hot) for r in keyed) == 1


def test_dedup(spark):
    long = "w" * 1_000_000
    rows = [(1, f"first line of the page here\n\n{long}"), (2, f"First line of the page here\nown words in the second\n{long}x\n"), (3, None), (4, ""), (5, "first line of the page here"), (None, "own words in the second!")]
    got = {r.doc_id: r.text for r in line_edit.dedup(docs_of(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "own words in the second\n", 3: None, 4: "", 5: "", None: ""}
    out = line_edit.dedup(docs_of(spark, rows))
    assert out.columns == docs_of(spark, rows).columns and out.count() == len(rows)


def test_cuts_of_any_place_find_what_is_near():
    """Any cut into edits + 1 segments serves, not only an even one: a window of the longer line equals a segment of the shorter."""
    random = Random(4)
    for _ in range(3000):
        edits, a = random.choice([1, 2]), "".join(random.choice("ab1") for _ in range(random.randint(6, 14)))
        b = list(a)
        for _ in range(random.randint(0, edits)):
            k = random.randrange(len(b))
            random.choice([lambda: b.pop(k), lambda: b.insert(k, "z"), lambda: b.__setitem__(k, "y")])()  # noqa: B023
        short, long = sorted(["".join(b), a], key=len)
        ends = [0, *sorted(random.sample(range(1, len(short)), edits)), len(short)]
        parts = [(x, y - x) for x, y in zip(ends, ends[1:])]
        assert any(long[at : at + n] == short[parts[g][0] :][:n] for g, at, n in line_edit.windows(len(long), len(short), edits, parts))


def test_cuts_lie_where_lines_differ():
    lines = [f"{'same words at the start ' * 3}{k * 2654435761 % 2**32:08x}{' and at the end' * 4}" for k in range(64)]
    (_, first), (at, size), _ = line_edit.cuts(lines, 2)
    assert 72 < first < 77 and 76 <= at + size < 80
    assert line_edit.cuts(["abc"] * 3, 2) == [(0, 1), (1, 1), (2, 1)] and line_edit.cuts(["ab"], 2) == line_edit.segments(2, 2)


def test_hot_segments_against_all_pairs(spark, monkeypatch):
    """Lines of one layout share two hot segments; near pairs of every kind are still found, through every depth."""
    monkeypatch.setattr(line_edit, "HOT", 3)
    random = Random(6)
    lines = []
    for k in range(150):
        code = "".join(random.choice("01") for _ in range(7))
        lines.append(f"request {code} was answered in {random.randint(1, 3)} ms")
        if k % 5 == 0:
            lines.append(random.choice([lines[-1][:-1], "x" + lines[-1], lines[-1].replace("was", "is"), lines[-1].replace("answered", "answerd")]))
    rows = [(k, x) for k, x in enumerate(lines)]
    got = Counter((r.doc_id, r.line_no, r.line_id, r.class_id, r.n_links, r.kept) for r in line_edit.near_lines(docs_of(spark, rows)).collect())
    assert got == brute(rows)


def test_candidates_of_a_hot_layout_grow_with_the_lines(spark):
    """Lines that differ in 16 hex digits only: none are near, and twice the lines are not four times the candidates."""
    counts = []
    for n in (4000, 8000):
        random = Random(2)
        docs = docs_of(spark, [(k, f"GET /api/v1/items/{random.getrandbits(64):016x} answered with status 200 in time") for k in range(n)])
        keyed = line_edit.line_keys(docs, line_edit.occurrences(docs.selectExpr("1L AS `row`", "doc_id", "text")))
        counts.append(line_edit.candidates(docs, keyed).count())
    assert counts[1] <= 100, counts
