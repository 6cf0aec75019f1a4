"""Line dedup: a segment-partition edit-distance join over all distinct lines.

With a budget of t edits a line is cut into t + 1 segments. Two lines within t edits share at least
one segment of the shorter, at nearly the same place, so each line looks up, for every length from its
own down to t less, the substrings that a segment of such a line could be (the multi-match-aware windows
of Li et al., 2011). Lines are made distinct before any key is joined, so a line that stands in every
document has its keys once. Candidates pass a bound on character and bigram parities inside the join and
are verified with banded bit-parallel edit distance.

A segment that many different lines of one length share (log lines, page footers) would join all with all.
Such a hot key is not joined: its lines are cut a second time, where they differ, and the key goes on
together with each of the new segments. By the same argument a pair within t edits shares one of these too, so
no link is lost. What is still hot is cut again, up to DEPTH times.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, fresh, materialize

#: (least characters, edits): what two lines may differ by, by the length of the shorter. Still shorter
#: lines are the same only if they are equal.
BUDGETS = ((8, 1), (20, 2))
#: Buckets of the fixed-size filters that tell lines which certainly stand once, or have no candidate, from
#: the rest. Where most of a filter is set more rows go through a shuffle, and results stay the same.
FILTER_BITS = 22

#: Different lines that may have one segment as their own before it counts as hot.
HOT = 64
#: How often the lines of hot keys are cut anew; keys still hot then are joined as they are.
DEPTH = 3
#: Lines of a hot key, about, that its new cuts are chosen by. They decide the work, not the result.
CUT_LINES = 64

_CHAR_BITS, _PAIR_BITS = 23, 40
_CHARS, _PAIRS = (1 << _CHAR_BITS) - 1, ((1 << _PAIR_BITS) - 1) << _CHAR_BITS
_ROWS = 512


def lines_of(text: str | None) -> list[str]:
    """A text's lines without white space at their ends, in order; blank ones stay, so numbers are line numbers."""
    return [x.strip() for x in (text or "").split("\n")]


def line_id(line: str) -> int:
    """64-bit hash of a line, as a signed integer."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(line)).view(np.int64))


def edits_of(n: int, budgets=BUDGETS) -> int:
    """Edits that a pair may have whose shorter line has n characters."""
    return max((e for least, e in budgets if n >= least), default=0)


def segments(n: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line of n characters, the longer ones last."""
    parts, short = edits + 1, n // (edits + 1)
    longer = n - short * parts
    out, at = [], 0
    for k in range(parts):
        size = short + (k >= parts - longer)
        out.append((at, size))
        at += size
    return out


def windows(n: int, length: int, edits: int, parts: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(segment, start, size) of the substrings of a line of n characters to look up among lines of length
    characters, which are cut into parts, edits + 1 of them; segments() where none are given."""
    out, gap = [], n - length
    for k, (at, size) in enumerate(parts or segments(length, edits)):
        low = max(at - k, at + gap - (edits - k), 0)
        high = min(at + k, at + gap + (edits - k), n - size)
        out += [(k, start, size) for start in range(low, high + 1)]
    return out


def plan(n: int, budgets=BUDGETS) -> tuple[list[tuple[int, int, int]], int, int]:
    """What a line of n characters has as keys: (seed, start, end) of each, then how many of the first are
    its own segments, and how many look among lines of its own length. Seeds tell length and segment."""
    own = edits_of(n, budgets)
    if not own:
        return [], 0, 0
    index = [(g, at, size) for g, (at, size) in enumerate(segments(n, own))]
    same = index + [x for x in windows(n, n, own) if x not in index]
    keys = [(n << 4 | g, at, at + size) for g, at, size in same]
    for length in range(n - 1, 0, -1):
        e = edits_of(length, budgets)
        if n - length > e:
            break
        keys += [(length << 4 | g, at, at + size) for g, at, size in windows(n, length, e)]
    return keys, len(index), len(same)


def cuts(lines: list[str], edits: int) -> list[tuple[int, int]]:
    """(start, length) of edits + 1 segments of lines of one length, between which the entropy of the columns is
    spread evenly. Of very long lines only the first few by order are looked at."""
    n = len(lines[0])
    if n <= edits:
        return segments(n, edits)
    lines = sorted(lines)[: max(2, 4_000_000 // n)]
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(lines), n)
    weight = np.full(n, 1e-6)
    for j in range(0, n, 4096):
        some = codes[:, j : j + 4096]
        weight[j : j + 4096] -= np.log2((some[:, None] == some[None]).mean(0)).mean(0)
    total, ends = np.cumsum(weight), [0]
    for k in range(1, edits + 1):
        at = int(np.searchsorted(total, total[-1] * k / (edits + 1))) + 1
        ends.append(min(max(at, ends[-1] + 1), n - (edits + 1 - k)))
    ends.append(n)
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def parities(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """63 bits for each of the lines that begin at starts: parities of hashed characters (23) and character pairs (40)."""
    c, one = codes.astype(np.uint64), np.uint64(1)
    a = one << (c * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(_CHAR_BITS)
    b = np.zeros(len(c), np.uint64)
    p = c[:-1] * np.uint64(0x85EBCA6B) + c[1:] * np.uint64(0xC2B2AE35)
    b[:-1] = one << (p >> np.uint64(9)) % np.uint64(_PAIR_BITS) + np.uint64(_CHAR_BITS)
    b[starts[1:] - 1] = 0  # a pair lies within a line
    return np.bitwise_xor.reduceat(a, starts) | np.bitwise_xor.reduceat(b, starts)


def edit_distance(a: str, b: str, most: int) -> int | None:
    """Edit distance of two strings, None beyond most.

    state[d] holds, as bits, the diagonals within `most` of the main one that are reachable with d edits
    after the characters of b so far; a step is a few shifts for all diagonals at once.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if abs(len(a) - len(b)) > most:
        return None
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << (i + most)
    full = (1 << 2 * most + 1) - 1
    state = [1 << most]  # bit k: position j - most + k of a
    for _ in range(most):
        state.append((state[-1] | state[-1] << 1) & full)
    for j, x in enumerate(b):
        match = places.get(x, 0) >> j & full
        new = [state[0] & match]
        for d in range(1, most + 1):
            new.append((state[d] & match | state[d - 1] | state[d - 1] >> 1 | new[d - 1] << 1 | new[d - 1]) & full)
        state = new
        if not state[-1]:
            return None
    goal = 1 << len(a) - len(b) + most
    return next((d for d, s in enumerate(state) if s & goal), None)


def _slices(batches, column: int):
    """(slice, its distinct lines' texts) for every few rows."""
    for b in batches:
        for k in range(0, b.num_rows, _ROWS):
            part = b.slice(k, _ROWS)
            yield part, [lines_of(t) for t in part.column(column).to_pylist()]


def occurrences(docs: DataFrame) -> DataFrame:
    """(row, doc_id, line_no, id) of every line that is not blank in docs(row, doc_id, text); line_no counts from 0."""

    def run(batches):
        for part, texts in _slices(batches, 2):
            at = [i for i, lines in enumerate(texts) for x in lines if x]
            number = [j for lines in texts for j, x in enumerate(lines) if x]
            ids = [xxhash.xxh3_64_intdigest(x) for lines in texts for x in lines if x]
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(number, pa.int32()), pa.array(np.array(ids, np.uint64).view(np.int64))], names=["row", "doc_id", "line_no", "id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, line_no int, id long")


def _bits(ids: DataFrame) -> np.ndarray:
    """A filter of 2**FILTER_BITS cells, set where one of ids(id) falls: its size does not grow with the data."""
    mask = (1 << FILTER_BITS) - 1
    out = np.zeros(mask + 1, bool)
    out[ids.select(F.col("id").bitwiseAND(F.lit(mask)).cast("int").alias("i")).distinct().toArrow()["i"].to_numpy()] = True
    return out


def line_keys(docs: DataFrame, found: DataFrame, budgets=BUDGETS) -> DataFrame:
    """(id, sig, n_index, n_same, keys) of each distinct line of docs(text) that has keys, once; found: occurrences().

    Lines that certainly stand once go straight on; all others meet in an aggregation on their id first.
    """
    cast = docs.sparkSession.sparkContext.broadcast(_bits(found.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")))
    mask = (1 << FILTER_BITS) - 1

    def run(batches):
        plans: dict[int, tuple] = {}
        for _, texts in _slices(batches, 0):
            lines = list({x for t in texts for x in t if edits_of(len(x), budgets)})
            if not lines:
                continue
            raw = "".join(lines).encode("utf-32-le", "surrogatepass")
            size = np.array([len(x) for x in lines], np.int64)
            starts = np.cumsum(size) - size
            keys, index, same, ends = [], [], [], [0]
            for n, at in zip(size.tolist(), (4 * starts).tolist(), strict=True):
                p = plans.get(n)
                if p is None:
                    wanted, i, s = plan(n, budgets)
                    p = plans[n] = [(seed, 4 * a, 4 * b) for seed, a, b in wanted], i, s
                keys += [xxhash.xxh3_64_intdigest(raw[at + a : at + b], seed) for seed, a, b in p[0]]
                index.append(p[1])
                same.append(p[2])
                ends.append(len(keys))
            ids = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64)
            sig = parities(np.frombuffer(raw, "<u4"), starts).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(sig), pa.array(index, pa.int32()), pa.array(same, pa.int32()), lists, pa.array(cast.value[ids & np.uint64(mask)])], names=["id", "sig", "n_index", "n_same", "keys", "maybe"])

    made = materialize(docs.select("text").mapInArrow(run, "id long, sig long, n_index int, n_same int, keys array<long>, maybe boolean"), "line-keys")
    columns = ["id", "sig", "n_index", "n_same", "keys"]
    again = made.where("maybe").groupBy("id").agg(*(F.first(c).alias(c) for c in columns[1:]))
    return made.where("NOT maybe").select(columns).union(materialize(again, "line-keys-once"))


def _sides(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, a, x) of the segments and (key, b, y) of the probes of line_keys(); a negative y looks among lines of its own length."""
    i = keyed.select(F.explode(F.slice("keys", F.lit(1), F.col("n_index"))).alias("key"), F.col("id").alias("a"), F.col("sig").alias("x"))
    p = keyed.select(F.posexplode("keys").alias("at", "key"), F.col("id").alias("b"), "sig", "n_same")
    return i, p.select("key", "b", F.when(F.col("at") < F.col("n_same"), F.col("sig").bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.col("sig")).alias("y"))


def _meet(i: DataFrame, p: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of _sides() that share a key and pass the parity bounds; a pair may come more than once."""
    differ = F.col("x").bitwiseXOR(F.col("y"))
    # an edit changes two characters and four pairs at most
    near = (F.bit_count(differ.bitwiseAND(F.lit(_CHARS))) <= 2 * edits) & (F.bit_count(differ.bitwiseAND(F.lit(_PAIRS))) <= 4 * edits)
    return i.join(p, (i["key"] == p["key"]) & near & ((F.col("y") >= 0) | (F.col("a") < F.col("b")))).select("a", "b")


def _hot(i: DataFrame, label: str) -> DataFrame | None:
    """(key, n) of the keys that more than HOT lines have as their own; None if there are none."""
    hot = materialize(i.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT), label)
    return None if hot.isEmpty() else hot


def texts_of(docs: DataFrame, need: DataFrame, label: str) -> DataFrame:
    """(id, line) of the lines of docs(text) whose ids are in need(id), each once."""
    cast, mask = docs.sparkSession.sparkContext.broadcast(_bits(need)), (1 << FILTER_BITS) - 1

    def run(batches):
        for _, texts in _slices(batches, 0):
            lines = {x for t in texts for x in t if x}
            some = {x: h for x in lines if cast.value[(h := xxhash.xxh3_64_intdigest(x)) & mask]}
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(some.values()), np.uint64).view(np.int64)), pa.array(list(some), pa.string())], names=["id", "line"])

    text = docs.select("text").mapInArrow(run, "id long, line string").join(need, "id", "left_semi").groupBy("id").agg(F.first("line").alias("line"))
    return materialize(text, label)


_CUT_ROW = "key long, id long, sig long, own boolean, length int, edits int, line string"


def _first_rows(text: DataFrame, budgets) -> DataFrame:
    """(key, id, sig, own, length, edits, line) of every key of text(id, line): own for a segment, else a probe
    among lines of length characters, with a negative sig where that is the line's own length."""

    def made(batches):
        for b in batches:
            for i, line in zip(b.column(0), b.column(1), strict=True):
                i, line = i.as_py(), line.as_py()
                raw, (keys, index, same) = line.encode("utf-32-le", "surrogatepass"), plan(len(line), budgets)
                sig = int(parities(np.frombuffer(raw, "<u4"), np.array([0])).view(np.int64)[0])
                for at, (seed, start, end) in enumerate(keys):
                    key = int(np.uint64(xxhash.xxh3_64_intdigest(raw[4 * start : 4 * end], seed)).view(np.int64))
                    like = seed >> 4, edits_of(seed >> 4, budgets), line
                    if at < index:
                        yield key, i, sig, True, *like
                    yield key, i, sig | -(1 << 63) if at < same else sig, False, *like

    def run(batches):
        return _cut_batches(made(batches))

    return text.mapInArrow(run, _CUT_ROW)


def _cut_batches(rows) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
    names, held, size = [c.split()[0] for c in _CUT_ROW.split(", ")], [], 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > 4_000_000 or len(held) == 16_384:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _cut_rows(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows as _first_rows() gives them whose key is in hot(key, n), each with the keys of a new cut in place of its own."""
    share = F.greatest(F.lit(1), F.floor(F.col("n") / CUT_LINES))
    some = rows.where("own").join(hot, "key").where(F.pmod(F.xxhash64("id"), share) == 0)

    def choose(batches):
        for b in batches:
            got = [[y for at in cuts(x, e) for y in at] for x, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], names=["key", "parts"])

    found = some.groupBy("key").agg(F.collect_list("line").alias("lines"), F.first("edits").alias("edits")).mapInArrow(choose, "key long, parts array<int>")
    # a key of which chance leaves no line here is cut evenly below; the rows of a hot key are dealt over several tasks
    salts = 16
    known = hot.select("key").join(found, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("salt", F.pmod("id", F.lit(salts)).cast("int")).join(known, ["key", "salt"])

    def made(batches):
        for b in batches:
            for row in zip(*b.columns, strict=True):
                key, i, sig, own, length, edits, line, flat = (x.as_py() for x in row)
                parts = list(zip(flat[::2], flat[1::2], strict=True)) if flat else segments(length, edits)
                raw = line.encode("utf-32-le", "surrogatepass")
                at = [(g, a, n) for g, (a, n) in enumerate(parts)] if own else windows(len(line), length, edits, parts)
                for g, a, n in at:
                    new = xxhash.xxh3_64_intdigest(raw[4 * a : 4 * (a + n)], xxhash.xxh3_64_intdigest(f"{key} {g}"))
                    yield int(np.uint64(new).view(np.int64)), i, sig, own, length, edits, line

    def run(batches):
        return _cut_batches(made(batches))

    return dealt.select("key", "id", "sig", "own", "length", "edits", "line", "parts").mapInArrow(run, _CUT_ROW)


def candidates(docs: DataFrame, keyed: DataFrame, budgets=BUDGETS) -> DataFrame:
    """Pairs (a, b) of ids of different lines of docs(text), by line_keys(), that share a segment, and where that
    is hot a segment of each further cut, and pass the parity bounds."""
    edits = max(e for _, e in budgets)
    i, p = _sides(keyed)
    hot = _hot(i, "line-hot")
    if hot is None:
        return _meet(i, p, edits).distinct()
    cold = lambda side: side.join(hot.select("key"), "key", "left_anti")
    out = [_meet(cold(i), cold(p), edits)]
    need = p.join(hot, "key", "left_semi").select(F.col("b").alias("id")).distinct()
    rows = _first_rows(texts_of(docs, need, "line-hot-texts"), budgets)
    for level in range(DEPTH):
        rows = materialize(_cut_rows(rows, hot), f"line-cut-{level}")
        i = rows.where("own").select("key", F.col("id").alias("a"), F.col("sig").alias("x"))
        p = rows.where("NOT own").select("key", F.col("id").alias("b"), F.col("sig").alias("y"))
        hot = _hot(i, f"line-hot-{level}") if level + 1 < DEPTH else None
        if hot is None:
            out.append(_meet(i, p, edits))
            break
        out.append(_meet(cold(i), cold(p), edits))
    return reduce(DataFrame.union, out).distinct()


def links(docs: DataFrame, found: DataFrame, budgets=BUDGETS) -> DataFrame:
    """Pairs (a, b) of ids of different lines of docs(text) within their budget of edits, each once; found: occurrences()."""
    pairs = materialize(candidates(docs, line_keys(docs, found, budgets), budgets), "line-candidates")
    need = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    text = texts_of(docs, need, "line-texts")

    def verify(batches):
        for b in batches:
            keep = [edit_distance(x, y, edits_of(min(len(x), len(y)), budgets)) is not None for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(text.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(text.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "line-links")


def near_lines(docs: DataFrame, budgets=BUDGETS) -> DataFrame:
    """(doc_id, line_no, line_id, class_id, n_links, kept, row) of every line that is not blank in docs(doc_id, text).

    Lines are compared without the white space at their ends. line_id is the hash of the line, class_id
    the smallest line_id that links reach, n_links the number of different lines within the budget of
    edits for the shorter one's length. kept is true for the first line of each class, by doc_id, row and
    line number. Null text has no lines. Rows without doc_id come after all others. row is a hash of
    doc_id and text; rows that repeat both are taken for one. A very long line is a line like others.
    Empty table: no rows. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    found = materialize(occurrences(docs), "line-occurrences")
    pairs = links(docs, found, budgets)
    degree = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("n_links"))
    known = materialize(components(pairs, "line-components").join(degree, F.col("node") == F.col("id")).select("id", F.col("root").alias("class_id"), "n_links"), "line-classes")
    rows = found.join(known, "id", "left").select("row", "doc_id", "line_no", F.col("id").alias("line_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line_no")
    rows = materialize(rows, "line-rows")
    # a table of its own: the join then has an exchange on either side, and a hot line's rows can be split
    first = materialize(rows.groupBy("class_id").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("class_id", "first"), "line-first")
    rows = rows.join(first, "class_id", "left")
    return rows.select("doc_id", "line_no", "line_id", "class_id", "n_links", (F.col("first").isNull() | (place == F.col("first"))).alias("kept"), "row")


def dedup(docs: DataFrame, budgets=BUDGETS) -> DataFrame:
    """docs with text reduced to the lines that near_lines() keeps, and to its blank lines; other columns stay."""
    row, gone = fresh(docs.columns, "row", "gone")
    late = near_lines(docs, budgets).where(~F.col("kept")).groupBy(F.col("row").alias(row)).agg(F.collect_set("line_no").alias(gone))
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text")).join(late, row, "left").drop(row)
    at = docs.columns.index("text")

    def cut(batches):
        for b in batches:
            for k in range(0, b.num_rows, _ROWS):
                part, texts = b.slice(k, _ROWS), []
                for text, numbers in zip(part.column(at).to_pylist(), part.column(len(docs_columns)).to_pylist(), strict=True):
                    drop = set(numbers or ())
                    texts.append("\n".join([x for j, x in enumerate(text.split("\n")) if j not in drop]) if drop else text)
                yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if j == at else part.column(j) for j in range(len(docs_columns)))], names=docs_columns)

    docs_columns = docs.columns
    return rows.select(*docs_columns, gone).mapInArrow(cut, T.StructType(docs.schema.fields))
