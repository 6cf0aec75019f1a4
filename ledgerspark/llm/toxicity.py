"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Names (words and beginnings of words that speak for toxicity) are learned from labelled texts. A text is
reduced to a skeleton in which look-alike characters share a class, repeats are one, and blanks and
punctuation are gone; where a name's skeleton begins at a beginning of a word, the characters there form a
lattice: each may stand for itself, for the letters it resembles, for nothing (punctuation, blanks,
repeats) or for the end of a word. The Viterbi path that a character trigram model of the corpus and the
channel like best is the restored text. A document's score puts the shares of all names together that
stand in what was restored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, held_out, materialize
from .linear import labelled_sample, training_rows

# The letters that the language model tells apart, and what characters resemble.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýœ"
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "µ": "u", "*": "aeiou", "#": "h", "%": "x"}
#: Cyrillic, Greek and other letters drawn like Latin ones.
HOMOGLYPHS = dict(zip("абвгеікмнорсѕтухјԁԛԝһαβεικνορτυχıɡɑ", "abbreikmhopcstyxjdqwhabeikvoptuxiga", strict=True))
#: Punctuation before and after words, and what may stand inside a word for nothing.
HEADS, TAILS = ".,;:?'\"([<", ".,;:?!'\")]>"
NOISE = ".,-_*'`~^:;/\\#"
#: Letters that one character may stand for share a class of the skeleton; "*" adds the vowels to these.
ALIKE, VOWELS = ("il", "gb"), "aeiou"
#: Natural log probabilities of the channel: a look-alike, a dropped character, a repeated letter, a blank
#: inside a word, a mark that ends a word.
LOOK, DROP, REPEAT, BLANK, MARK = (math.log(x) for x in (0.05, 0.02, 0.03, 0.02, 0.5))
OTHER, EDGE = len(LETTERS), len(LETTERS) + 1
ALPHABET = len(LETTERS) + 2
#: Stands in a path's text where a blank inside a word went.
JOINED = "\u200b"

#: Labelled rows of each class that the model is fitted on, at most; names come from these rows alone.
MOST_ROWS = 10_000
#: Least evidence that a name speaks for toxicity, as twice a log likelihood ratio.
EVIDENCE = 20.0
#: Least share of toxic documents among those that hold a name. With many labelled rows even a slight
#: leaning is evidence; a name is a sign only if most of its documents are toxic.
SHARE = 0.5
#: How many documents a beginning's share counts for beside a word's own.
STRENGTH = 3.0
PREFIXES = (3, 4, 5, 6)
#: Bytes of restored regions that a worker remembers at most.
REGIONS_BYTES = 16 << 20

_PUNCTUATION = "*#$%&!?.,;:|'\"()[]<>"
_GAPS = re.compile(r"\s+|([^\w\s])\1+")
_RUNS = re.compile(r"(\w)\1\1\1+")
_STARRED = re.compile(r"[^\s*#][*#]+[^\s*#]").search


@lru_cache(maxsize=1 << 16)
def choices_of(x: str) -> list[tuple[str, int, float]]:
    """(letter, its number, channel cost) of what a character may stand for."""
    i = LETTERS.find(x)
    out = [(x, i if i >= 0 else OTHER, 0.0)] if i >= 0 or x.isalpha() else [(y, LETTERS.index(y), LOOK) for y in LOOKALIKES.get(x, "")]
    base = HOMOGLYPHS.get(x) or unicodedata.normalize("NFKD", x)[:1]
    if out and base != x and base in LETTERS:
        out.append((base, LETTERS.index(base), LOOK))
    return out


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """By code point: the number of a letter, OTHER for other letters, EDGE for all that ends a word."""
    out = np.full(0x110000, EDGE, np.int64)
    for c in range(0x80, 0x110000):
        if chr(c).isalpha():
            out[c] = OTHER
    for i, x in enumerate(LETTERS):
        out[ord(x)] = i
    return out


@lru_cache(maxsize=2)
def _classes(starred: bool) -> np.ndarray:
    """By code point: its class in the skeleton, 0 for what the skeleton leaves out. starred: "*" is a vowel and "#" an h."""
    group = {x: x for x in "abcdefghijklmnopqrstuvwxyz"}
    for some in (*ALIKE, VOWELS + "l") if starred else ALIKE:
        group |= {x: some[0] for x in some}
    number = {x: ord(group[x]) - 96 for x in group}
    out = np.where(_codes() == EDGE, 0, 40).astype(np.uint8)
    for c in np.flatnonzero(out).tolist():
        base = HOMOGLYPHS.get(chr(c)) or unicodedata.normalize("NFKD", chr(c))[:1]
        out[c] = number.get(base, 40)
    for x, letters in LOOKALIKES.items():
        if x not in "*#" or starred:
            out[ord(x)] = number[letters[0]]
    return out


def skeleton(text: str, starred: bool = False) -> tuple[str, np.ndarray, np.ndarray]:
    """The skeleton of a text in lower case; for each of its characters the last place in the text at which
    its run begins a word (-1 if none does), and the first place of the run."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    classes = _classes(starred)[codes]
    at = np.flatnonzero(classes)
    if not len(at):
        return "", at, at
    kept = classes[at]
    new = np.ones(len(at), bool)
    new[1:] = kept[1:] != kept[:-1]
    run = np.cumsum(new) - 1
    begins = np.ones(len(at), bool)  # no letter stands before
    begins[at > 0] = _codes()[codes[at[at > 0] - 1]] == EDGE
    starts = np.full(int(run[-1]) + 1, -1, np.int64)
    some = np.flatnonzero(begins)
    starts[run[some]] = at[some]  # of several the last
    return kept[new].tobytes().decode("latin-1"), starts, at[new]


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all letter trigrams of docs(text), over all documents; the table has ALPHABET**3 cells, whatever the corpus."""

    def count(batches):
        table = np.zeros(ALPHABET**3, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                text = " ".join([t or "" for t in b.column("text").slice(k, 64).to_pylist()]).lower()
                c = _codes()[np.frombuffer(f"  {text}  ".encode("utf-32-le", "surrogatepass"), "<u4")]
                table += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=ALPHABET**3)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["at", "n"])

    parts = docs.select("text").mapInArrow(count, "at long, n long")
    got = parts.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(ALPHABET**3, np.int64)
    table[got["at"].to_numpy()] = got["n"].to_numpy()
    return table


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b) as an array [a, b, c], trigrams smoothed by bigrams and letters."""
    tri = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(np.float64)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + ALPHABET)
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    return np.log((tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5))


def ends_of(text: str) -> list[float | None]:
    """By character: what it costs if it ends a word, None if it cannot.

    Blanks do. So do marks that resemble no letter, and others where they stand doubled, or as plain
    punctuation, around a word. Letters and digits do not.
    """
    out = [0.0 if x.isspace() else None if x.isalnum() or choices_of(x) else MARK for x in text]
    n = len(text)
    for order, plain in ((range(n), HEADS), (range(n - 1, -1, -1), TAILS)):
        outside = True
        for k in order:
            x = text[k]
            if out[k] is None and outside and not x.isalnum() and (x in plain or x in (text[k - 1 : k], text[k + 1 : k + 2])):
                out[k] = MARK
            outside = x.isspace() or outside and out[k] is not None
    return out


def decode(text: str, model: np.ndarray) -> tuple[float, str]:
    """(log probability, restored text) of the likeliest path through a text's lattice, blanks as one blank.

    Words stand apart by one blank; JOINED marks where a blank inside a word went.
    """
    # states: the last two letters; each holds (log probability, text)
    states: dict[tuple[int, int], tuple[float, str]] = {(EDGE, EDGE): (0.0, "")}
    for k, (x, ends) in enumerate(zip(text, ends_of(text), strict=True)):
        choices = choices_of(x)
        same = k > 0 and text[k - 1] == x
        # what it costs if the character stands for nothing
        nothing = REPEAT if same and not x.isspace() else BLANK if x.isspace() else DROP if x in NOISE else None
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (p, t) in states.items():
            for y, c, cost in choices:
                q = p + cost + model[a, b, c]
                if (b, c) not in new or q > new[b, c][0]:
                    new[b, c] = q, t + y
            if nothing is not None and b != EDGE:
                q = p + nothing
                if (a, b) not in new or q > new[a, b][0]:
                    new[a, b] = q, t + JOINED if x.isspace() else t
            if ends is not None:
                q, end = (p + ends, (a, b)) if b == EDGE else (p + ends + model[a, b, EDGE], (b, EDGE))
                if end not in new or q > new[end][0]:
                    new[end] = q, t if b == EDGE else t + " "
        states = new
    return max((p if b == EDGE else p + model[a, b, EDGE], t.strip(" " + JOINED)) for (a, b), (p, t) in states.items())


def beginnings(core: str) -> list[str]:
    """The names of a word's beginnings, shortest first, and of the word itself."""
    return [*(f"^{core[:n]}" for n in PREFIXES if len(core) >= n), core] if core else []


class Restorer:
    """Finds names in texts, however they are written.

    shares: of the documents that hold a name, those that are toxic. counts: (toxic, other) documents of
    words that begin with a name and stand in others too; they refine the share.
    """

    def __init__(self, model: np.ndarray, shares: dict[str, float] | None = None, counts: dict[str, tuple[float, float]] | None = None):
        self.model, self.shares, self.counts = model, shares or {}, counts or {}
        self.restored = Recent(REGIONS_BYTES)
        # longer than any word that shares or counts tell of, so a word that is cut there is none of them
        self.longest = max(map(len, [*self.shares, *self.counts]), default=0) + 32
        self.finders = []
        for starred in (False, True):
            finder = ahocorasick.Automaton()
            for name in self.shares:
                bones = skeleton(name.removeprefix("^"), starred)[0]
                if bones:
                    finder.add_word(bones, len(bones))
            if len(finder):
                finder.make_automaton()
                self.finders.append((starred, finder))

    def regions(self, low: str) -> set[str]:
        """The stretches of a text in lower case that may hold a name: from where its skeleton begins a word
        to the end of the word in which it ends; runs of blanks, of one mark, and of one letter beyond three cut short."""
        out = set()
        for starred, finder in self.finders:
            if starred and not _STARRED(low):
                continue
            bones, starts, firsts = skeleton(low, starred)
            for end, size in finder.iter(bones):
                start = int(starts[end - size + 1])
                if start >= 0:
                    last = int(firsts[end])
                    if last < start:
                        last = start
                    part = _RUNS.sub(r"\1\1\1", _GAPS.sub(lambda m: m.group(1) or " ", low[start : last + 1]))
                    word = low[last + 1 : last + 1 + 4 * self.longest].split(None, 1)
                    tail = word[0] if word and not low[last + 1].isspace() else ""
                    out.add(part + _RUNS.sub(r"\1\1\1", tail)[: self.longest])
        return out

    def name_of(self, word: str, joined: bool = False) -> str | None:
        """The longest name that a word begins with; where a blank inside it went, only a name that is all of it."""
        if joined:
            return next((x for x in (word, f"^{word}") if x in self.shares), None)
        return next((x for x in reversed(beginnings(word)) if x in self.shares), None)

    def names(self, region: str) -> list[tuple[str, str]]:
        """(name, restored word) of each name in a region: as it is written, or else in what decode() reads there."""
        plain = region.strip(_PUNCTUATION)
        if plain.isalpha():
            name = self.name_of(plain)
            if name:
                return [(name, plain)]
        out = []
        for word in decode(region, self.model)[1].split(" "):
            core = word.replace(JOINED, "")
            name = self.name_of(core, JOINED in word)
            if name:
                out.append((name, core))
        return out

    def share(self, name: str, word: str) -> float:
        """The share of toxic documents for a word that begins with a name."""
        p = self.shares[name]
        if name != word and word in self.counts:
            pos, neg = self.counts[word]
            p = (pos + STRENGTH * p) / (pos + neg + STRENGTH)
        return p

    def found(self, text: str | None) -> dict[str, tuple[float, str]]:
        """By name without its mark: (share, restored word) of all names in a text, the highest share of each."""
        out: dict[str, tuple[float, str]] = {}
        regions = self.regions((text or "").lower())
        for x in self.restored.unknown(regions):
            self.restored.put(x, self.names(x))
        for x in regions:
            for name, word in self.restored.now[x]:
                got, root = (self.share(name, word), word), name.removeprefix("^")
                if root not in out or got > out[root]:
                    out[root] = got
        return out


def together(plain: float, shares: list[float]) -> float:
    """The score of a text that holds names of such shares: 1 less the product of what each leaves clean.

    plain is the share of toxic texts among those without a name; one name alone gives its own share,
    and a share below plain adds nothing.
    """
    clean = 1 - plain
    for p in sorted(shares):
        clean *= min(1.0, (1 - p) / (1 - plain))
    return 1 - clean


def root_shares(counts: dict[str, tuple[float, float]], base: float) -> dict[str, float]:
    """The share of toxic documents for words that begin with a name and with no longer one.

    What the longer name of most toxic documents accounts for is taken off: "lose" is no sign because
    "loser" is one.
    """
    under: dict[str, list] = {}
    for x, c in counts.items():
        for name in beginnings(x.removeprefix("^"))[:-1]:
            if name != x:
                under.setdefault(name, []).append(c)
    out = {}
    for name, (pos, neg) in counts.items():
        p = (pos + STRENGTH * base) / (pos + neg + STRENGTH)
        if name in under:
            most = max(under[name])
            left = max(0.0, pos - most[0]), max(0.0, neg - most[1])
            p = (left[0] + STRENGTH * p) / (left[0] + left[1] + STRENGTH)
        out[name] = p
    return out


def evidence(p: float, q: float, pos: int, neg: int) -> float:
    """Twice the log likelihood ratio of counts p and q against pos and neg rows, 0 if they speak for no toxicity."""
    if p * neg <= q * pos:
        return 0.0
    part = lambda x, size: x * math.log(x * (pos + neg) / ((p + q) * size)) if x else 0.0
    return 2 * (part(p, pos) + part(q, neg))


def _words(text: str | None) -> set[str]:
    """A text's words in lower case, without punctuation around them."""
    return {w.strip(_PUNCTUATION) for w in (text or "").lower().split()}


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> dict:
    """The language model from all of docs, and names' shares from at most most_rows labelled rows of each
    class that are not held out.

    Words and beginnings are counted by document and class where the rows are. All names with enough
    evidence, and the counts of words in texts of both classes that begin with one, reach the driver:
    what a sample of bounded rows can hold.
    """
    model = language_model(letter_counts(docs))
    sample = materialize(labelled_sample(docs, labels, "toxic", most_rows), "toxicity-sample")
    size = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    whole = {r.label: r.n for r in training_rows(labels, "toxic").groupBy("label").agg(F.count("*").alias("n")).collect()}
    base = (whole.get(1, 0) + 0.5) / (sum(whole.values()) + 1)
    if not pos or not neg:
        return {"lm": model, "shares": {}, "words": {}, "plain": base}
    # a class that the sample cut down weighs as much as all its rows
    heavy = whole[1] / pos, whole[0] / neg

    def count(batches):
        counts = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                words = _words(t) - {""}
                counts[y].update(words)
                for k in PREFIXES:
                    counts[y].update({f"^{w[:k]}" for w in words if len(w) >= k})
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][x] for x in names], pa.int64()), pa.array([counts[0][x] for x in names], pa.int64())], names=["name", "pos", "neg"])

    seen = sample.mapInArrow(count, "name string, pos long, neg long").groupBy("name").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg > 1")
    # twice the log likelihood ratio of a name's counts against the classes' sizes, where it speaks for toxicity
    n = F.col("pos") + F.col("neg")
    part = lambda x, size: F.when(x > 0, x * F.log(x * (pos + neg) / (n * size))).otherwise(0.0)
    weight = F.when(F.col("pos") * neg > F.col("neg") * pos, 2 * (part(F.col("pos"), pos) + part(F.col("neg"), neg))).otherwise(0.0)
    seen = materialize(seen.withColumn("weight", weight), "toxicity-names")
    n = F.col("pos") * heavy[0] + F.col("neg") * heavy[1] + STRENGTH
    best = seen.where((F.col("weight") >= EVIDENCE) & ((F.col("pos") * heavy[0] + STRENGTH * base) / n >= SHARE)).orderBy("name").collect()
    numbers = docs.sparkSession.sparkContext.broadcast({r.name: i for i, r in enumerate(best)})

    def contexts(batches):
        number, found = numbers.value, set()
        for b in batches:
            for t in b.column("text").to_pylist():
                words = ["", *(t or "").lower().split(), ""]
                for k in range(1, len(words) - 1):
                    for x in beginnings(words[k].strip(_PUNCTUATION)):
                        if x in number:
                            found.add((number[x], xxhash.xxh3_64_intdigest(" ".join(words[k - 1 : k + 2])) >> 1))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([h for _, h in found], pa.int64())], names=["i", "context"])

    # copies of one text make no evidence of its words: a name counts once for each pair of words around it
    around = sample.where("label = 1").select("text").mapInArrow(contexts, "i int, context long").distinct().groupBy("i").agg(F.count("*").alias("n")).collect()
    alone = {r.i: r.n for r in around}
    chosen = [i for i, r in enumerate(best) if evidence(min(r.pos, alone.get(i, 0)), r.neg, pos, neg) >= EVIDENCE]
    shares = root_shares({best[i].name: (best[i].pos * heavy[0], best[i].neg * heavy[1]) for i in chosen}, base)
    shares = {x: p for x, p in shares.items() if p >= SHARE}
    roots = docs.sparkSession.createDataFrame([(x,) for x in sorted(shares)], "name string")
    # words that begin with one of those names, where other texts hold them too
    some = seen.where(~F.col("name").startswith("^") & (F.col("neg") > 0))
    longer = some.withColumn("root", F.explode(F.array(*(F.concat(F.lit("^"), F.substring("name", 1, k)) for k in PREFIXES))))
    below = longer.join(roots.withColumnRenamed("name", "root"), "root", "left_semi").select("name", "pos", "neg").distinct().collect()
    out = {"lm": model, "shares": shares, "words": {r.name: (r.pos * heavy[0], r.neg * heavy[1]) for r in below}}
    tell = docs.sparkSession.sparkContext.broadcast(out)

    def unknown(batches):
        restorer = Restorer(tell.value["lm"], tell.value["shares"], tell.value["words"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([not restorer.found(t) for t in b.column("text").to_pylist()], pa.bool_())], names=["label", "none"])

    left = {r.label: r.n for r in sample.select("label", "text").mapInArrow(unknown, "label int, none boolean").where("none").groupBy("label").agg(F.count("*").alias("n")).collect()}
    p, q = left.get(1, 0) * heavy[0], left.get(0, 0) * heavy[1]
    out["plain"] = (p + 0.5) / (p + q + 1)  # the share of toxic texts among those without a name
    return out


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, words) per row of docs(doc_id, text).

    words: the restored words that speak for toxicity, in ascending order. The score puts the shares of all
    names in the restored text together(). Null text counts as empty.
    """
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = cast.value
        restorer = Restorer(m["lm"], m["shares"], m["words"])
        for b in batches:
            found = [restorer.found(t) for t in b.column("text").to_pylist()]
            p = np.array([together(m["plain"], [p for p, _ in x.values()]) for x in found], np.float64)
            words = [sorted({w for _, w in x.values()}) for x in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "held_out", "score", "predicted", "words"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, words array<string>")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on labels(doc_id, toxic) and all texts, then score all of docs(doc_id, text); see fit() and score().

    Null doc_id: not held out, never learned from. Repeated rows are scored each, ties alike. Empty tables:
    no rows, or scores of a model that knows nothing. Very long texts and words take time in proportion.
    Other columns are ignored, whatever their names.
    """
    return score(docs, fit(docs, labels, **options))
