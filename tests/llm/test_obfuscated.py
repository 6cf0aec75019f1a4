"""Planted obfuscations of known names, Viterbi paths against all paths, and texts that must take linear time."""

import itertools
import time

import numpy as np
import pytest
from ledgerspark.llm import toxicity
from ledgerspark.llm.toxicity import BLANK, DROP, EDGE, JOINED, NOISE, REPEAT, choices_of

TEXT = "such a loser is an idiot and a shit book for the kids who read it at home with the others " * 50


@pytest.fixture(scope="module")
def model():
    table = np.zeros(toxicity.ALPHABET**3, np.int64)
    c = toxicity._codes()[np.frombuffer(f"  {TEXT}  ".encode("utf-32-le"), "<u4")]
    np.add.at(table, (c[:-2] * toxicity.ALPHABET + c[1:-1]) * toxicity.ALPHABET + c[2:], 1)
    return toxicity.language_model(table)


@pytest.fixture(scope="module")
def restorer(model):
    return toxicity.Restorer(model, {"^idiot": 0.9, "^loser": 0.9, "shit": 0.9})


FORMS = ["idiot", "iddiot", "idiiot", "an idiоt here", "іdiot", "ｉdiot", "5h17", "$#17", "$h!t!", "such a l o s e r", "l  o  s  e  r", "x l\to  s e r y", "i  d  i  o  t", "id iot", "IDIOT!!!", "(loser)", "l.o.s.e.r", "l0$er", "looooooooser", "all idiots", "l*ser", "sh#t sh*t", "i_d-i.o't", "ídiót", "1d10t", "bad\nidiot.\nmore"]


@pytest.mark.parametrize("text", FORMS)
def test_found(restorer, text):
    assert [p for p, _ in restorer.found(text).values()] == [0.9]


@pytest.mark.parametrize("text", ["the kids read a book", "5417", "a b c d", "home 2024 10:30", "", None, " \n", "id. iotas", "clo serial", "medidiot"])
def test_clean(restorer, text):
    assert restorer.found(text) == {}


def all_paths(text, model):
    """The best log probability of all paths through a short text's lattice, one arc of each character at a time."""
    arcs, ends = [], toxicity.ends_of(text)
    for k, x in enumerate(text):
        some = [("letter", y, c, cost) for y, c, cost in choices_of(x)]
        if k and text[k - 1] == x and not x.isspace():
            some.append(("nothing", "", None, REPEAT))
        elif x.isspace():
            some.append(("nothing", JOINED, None, BLANK))
        elif x in NOISE:
            some.append(("nothing", "", None, DROP))
        if ends[k] is not None:
            some.append(("end", " ", EDGE, ends[k]))
        arcs.append(some)
    best = (-np.inf, "")
    for path in itertools.product(*arcs):
        a, b, p, out = EDGE, EDGE, 0.0, ""
        for kind, y, c, cost in path:
            if kind == "letter":
                p, a, b, out = p + cost + model[a, b, c], b, c, out + y
            elif kind == "nothing":
                if b == EDGE:
                    break
                p, out = p + cost, out + y
            elif b != EDGE:
                p, a, b, out = p + cost + model[a, b, EDGE], b, EDGE, out + y
            else:
                p += cost
        else:
            best = max(best, (p if b == EDGE else p + model[a, b, EDGE], out.strip(" " + JOINED)))
    return best


@pytest.mark.parametrize("text", ["5h17", "l0 $er", "id iot", "i d i", "sh!t!", "1d.10t", "l*s#r", "aa bb", "(a).", "оооk", "  x"])
def test_viterbi_is_the_best_path(model, text):
    got, want = toxicity.decode(text, model), all_paths(text, model)
    assert got[0] == pytest.approx(want[0]) and got[1].replace(JOINED, "") == want[1].replace(JOINED, "")


@pytest.mark.parametrize("text", ["." * 100_000, "Introduction" + "." * 100_000 + "7", "\n".join(f"Chapter {k} " + "." * 200 + f" {k * 7}" for k in range(500)), "w" * 1_000_000, "idiot" + "x" * 1_000_000, "l " * 300_000, "a b " * 200_000, "*#" * 200_000, "l" + "." * 200_000 + "oser", "!" * 300_000])
def test_linear_time(restorer, text):
    began = time.process_time()
    restorer.found(text)
    assert time.process_time() - began < 5


def test_word_ends():
    ends = lambda t: "".join("x" if e is None else "_" for e in toxicity.ends_of(t))
    assert ends("$h!t!") == "xxxx_" and ends("(a b)!!") == "_x_x___" and ends("a-b 5") == "x_x_x" and ends("$$a #b") == "__x_xx"


def test_names_add_up(spark):
    words = ["loser", "idiot", "plain", "book", "house"]
    docs = [(k, f"tell w{k} {words[k % 5]} v{k * 7} about") for k in range(900)]
    labels = [(k, int(k % 5 < 2)) for k in range(900)]
    more = [(1000, "tell w1 l0ser v1 about"), (1001, "tell w1 loser and an id1ot about"), (1002, "tell book about"), (None, None), (1002, "tell book about")]
    d = spark.createDataFrame(docs + more, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS held_out", "3 AS words")
    got = toxicity.classify(d, spark.createDataFrame(labels, "doc_id long, toxic int")).where("doc_id >= 1000 OR doc_id IS NULL").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5
    assert by[1000].predicted == 1 and by[1000].words == ["loser"]
    assert by[1001].score > by[1000].score and by[1001].words == ["idiot", "loser"]
    assert by[1002].predicted == 0 and by[None].predicted == 0 and by[None].words == []
