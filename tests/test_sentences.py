"""Sentences against a splitter that goes through a text character by character."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import sentences as s


def plain(text):
    """Cut after an ending and blanks, where a capital, a digit or an opening sign follows and no abbreviation ends."""
    out, at = [], 0
    text = text or ""
    i = 0
    while i < len(text):
        if text[i] in "\n\r":
            out.append(text[at:i])
            at = i + 1
        elif text[i] in ".!?…" and not inside(text, i):
            k = i
            while k < len(text) and text[k] in ".!?…":
                k += 1
            while k < len(text) and text[k] in "\"'”»)]":
                k += 1
            j = k
            while j < len(text) and text[j] in " \t":
                j += 1
            if k < j < len(text) and (text[j].isupper() or text[j].isdigit() or text[j] in "\"'“«¿¡(["):
                out.append(text[at:k])
                at = j
                i = j
                continue
            i = k
            continue
        i += 1
    out.append(text[at:])
    return [x.strip(" \t") for x in out if x.strip(" \t")]


def inside(text, i):
    """Does the full stop at ``i`` belong to an abbreviation, an initial or a number?"""
    if text[i] != ".":
        return False
    if 0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit():
        return True
    for a in s.ABBREVIATIONS:
        if text[:i].endswith(a) and (i == len(a) or not text[i - len(a) - 1].isalnum() and text[i - len(a) - 1] != "."):
            return True
    return i > 0 and text[i - 1].isupper() and (i == 1 or not text[i - 2].isalnum())


TEXTS = [
    None,
    "",
    "One sentence",
    "Dr. Smith paid 3.50 to J. R. Jones, e.g. in May. He left! Did he? Yes.",
    "Wait... what? He said “Stop.” Then he left… And then nothing.",
    "M. Dupont est venu, cf. la page 3. Il est parti. Élodie aussi.",
    "Das ist z.B. so, d.h. fast immer. Über allem steht es. 12 Leute kamen.",
    "El Sr. García llegó. ¿Y tú? ¡Claro! No sé.",
    "line one\nline two. Same line\n\n  third  ",
    "no capital. after this one stays",
    "A. B. C. Done.",
    "(He came.) She went. [Note.] End",
]


@pytest.mark.parametrize("text", TEXTS)
def test_cases(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(s.sentences(F.col("text"))).first()[0] == plain(text)


def test_drawn_texts(spark):
    rng = random.Random(1)
    words = ["word", "Dr.", "Bold", "3.5", "e.g.", "end.", "End!", "what?", "…", "x.", "“Quote.”", "\n", "7.", "Élan", "(so)", "z.B.", "and"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.s for r in df.select("i", s.sentences(F.col("text")).alias("s")).collect()}
    wrong = [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)]
    assert not wrong, wrong[:2]
