"""Learning and scoring against a plain version."""

import random
import re
from collections import Counter

import numpy as np

from quarry.llm.toxicity import KINDS, LEAST_ODDS, LEAST_RATIO, LEXICON, PREFIXES, PRIOR, SYMBOLS, learn, match, score

WORDS = re.compile(r"[a-z0-9_\u0080-\U0010ffff]+")


def learned(rows):
    terms = lambda t: {x for w in WORDS.findall((t or "").lower()) for x in [(0, w), *((k, w.encode()[:k]) for k in PREFIXES if len(w.encode()) > k)]}
    toxic, clean = Counter(), Counter()
    for _, t, y in rows:
        (toxic if y else clean).update(terms(t))
    n_toxic, n_clean = sum(y for *_, y in rows), sum(not y for *_, y in rows)
    base = n_toxic / (n_toxic + n_clean)
    out = set()
    for term, a in toxic.items():
        b = clean[term]
        ratio = a * np.log(a / (a + b) / base) + (b * np.log(b / (a + b) / (1 - base)) if b else 0)
        if a >= max(LEAST_RATIO / -np.log(base), 0.002 * n_toxic) and ratio >= LEAST_RATIO and ((a + 0.5) / (n_toxic + 1)) / ((b + 0.5) / (n_clean + 1)) >= LEAST_ODDS:
            out.add(term)
    return out


def counts(text, terms):
    known = {w: s for s in reversed(SYMBOLS[:5]) for w in LEXICON[s].split()}
    found = Counter()
    for clause in re.split(r"[.!?;:,\n]", (text or "").lower()):
        symbols = []
        for w in WORDS.findall(clause):
            s = "insult" if (0, w) in terms else known.get(w, "other")
            if s == "other" and any((k, w.encode()[:k]) in terms for k in PREFIXES if len(w.encode()) > k):
                s = "insult"
            symbols.append(s)
        found.update(match(symbols) if {"insult", "threat"} & set(symbols) else ())
    return [np.log2(1 + found[k]) for k in KINDS]


def test_against_a_plain_version(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + "you not said kill he".split()
    rows = []
    for i in range(500):
        line = [rng.choice(words) + rng.choice(["", "", "", ".", ",", "!"]) for _ in range(rng.randrange(3, 40))]
        toxic = i % 4 == 0
        for _ in range(rng.choice([1, 1, 2, 9]) if toxic and i % 12 else i % 31 == 0):
            line.insert(rng.randrange(len(line)), rng.choice(["grub", "snotty" + rng.choice("abcd") * 3, "idiot", "Scum"]))
        rows.append((i, " ".join(line), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = learn(df, df)
    terms = learned(rows)
    assert (0, "grub") in terms and any(k for k, _ in terms)
    x = np.array([[1, *counts(t, terms)] for _, t, _ in rows])
    y = np.array([t for *_, t in rows])
    weights = model[1]
    got = {r.doc_id: r.score for r in score(df, model).collect()}
    want = 1 / (1 + np.exp(-x @ weights))
    assert max(abs(got[i] - want[i]) for i in range(len(rows))) < 1e-9
    # the weights are the best ones: the slope of their posterior is flat
    precision = np.array([0.01] + [0.5] * len(KINDS))
    assert np.abs(x.T @ (y - want) - precision * (weights - PRIOR)).max() < 1e-3
    assert counts("idiot. " * 15, terms)[0] == 4
