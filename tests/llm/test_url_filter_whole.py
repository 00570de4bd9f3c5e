"""Segmentation and verdicts of the whole table against a plain version."""

import math
from collections import Counter

import regex
import xxhash

from quarry.llm.url_filter import FEATURES, SEED_WEIGHT, SEEDS, judge
from tests.llm.test_url_filter import parse, rule


def split(name, counts, total):
    best, back = [0.0], [0]
    for j in range(1, len(name) + 1):
        options = [(best[i] + (math.log(counts[w] / total) if (w := name[i:j]) in counts else math.log(10 / total) - (j - i) * math.log(10)), -i) for i in range(j)]
        value, i = max(options)
        best.append(value)
        back.append(-i)
    words, j = [], len(name)
    while j:
        words.append(name[back[j] : j])
        j = back[j]
    return words[::-1]


def brute(pages):
    bare = [regex.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ", html or "") for _, _, html in pages]
    counts = Counter(w for text in bare for w in regex.findall(r"\p{L}+", text.lower()))
    total = sum(counts.values()) + 1e4
    rows = []
    for page, url, _ in pages:
        host, path = parse(url)
        words = [w for name in regex.split(r"[.\-_:@]+", host) if name for w in split(name, counts, total)]
        words += ["/" + ("0" if regex.fullmatch("[0-9]+", w) else w) for w in regex.findall(r"[\p{L}\p{N}]+", path.lower())]
        rows.append((page, *rule(host, path), words))
    place = lambda w: xxhash.xxh64_intdigest(w.encode(), seed=42) % FEATURES
    seen = {v: Counter() for v in ("block", "allow")}
    for _, _, verdict, words in rows:
        if verdict:
            seen[verdict].update(map(place, words))
    for v, line in SEEDS.items():
        for w in line.split():
            seen[v][place(w)] += SEED_WEIGHT
    size = {v: sum(c.values()) + FEATURES for v, c in seen.items()}
    decided = Counter(v for _, _, v, _ in rows if v)
    prior = math.log((decided["block"] + 1) / (decided["allow"] + 1))
    odds = lambda w: math.log((seen["block"][place(w)] + 1) / size["block"]) - math.log((seen["allow"][place(w)] + 1) / size["allow"])
    return {page: (v or ("block" if prior + sum(map(odds, words)) > 1e-9 else "allow"), words, prior + sum(map(odds, words))) for page, _, v, words in rows}


def same(got, want):
    assert len(got) == len(want)
    for r in got:
        verdict, words, score = want[r.page_id]
        assert r.words == words and abs(r.score - score) < 1e-6 and r.verdict == verdict


def test_small_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    same(judge(pages).collect(), brute([(r.page_id, r.url, r.html) for r in pages.collect()]))


def test_long_names_and_words(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    text = f"<p>{'the cat and the dog with cheap pills ' * 30} {long * 1} {'été ' * 40}</p>"
    rows = [(1, f"http://{'catdog' * 20}.example.fr/x", text), (2, f"http://the{long}cat.example.fr/", text), (3, "http://étécat.example.fr/a/22", text), (4, "http://example.net/spam", text)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    same(got, brute(rows))
    by = {r.page_id: r.words for r in got}
    assert by[1][:40] == ["cat", "dog"] * 20 and by[2][:3] == ["the", long, "cat"] and by[3][:2] == ["été", "cat"]
