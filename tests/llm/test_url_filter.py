import itertools
import math
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm.url_filter import RULES, judge, op4_url_filter, viterbi


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


@given(st.text(alphabet="ab", min_size=1, max_size=7), st.dictionaries(st.text(alphabet="ab", min_size=1, max_size=3), st.integers(1, 50)))
def test_viterbi_is_the_best_split(name, counts):
    known = {(i, j): counts[name[i:j]] for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in counts}
    value = lambda ws: sum(math.log(counts[w] / 1e4) if w in counts else math.log(10 / 1e4) - len(w) * math.log(10) for w in ws)
    splits = [[name[a:b] for a, b in itertools.pairwise([0, *cut, len(name)])] for n in range(len(name)) for cut in itertools.combinations(range(1, len(name)), n)]
    assert abs(value(viterbi(name, known, 1e4)) - max(map(value, splits))) < 1e-9


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/1?x", "a://b://c/d", "http://net/", "http://xnet/", "http://a.net", "http://example.com/de/x#y", "http://é.org/fr/", "http://cheappills.example.com/en/3",
        "http://catdog.example.org/en/x", "http://" + "long" * 5000 + "/p", "http://x.example.net:80/en/", "http://a.net/en/", "http://x.example.org/fr/9", "http://a\nb.net/q"]


def test_edges(spark):
    words = "the cat and the dog with cheap pills " * 30
    rows = [(i, u, f"<p>{words}</p><script>zebra</script>" if i % 2 else None) for i, u in enumerate(URLS)] + [(None, URLS[4], None)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "words", "name", "n", "score")})
    got = judge(df.repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, url in enumerate(URLS):
        r = by[i]
        assert (r.host, r.path) == parse(url), url
        assert (r.rule, r.verdict) == rule(*parse(url)) if r.rule else (rule(r.host, r.path)[0] is None and r.verdict in ("allow", "block"))
    assert by[11].words[:2] == ["cheap", "pills"] and by[11].verdict == "block" and by[12].words[:2] == ["cat", "dog"]
    assert judge(df.limit(0)).count() == 0


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op4_url_filter(spark, sf).collect():
        assert (r.host, r.path) == parse(urls[r.page_id]) and (r.rule is None or (r.rule, r.verdict) == rule(r.host, r.path))
