from quarry.operators import retrieval as R

TEXTS = ["one two three\n\nfour five\n\n  two three four \n\n\n five", None, "", "two\n\nthree two\n\nphone two 3", "净利润 three\n\nsupply chain two", "one two three", "xone two threes\n\nx"]


def test_paragraphs_are_scored_where_they_are_read(spark, monkeypatch):
    """Tokens of paragraphs aren't joined with those of queries, if these are few; the rows are the same."""
    docs = spark.createDataFrame([(i * 7 - 20, t) for i, t in enumerate(TEXTS * 6)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "one two three"), (2, " two three "), (3, "净利润"), (4, "supply chain"), (5, None), (6, "five 3 four"), (7, "one two three")], "query_id long, text string")
    rows = lambda: sorted(tuple(r) for r in R.paragraph_search(queries, docs).collect())
    joined, join = [], R.wanted_terms
    monkeypatch.setattr(R, "wanted_terms", lambda *a: joined.append(a) or join(*a))
    got = rows()
    assert not joined and {r[0] for r in got} == {1, 2, 3, 4, 6, 7}
    monkeypatch.setattr(R.S, "MOST_TERMS", 0)
    assert rows() == got and joined


def test_documents_of_one_id_are_one(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "three")], "doc_id long, text string")
    got = R.paragraph_search(spark.createDataFrame([(1, "one two three")], "query_id long, text string"), docs).collect()
    assert {r.score for r in got} == {1.0}
