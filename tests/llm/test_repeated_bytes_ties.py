import hashlib

from quarry.llm.repeated_bytes import repeats, without_repeats


def colliding():
    """Two texts, of 150 bytes and more, whose digests begin with the same 24 bits."""
    seen, i = {}, 0
    while True:
        text = f"{i} " + "".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(3 + i % 2))
        lead = hashlib.md5(text.encode()).digest()[:3]
        if lead in seen and len(seen[lead]) != len(text):
            return seen[lead], text
        seen.setdefault(lead, text)
        i += 1


def test_texts_that_share_an_id_stay_apart(spark, docs):
    a, b = colliding()
    for doc_id in (None, 4):
        rows = [(doc_id, a), (doc_id, b), (doc_id, b), (9 if doc_id else None, b[:130])]
        got = sorted((r.n_bytes, r.kept_sha256) for r in repeats(docs(rows)).collect() if r.n_removed == 0)
        assert (len(a), hashlib.sha256(a.encode()).hexdigest()) in got
        assert {r.text for r in without_repeats(docs(rows)).collect()} >= {a}
        assert sorted(r.n_bytes for r in repeats(docs(rows)).collect()) == sorted(len(t) for _, t in rows)
