import random

from hypothesis import given, settings, strategies as st

from noticelake.llm import simhash
from noticelake.llm.components import components


def by_hand(text):
    import re
    import xxhash
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aBé \t\n\x0b\x1f 世", max_size=60))
def test_fingerprint_by_hand(text):
    assert simhash.fingerprint(text.encode()) == by_hand(text)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 301}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == whole


def families(n, seed):
    """Fingerprints in chains of one to three changed bits."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        out.append(out[rng.randrange(len(out))] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    return out


def test_classes_against_all_pairs(spark):
    for crowd, distance in ((16, 2), (1, 2), (1, 1), (4, 1)):
        prints = families(160, crowd + distance)
        rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "id long, fp long")
        found = {r.fp: r.component_id for r in simhash.classes(rows, distance=distance, crowd=crowd).collect()}
        for (i, fp), group in zip([tuple(r) for r in rows.orderBy("id").collect()], simhash.reachable(prints, distance)):
            assert found[fp] == min(group)


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len(found) == 304 and len({found[i] for i in range(301)}) == 1
    assert found[1000] == found[1001] == found[1002] != found[0]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(documents, nothing):
    found = simhash.near_duplicates(documents).collect()
    assert len(found) == documents.count()
    assert {r.component_id for r in found if r.fingerprint == "0" * 16} == {3}
    for r, text in ((r, t) for r in found for t in {x.text for x in documents.where("doc_id = 7").collect()} if r.doc_id == 7):
        assert int(r.fingerprint, 16) == by_hand(text) and r.component_id == 1
    assert simhash.near_duplicates(nothing).count() == 0


def test_keep_one_of_each_class(documents, nothing):
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 6, 8]  # the two texts of 6 are not alike
    assert simhash.keep_one(nothing).count() == 0
    twice = documents.where("doc_id = 4").union(documents.where("doc_id = 4"))
    assert simhash.keep_one(twice).count() == 1


def test_null_ids_are_classes_too(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (None, "A b c d"), (None, "e f g h")], "doc_id long, text string")
    assert simhash.keep_one(rows).count() == 2
    assert {r.component_id for r in simhash.near_duplicates(rows).collect()} == {None}
