"""Near copies of the pipeline's stage against brute force over all pairs of texts."""

import random

import corpus_pipeline
from fixtures import SCHEMA, empty

from pathloom.llm import likeness, simhash


def planted(seed=11):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(12)]
    said = []
    for k in range(25):
        base = [word() for _ in range(r.choice([30, 80, 200]))] + common
        said.append(" ".join(base))
        for edits in range(1, r.randrange(2, 9)):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = word()
            said.append(" ".join(copy))
    said += [" ".join(common), said[0], said[0].upper(), "one two", "one two", "one two three", None, "", "  \n"]
    r.shuffle(said)
    return said


def grams(text):
    words = (text or "").lower().split()
    size = min(5, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def components(said):
    sets, root = [grams(t) for t in said], list(range(len(said)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                links += a != b
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(said))], links


def test_stage_drops_near_copies_and_nothing_else(spark, tmp_path):
    said = planted()
    want, links = components(said)
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in enumerate(said)], SCHEMA)
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert links > 40
    far = [(a, b) for a in range(len(said)) for b in range(a) if want[a] == want[b] and (simhash.fingerprint(said[a]) ^ simhash.fingerprint(said[b])).bit_count() > 3]
    assert far
    assert corpus_pipeline.simhash_near_dedup(spark, empty(spark), str(tmp_path)).count() == 0


def test_the_order_of_shingles_changes_nothing(spark, monkeypatch):
    said = planted(12)
    want, _ = components(said)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "doc_id long, text string")
    none = likeness.np.zeros(0, dtype=likeness.np.uint64), likeness.np.zeros(0, dtype=likeness.np.int64)
    for order in (likeness.common_shingles, lambda *_: none):
        monkeypatch.setattr(likeness, "common_shingles", order)
        by = {}
        for r in likeness.near_copies(docs).collect():
            by.setdefault(r["root"], []).append(r["doc_id"])
        assert sorted(min(x) for x in by.values()) == sorted(set(want)) and sum(map(len, by.values())) == len(said)


def test_different_texts_under_one_id_stay(spark):
    r = random.Random(3)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    a, b, c = text(), text(), text()
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (2, a), (3, b), (4, c)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == sorted([(1, a), (1, b), (4, c)])
    assert sorted(map(tuple, simhash.one_of_each(docs, likeness.near_copies(docs)).collect())) == sorted([(1, a), (1, b), (4, c)])


def test_fingerprints_link_first_and_change_nothing(spark, tmp_path, monkeypatch):
    said = planted(12)
    want, _ = components(said)
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in enumerate(said)], SCHEMA)
    asked, verified, pairs, check = [], [], simhash.linked_pairs, likeness._verified
    monkeypatch.setattr(simhash, "linked_pairs", lambda nodes, radius: asked.append(radius) or pairs(nodes, radius))
    monkeypatch.setattr(likeness, "_verified", lambda found, *rest: verified.append(check(found, *rest)) or verified[-1])
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert asked == [simhash.RADIUS] and verified[0].count()
