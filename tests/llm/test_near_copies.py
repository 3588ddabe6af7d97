"""The pipeline's near duplicates on planted copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import near_copies


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def planted(pairs=160):
    """Texts and copies with single words replaced, the pairs' likeness spread over 0.6 to 1."""
    r = random.Random(11)
    out = []
    while len(out) < pairs:
        words = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(100, 400))]
        copy = list(words)
        for at in r.sample(range(len(words)), r.randint(1, max(1, len(words) // 20))):
            copy[at] = f"x{r.randint(0, 10**9)}"
        out.append((" ".join(words), " ".join(copy)))
    return out


def frame(spark, texts):
    rows = [(i, t, "en", "a", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_planted_copies_at_their_likeness(spark):
    pairs = planted()
    texts = [(2 * i + k, pair[k]) for i, pair in enumerate(pairs) for k in (0, 1)]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = {x.doc_id for x in stage(spark, frame(spark, texts), "").collect()}
    like = [jaccard(*p) for p in pairs]
    assert sum(0.8 <= s < 0.85 for s in like) >= 10 and sum(0.85 <= s < 0.95 for s in like) >= 10 and sum(s < 0.8 for s in like) >= 20
    assert all(2 * i in kept for i in range(len(pairs)))
    assert [2 * i + 1 in kept for i in range(len(pairs))] == [s < 0.8 for s in like]


@pytest.mark.parametrize("count", [30, 150])
def test_walk_keeps_the_groups_and_stays_linear(count):
    r = random.Random(5)
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(200)]
        for _ in range(count):
            copy = list(base)
            for at in r.sample(range(200), r.randint(1, 6)):
                copy[at] = f"x{r.randint(0, 10**9)}"
            texts.append(" ".join(copy))
    texts.append("else " * 3 + "one two three four five six")
    hashes = [near_copies.shingles(t.encode()) for t in texts]
    slots = np.stack([near_copies.min_hashes(h) for h in hashes]).astype("<u2")
    low = [np.unique((h >> np.uint64(32)).astype("<u4")) for h in hashes]
    found = near_copies.walk(slots, low.__getitem__)
    groups = lambda links: {frozenset(g) for g in components(len(texts), links)}
    sets = [set(h.tolist()) for h in hashes]
    stands = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    every = [(a, b) for a in range(len(texts)) for b in range(a) if stands(a, b)]
    assert groups(found.tolist()) == groups(every)
    assert len(found) < len(texts) and all(stands(*p) for p in found.tolist())


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    out = {}
    for x in range(n):
        out.setdefault(find(x), []).append(x)
    return out.values()


def test_a_large_bucket_keeps_one(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(near_copies.FEW * 3)]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert [x.doc_id for x in stage(spark, frame(spark, texts), "").collect()] == [0]


def test_texts_without_words_and_rows_without_id(spark):
    texts = [(1, None), (2, ""), (3, " "), (4, "a b c"), (5, "A  b c"), (None, "a b c"), (7, "a b d"), (None, "only here")]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = [x.doc_id for x in stage(spark, frame(spark, texts), "").collect()]
    assert sorted(kept, key=str) == sorted([1, 4, 7, None], key=str)
    assert stage(spark, frame(spark, texts).limit(0), "").count() == 0


def just_alike(seed):
    """Two texts of nine shingles each that share eight of ten."""
    r = random.Random(seed)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(14)]
    return " ".join(words[:13]), " ".join(words[:12] + words[13:])


def test_fingerprints_find_what_min_hashes_pass_over(spark):
    pairs = [just_alike(seed) for seed in (8799, 29649, 79299)]
    for pair in pairs:
        assert jaccard(*pair) == 0.8
        slots = np.stack([near_copies.min_hashes(near_copies.shingles(t.encode())) for t in pair]).astype("<u2")
        assert not len(near_copies.candidates(slots))
    texts = [(2 * i + k, pair[k]) for i, pair in enumerate(pairs) for k in (0, 1)]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(x.doc_id for x in stage(spark, frame(spark, texts), "").collect()) == [0, 2, 4]


def test_blocks_alone_link_what_is_close_and_alike(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(near_copies.FEW * 3)]
    for _ in range(40):  # short texts: close fingerprints of pairs that are not alike as well
        words = [f"v{r.randint(0, 10**6)}" for _ in range(30)]
        texts += [" ".join(words), " ".join(words[:-1]), " ".join([*words[:14], "x", *words[14:]])]
    docs = frame(spark, list(enumerate(texts))).selectExpr("doc_id", "doc_id as mark", "text")
    prints = docs.mapInArrow(near_copies._prints, "doc_id long, mark long, fp long, print long, bands array<long>, slots binary, shingles binary")
    prints = prints.withColumn("bands", F.expr("slice(bands, 1, 0)")).cache()
    rows = {x.fp: (x.doc_id, x.print) for x in prints.collect()}
    near = {frozenset((u, v)) for u in rows for v in rows if u < v and ((rows[u][1] ^ rows[v][1]) & (2**64 - 1)).bit_count() <= 4}
    stands = {p for p in near if jaccard(*(texts[rows[x][0]] for x in p)) >= 0.8}
    found = near_copies.links(prints, 0.8).collect()
    sure = [(x.u, x.v) for x in found if x.sure]
    assert sure and all(frozenset((x.u, x.v)) in near for x in found) and {frozenset(p) for p in sure} <= stands
    got = [p for x in found if (p := (x.u, x.v)) and frozenset(p) in stands]
    place = {fp: i for i, fp in enumerate(rows)}
    groups = lambda links: {frozenset(g) for g in components(len(rows), [tuple(place[x] for x in p) for p in links])}
    assert groups(got) == groups(stands) and len(stands) > len(near_copies.shingles(texts[0].encode()))
    prints.unpersist()
