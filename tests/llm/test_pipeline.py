"""Every stage of the corpus pipeline against brute force, and its edge cases."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import langid, mixing, packing, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    vocab = {"en": ["the", "of", "thing", "with", "house", "where"], "de": ["der", "über", "schön", "und", "haus", "nicht"]}
    made = []
    for i in range(90):
        k = r.choice(["en", "de"])
        made.append((i, " ".join(r.choice(vocab[k]) + r.choice(["", str(r.randint(0, 500))]) for _ in range(r.randint(30, 160))), k, r.choice(["s1", "s2", None]), 0))
    for i in range(20):  # near copies: one word in about 40 is another
        words = made[i][1].split()
        for j in range(0, len(words), 80):
            words[j] = f"other{i}"
        made.append((200 + i, " ".join(words), made[i][2], "s1", 0))
    made += [(300, made[3][1], made[3][2], "s2", 0), (300, made[3][1], made[3][2], "s2", 0), (None, made[4][1], None, None, 0), (310, None, "en", "s1", 0), (311, "", None, None, 0), (312, "12 34 !", "en", "s1", 0)]
    return made


def test_languages_against_the_plain_model(spark, rows):
    docs = frame(spark, rows)
    model = langid.train(docs, F.lit(True))
    want = Counter()
    for d, t, k, s, n in rows:
        lang, p = model.predict(t)
        if lang != langid.UNKNOWN and p >= 0.5:
            want[d, t, k or lang, s, n] += 1
    assert Counter(map(tuple, STAGES["languages"](spark, docs, "").collect())) == want
    assert not {310, 311, 312} & {k[0] for k in want} and len(want) > 100


def alike(a, b):
    cut = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set()
    x, y = cut(a), cut(b)
    return x == y or (bool(x | y) and len(x & y) >= 0.8 * len(x | y))


def test_near_duplicates_against_all_pairs(spark, rows):
    texts = sorted({t or "" for _, t, *_ in rows})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if alike(texts[i], texts[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[find(texts.index(t or ""))].append(d)
    want = sorted(min((d for d in g if d is not None), default=None) for g in groups.values())
    got = STAGES["near_duplicates"](spark, frame(spark, rows), "").collect()
    assert sorted(x.doc_id for x in got) == want
    assert len(want) < len({d for d, *_ in rows}) - 15


def test_personal_data_against_the_spans(spark):
    texts = ["mail ana@site.example.org or ring +49 30 1234 5678, host 10.1.2.3", "card 4111 1111 1111 1111 and reach bob (at) host (dot) org", "nothing here", "", None]
    got = STAGES["personal_data"](spark, frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)] * 2), "").collect()
    assert len(got) == 2 * len(texts)
    model = pii.train()
    for x in got:
        t = texts[x.doc_id]
        if t is None:
            assert x.text is None and x.n_chars is None
            continue
        plain = list(t)
        for kind, s, e in sorted(pii.find(t, model)[1], key=lambda y: -y[1]):
            plain[s:e] = f"<{kind}>"
        assert x.text == "".join(plain) and x.n_chars == len(x.text)
    assert {x.doc_id: x.text for x in got}[0] == "mail <email> or ring <phone>, host <ip>"
    assert {x.doc_id: x.text for x in got}[1] == "card <card> and reach <email>"


def test_mixture_takes_what_the_operator_says(spark, rows):
    docs = frame(spark, rows)
    got = defaultdict(list)
    for x in STAGES["mixture"](spark, docs, "").collect():
        got[x.doc_id, x.source].append(x.text)
        assert x.n_chars == len(x.text)
    whole = defaultdict(set)
    for d, t, _, s, _ in rows:
        whole[d, s].add(t)
    taken = Counter()
    for x in mixing.mix_sources(docs).collect():
        taken[x.doc_id, x.source] += x.taken
    for key, n in taken.items():
        assert sum(len(t.split()) for t in got.get(key, [])) == n
        for t in got.get(key, []):
            assert any(t == w or " ".join((w or "").split()).startswith(t) for w in whole[key])
    targets = {x.source: x.target for x in mixing.mix_sources(docs).select("source", "target").distinct().collect()}
    for s, target in targets.items():
        assert abs(sum(n for (_, source), n in taken.items() if source == s) - target) <= 2


def test_packed_pieces_are_the_ids(spark, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    some = rows[:40] + rows[-6:]
    got = STAGES["packed"](spark, frame(spark, some), "").collect()
    ids = defaultdict(list)
    for d, t, *_ in some:
        ids[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    assert set(by) == set(ids)
    import numpy as np

    for d, pieces in by.items():
        assert sum(x.length for x in pieces) == sum(map(len, ids[d]))
        for x in pieces:
            assert any(packing.crc(np.array(full[x.start : x.start + x.length], np.uint16)) == x.ids_crc32 and len(full) == x.doc_tokens for full in ids[d])
    windows = defaultdict(list)
    for x in got:
        windows[x.sequence_id].append(x)
    for pieces in windows.values():
        at = 0
        for x in sorted(pieces, key=lambda y: y.offset):
            assert x.offset == at
            at += x.length
        assert at == 2048 or at & (at - 1) == 0


@pytest.mark.parametrize("name", list(STAGES))
def test_extra_columns_and_no_rows(spark, rows, name):
    docs = frame(spark, rows)
    clashing = docs.select("*", *(F.lit(1).alias(c) for c in ("row", "mark", "key", "fp", "size", "bucket", "turn", "place", "part", "ids", "start")))
    plain, more = (sorted(map(repr, STAGES[name](spark, x, "").collect())) for x in (docs, clashing))
    strip = lambda found: [re.sub(r"sequence_id=\d+, offset=\d+|start=\d+, length=\d+, ids_crc32=\d+", "", x) for x in found]
    assert (plain == more) if name != "packed" else len(strip(plain)) == len(strip(more))
    empty = STAGES[name](spark, docs.limit(0), "")
    assert empty.count() == 0
    if name != "packed":
        assert empty.columns == docs.columns
