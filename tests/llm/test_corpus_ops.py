"""Substring deduplication, language-model scores, token counts, nearest neighbours and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import ann, langid, ngram_lm, simhash, substring, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did long, mark long, bucket int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or ""), 1, 2, 3) for i, t in rows], SCHEMA).repartition(3)


def passages():
    r = random.Random(6)
    word = lambda: r.choice(["the", "und", "of", "ñ", "éa", "x,"]) + str(r.randint(0, 400))
    shared = [[word() for _ in range(r.randint(18, 70))] for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [[word() for _ in range(r.randint(0, 60))] for _ in range(3)]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, 3), list(r.choice(shared)))
        rows.append((i, r.choice([" ", "\n", "  "]).join(w for p in parts for w in p)))
    rows += [(200 + i, rows[5][1]) for i in range(5)] + [(300, "line of five words here\n" * 40), (301, None), (302, ""), (303, "a b c"), (304, " ".join(word() for _ in range(20_000)))]
    rows += [(None, rows[7][1]), rows[9], rows[9]]
    return rows


def brute_kept(rows, width=20):
    first, out = {}, Counter()
    for i, t in sorted(((substring.NULL_ID if i is None else i), t or "") for i, t in set(rows)):
        w, seen = t.encode().split(), []
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if first.setdefault(key, (i, t, s)) != (i, t, s):
                seen.append(s)
        gone = {j for s in seen for j in range(s, s + width)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        copies = sum((substring.NULL_ID if k is None else k, v or "") == (i, t) for k, v in rows)
        out[(None if i == substring.NULL_ID else i, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += copies
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_substring_dedup_against_brute_force(spark, batches, monkeypatch):
    rows = passages()
    got = substring.deduplicate(make(spark, rows), batches=batches, with_text=True).collect()
    assert Counter((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got) == brute_kept(rows)
    assert all(hashlib.sha256(x.kept_text.encode()).hexdigest() == x.kept_sha256 for x in got)


def test_substring_dedup_of_nothing(spark):
    assert substring.deduplicate(make(spark, [])).count() == 0
    assert substring.deduplicate(make(spark, [(1, None)])).first().n_words == 0


def test_small_chunks_and_buckets_agree(spark):
    rows = passages()
    own = make(spark, rows).select(F.coalesce("doc_id", F.lit(substring.NULL_ID)).alias("did"), "text")
    index = substring.FingerprintIndex(spark, substring.shared_dir(spark), buckets=7)
    for k in range(4):
        index.ingest(own.where(F.pmod(F.xxhash64("did"), F.lit(4)) == k))
    assert len(index.runs) <= index.fanout
    got = {(r.did, p) for r in index.candidates().collect() for blob in r.places for p in np.frombuffer(blob, np.int32).tolist()}
    anchors = Counter()
    places = {}
    for i, t in {(substring.NULL_ID if i is None else i, t or "") for i, t in rows}:
        chunk = substring.Chunk([t.encode()])
        _, at, runs = chunk.windows(20, 6)
        for a in np.unique(at).tolist():
            anchors[int(runs[a])] += 1
            places.setdefault(int(runs[a]), []).append((i, a))
    assert {x for h, n in anchors.items() if n > 1 for x in places[h]} <= got


def corpus():
    r = random.Random(3)
    words = ["The", "of", "tion", "ñandú", "Éa", "haus", "x", "y,", "z."] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 80)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, "unseen Words here"), (503, "the of " * 4000), rows[3], rows[3], (None, "The of")]


def test_scores_against_brute_force(spark):
    rows = corpus()
    got = ngram_lm.score(make(spark, rows), F.pmod(ngram_lm.id_crc("doc_id"), F.lit(5)) == 1, F.pmod(ngram_lm.id_crc("doc_id"), F.lit(25)) == 2).collect()
    assert len(got) == len(rows)
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode())
    count = Counter()
    for i, t in rows:
        if crc(i) % 5 != 1:
            count.update([*(t or "").encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    by = {}
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        by[i] = (len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), crc(i) % 5 == 1)
    for x in got:
        tokens, known, base, held = by[x.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (tokens, known, n, held)
        assert math.isclose(x.base_score, base, rel_tol=1e-12)
        assert x.score < 0 and math.isfinite(x.score)
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > 1.05 * sum(x.base_score for x in held)


def test_probabilities_add_up():
    weights = ngram_lm.expectation_maximisation(np.array([[b, 10.0, 0.2, 0.05, 0.01] for b in range(6)]))
    assert np.allclose(weights.sum(1), 1) and weights[0, 0] == 0
    count, pairs = {"a": 6, "b": 3, "c": 1}, {("a", "a"): 2, ("a", "b"): 3, ("a", "c"): 1}
    third = ngram_lm.third_weights(np.array([[b, 10.0, 0.5, 0.1] for b in range(1, 6)]))
    assert third[0] == 0 and ((0 <= third) & (third <= 1)).all()
    mix = ngram_lm.Mixture(10, 3, weights, third)
    low = [np.full(4, 6), np.array([pairs.get(("a", t), 0) for t in "abcd"]), np.array([count.get(t, 0) for t in "abcd"])]
    assert math.isclose(mix.bigram(*low).sum(), 1.0)
    assert math.isclose(mix.probability(np.full(4, 2), np.array([0, 2, 0, 0]), *low).sum(), 1.0)
    assert math.isclose(mix.probability(np.zeros(4, int), np.zeros(4, int), *low).sum(), 1.0)


def plain_scores(rows, learn, teach):
    """The same model by dictionaries of words, pairs and triples, without hashes, chunks or buckets of hashes."""
    split = lambda t: [*(t or "").encode().lower().split(), None]

    def counts(keep):
        one, two, three, docs = Counter(), Counter(), Counter(), 0
        for i, t in rows:
            if keep(i):
                w, docs = split(t), docs + 1
                one.update(w)
                two.update(zip(["<s>", *w[:-1]], w, strict=True))
                three.update(zip(["<s>", *w[:-2]], w[:-1], w[1:], strict=True) if len(w) > 1 else [])
        return one, two, three, docs

    def tokens(t, c):
        one, two, three, docs = c
        w = split(t)
        for j, x in enumerate(w):
            v = w[j - 1] if j else "<s>"
            u = (w[j - 2] if j > 1 else "<s>") if j else None
            yield (two[u, v] if j else 0), (three[u, v, x] if j else 0), (one[v] if j else docs), two[v, x], one[x]

    whole, fewer = counts(learn), counts(lambda i: learn(i) and not teach(i))
    n, v = sum(whole[0].values()), len(whole[0])
    step = lambda x: round(math.log(x) * ngram_lm.CELL) if x > 0 else None
    value = lambda s: 0.0 if s is None else math.exp(s / ngram_lm.CELL)
    bucket = lambda c: 0 if not c else min(int(math.log2(c)) + 1, ngram_lm.BUCKETS - 1)
    seen = [x for i, t in rows if learn(i) and teach(i) for x in tokens(t, fewer)]
    low = Counter((bucket(c), step(p / c if c else 0), step(x / n)) for _, _, c, p, x in seen)
    w = ngram_lm.expectation_maximisation(np.array([(b, k, value(p), value(x), 1 / (v + 1)) for (b, p, x), k in low.items()], float).reshape(-1, 5))
    bigram = lambda c, p, x: float(w[bucket(c)] @ np.array([p / c if c else 0.0, x / n, 1 / (v + 1)]))
    high = Counter((bucket(c2), step(t3 / c2), step(bigram(c, p, x))) for c2, t3, c, p, x in seen if c2)
    m = ngram_lm.third_weights(np.array([(b, k, value(t3), value(p)) for (b, t3, p), k in high.items()], float).reshape(-1, 4))
    mix = lambda c2, t3, c, p, x: m[bucket(c2)] * (t3 / c2 if c2 else 0.0) + (1 - m[bucket(c2)]) * bigram(c, p, x)
    return [(i, sum(math.log10(mix(*x)) for x in tokens(t, whole))) for i, t in rows]


def test_model_scores_against_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BUCKET", 300)
    rows, crc = corpus(), lambda i: zlib.crc32(b"" if i is None else str(i).encode())
    got = ngram_lm.score(make(spark, rows), F.pmod(ngram_lm.id_crc("doc_id"), F.lit(5)) == 1, F.pmod(ngram_lm.id_crc("doc_id"), F.lit(5)) == 2).collect()
    want = plain_scores(rows, lambda i: crc(i) % 5 != 1, lambda i: crc(i) % 5 == 2)
    key = lambda x: (x[0] is None, x[0] or 0, round(x[1], 6))
    for (i, a), (j, b) in zip(sorted(((x.doc_id, x.score) for x in got), key=key), sorted(want, key=key), strict=True):
        assert i == j and math.isclose(a, b, rel_tol=1e-6)


def test_scores_with_nothing_to_learn(spark):
    got = ngram_lm.score(make(spark, [(1, "a b")]), F.lit(True), F.lit(False)).first()
    assert got.train_tokens == 0 and got.n_known == 0 and got.score <= 0
    assert ngram_lm.score(make(spark, []), F.lit(False), F.lit(False)).count() == 0


def test_edits_keep_counts_exact(spark):
    ranks, pattern = token_counts.default_vocabulary()
    counter = token_counts.counter(ranks, pattern)
    whole = lambda t: len(counter.encoding.encode_ordinary(t))
    r = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "'", "s", "'re", ".", "1", "é", " word", "\t", "!!", "\U0001f600"]
    for _ in range(300):
        text = "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 5, 50, 400, 2000])))
        chars, tokens, _ = token_counts.build(text, counter)
        tree = token_counts.Tree.of(chars, tokens)
        assert tree.tokens[1] == whole(text)
        for _ in range(4):
            s = r.randint(0, len(text))
            e = s + r.choice([0, 1, 3, 30, 500])
            text, _ = token_counts.edit(text, tree, s, e, "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 3, 200]))), counter)
            assert tree.tokens[1] == whole(text) and tree.chars[1] == len(text)
            assert (token_counts._sums(tree.tokens[tree.size : tree.size + tree.leaves]) == tree.tokens).all()


def test_token_count_query(spark):
    ranks, pattern = token_counts.default_vocabulary()
    counter = token_counts.counter(ranks, pattern)
    rows = corpus()
    docs = make(spark, rows)
    trees = token_counts.build_trees(docs, ranks, pattern)
    got = token_counts.apply_edits(trees.withColumn("edits", token_counts.revision(F.col("text"))), ranks, pattern).collect()
    by = {i: t or "" for i, t in rows}
    assert len(got) == len(rows)
    for x in got:
        text = by[x.doc_id]
        n = len(text)
        assert x.n_tokens == len(counter.encoding.encode_ordinary(text)) and x.n_chars == n
        for at, width, new in ((n // 4, 0, " (revised) "), (n * 2 // 4, 24, ""), (n * 3 // 4, 12, "it's 2 new words")):
            at = min(at, len(text))
            text = text[:at] + new + text[at + width :]
        assert x.edited_tokens == len(counter.encoding.encode_ordinary(text)) and x.edited_chars == len(text)
    long = next(x for x in got if x.doc_id == 503)
    assert long.recounted < long.pretokens / 4
    assert token_counts.apply_edits(token_counts.build_trees(make(spark, []), ranks, pattern).withColumn("edits", token_counts.revision(F.col("text"))), ranks, pattern).count() == 0


def vectors(spark, n=900, dims=32):
    r = np.random.default_rng(2)
    x = r.normal(size=(n, dims)).astype(np.float32)
    x[300:340] = x[299]  # copies
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(n)]
    rows += [(2000, None, 0), (2050, [0.0] * dims, 0), (2001, [float("nan")] * dims, 0), (2002, [None] * dims, 0), (2003, [float("inf")] + [0.0] * (dims - 1), 0), (2004, [1.0, 2.0], 0), (None, [1.0] * dims, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3), x.astype(float)


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 256)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 8)
    df, x = vectors(spark)
    got = ann.search(df, F.col("vec_id") % 50 == 0, rerank=128).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    found = {}
    for row in got:
        found.setdefault(row.query_id, []).append(row)
    assert set(found) == set(range(0, 900, 50))
    for q, rows in found.items():
        rows.sort(key=lambda r: r["rank"])
        s = unit @ unit[q]
        s[q] = -9
        want = sorted(range(len(x)), key=lambda j: (-round(s[j], 12), j))[:5]
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        assert all(math.isclose(r.score, x[q] @ x[r.vec_id] / math.sqrt((x[q] @ x[q]) * (x[r.vec_id] @ x[r.vec_id])), abs_tol=1e-12) for r in rows)
        hits += len(set(want) & {r.vec_id for r in rows})
        total += 5
    assert hits >= 0.95 * total


def test_neighbours_at_the_registered_values(spark):
    """More rows than a block of 8,192, of which 512 are looked at again: recall of the five nearest."""
    r = np.random.default_rng(12)
    x = (r.normal(size=(40, 32))[r.integers(0, 40, 18_000)] + 0.9 * r.normal(size=(18_000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 150 == 0).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 18_000, 150):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(np.argsort(-s, kind="stable")[:5].tolist()) & {y.vec_id for y in got if y.query_id == q})
    assert hits >= 0.9 * 5 * 120


def test_neighbours_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0, 2.0]), (50, [1.0, 1.0, 2.0])], schema)
    got = ann.search(two, F.col("vec_id") % 50 == 0).collect()
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == {(0, 50, 1), (50, 0, 1)}


def test_anisotropic_codes_lower_the_parallel_error():
    r = np.random.default_rng(4)
    x = r.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    error = []
    for threshold in (0.0, 0.3):
        book = ann.fit(x, rounds=4, threshold=threshold)
        codes = book.codes(x)
        residual = book.pairs(x) - book.centers[np.arange(8)[None], codes]
        error.append(float(np.square((residual * book.pairs(x)).sum((1, 2))).mean()))
    assert error[1] < error[0]


@pytest.fixture(scope="module")
def raw(spark):
    r = random.Random(9)
    vocab = {"en": ["the", "of", "thing", "with", "house"], "de": ["der", "über", "schön", "und", "haus"]}
    rows = []
    for i in range(150):
        k = r.choice(["en", "de"])
        rows.append((i, " ".join(r.choice(vocab[k]) + r.choice(["", "", str(r.randint(0, 99)) + "x"]) for _ in range(r.randint(20, 200))), k, f"s{i % 4}", 0))
    rows += [(200 + i, rows[i][1], rows[i][2], "s0", 0) for i in range(10)] + [(300, "mail bob@site.example.org now " + " ".join(f"the{i} house" for i in range(60)), "en", "s1", 0), (301, None, "en", "s1", 0), (302, "12 34", "en", "s1", 0), (303, "", None, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), {row[0]: row for row in rows}


def test_pipeline_stage_by_stage(spark, raw):
    docs, by = raw
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["languages"](spark, docs, "").collect()
    assert {x.doc_id for x in spoken} == set(by) - {301, 302, 303}
    kept = stages["near_duplicates"](spark, spark.createDataFrame(spoken, docs.schema), "").collect()
    groups = simhash.near_duplicates(spark.createDataFrame(spoken, docs.schema)).collect()
    assert sorted(x.doc_id for x in kept) == sorted({x.component_id for x in groups})
    assert all(by[x.doc_id][1] == x.text for x in kept)
    clean = stages["personal_data"](spark, spark.createDataFrame(kept, docs.schema), "").collect()
    assert len(clean) == len(kept) and not any("bob@" in x.text for x in clean)
    assert next(x for x in clean if x.doc_id == 300).text.startswith("mail <email> now ")
    mixed = stages["mixture"](spark, spark.createDataFrame(clean, docs.schema), "").collect()
    size = lambda rows: sum(len(x.text.split()) for x in rows)
    assert abs(size(mixed) - size(clean)) <= 4
    packed = stages["packed"](spark, spark.createDataFrame(mixed, docs.schema), "").collect()
    assert all(x.length > 0 for x in packed)
    assert {x.doc_id for x in packed} == {x.doc_id for x in mixed}


def test_pipeline_run(spark, raw, tmp_path):
    docs, _ = raw
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_unlabelled_text_is_filled_in(spark, raw):
    docs, _ = raw
    model = langid.train(docs, F.lit(True))
    got = langid.accept(docs.withColumn("lang", F.when(F.col("doc_id") != 5, F.col("lang"))), model).where("doc_id = 5").first()
    assert got.lang in ("en", "de")
