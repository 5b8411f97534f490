import random

import numpy as np
import pytest

from glyphlake.llm import langid, quality, toxicity

from . import cases


def labelled(spark, n=400, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic, bad = rng.random() < 0.3, rng.random() < 0.4
        body = cases.words(rng, rng.randint(30, 90)).split()
        if toxic:
            for _ in range(4):
                body.insert(rng.randrange(len(body)), rng.choice(["zorkish", "zorkable", "zorking", "vile"]))
        if bad:
            body = [w.upper() + "!!" for w in body]
        rows.append((i, " ".join(body), "en", "s"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(n, None, None, None), (n + 1, "", "en", "s"), (None, "vile zorking vile", "en", "s"), rows[0]]
    rows = [(*r, 7, "clash") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, y int, feature string"), spark.createDataFrame(labels + labels[:5] + [(None, 1, 1)], "doc_id long, quality int, toxic int"), labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels, truth = labelled(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    known = {i: t for i, _, t in truth}
    held = [r for i, r in got.items() if i in known and r.held_out]
    assert len(held) > 40 and np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[400].score == got[401].score and got[None].predicted == 1


def test_toxic_passages_and_empty_tables(spark):
    docs, labels, _ = labelled(spark)
    model = toxicity.fit(docs, labels)
    passages = toxicity.score(spark.createDataFrame([(1, "aa bb cc vile zorking vile dd ee")], "doc_id long, text string"), model, with_passages=True).first().passages
    assert passages and "vile" in passages[0].words
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    assert all(r.predicted == 0 for r in toxicity.toxicity(docs, labels.limit(0)).collect())


def brute_segments(scores):
    """Maximal scoring segments by their definition: repeatedly the best one, then both sides."""
    out = []

    def go(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (best is None or total > best[2] + 1e-12 or (abs(total - best[2]) <= 1e-12 and j - i < best[1] - best[0])):
                    best = (i, j, total)
        if best:
            go(a, best[0])
            out.append(best)
            go(best[1] + 1, b)

    go(0, len(scores))
    return out


def test_segments_are_the_maximal_ones():
    rng = random.Random(8)
    for _ in range(200):
        scores = [rng.choice([-3.1, -1.37, -0.21, 0.53, 1.29, 2.71]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.Segments.of(np.asarray(scores)).found]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


def test_lambda_solves_its_equation():
    scores, counts = np.asarray([-1.0, 2.0]), np.asarray([9.0, 1.0])
    lam = toxicity.solve_lambda(scores, counts)
    assert (counts / counts.sum() * np.exp(lam * scores)).sum() == pytest.approx(1.0, abs=1e-6)


def test_quality_on_held_out_documents(spark):
    docs, labels, truth = labelled(spark)
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    known = {i: q for i, q, _ in truth}
    held = [r for i, r in got.items() if i in known and r.held_out]
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and got[400].score == got[401].score
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(map(repr, [r.doc_id for r in kept.collect()])) == sorted(map(repr, [r.doc_id for r in quality.quality(docs, labels).collect() if r.predicted]))
    assert quality.quality(docs.limit(0), labels).collect() == []


def test_a_words_part_is_the_average_of_its_vectors():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=quality.BUCKETS + 2)
    parts = quality._Parts(logits)
    for text in (b"one two two", b"x", b"", b"abc abc abc def"):
        ids, share = quality.document_features(text)
        assert quality.probability(text, parts) == pytest.approx(1 / (1 + np.exp(-(logits[ids] * share).sum())), rel=1e-5)


def test_kept_words_are_bounded_by_their_bytes(monkeypatch):
    monkeypatch.setattr(quality, "word_features", lambda word: [len(word) % 7, 3])
    logits = np.arange(quality.BUCKETS + 2, dtype=float)
    parts = quality._Parts(logits)
    for k in range(90):
        word = b"%d" % k + b"x" * (1 << 20)
        assert parts[word] == parts[word] == complex(len(word) % 7 + 3, 2)
    assert sum(map(len, parts.keys() | parts.old.keys())) <= 2 * (32 << 20)


def multilingual(spark):
    rng = random.Random(3)
    syllables = {"aa": ["tha", "ing", "wo"], "bb": ["ich", "ung", "sch"], "cc": ["eau", "oux", "é"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, lang))
    return rows + [(300, None, "aa"), (301, "123 !!", None), (302, "", "bb"), (None, rows[0][1], "cc"), rows[0]]


def test_languages_of_held_out_documents(spark):
    rows = multilingual(spark)
    got = langid.language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    known = {r[0]: r[2] for r in rows[:300]}
    held = [r for r in got if r.doc_id in known and r.held_out]
    assert np.mean([r.lang_pred == known[r.doc_id] for r in held]) > 0.95
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and by_id[301].score == 0 and len(got) == len(rows)
    assert langid.language(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_code_switched_words_are_labelled_by_their_neighbours(spark):
    model = langid.fit(spark.createDataFrame(multilingual(spark), "doc_id long, text string, lang string"))
    labeller = langid.Labeller(model)
    one, two = ["thaing", "wotha", "ingwo"] * 5, ["ichung", "schich", "ungsch"] * 5
    share = dict(zip(model.langs, labeller.shares([one + two])[0], strict=True))
    assert 0.3 < share["aa"] < 0.7 and 0.3 < share["bb"] < 0.7


def test_joined_chains_are_those_on_their_own():
    rng = np.random.default_rng(0)
    lengths = [1, 5, 300, 2, 700]
    emission, transition, first = rng.random((sum(lengths), 3)) + 0.01, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    starts = np.zeros(sum(lengths), bool)
    starts[np.cumsum([0, *lengths[:-1]])] = True
    got, at = langid.chain_marginals(emission, starts, transition, first), 0
    for n in lengths:
        e = emission[at : at + n]
        a, out, b = [first * e[0] / (first * e[0]).sum()], [], np.ones(3)
        for t in range(1, n):
            x = a[-1] @ transition * e[t]
            a.append(x / x.sum())
        for t in range(n - 1, -1, -1):
            out.append(a[t] * b / (a[t] * b).sum())
            b = transition @ (b * e[t])
            b /= b.sum()
        assert np.allclose(got[at : at + n], out[::-1])
        at += n


def random_model(langs=3, seed=1):
    rng = np.random.default_rng(seed)
    return langid.Model([f"l{k}" for k in range(langs)], rng.normal(size=(langid.BUCKETS, langs)) / 4, rng.normal(size=(langs, langs)), rng.normal(size=langs), set())


def plain_shares(model, words):
    """Forward-backward one word after the other."""
    e, a, first = model.emissions(words), np.exp(model.transition), np.exp(model.first)
    alpha = np.empty(e.shape)
    for t in range(len(words)):
        x = (alpha[t - 1] @ a if t else first) * e[t]
        alpha[t] = x / x.sum()
    beta, total = np.ones(e.shape[1]), np.zeros(e.shape[1])
    for t in range(len(words) - 1, -1, -1):
        total += alpha[t] * beta / (alpha[t] * beta).sum()
        beta = a @ (beta * e[t])
        beta /= beta.sum()
    return total / len(words)


def test_a_text_scores_the_same_beside_any_other():
    rng, model = random.Random(4), random_model()
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts = [[word() for _ in range(n)] for n in (2_000, 199_000, 7, 500_000, 30_000, 1, 175_000)]
    alone = [langid.Labeller(model).shares([t])[0] for t in texts]
    for order in ([0, 1, 2, 3, 4, 5, 6], [3, 6, 1, 0, 5, 4, 2], [5, 2, 0, 4, 1, 6, 3]):
        assert (langid.Labeller(model).shares([texts[k] for k in order]) == [alone[k] for k in order]).all()
    for k in (0, 2, 3, 5):
        assert np.allclose(alone[k], plain_shares(model, texts[k]), atol=2e-6)


def test_language_scores_do_not_depend_on_partitions_or_columns(spark):
    rows = multilingual(spark)
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, words string, id int, score string")
    one, many = ({repr(tuple(r)) for r in langid.language(d).collect()} for d in (docs.coalesce(1), docs.orderBy("text").repartition(7)))
    assert one == many


def test_very_long_texts_are_scored_whole(spark):
    docs, labels, _ = labelled(spark, 200)
    rng = random.Random(2)
    clean, toxic = (" ".join(cases.words(rng, 60_000).split()[:60_000]) for _ in range(2))
    toxic = toxic + " vile zorking zorkish vile zorkable vile"
    more = spark.createDataFrame([(9000, clean, "en", "s", 1, "f"), (9001, toxic, "en", "s", 1, "f"), (9002, clean.upper().replace(" ", "!! "), "en", "s", 1, "f")], docs.schema)
    found = {r.doc_id: r.score for r in toxicity.toxicity(docs.unionByName(more), labels).collect()}
    assert found[9001] > found[9000]
    found = {r.doc_id: r.predicted for r in quality.quality(docs.unionByName(more), labels).collect()}
    assert (found[9000], found[9002]) == (1, 0)
