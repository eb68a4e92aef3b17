"""Language, quality and toxicity: held-out accuracy and odd inputs."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from framelake.llm import crf, quality, tokens, toxicity

BIG = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    pos = int((label == 1).sum())
    return (rank[label == 1].sum() - pos * (pos - 1) / 2) / (pos * (len(label) - pos))


def test_language_held_out(spark):
    got = crf.op1(spark, BIG).toPandas().merge(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang").toPandas())
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang_pred == held.lang).mean() > 0.98


def test_quality_held_out(spark):
    got = quality.op5(spark, BIG).toPandas().merge(spark.read.parquet(f"{BIG}/labels.parquet").toPandas())
    held = got[got.held_out]
    assert auc(held.score.values, held.quality.values) > 0.97


def test_toxicity_held_out(spark):
    got = toxicity.op7(spark, BIG).toPandas().merge(spark.read.parquet(f"{BIG}/labels.parquet").toPandas())
    held = got[got.held_out]
    assert auc(held.score.values, held.toxic.values) > 0.8
    assert held[held.toxic == 0].predicted.mean() < 0.05


@pytest.mark.parametrize("fit, run", [(lambda d: crf.fit(d), crf.identify), (lambda d: toxicity.fit_ftrl(pa.array(["a b", "c d"]), np.array([1.0, 0.0])), toxicity.score), (lambda d: quality.fit_pairs(pa.array(["a b", "c d"]), np.array([1.0, 0.0])), quality.score)])
def test_odd_rows(odd, none, fit, run):
    model = fit(odd)
    got = run(odd, model).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all()
    one, two = got[got.id == 1], got[got.id == 2]
    assert len(two) == 2 and set(two.score) == set(one.score)
    assert run(none, model).count() == 0
    if "lang_pred" in got:
        assert set(got[got.id.isin([3, 4, 5])].lang_pred) == {"und"}
        assert (got[got.id.isin([3, 4, 5])].score == 0).all()


def test_no_labels_at_all():
    assert crf.predict(pa.array(["abc"]), crf.fit_texts(pa.array([], pa.string()), []))[0] == ["und"]
    m = toxicity.fit_ftrl(pa.array([], pa.string()), np.zeros(0))
    assert len(m.ids) == 0
    assert len(set(quality.predict(pa.array(["a", "b c d"]), quality.fit_pairs(pa.array(["x"]), np.array([1.0]))))) == 1


def test_forward_backward_is_exact():
    """Marginals against the sum over all label paths, over several blocks' borders."""
    rng = np.random.default_rng(0)
    k, sizes = 2, [1, 3, 9]
    emit, trans, start = rng.standard_normal((sum(sizes), k)), rng.standard_normal((k, k)), rng.standard_normal(k)
    row = np.repeat(np.arange(3), sizes)
    old, crf.BLOCK = crf.BLOCK, 4
    try:
        got = crf.posteriors(emit, row, trans, start)
    finally:
        crf.BLOCK = old
    at = 0
    for n in sizes:
        total = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            s = start[path[0]] + sum(emit[at + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False))
            for i, y in enumerate(path):
                total[i, y] += np.exp(s)
        assert np.allclose(got[at : at + n], total / total.sum(1, keepdims=True))
        at += n


def test_code_switched_words():
    texts = pa.array(["the house and the garden with a door " * 6, "la maison et le jardin avec une porte " * 6] * 8)
    m = crf.fit_texts(texts, ["en", "fr"] * 8)
    w, p = crf.label_words(pa.array(["the house and the garden la maison et le jardin"]), m)
    assert [m.labels[i] for i in p.argmax(1)] == ["en"] * 5 + ["fr"] * 5


def test_words_match_a_plain_tokenizer():
    texts = ["Héllo, wörld! x2 — “q” …", "", "a b", "ÀB cd"]
    w = tokens.words(pa.array(texts))
    got = [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == ["héllo", "wörld", "x2", "q", "a", "b", "àb", "cd"]
    assert w.row.tolist() == [0, 0, 0, 0, 2, 2, 3, 3]
    again = tokens.words(pa.array(["cd", "q"]))
    assert again.hash.tolist() == [w.hash[7], w.hash[3]]


def plain_ftrl(per, labels, p):
    """FTRL-proximal, a coordinate at a time."""
    rate = sum(labels) / len(labels)
    prior, l1 = np.log((rate + 1e-3) / (1 - rate + 1e-3)), p.l1 * len(labels) ** 0.5
    z, n, zb, nb = {}, {}, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2)
    bias = lambda: -zb / ((p.beta + nb**0.5) / p.alpha + p.l2)
    order = np.argsort(tokens.splitmix(np.arange(len(per), dtype=np.uint64) + np.uint64(7)))
    for k in [k for _ in range(p.epochs) for k in order]:
        own = {i: weight(i) for i in per[k]}
        g = 1 / (1 + np.exp(-(prior + bias() + sum(own.values())))) - labels[k]
        for i, w in own.items():
            old = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / p.alpha * w
            n[i] = old + g * g
        zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / p.alpha * bias()
        nb += g * g
    return {i: weight(i) for i in z if weight(i)}, prior + bias()


def labelled(spark, sf, column, keep):
    """(texts, labels) that a fit may learn from, by id, by plain Python."""
    lab = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if lab.get(r.doc_id) is not None and keep(zlib.crc32(str(r.doc_id).encode()))]
    return [r.text or "" for r in rows], [float(lab[r.doc_id]) for r in rows]


def test_op7_against_plain_loops(spark, sf):
    p = toxicity.Params()
    texts, labels = labelled(spark, sf, "toxic", lambda c: c % 4 != 2)
    sets = lambda t: set(toxicity.features(pa.array([t]), p.bits)[1].tolist())
    weights, bias = plain_ftrl([sets(t) for t in texts], labels, p)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = toxicity.op7(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = 1 / (1 + np.exp(-(bias + sum(weights.get(i, 0.0) for i in sets(docs[r.doc_id])))))
        assert abs(r.score - want) < 1e-6 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3)


def test_features_against_plain_words():
    """Words, pairs, skip-grams and stems of a text, each once, by plain Python."""
    text = "Foo bar, foo bar bazzes ünïcode"
    words = ["foo", "bar", "foo", "bar", "bazzes", "ünïcode"]
    plain = {(k, *(words[i + g] for g in shape)) for k, shape in enumerate(toxicity.SHAPES) for i in range(len(words) - shape[-1])}
    plain |= {("stem", k, w[:k]) for w in words for k in toxicity.STEMS if len(w) > k}
    assert len(toxicity.features(pa.array([text]), 40)[1]) == len(plain)


def test_op5_against_plain_pairs(spark, sf):
    """The loss of every pair by itself, Adam by its formulas, and the scores of the query."""
    p = quality.Params()
    texts, labels = labelled(spark, sf, "quality", lambda c: c % 5 != 0)
    frequent = quality.frequent_words(pa.array(texts), p.frequent)
    x = np.concatenate([quality.statistics(pa.array([t]), frequent) for t in texts])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)

    def expand(row):
        z = np.clip((row - mean) / scale, -4, 4)
        return np.concatenate([z, [z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))]])

    z = np.array([expand(r) for r in x])
    good, bad = [k for k, y in enumerate(labels) if y == 1], [k for k, y in enumerate(labels) if y != 1]
    mix = lambda k: int(tokens.splitmix(np.array([k], np.uint64))[0])
    pairs = [(a, bad[mix(i * p.rivals + j + 2) % len(bad)]) for i, a in enumerate(good) for j in range(p.rivals)]
    pairs += [(good[mix(i * p.rivals + j + 1) % len(good)], b) for i, b in enumerate(bad) for j in range(p.rivals)]
    diff = np.array([z[a] - z[b] for a, b in pairs])
    w = m = v = np.zeros(z.shape[1])
    for t in range(1, p.steps + 1):
        g = -(diff / (1 + np.exp(diff @ w))[:, None]).mean(0) + p.l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model = quality.fit_pairs(pa.array(texts), np.array(labels), p)
    assert np.allclose(model.weights, w, rtol=1e-4, atol=1e-6)
    assert np.isclose(model.cut, np.quantile(z @ w, len(bad) / len(texts)), rtol=1e-4)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in quality.op5(spark, sf).collect():
        s = expand(quality.statistics(pa.array([docs[r.doc_id]]), frequent)[0]) @ w
        want = 1 / (1 + np.exp(-(np.log(0.3 / 0.7) + model.slope * (s - model.cut))))
        assert abs(r.score - want) < 1e-4


def test_a_fit_is_bounded_by_bytes(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('word ', 200) AS text")
    labels = spark.range(300).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    from framelake.llm import common

    rows, lab = docs.selectExpr("doc_id AS _id", "text AS _text"), labels.selectExpr("doc_id AS _id", "CAST(toxic AS double) AS _y")
    assert common.sample_texts(rows, lab, 1000, 1 << 20).num_rows == 300
    assert 40 < common.sample_texts(rows, lab, 1000, 100_000).num_rows < 180
