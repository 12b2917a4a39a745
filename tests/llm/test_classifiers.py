"""Language, quality and toxicity: accuracy on small corpora, and odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bytecnn, langid, quality, toxicity

SYLLABLES = {"aa": "ka lo mi nu sa te".split(), "bb": "grü sch ähn ung ber eit".split(), "cc": "ción que ñar los ió esa".split()}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, lang, rng.randrange(3, 200)), lang) for k, lang in enumerate(rng.choices(list(SYLLABLES), k=150))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).cache()


def test_languages(languages, spark):
    net, names = langid.fit(languages.where("doc_id % 3 <> 0"))
    found = langid.identify(languages, net, names).join(languages, "doc_id").where("doc_id % 3 = 0").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    odd = [(1, None), (2, ""), (3, "12 !? 34"), (None, "ka lo mi"), (5, "schung " * 30_000), (5, "schung " * 30_000)]
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    got = langid.identify(df, net, names).collect()
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert [r.lang_pred for r in got if r.doc_id == 5] == ["bb"] * 2 and len(got) == 6
    assert langid.identify(df.limit(0), net, names).count() == 0


def test_no_or_one_language(languages):
    net, names = langid.fit(languages.limit(0))
    assert net is None and {r.lang_pred for r in langid.identify(languages, net, names).collect()} == {"und"}
    net, names = langid.fit(languages.where("lang = 'aa'"))
    assert {r.lang_pred for r in langid.identify(languages, net, names).collect()} == {"aa"}


def test_every_byte_lies_in_a_window():
    raw = np.arange(1, 256, dtype=np.uint8)
    offsets = np.array([0, 0, 1, 130, 255])
    windows, row, own = bytecnn.windows_of(raw, offsets, 64, 48, 5)
    for k in range(4):
        assert set(windows[row == k].ravel().tolist()) - {0} == set(raw[offsets[k] : offsets[k + 1]].tolist())
    assert own.sum() >= 255 and (np.bincount(row) > 0).all()


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    widths = (6, 4, 2)
    net = bytecnn.train(rng.integers(0, 256, (30, 69)).astype(np.uint8), rng.integers(0, 2, 30), 2, widths, count=3, steps=5, epochs=1)
    windows = rng.integers(0, 256, (7, 69)).astype(np.uint8)
    direct = []
    for w, f in zip(widths, net.filters, strict=True):
        x = net.embedding[windows]
        direct.append(np.stack([sum(x[:, p + k] @ f[k] for k in range(w)) for p in range(64)]).max(axis=0))
    assert np.allclose(bytecnn.pooled(net, net.tables(), windows, block=3), np.concatenate(direct, axis=1), atol=1e-4)


def test_quality(spark):
    rng = random.Random(2)
    rows = []
    for k in range(160):
        words = prose(rng, "aa", rng.randrange(30, 120))
        rows.append((k, words if k % 2 else words.replace(" ", "### ").upper(), k % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3).cache()
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "label")
    model = quality.fit(docs, labels.where("doc_id % 5 <> 0"))
    found = quality.score(docs, model).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    assert all((r.score > 0.5) == (r.label == 1) for r in found)
    odd = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (None, "ka", 0.0), (4, "ka lo " * 20_000, 0.0)], "doc_id long, text string, score double")
    got = quality.score(odd, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(odd, quality.fit(docs, labels.where("label = 1"))).first().score == 1.0
    assert quality.score(odd, quality.fit(docs, labels.limit(0))).first().score == 0.5


def test_toxicity(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        words = prose(rng, "aa", rng.randrange(40, 200)).split()
        if k % 8 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "Scum!", "awful"]))
        rows.append((k, " ".join(words), int(k % 8 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3).cache()
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "label")
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 1"))
    found = toxicity.score(docs, model).join(labels, "doc_id").where("doc_id % 3 = 1").collect()
    assert all((r.score >= 0.7) == (r.label == 1) for r in found)
    texts = dict((r[0], r[1]) for r in rows)
    for r in found:
        for p in r.passages:
            assert any(w in texts[r.doc_id][p.start : p.end].lower() for w in ("vile", "scum", "awful")) and p.expected <= toxicity.EXPECTED
        assert bool(r.passages) == bool(r.label)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "vile scum awful vile scum", 3), (4, "ka " * 40_000, 4)], "doc_id long, text string, score int")
    got = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert got[None] > 0.7 and max(got[1], got[2], got[4]) < 0.7
    assert toxicity.without_toxic(odd, model).columns == odd.columns and toxicity.without_toxic(odd, model).count() == 3
    assert toxicity.score(odd, toxicity.fit(docs, labels.limit(0))).where("score <> 0").count() == 0


def test_toxicity_scores_do_not_follow_the_bound(spark):
    rng = random.Random(5)
    rows = []
    for k in range(3000):
        words = prose(rng, "aa", 60).split()
        toxic = k % 10 == 0
        # some clean texts quote as much as most toxic ones say, so that the classes overlap
        for _ in range(rng.choice([1, 2, 3]) if toxic else rng.choice([0] * 9 + [1, 2])):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "scum", "awful"]))
        rows.append((k, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3).cache()
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "label")
    whole, thinned = toxicity.fit(docs, labels), toxicity.fit(docs, labels, bound=300)
    got = [np.array([r.score for r in toxicity.score(docs, m).orderBy("doc_id").collect()]) for m in (whole, thinned)]
    share = np.mean([r[2] for r in rows])
    assert abs(got[0].mean() - share) < 0.01 and abs(got[1].mean() - share) < 0.04


def maximal_segments(s):
    """By definition: a best-scoring run, shortest first, then both sides of it."""
    if not any(x > 0 for x in s):
        return []
    n = len(s)
    best = max(((round(sum(s[a:b]), 9), -(b - a), -a, b) for a in range(n) for b in range(a + 1, n + 1)))
    a, b = -best[2], best[3]
    return maximal_segments(s[:a]) + [(a, b)] + [(x + b, y + b) for x, y in maximal_segments(s[b:])]


def test_segments_are_the_maximal_ones():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.choice([-3.1, -1.7, -0.3, 0.9, 2.3, 4.05]) + rng.random() / 100 for _ in range(rng.randrange(1, 14))]
        found = toxicity.segments(np.array(s))
        assert [(a, b) for a, b, _ in found] == maximal_segments(s)
        assert all(abs(sum(s[a:b]) - x) < 1e-9 for a, b, x in found)


def test_empty_tables_repeated_rows_and_ties(spark):
    """Every classifier: an empty table gives no rows, repeated rows get equal scores, without a label there is a score all the same."""
    rng = random.Random(9)
    rows = [(k, prose(rng, "aa" if k % 2 else "bb", 40) + (" vile scum" if k % 5 == 0 else ""), k % 2) for k in range(60)]
    rows += [rows[3]] * 30 + [(None, None, None), (None, "ka lo mi", None), (7, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    docs, labels = df.select("doc_id", "text").withColumn("label", F.lit("mine")).withColumn("n", F.lit(0)), df.select("doc_id", "label")
    for module in (quality, toxicity):
        model = module.fit(docs, labels)
        got = module.score(docs, model).collect()
        assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 3}) == 1 and all(0 <= r.score <= 1 for r in got)
        assert module.score(docs.limit(0), model).count() == 0
        again = module.fit(docs.repartition(7), labels.repartition(2))
        assert [r.score for r in module.score(docs, again).orderBy("doc_id", "score").collect()] == pytest.approx([r.score for r in module.score(docs, model).orderBy("doc_id", "score").collect()])
        assert module.score(docs, module.fit(docs.limit(0), labels)).count() == len(rows)
    assert toxicity.without_toxic(docs.limit(0), toxicity.fit(docs, labels)).count() == 0
    known = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "bb").otherwise("aa"))
    net, names = langid.fit(known)
    got = langid.identify(docs, net, names).collect()
    assert names == ["aa", "bb"] and len(got) == len(rows) and len({(r.lang_pred, r.score) for r in got if r.doc_id == 3}) == 1


def test_letters_are_those_of_unicode():
    assert all(langid.has_letter(t) for t in ("a", "1é", "ß", "日", "ª", "ʰ"))
    assert not any(langid.has_letter(t) for t in (None, "", "5²", "½", "①", "12 !?", "_", "́"))


def test_samples_are_bounded_whatever_the_ids(spark):
    """Rows without ids, and rows that repeat one id, are sampled like others."""
    from tessera.llm.common import labelled_sample, weighted_sample

    made = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("x").alias("lang"))
    rows, stands_for = weighted_sample(made, ["doc_id", "text"], 100, "lang")
    assert 60 < rows.count() < 140 and stands_for["x"] == pytest.approx(30, rel=1e-3)
    same = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 2000).alias("text"))
    rows, stands_for = labelled_sample(same, spark.createDataFrame([(1, 1)], "doc_id long, label int"), 100)
    assert 60 < rows.count() < 140 and stands_for[1] == pytest.approx(20, rel=1e-3)


def plain_pooled(net, data, size):
    """Best response of each filter over `size` places, byte by byte; zeros follow the data."""
    padded = list(data) + [0] * (size + net.reach)
    out = []
    for f in net.filters:
        for c in range(f.shape[2]):
            out.append(max(sum(float(net.embedding[padded[p + k]] @ f[k, :, c]) for k in range(f.shape[0])) for p in range(size)))
    return np.array(out)


def plain_windows(data, size, step, reach):
    """(bytes with what follows, own bytes) of windows that cover the data."""
    starts = [0]
    while starts[-1] + size < len(data):
        starts.append(starts[-1] + step)
    return [(data[s : min(len(data), s + size + reach)], max(1, min(size, len(data) - s))) for s in starts]


def plain_logits(net, pooled):
    return np.maximum(pooled + net.bias, 0) @ net.dense + net.offset


def small_net(classes, dtype=np.float32):
    rng = np.random.default_rng(8)
    widths, count, dims = (6, 4, 2), 2, 3
    return bytecnn.ByteCNN(
        widths, rng.normal(size=(256, dims)).astype(dtype), [rng.normal(size=(w, dims, count)).astype(dtype) for w in widths],
        rng.normal(size=6).astype(dtype), rng.normal(size=(6, classes)).astype(dtype), rng.normal(size=classes).astype(dtype),
    )


TEXTS = ["short", "exactly " * 32, "x" * 257, "Ünïcode text, 12 and more of it. " * 30, "a b " * 300, "é" * 128]


def test_languages_against_plain_convolution(spark):
    net, names = small_net(3), ["aa", "bb", "cc"]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(df, net, names).collect()}
    for k, text in enumerate(TEXTS):
        folded = bytes(langid._FOLD[np.frombuffer(text.encode(), np.uint8)])
        parts = plain_windows(folded, langid.SIZE, langid.SIZE, net.reach)
        z = sum(plain_logits(net, plain_pooled(net, data, langid.SIZE)) * own for data, own in parts) / sum(own for _, own in parts)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[k].lang_pred == names[int(p.argmax())] and got[k].score == pytest.approx(p.max(), abs=1e-4)


def test_quality_against_plain_convolution(spark):
    net = small_net(2)
    rng = np.random.default_rng(9)
    model = {"net": net, "centre": rng.normal(size=9), "scale": rng.random(9) + 1, "weights": rng.normal(size=10) / 5}
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    for k, text in [*enumerate(TEXTS), (99, "")]:
        parts = plain_windows(text.encode(), quality.SIZE, quality.STEP, net.reach)
        pooled = [plain_pooled(net, data, quality.SIZE) for data, _ in parts]
        odds = [float(np.diff(plain_logits(net, x))[0]) for x in pooled]
        mean = sum(o * own for o, (_, own) in zip(odds, parts, strict=True)) / sum(own for _, own in parts)
        f = np.array([mean, max(odds), min(odds), *np.maximum(np.max(pooled, axis=0) + net.bias, 0)])
        z = (f - model["centre"]) / model["scale"] @ model["weights"][:-1] + model["weights"][-1]
        assert got[k] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def plain_toxicity(rows):
    """rows (text, label) -> score of a text, by the description: counts, segments, extreme values, logistic curve."""
    words = lambda t: [w for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
    docs = (sum(y for _, y in rows), sum(1 - y for _, y in rows))
    counts = {}
    for text, y in rows:
        for w in set(words(text)):
            t, c = counts.get(w, (0, 0))
            counts[w] = (t + y, c + 1 - y)
    share = docs[0] / sum(docs)
    counts = {w: (t, c) for w, (t, c) in counts.items() if t + c >= 3 and abs(t - (t + c) * share) > 2 * math.sqrt((t + c) * share * (1 - share))}

    def weight(w, out=None):
        if w not in counts:
            return -toxicity.DRIFT
        (t, c), (a, b) = counts[w], docs
        if out is not None:
            t, c, a, b = t - out, c - (1 - out), a - out, b - (1 - out)
        odds = math.log((t + 0.5) / (a + 1)) - math.log((c + 0.5) / (b + 1))
        left = abs(odds) - toxicity.ERRORS * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        return math.copysign(left, odds) if left >= toxicity.LEAST else -toxicity.DRIFT

    def found(text, out=None):
        s = [weight(w, out) for w in words(text)]
        return s, [sum(s[a:b]) for a, b in maximal_segments(s)]

    seen = [(y, *found(t, y)) for t, y in rows]
    clean = [round(x, 3) for y, s, _ in seen if y == 0 for x in s]
    below = [x for x in clean if x < 0]
    cells = [x for x in clean if x > 0] + [sum(below) / len(below)] * len(below)
    if sum(cells) < 0:
        lo, hi = 1e-6, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.mean(np.exp(mid * np.array(cells))) < 1 else (lo, mid)
        rate = min(hi, 1.0)
    else:
        rate = 1e-3
    best = [len(s) * math.exp(-rate * max(g, default=0.0)) for y, s, g in seen if y == 0 and s]
    scale = len(best) / sum(best)

    def statistic(s, g):
        normal = sorted((rate * x - math.log(scale * len(s)) for x in g), reverse=True)
        top = 0.0
        for r in range(1, len(normal) + 1):
            if normal[r - 1] <= 0:
                break
            total = sum(normal[:r])
            top = max(top, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
        return math.log1p(max(normal[0], 0.0) if normal else 0.0), math.log1p(top)

    x = np.array([[*statistic(s, g), 1.0] for _, s, g in seen])
    y = np.array([y for y, _, _ in seen])
    w = np.zeros(3)
    for _ in range(300):  # damped Newton steps on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.array([0.1, 0.1, 1e-6])
        w -= 0.5 * np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return lambda text: 1 / (1 + math.exp(-float(np.array([*statistic(*found(text)), 1.0]) @ w)))


def test_toxicity_against_plain_python(spark):
    rng = random.Random(17)
    rows = []
    for k in range(240):
        words = prose(rng, "aa", rng.randrange(5, 30)).split()
        for _ in range(rng.choice([1, 2, 3]) if k % 6 == 0 else rng.choice([0, 0, 0, 0, 1])):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "scum", "awful"]))
        rows.append((k, " ".join(words), int(k % 6 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "label"))
    score = plain_toxicity([(t, y) for _, t, y in rows])
    for r in toxicity.score(df.select("doc_id", "text"), model).collect():
        assert r.score == pytest.approx(score(rows[r.doc_id][1]), abs=2e-3)
