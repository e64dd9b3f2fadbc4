"""Quality rules, language ID, classifier, language model: brute force, held-out accuracy, edges."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import attention, bayes, compression, resampling
from pagemill.llm.queries import QUERIES

BLANK = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in BLANK:
            out, word = (out + [word] if word else out), ""
        else:
            word += c
    return out + [word] if word else out


def plain_base(text):
    words = words_of(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = Counter(windows)
    hit = {k for i, w in enumerate(windows) if twice[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_op2_against_brute_force(spark, sf, documents):
    rows = {r.doc_id: r for r in QUERIES["op2_compression"](spark, sf).collect()}
    for d in documents.collect():
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(d.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    fine = [rows[i].kept for i, (q, t) in labels.items() if q == 1 and not rows[i].base_failed]
    assert np.mean(fine) > 0.98


def test_bands_reject_repetition_and_noise():
    import zstandard

    given = random.Random(1)
    judge = lambda t: compression.judged(t, zstandard.ZstdCompressor(level=3))[-1]
    prose = " ".join(given.choice(["river", "mill", "village", "nobody", "knew", "stone", "bridge", "water", "often", "under"]) + given.choice(["", "s", "ed", "ing"]) + str(given.randrange(30)) for _ in range(900))
    assert judge(prose) == "kept"
    assert judge("".join(given.choice([chr(c) for c in range(0x4E00, 0x9000)]) + " " * (i % 40 == 0) for i in range(6000))) == "incompressible"
    assert judge(" ".join(f"same{i % 7}" for i in range(25)) * 30) in ("repetitive", "base")
    half = "".join(given.choice([chr(c) for c in range(0x100, 0x9000)]) for _ in range(9000)) + " a" * 3
    assert judge(half + prose) in ("incompressible", "chunks")


def test_op2_edges(edges, empty):
    rows = compression.compression_rules(edges).collect()
    assert len(rows) == edges.count()
    for r in rows:
        if r.doc_id in (3, 4, 5, 8):
            assert not r.kept and r.base_failed and (r.n_words, r.n_dup_lines, r.n_repeat_words) == (int(r.doc_id == 8), 0, 0)
    assert compression.compression_rules(empty).count() == 0


def held_out(i, folds):
    return zlib.crc32(str(i).encode()) % folds == 2


def test_op7_held_out_accuracy(spark, sf, documents):
    lang = {r.doc_id: r.lang for r in documents.collect()}
    rows = QUERIES["op7_language"](spark, sf).collect()
    assert all(r.held_out == held_out(r.doc_id, 4) and 0 <= r.score <= 1 for r in rows) and len(rows) == len(lang)
    own = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(own) > 20 and np.mean(own) > 0.97


def test_op7_against_plain_counts(spark):
    rows = [("abc abd", "p"), ("abc", "p"), ("xyz xyw", "q"), (None, "q"), ("zzz", None), ("123", "q")]
    model = bayes.fit(spark.createDataFrame(rows, "text string, label string")).value
    letters, counts = bayes.letters_table(), {}
    for text, label in rows:
        if text and label:
            c = counts.setdefault(label, Counter())
            c.update(bayes.ngram_buckets(text, letters).tolist())
    assert model.labels == ["p", "q"] and np.allclose(np.exp(model.prior), [2 / 3, 1 / 3])
    for k, label in enumerate(model.labels):
        total = sum(counts[label].values()) + bayes.SMOOTHING * (1 << bayes.BITS)
        for b, n in counts[label].items():
            assert math.isclose(model.matrix[b, k], math.log((n + bayes.SMOOTHING) / total), rel_tol=1e-5)
    assert bayes.classify("abcabd", model, letters)[0] == "p"


def test_op7_edges(spark, edges, empty):
    model = bayes.fit(edges.selectExpr("text", "lang AS label"))
    rows = bayes.predicted(edges, model).collect()
    assert len(rows) == edges.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (3, 4, 5))
    assert {r.lang_pred for r in rows if r.doc_id == 1} == {"en"}
    nothing = bayes.fit(empty.selectExpr("text", "lang AS label"))
    assert {r.lang_pred for r in bayes.predicted(edges, nothing).collect()} == {"und"}
    assert bayes.predicted(empty, model).count() == 0


def test_op8_keeps_target_and_drops_the_rest(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op8_resampling"](spark, sf).collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert len(rows) == len(kept) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([kept[i] for i, good in labels.items() if good]) > 0.93
    assert np.mean([kept[i] for i, good in labels.items() if not good]) < 0.35


def test_weights_against_a_loop():
    given = random.Random(2)
    docs = [[given.choice([b"a", b"b", b"Of", b"!!", b"x9"]) for _ in range(n)] for n in (0, 1, 2, 7, 100)]
    table = np.random.default_rng(0)
    ratios = resampling.Ratios(table.integers(-9, 9, 1 << resampling.BITS), table.integers(-9, 9, 1 << resampling.BITS))
    for passage, worst in ((1, 2), (3, 2), (8, 1)):
        want = []
        for d in docs:
            _, word, shape = resampling.features([d])
            each = [int(ratios.word[w] + ratios.shape[s]) for w, s in zip(word, shape)]
            sums = sorted(sum(each[i : i + passage]) for i in range(0, len(each), passage))
            want.append(sum(sums[:worst]) / resampling.UNIT)
        assert resampling.weights(docs, ratios, passage, worst).tolist() == want


def test_op8_long_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    long = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len((r.text or "").split()) > 3000}
    rows = QUERIES["op8_resampling"](spark, sf).collect()
    assert [r.doc_id for r in rows if r.doc_id in long and labels.get(r.doc_id) and not r.kept] == []
    assert np.mean([r.kept for r in rows if labels.get(r.doc_id)]) > 0.98
    assert np.mean([r.kept for r in rows if labels.get(r.doc_id) is False]) < 0.12
    assert np.mean([not r.kept for r in rows if r.doc_id in long]) < 0.3  # some of the unlabelled ones are bad


def test_weight_is_of_the_whole_text():
    word, shape = np.zeros(1 << resampling.BITS, np.int64), np.zeros(1 << resampling.BITS, np.int64)
    odd, fine, poor = b"odd", b"fine", b"poor"
    for w, v in ((odd, -6), (fine, 0.5), (poor, -0.5)):
        word[resampling.features([[w]])[1]] = int(v * resampling.UNIT)
    ratios = resampling.Ratios(word, shape)
    of = lambda *docs: resampling.text_weights(list(docs), ratios)
    short, long, empty = of([odd] * 2 + [fine] * 20, [odd] * 2 + [fine] * 5000, [])
    assert short < long and long > 0 and empty == 0
    a, b = of([odd] * 2 + [fine] * 300, [odd] * 2 + [poor] * 300)  # the words besides the worst count
    assert a > b
    some = [odd] * 4 + [fine] * 300 + [poor] * 90
    assert math.isclose(of(some)[0], (4 * (-6 + resampling.STEEP * -5) + 150 - 45) / (394 + resampling.NEUTRAL))


def test_kth_largest(spark):
    given = random.Random(5)
    values = [given.choice([given.gauss(0, 1), 3.25, given.random() * 1e-9]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 700, 1500, 3000):
        assert resampling.kth_largest(df, "v", k, most=50, bins=16) == ordered[k - 1]
    assert resampling.kth_largest(df, "v", 0) == np.inf
    assert resampling.kth_largest(df.limit(0), "v", 4) == -np.inf


def test_best_cut():
    assert resampling.best_cut(np.array([1.0, 2, 5, 6]), np.array([False, False, True, True])) == 3.5
    assert resampling.best_cut(np.array([1.0, 2]), np.array([True, True])) == -np.inf


def test_op8_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (None, 1, 0), (6, None, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    rows = resampling.quality(edges, labels).collect()
    assert len(rows) == edges.count() and all(r.weight == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert all(r.kept for r in resampling.quality(edges, labels.limit(0)).collect())
    drawn = resampling.resampled(edges, labels)
    assert drawn.columns == edges.columns
    assert resampling.quality(empty, labels).count() == 0 and resampling.resampled(empty, labels).count() == 0


def test_op9_base_score_and_counts(spark, sf, documents):
    texts = {r.doc_id: words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)) for r in documents.collect()}
    counts, train = Counter(), 0
    for i, words in texts.items():
        if not held_out(i, 7):
            counts.update(words)
            train += 1
    n, v = sum(counts.values()) + train, len(counts) + 1
    for head in (attention.HEAD, 50):  # counts broadcast, and most of them joined
        made = attention.language_model_scores(documents, spark_held_out(), head=head, rounds=1).collect()
        assert len(made) == len(texts)
        for r in made:
            words = texts[r.doc_id]
            want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((train + 1) / (n + v + 1))
            assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.train_tokens == n
            assert (r.n_tokens, r.n_known) == (len(words) + 1, sum(counts[w] > 0 for w in words) + 1)


def spark_held_out():
    from pagemill.llm.queries import held_out

    return held_out(7)


def test_attention_gradients_and_learning():
    given = np.random.default_rng(0)
    classes = attention.Classes.of(given.integers(0, 1000, 5000).astype(float))
    w = {k: v.astype(float) for k, v in attention.begun(classes).items()}
    inputs = given.integers(0, attention.INPUTS, (2, attention.SPAN))
    inputs[0, :9] = attention.INPUTS - 1
    targets = given.integers(0, attention.CLASSES, 2 * attention.STRIDE)
    real = np.ones(len(targets))
    real[-3:] = 0
    _, g = attention.gradients(w, inputs, targets, real)
    for name in w:
        flat = np.argsort(-np.abs(g[name]), axis=None)[:2]
        for at in (np.unravel_index(i, w[name].shape) for i in flat):
            held = w[name][at]
            w[name][at] = held + 1e-5
            up = attention.gradients(w, inputs, targets, real)[0]
            w[name][at] = held - 1e-5
            down = attention.gradients(w, inputs, targets, real)[0]
            w[name][at] = held
            assert math.isclose((up - down) / 2e-5, g[name][at], rel_tol=1e-3, abs_tol=1e-8)


def test_attention_is_causal_and_sums_to_one():
    given = np.random.default_rng(1)
    classes = attention.Classes.of(given.integers(0, 50, 4000).astype(float))
    w = attention.begun(classes)
    inputs = given.integers(0, attention.INPUTS - 1, (1, attention.SPAN))
    z, _ = attention.forward(w, inputs)
    later = inputs.copy()
    later[0, -1] = (later[0, -1] + 1) % 100
    other, _ = attention.forward(w, later)
    assert np.allclose(z[:-1], other[:-1], atol=1e-6) and not np.allclose(z[-1], other[-1], atol=1e-6)
    every = np.arange(4000)
    each = attention.outputs(w, np.repeat(z[:1], 4000, 0), classes.classes[every])[0] + classes.within[every]
    assert math.isclose(np.exp(each.astype(float)).sum(), 1, rel_tol=1e-3)


def test_folded_scores_equal_plain_ones():
    given = np.random.default_rng(2)
    classes = attention.Classes.of(given.integers(0, 50, 4000).astype(float))
    for factor in (1, 30, 400):
        w = {k: (v * np.float32(factor)) for k, v in attention.begun(classes).items()}
        inputs = given.integers(0, attention.INPUTS - 1, (9, attention.SPAN))
        inputs[0, :16] = inputs[3, :7] = attention.INPUTS - 1
        targets = given.integers(0, attention.CLASSES, 9 * attention.STRIDE)
        want = attention.outputs(w, attention.forward(w, inputs)[0], targets)[0]
        got = attention.class_scores(attention.folded(w), inputs, targets)
        assert np.isfinite(got).all() and np.allclose(got, want, rtol=2e-3, atol=2e-3 * factor)


@pytest.fixture(scope="module")
def subwords():
    return attention.Subwords(attention.load_vocabulary(attention.VOCABULARY))


def test_windows_score_each_token_once(subwords):
    given = random.Random(3)
    found = [[given.choice([b"the", b"erlyat,", "été".encode(), b"x" * 700]) for _ in range(n)] for n in (0, 1, 15, 16, 17, 200)]
    _, tokens, sizes, _ = subwords.sequences(found)
    ids, text = subwords.windows(tokens, sizes)
    start = 0
    for k, size in enumerate(sizes):
        own = tokens[start : start + size]
        start += size
        assert own[0] == subwords.begin and own[-1] == subwords.end
        targets = ids[text == k][:, attention.STRIDE + 1 :].ravel()
        assert targets[targets != subwords.pad].tolist() == own[1:].tolist()
        assert own[1:-1].tolist() == [t for w in found[k] for t in subwords.subwords(" " + w.decode())]


def test_every_token_trains(subwords):
    import pyarrow as pa
    from types import SimpleNamespace

    given = random.Random(4)
    own = [" ".join(given.choice(["the", "erlyat,", "été", "mill"]) for _ in range(n)) for n in (0, 1, 15, 16, 40, 900)]
    run = attention._learn(SimpleNamespace(value=attention.load_vocabulary(attention.VOCABULARY)), attention.WINDOW_SHARE)
    rows = [r for b in run(iter([pa.RecordBatch.from_pydict({"text": own})])) for r in b.to_pylist() if r["kind"] == "x"]
    trained = sorted(t for r in rows for t in r["tokens"][attention.STRIDE + 1 :] if t != subwords.pad)
    _, tokens, _, _ = subwords.sequences([attention.split_words(t) for t in own])
    assert trained == sorted(tokens[tokens != subwords.begin].tolist())


def test_score_is_the_sum_of_the_tokens(subwords):
    """Scoring text by text, token by token, gives what batched scoring gives."""
    found = [attention.split_words("One two three, " * 20), [], attention.split_words("été the of")]
    _, tokens, sizes, _ = subwords.sequences(found)
    classes = attention.Classes.of(np.bincount(tokens[tokens <= subwords.end], minlength=subwords.end + 1).astype(float))
    w = attention.begun(classes)
    ids, text = subwords.windows(tokens, sizes)
    got = attention.log10_scores(w, classes, ids, text, len(found))
    begins = np.cumsum(sizes) - sizes
    for k, size in enumerate(sizes):
        own, total = tokens[begins[k] : begins[k] + size], 0.0
        for t in range(1, size):
            first = max(0, (t - 1) // attention.STRIDE * attention.STRIDE - attention.STRIDE)
            x = w["embed"][classes.inputs[own[first:t]]].astype(float)
            key, value, query = x @ w["key"], x @ w["value"], x[-1] @ w["query"]
            s = key @ query * attention.WIDTH**-0.5 + w["near"][np.arange(len(x))[::-1]]
            a = np.exp(s - s.max())
            z = x[-1] + (a / a.sum()) @ value @ w["mix"]
            total += attention.outputs(w, z[None, :], classes.classes[own[t : t + 1]])[0][0] + classes.within[own[t]]
        assert math.isclose(got[k], total / math.log(10), rel_tol=1e-4)


def test_equal_texts_score_alike_in_any_company(subwords):
    """To the last bit, whatever is scored together with them, and however many windows at once."""
    given = random.Random(8)
    own = [attention.split_words(" ".join(given.choice(["the", "erlyat,", "été", "mill", "x"]) for _ in range(n))) for n in (0, 0, 1, 15, 40, 900, 9000)]
    _, tokens, _, _ = subwords.sequences(own)
    classes = attention.Classes.of(np.bincount(tokens[tokens <= subwords.end], minlength=subwords.end + 1).astype(float))
    w = attention.begun(classes)

    def scores(found):
        _, tokens, sizes, _ = subwords.sequences(found)
        ids, text = subwords.windows(tokens, sizes)
        return attention.log10_scores(w, classes, ids, text, len(found)).tolist()

    alone = [scores([words])[0] for words in own]
    for company in range(1, 40):
        many = given.choices(range(len(own)), k=company)
        assert scores([own[i] for i in many]) == [alone[i] for i in many]


def test_op9_edges(spark, edges, empty):
    from pyspark.sql import functions as F

    rows = attention.language_model_scores(edges, F.lit(False), rounds=1).collect()
    assert len(rows) == edges.count()
    ends = {(r.base_score, r.score, r.n_tokens) for r in rows if r.doc_id in (3, 4, 5)}
    assert len(ends) == 1 and next(iter(ends))[2] == 1
    nothing = attention.language_model_scores(edges, F.lit(True), rounds=1).collect()
    assert len(nothing) == edges.count() and {(r.train_tokens, r.n_known) for r in nothing} == {(0, 0)}
    assert attention.language_model_scores(empty, F.lit(False), rounds=1).count() == 0
