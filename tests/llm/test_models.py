"""LM scoring against enumeration; the toxicity network on held-out documents; the pipeline by stage."""

import math
from collections import Counter
from hashlib import md5
from random import Random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from tessera.llm import lm_score, toxicity
from tessera.llm.digest_index import first_of_each
from tessera.llm.queries import VOCABULARY

from .conftest import DOCS, ODD

R = Random(2)
PIECES = [("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -1.5), ("▁a", -1.0), ("▁ab", -2.2), ("ba", -2.0), ("bab", -3.1), ("▁▁", -4.0), ("ü", -5.0), ("日", -6.0)]


def every_way(text, vocab):
    """log of the sum over all segmentations, by recursion over the whole text."""
    numbers = {lm_score._hash(p): n for n, (p, _) in enumerate(PIECES)}
    logp = {p: vocab.logp[numbers[lm_score._hash(p)]] for p, _ in PIECES}
    symbols = "▁" + text.replace(" ", "▁")
    memo = {len(symbols): 1.0}

    def ways(i):
        if i not in memo:
            total = sum(math.exp(logp[symbols[i:j]]) * ways(j) for j in range(i + 1, min(len(symbols), i + 4) + 1) if symbols[i:j] in logp)
            if symbols[i] not in logp:
                total += math.exp(vocab.logp[vocab.byte] * len(symbols[i].encode())) * ways(i + 1)
            memo[i] = total
        return memo[i]

    return math.log(ways(0))


def test_log_probability_sums_all_segmentations(spark):
    vocab = lm_score.vocabulary(PIECES)
    assert np.exp(vocab.logp[:-2]).sum() + 256 * np.exp(vocab.logp[vocab.byte]) == pytest.approx(1)
    texts = ["abab", "a", "b a", "  a  b ", "zab", "ab\nba", "\n", "ü日zz a", "ab ab\n\n ab", "bab" * 9] + ["".join(R.choice("ab z\nü") for _ in range(R.randrange(1, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in lm_score.score_documents(df, vocab).collect()}
    for i, t in enumerate(texts):
        assert rows[i].logprob == pytest.approx(every_way(t, vocab), rel=1e-9), t
        assert rows[i].bits_per_char == pytest.approx(-rows[i].logprob / math.log(2) / len(t))


def test_corpus_probabilities_are_one_em_step(spark):
    vocab = lm_score.vocabulary(PIECES)
    texts = ["ab ab ba", "bab z", "a a a"]
    got = lm_score.corpus_logp(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocab, prior=10.0)
    uses = np.zeros(len(vocab.logp) - 1)
    eps = 1e-5
    for k in range(len(uses)):  # expected uses are derivatives of the log probability
        bent = vocab.logp[:-1].copy()
        bent[k] += eps
        up = sum(every_way(t, vocab.with_logp(bent)) - every_way(t, vocab) for t in texts)
        uses[k] = up / eps
    own = np.exp(vocab.logp[:-1])
    own[-1] *= 256
    want = (uses + 10 * own) / (uses.sum() + 10)
    want[-1] /= 256
    assert np.exp(got) == pytest.approx(want, rel=1e-3)
    assert np.exp(got[:-1]).sum() + 256 * np.exp(got[-1]) == pytest.approx(1)


def test_public_vocabulary_loads_and_is_normalised():
    v = lm_score.load_vocabulary(VOCABULARY)
    assert np.exp(v.logp[:-2]).sum() + 256 * np.exp(v.logp[v.byte]) == pytest.approx(1)
    likely, unlikely = lm_score.log_probabilities(["the", "xqzjv"], v, [v.logp])[0]
    assert likely > unlikely


def test_lm_odd_rows(odd, empty):
    v = lm_score.load_vocabulary(VOCABULARY)
    rows = lm_score.score_documents(odd, v).collect()
    assert len(rows) == len(ODD) and all((r.logprob is None) == (r.n_chars is None) for r in rows)
    assert [r.logprob for r in rows if r.n_chars == 0] == [0.0]
    assert all(math.isfinite(r.logprob) and r.logprob < 0 for r in rows if r.n_chars)
    assert lm_score.score_documents(empty, v).count() == 0


def labelled(n, seed):
    rng = Random(seed)
    common, bad = [f"w{k}" for k in range(800)], {"en": ["scum", "idiot", "moron", "trash"], "fr": [f"veju{x}" for x in ("ta", "mo", "rit", "ai", "ce")]}
    docs, labels = [], []
    for i in range(n):
        lang, toxic = rng.choice(["en", "fr"]), rng.random() < 0.3
        w = [rng.choice(common) for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad[lang])
        docs.append((i, " ".join(w), lang, "s", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled(1600, 1)
    df = spark.createDataFrame(docs, DOCS)
    truth = {i: t for i, _, t in labels}
    train = spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int")
    found = {r.doc_id for r in toxicity.toxic_documents(df, train).collect()}
    held = range(1000, 1600)
    bad = [i for i in held if truth[i]]
    assert sum(i in found for i in bad) >= 0.95 * len(bad)
    assert sum(i in found for i in held if not truth[i]) <= 0.01 * (len(held) - len(bad))
    kept = toxicity.drop_toxic(df, train)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(truth) - found


def test_network_equals_plain_loops():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, toxicity.ROWS, (k, 3)) for k in (1, 2, 7, 30)]
    m = toxicity.train(texts, np.array([0.0, 1.0, 0.0, 1.0], np.float32), epochs=1)
    ids, doc = np.concatenate(texts), np.repeat(np.arange(4), [len(t) for t in texts])
    got = m.pooled(ids, doc, 4)
    for i, t in enumerate(texts):
        x = m.embedding[t].sum(1)
        for at, (w, kernel) in enumerate(zip(toxicity.WIDTHS, m.kernels)):
            for f in range(toxicity.FILTERS):
                best = max((sum(x[p + j] @ kernel[j, :, f] for j in range(w)) for p in range(len(t) - w + 1)), default=-np.inf)
                assert got[i, at * toxicity.FILTERS + f] == pytest.approx(max(0, best + m.biases[at][f]), abs=1e-4)


def test_one_step_follows_the_gradient():
    """The first Adagrad step tells the gradient; it is that of the loss by finite differences."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 40, (k, 3)) for k in (1, 4, 9, 6)]
    y = np.array([0.0, 1.0, 1.0, 0.0], np.float32)
    ids, doc = np.concatenate(texts), np.repeat(np.arange(4), [len(t) for t in texts])
    rate, decay, past = 0.1, 0.0, 1e-2
    start = toxicity.train(texts, y, epochs=0)
    after = toxicity.train(texts, y, epochs=1, rate=rate, decay=decay)

    def loss(m):
        x = m.embedding.astype(np.float64)[ids].sum(1)
        pooled = np.zeros((4, len(m.out)))
        for at, (w, kernel) in enumerate(zip(toxicity.WIDTHS, m.kernels)):
            for i in range(4):
                own = x[doc == i]
                if len(own) >= w:
                    r = [sum(own[p + j] @ kernel[j].astype(np.float64) for j in range(w)) for p in range(len(own) - w + 1)]
                    pooled[i, at * toxicity.FILTERS : (at + 1) * toxicity.FILTERS] = np.maximum(np.max(r, axis=0) + m.biases[at], 0)
        z = pooled @ m.out + m.bias
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    def slope(array, place, eps=2e-3):
        old = array[place].copy()
        array[place] = old + eps
        up = loss(start)
        array[place] = old - eps
        down = loss(start)
        array[place] = old
        return (up - down) / (2 * eps)

    def gradient(moved, size):
        return moved * np.sqrt(past) / np.sqrt(np.maximum(rate**2 - size**2, 1e-12))

    checked = 0
    pairs = [(start.out, after.out), *zip(start.kernels, after.kernels), *zip(start.biases, after.biases)]
    for old, new in pairs:
        moved = (old - new).astype(np.float64)
        for place in list(np.ndindex(old.shape))[:: max(1, old.size // 12)]:
            want = slope(old, place)
            assert gradient(moved[place], abs(moved[place])) == pytest.approx(want, abs=2e-3, rel=0.1)
            checked += abs(want) > 1e-3
    rows = np.unique(ids)
    for r in rows[:12]:
        moved = (start.embedding[r] - after.embedding[r]).astype(np.float64)
        for d in (0, 5):
            want = slope(start.embedding, (r, d))
            assert gradient(moved[d], np.linalg.norm(moved)) == pytest.approx(want, abs=2e-3, rel=0.1)
            checked += abs(want) > 1e-3
    assert checked > 20


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    docs = [(i, f"t{i} " * (1000 if i % 5 == 0 else 10), "en", "s", 1) for i in range(200)]
    docs += docs[:100] * 3 + [(7, "another text of the same id", "en", "s", 1), (None, "no id", "en", "s", 1), (8, None, "en", "s", 1)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, DOCS)
    size = lambda rows, c: sum(len(r["text"]) for r in rows if r["toxic"] == c)
    every = toxicity.training_rows(df, labels, {0: 999, 1: 999}, 1 << 30, "x").to_pylist()
    assert Counter(r["doc_id"] for r in every) == Counter([*range(200), 7])
    few = toxicity.training_rows(df, labels, {0: 30, 1: 40}, 9000, "x").to_pylist()
    assert Counter(r["toxic"] for r in few)[0] <= 30 and Counter(r["toxic"] for r in few)[1] <= 40 and max(size(few, 0), size(few, 1)) <= 9000
    text = {(r[0], r[1]) for r in docs}
    assert all((r["doc_id"], r["text"]) in text for r in few) and few == toxicity.training_rows(df.repartition(3), labels, {0: 30, 1: 40}, 9000, "x").to_pylist()


def test_every_labelled_row_trains_or_calibrates(spark, monkeypatch):
    """More rows of either class than a sample held before; each is a word of its own, whose row of the embedding tells whether it was trained on."""
    n = 13_200
    words = [md5(str(i).encode()).hexdigest()[:10] for i in range(n)]
    docs = spark.createDataFrame([(i, w, "en", "s", 1) for i, w in enumerate(words)], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i < 5200)) for i in range(n)], "doc_id long, quality int, toxic int")
    seen, plain = [], toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda held, *rest: seen.append(len(held) if isinstance(held, np.ndarray) else held.count()) or plain(held, *rest))
    model = toxicity.fit(docs, labels)
    start = toxicity.train([np.zeros((1, 3), np.int64)], np.ones(1, np.float32), epochs=0)
    rows = toxicity.word_ids(pa.array(words))[0][:, 0]
    assert seen == [n // 4]
    assert (model.embedding[rows] != start.embedding[rows]).any(1).mean() > 0.74


def test_lanes_hold_each_labelled_row_once(spark, odd):
    docs, labels = labelled(300, 8)
    docs += docs[:50] * 2 + [(7, "another text of the same id", None, "s", 1), (None, "no id", "en", "s", 1), (8, " ... ", "en", "s", 1), (9, docs[9][1], "aa", "s", 1)]
    train = spark.createDataFrame([*labels[:200], (3, 0, 1), (250, 1, None), (None, 1, 1), (251, 1, 7)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, DOCS)
    lanes = toxicity.lanes_of(df, train, "x", 40, 1 << 20)
    truth = {i: t for i, _, t in labels[:200]} | {3: 1}
    want = {}
    for i, text, lang, _, _ in docs:
        if i in truth and text.strip(" ."):
            want[i, text] = min((lang or "~", want.get((i, text), "~")))
    got = Counter()
    for r in lanes.collect():
        ends = np.cumsum(np.frombuffer(r["length"], np.int64))
        words = np.split(np.frombuffer(r["words"], np.uint16).reshape(-1, 3), ends[:-1])
        assert len(ends) == r.bad + r.clean and sum(r["toxic"]) == r.bad
        got.update((w.tobytes(), t, x or "~") for w, t, x in zip(words, r["toxic"], r["lang"]))
    assert got == Counter(((toxicity.word_ids(pa.array([text]))[0] - toxicity.BASE).astype(np.uint16).tobytes(), truth[i], lang) for (i, text), lang in want.items())
    assert lanes.count() > 3 and lanes.count() == lanes.select("lane").distinct().count()
    # the model doesn't hang on partitions
    one, two = (toxicity.fit(x, train, epochs=2, lane_rows=40) for x in (df, df.repartition(7)))
    assert (one.embedding == two.embedding).all() and one.thresholds == two.thresholds and one.bias == two.bias


def test_thresholds_equal_those_of_sorted_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(lang, t, np.float32(1 / (1 + np.exp(-rng.normal(2 * t - 1, 1.5))))) for lang, n in (("en", 900), ("fr", 300), (None, 60), ("", 30), ("de", 25)) for t in rng.integers(0, 2, n).tolist()]
    rows += [("en", 1, np.float32(1)), ("en", 0, np.float32(0))] * 3

    def cut(own):
        clean, bad = (sorted(float(p) for _, t, p in own if t == c) for c in (0, 1))
        low = clean[max(0, len(clean) - 1 - int(0.05 * len(clean)))]
        above = [p for p in bad if p > low]
        logit = lambda p: math.log(max(p, 1e-9) / max(1 - p, 1e-9))
        return min(0.98, max(0.05, 1 / (1 + math.exp(-(logit(low) + logit(above[int(0.02 * len(above))] if above else 1.0)) / 2))))

    held = spark.createDataFrame([(x, t, int(p.view(np.int32))) for x, t, p in rows], "lang string, toxic int, bits int")
    by, common = toxicity.calibrate(held, 0.05)
    groups = {x: [r for r in rows if (r[0] or "") == x] for x in ("en", "fr", "", "de")}
    assert by == pytest.approx({x: cut(g) for x, g in groups.items() if min(sum(t == c for _, t, _ in g) for c in (0, 1)) >= 20}) and common == pytest.approx(cut(rows))
    assert set(by) == {"en", "fr", ""} and toxicity.calibrate(held.filter("toxic = 0")) == ({}, 0.5)


def test_winners_are_the_same_in_pieces():
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 50, (k, 3)) for k in (1, 2, 9, 40, 3)]
    m = toxicity.train(texts, np.array([0.0, 1.0, 0.0, 1.0, 0.0], np.float32), epochs=1)
    ids, doc = np.concatenate(texts), np.repeat(np.arange(5), [len(t) for t in texts])
    pooled, winner = toxicity._winners(m, ids, doc, 5)
    assert pooled == pytest.approx(m.pooled(ids, doc, 5), abs=1e-5) and ((winner >= 0) == (pooled > 0)).all()
    for step in (1, 4, 7):
        in_pieces = toxicity._winners(m, ids, doc, 5, step)
        assert in_pieces[0] == pytest.approx(pooled, abs=1e-6) and (in_pieces[1] == winner).mean() > 0.95


def test_toxicity_odd_rows(spark, odd, empty):
    docs, labels = labelled(300, 3)
    train = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (5, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    both = spark.createDataFrame(docs, DOCS)
    model = toxicity.fit(both, train)
    scored = toxicity.score_documents(odd.drop("toxicity", "toxicity_threshold"), model).collect()
    assert len(scored) == len(ODD) and all(r.toxicity == 0 for r in scored if not (r.text or "").strip())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(odd, none).count() == len(ODD) and toxicity.drop_toxic(empty, train).count() == 0
    assert toxicity.toxic_documents(empty, none).count() == 0
    # odd rows beside documents that the model learns from
    bad = "w1 idiot w2 moron scum w3 trash"
    odd_rows = odd.unionByName(spark.createDataFrame([(None, bad, None, "s", 1), (900, bad, "en", "s", 1), (900, bad, "en", "s", 1), (900, "w1 w2 w3", "en", "s", 1), (901, "w5 " * 90_000 + bad, "xx", "s", 1)], DOCS), allowMissingColumns=True)
    mixed = both.unionByName(odd_rows, allowMissingColumns=True)
    kept = toxicity.drop_toxic(mixed, train)
    assert kept.columns == mixed.columns
    left = Counter((r.doc_id, r.text) for r in kept.collect() if r.doc_id is None or r.doc_id >= 900 or (r.doc_id, r.text) in {x[:2] for x in ODD})
    assert not any(t == bad or (t or "").endswith(bad) for _, t in left) and left[900, "w1 w2 w3"] == 1
    for (i, text), n in Counter(r[:2] for r in ODD).items():
        assert left[i, text] >= n or left[i, text] == 0 and (text or "").strip()  # wordless rows stay, repeated rows go together
    # one document of each class: nothing is held out
    tiny = toxicity.fit(spark.createDataFrame([(1, "w1 idiot", "en", "s", 1), (2, "w1 w2", "en", "s", 1)], DOCS), spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int"))
    assert tiny.thresholds == {} and tiny.default_threshold == 0.5


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    """Each stage on its own input: what goes, goes for its reason, and nothing else does."""
    docs, labels = labelled(500, 4)
    rng = Random(9)
    docs += [(1000 + k, docs[k][1], "en", "t", 1) for k in range(0, 80, 2)]
    docs += [(2000 + k, " ".join("edit" if rng.random() < 0.02 else x for x in docs[k][1].split()), "en", "s", 1) for k in range(0, 60, 3)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    truth = {i: t for i, _, t in labels}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{names.index(name)}")
        out = spark.read.parquet(f"{tmp_path}/{names.index(name)}")
        old = {r.doc_id: r for r in now.collect()}
        if name != "packing":
            assert out.columns == now.columns
        if name == "toxicity":
            gone = set(old) - {r.doc_id for r in out.collect()}
            known = [i for i in old if i in truth]
            assert all(truth[i] for i in gone if i in truth) and sum(i in gone for i in known if truth[i]) > 0.95 * sum(truth[i] for i in known)
        elif name == "exact dedup":
            best = {}
            for i, r in sorted(old.items()):
                best.setdefault(r.text, i)
            assert {r.doc_id for r in out.collect()} == set(best.values())
        elif name == "near dedup":
            kept = {r.doc_id for r in out.collect()}
            assert {i for i in old if i < 1000} <= kept and sum(i >= 2000 for i in set(old) - kept) >= 0.9 * sum(i >= 2000 for i in old)
        elif name == "mixing":
            assert set(r.doc_id for r in out.collect()) <= set(old)
        else:
            size = Counter()
            for r in out.collect():
                size[r.doc_id] += r.n_tokens
            want = Counter()
            for r in now.collect():
                want[r.doc_id] += len(model.encode(r.text))
            assert size == want
        now = out
    assert first_of_each(spark.read.parquet(f"{tmp_path}/documents.parquet")).count() < len(docs)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_pipeline_stages_bear_odd_rows(spark, odd, empty, tmp_path):
    """Null texts and keys, empty and long texts, repeated rows, columns with operators' names, and empty tables, through every stage."""
    docs, labels = labelled(200, 6)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    full = spark.createDataFrame(docs, DOCS).unionByName(odd, allowMissingColumns=True)
    for name, first in (("full", full), ("empty", odd.limit(0)), ("few", odd)):
        now = first
        for k, (stage, function) in enumerate(corpus_pipeline.STAGES):
            out = function(spark, now, str(tmp_path))
            path = f"{tmp_path}/{name}-{k}"
            out.write.parquet(path)
            out = spark.read.schema(out.schema).parquet(path)
            old, new = Counter((r.doc_id, r.text) for r in now.collect()), out.collect()
            if stage != "packing":
                assert out.columns == now.columns
                kept = Counter((r.doc_id, r.text) for r in new)
                assert set(kept) <= set(old)
                if stage in ("toxicity", "exact dedup", "near dedup"):
                    assert all(kept[x] == n for x, n in old.items() if x[1] is None) and sum(n for x, n in kept.items() if x[1] == "") == min(1, sum(n for x, n in old.items() if x[1] == ""))
                if stage == "exact dedup":
                    assert all(n == 1 for x, n in kept.items() if x[1] is not None) and len({t for _, t in kept}) == len({t for _, t in old})
            else:
                assert {r.doc_id for r in new} <= {i for i, _ in old} and bool(new) == (name != "empty")
            now = out
