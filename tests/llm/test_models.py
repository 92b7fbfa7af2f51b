"""Toxicity, line quality and pseudo-likelihood: held-out accuracy and odd inputs."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import line_crf, masked_lm, textbytes, toxicity
from helixframe.llm.base import held_out, training_rows

SMALL = toxicity.Settings(per_class=300, epochs=4, least=2, buckets=1 << 12, batch=64)
ODD = ["id", "score", "held_out", "predicted", "label"]


def corpus(n=500):
    rnd = random.Random(1)
    clean = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(clean) for _ in range(rnd.randint(5, 40))]
        toxic = i % 4 == 0
        if toxic:
            words[rnd.randrange(len(words))] = "grumbix" + rnd.choice(["", "o", "es", "ing", "zzle"])
        junk = i % 3 == 0
        text = " | ".join(words) if junk else " ".join(words).capitalize() + "."
        rows.append((i, text + "\nA plain line that ends well, as lines do.\n" + text))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, documents):
    rows, labels = corpus()
    extra = [(9000, None), (9001, ""), (None, "some words"), (0, rows[0][1])]
    contradicting = [(1, 0, 1), (None, 1, 1), (2, None, None)]
    return documents(rows + extra, *ODD), spark.createDataFrame(labels + contradicting, "doc_id bigint, quality int, toxic int")


def test_training_rows_leave_held_out_ones_alone(tables):
    docs, labels = tables
    rows = training_rows(docs, labels, "toxic", 50)
    picked = {r["_id"] for r in rows.collect()}
    held = {r["doc_id"] for r in docs.where(held_out()).select("doc_id").collect()}
    assert not picked & held and not picked & {1, None} and len(picked) <= 100


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_accuracy(tables, kind):
    docs, labels = tables
    if kind == "toxic":
        scored = toxicity.score(docs, toxicity.train(docs, labels, settings=SMALL))
    else:
        scored = line_crf.score(docs, line_crf.train(docs, labels, settings=line_crf.Settings(per_class=300)))
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and scored.count() == docs.count()
    rows = scored.join(labels.dropna(), "doc_id").where("held_out and doc_id not in (1, 2)").collect()
    assert sum(r["predicted"] == r[kind] for r in rows) >= 0.95 * len(rows) and len(rows) > 50
    assert all(0 <= r["score"] <= 1 for r in scored.collect())


def test_misspelt_words_share_their_n_grams():
    rows, labels = corpus()
    model = toxicity.fit([t for _, t in rows], np.array([x for _, _, x in labels]), SMALL)
    scorer = toxicity.Scorer(model)
    assert scorer.score("a line with grumbixxy in it") > 0.5 > scorer.score("a line with nothing in it")
    assert scorer.score("") < 0.5 and scorer.score(None) == scorer.score("")


def test_without_labels_nothing_is_rejected(spark, tables, documents):
    docs, labels = tables
    none = toxicity.train(docs, labels.limit(0), settings=SMALL)
    assert toxicity.reject_toxic(docs, none).count() == docs.count()
    kept = toxicity.reject_toxic(docs, toxicity.train(docs, labels, settings=SMALL))
    assert kept.columns == docs.columns and kept.where("doc_id >= 9000").count() == 2
    assert toxicity.score(documents([]), none).count() == 0
    assert line_crf.score(documents([]), line_crf.train(docs, labels.limit(0))).count() == 0


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(2)
    emit, move, first = rng.normal(size=(9, 2)), rng.normal(size=(2, 2)), np.array([0, 4, 5, 9])
    got, _, z = line_crf.marginals(emit, move, first)
    total = 0.0
    for low, high in zip(first, first[1:], strict=False):
        n = high - low
        weights = {}
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            weights[code] = np.exp(sum(emit[low + k, y[k]] for k in range(n)) + sum(move[y[k], y[k + 1]] for k in range(n - 1)))
        total += np.log(sum(weights.values()))
        for k in range(n):
            want = sum(w for c, w in weights.items() if (c >> k) & 1) / sum(weights.values())
            assert got[low + k, 1] == pytest.approx(want)
    assert z == pytest.approx(total)


def test_words_and_shingles_of_many_texts():
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("aB \n\té\x0b漢") for _ in range(rnd.randint(0, 30))) for _ in range(200)] + [None, "", "a " * 3000]
    named, at = {}, 0
    for start, data, bounds in textbytes.chunks(pa.array(texts), 64):
        words = textbytes.find_words(data, bounds)
        assert start == at
        for i in range(len(bounds) - 1):
            want = (texts[at] or "").encode().lower().split()
            hashes = words.hash[words.first[i] : words.first[i + 1]].tolist()
            assert len(hashes) == len(want)
            for word, h in zip(want, hashes, strict=True):
                assert named.setdefault(word, h) == h
            at += 1
    assert at == len(texts) and len(set(named.values())) == len(named)


LM = masked_lm.Settings(classes=8, per_class=8, share=2, rounds=3, shard=2_000)


def test_word_order_matters_to_the_score(documents):
    rnd = random.Random(8)
    chain = {w: rnd.sample("abcdefghij", 2) for w in "abcdefghij"}

    def text():
        words = [rnd.choice("abcdefghij")]
        for _ in range(60):
            words.append(rnd.choice(chain[words[-1]]))
        return words

    good = [text() for _ in range(300)]
    mixed = [rnd.sample(w, len(w)) for w in good[:50]]
    rows = [(i, " ".join(w)) for i, w in enumerate(good)]
    docs = documents(rows + [(900, None), (901, ""), (902, "zz"), (None, "a b")], "n_tokens", "log_prob", "id")
    vocab = masked_lm.vocabulary(docs, settings=LM)
    network = masked_lm.train(docs, vocab, settings=LM)
    got = {r["doc_id"]: r for r in masked_lm.score(docs, vocab, network).collect()}
    assert len(got) == 304 and got[0]["n_tokens"] == 61
    assert got[900]["n_tokens"] == 0 and got[900]["log_prob"] == 0 and got[900]["mean_log_prob"] is None
    bad = [r["mean_log_prob"] for r in masked_lm.score(documents([(i, " ".join(w)) for i, w in enumerate(mixed)]), vocab, network).collect()]
    assert np.mean([got[i]["mean_log_prob"] for i in range(50)]) > np.mean(bad) + 0.3
    assert masked_lm.score_corpus(documents([]), settings=LM).count() == 0


def test_words_outside_the_vocabulary_have_their_own_probability(documents):
    listed = " ".join(f"h{i}" for i in range(63))
    rows = [(i, listed) for i in range(40)] + [(100 + i, "h1 mid h2") for i in range(10)]
    rows += [(200, "h1 rare h2"), (201, "h1 odd h2"), (202, None), (None, "h1 mid h2"), (200, "h1 mid h2")]
    docs = documents(rows, "others", "_row")
    vocab = masked_lm.vocabulary(docs, settings=LM)
    network = masked_lm.train(docs, vocab, settings=LM)
    assert vocab.n_rest == 14 and [r["n"] for r in vocab.rest.collect()] == [12]
    got = masked_lm.score(docs, vocab, network).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r["log_prob"] for r in got if r["doc_id"] != 200}
    twice = sorted(r["log_prob"] for r in got if r["doc_id"] == 200)
    assert by_id[100] - twice[0] == pytest.approx(np.log(12), abs=1e-4)
    assert by_id[201] == pytest.approx(twice[0], abs=1e-4)
    assert by_id[None] == pytest.approx(by_id[100], abs=1e-6) == pytest.approx(twice[1], abs=1e-6)
    unseen = masked_lm.score(documents([(1, "h1 nowhere h2")]), vocab, network).first()["log_prob"]
    assert unseen == pytest.approx(twice[0], abs=1e-4)


def test_every_position_trains_with_the_words_around_it(documents):
    rows = [(i, " ".join(f"w{(i + j) % 7}" for j in range(i % 5 + 1))) for i in range(60)]
    docs = documents([*rows, (90, None), (91, "")])
    s = masked_lm.Settings()
    vocab = masked_lm.vocabulary(docs, settings=s)
    blocks = masked_lm.training_positions(docs, vocab, "text", s).collect()
    assert sum(r["n"] for r in blocks) == sum(len(text.split()) for _, text in rows)
    got, want = [], []
    for target, around in [masked_lm._positions([(r["ids"], r["chosen"])], s) for r in blocks]:
        got += np.concatenate([target[:, None], around], axis=1).tolist()
    for _, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        words = textbytes.find_words(data, np.array([0, len(data)]))
        target, around = masked_lm.contexts(words, vocab, np.arange(len(words.hash)), s.side)
        want += np.concatenate([target[:, None], around], axis=1).tolist()
    assert sorted(got) == sorted(want)


def test_probabilities_add_up_to_one():
    network = masked_lm.Network(LM)
    around = np.array([[1, 2, 3, 64]])
    logs = network.log_probs(np.arange(LM.words), np.repeat(around, LM.words, axis=0))
    assert np.exp(logs).sum() == pytest.approx(1.0, abs=1e-4)


def plain_pass(network, targets, around, rng):
    """Network.train as its formulas read: a class at a time, every gradient as an array of its own."""
    p, s = network.parts, network.s

    def softmax(x):
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    seen = {k: np.full_like(v, 1e-2) for k, v in p.items()}
    order = rng.permutation(len(targets))
    for at in range(0, len(order), s.batch):
        rows = order[at : at + s.batch]
        n, ctx = len(rows), around[rows]
        group, word = np.divmod(targets[rows], s.per_class)
        h = np.tanh(sum(p["embed"][ctx[:, k]] * p["place"][k] for k in range(ctx.shape[1])) + p["hidden"])
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        err = softmax(h @ p["group"].T + p["group_bias"])
        err[np.arange(n), group] -= 1
        grad["group"], grad["group_bias"], to_h = err.T @ h, err.sum(axis=0), err @ p["group"]
        for c in np.unique(group):
            own = np.flatnonzero(group == c)
            err = softmax(h[own] @ p["out"][c].T + p["out_bias"][c])
            err[np.arange(len(own)), word[own]] -= 1
            grad["out"][c], grad["out_bias"][c] = err.T @ h[own], err.sum(axis=0)
            to_h[own] += err @ p["out"][c]
        to_x = to_h * (1 - h * h)
        grad["hidden"] = to_x.sum(axis=0)
        for k in range(ctx.shape[1]):
            grad["place"][k] = (to_x * p["embed"][ctx[:, k]]).sum(axis=0)
            np.add.at(grad["embed"], ctx[:, k], to_x * p["place"][k])
        for k, g in grad.items():
            g = g / np.sqrt(n)
            seen[k] += g * g
            p[k] -= s.rate * g / np.sqrt(seen[k])


def positions(s, n):
    """Uneven as words are: some classes have most positions of a batch, some a few, some none."""
    rng = np.random.default_rng(5)
    draw = lambda *shape: np.minimum(rng.zipf(1.3, shape) - 1, s.words - 1)
    around = draw(n, 2 * s.side)
    around[rng.random(around.shape) < 0.05] = s.words
    return draw(n), around


def test_a_pass_takes_the_steps_of_the_formulas():
    for s in (masked_lm.Settings(), masked_lm.Settings(classes=5, per_class=7, width=3, side=1, batch=50)):
        for n in (3 * s.batch, 2 * s.batch + 3, 1):
            targets, around = positions(s, n)
            want, got = masked_lm.Network(s), masked_lm.Network(s)
            for network in (want, got):
                network.parts["out_bias"] += 200  # beyond what float32 can raise e to
                network.parts["group_bias"][0] -= 300
            plain_pass(want, targets, around, np.random.default_rng(2))
            got.train(targets, around, np.random.default_rng(2))
            for name, part in want.parts.items():
                assert got.parts[name] == pytest.approx(part, abs=2e-4), name
    logs = got.log_probs(np.arange(s.words), np.repeat(around, s.words, axis=0))
    assert np.exp(logs).sum() == pytest.approx(1.0, abs=1e-3)


def test_a_pass_is_much_faster_than_a_class_at_a_time():
    s = masked_lm.Settings()
    targets, around = positions(s, 8 * s.batch)

    def seconds(run):
        took = []
        for _ in range(4):
            start = time.perf_counter()
            run(masked_lm.Network(s), targets, around, np.random.default_rng(2))
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(masked_lm.Network.train) < seconds(plain_pass) / 1.6


def test_score_of_a_document_word_by_word(documents):
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(i % 9))) for i in range(40)]
    docs = documents(rows)
    vocab = masked_lm.vocabulary(docs, settings=LM)
    network = masked_lm.train(docs, vocab, settings=LM)
    got = {r["doc_id"]: r["log_prob"] for r in masked_lm.score(docs, vocab, network).collect()}
    p, s = {k: v.astype(float) for k, v in network.parts.items()}, LM
    log_softmax = lambda x: x - np.log(np.exp(x).sum())
    for doc, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        ids = [s.words] * s.side + vocab.lookup(textbytes.find_words(data, np.array([0, len(data)])).hash).tolist() + [s.words] * s.side
        total = 0.0
        for at in range(s.side, len(ids) - s.side):
            near = ids[at - s.side : at] + ids[at + 1 : at + s.side + 1]
            h = np.tanh(sum(p["embed"][w] * p["place"][k] for k, w in enumerate(near)) + p["hidden"])
            c, w = divmod(ids[at], s.per_class)
            total += log_softmax(p["group"] @ h + p["group_bias"])[c] + log_softmax(p["out"][c] @ h + p["out_bias"][c])[w]
        assert got[doc] == pytest.approx(total, abs=1e-3)
