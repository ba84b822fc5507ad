"""The classifiers' updates against a plain version, ids of other types, the bound on gathered features."""

import math

import numpy as np
import pytest
from test_text_operators import words

from taxolens.llm import linear, op2_quality_classifier, op3_toxicity, op9_chat_format
from taxolens.llm.ftrl import Ftrl


@pytest.mark.parametrize("ftrl", [Ftrl(bits=6, epochs=3), Ftrl(bits=6, alpha=2.0, l1=0.3, l2=0.1, epochs=2, positive=2.0), op3_toxicity.FTRL.__class__(bits=6, l1=1.0, min_updates=90)])
def test_updates_against_a_plain_version(ftrl):
    rng = np.random.default_rng(3)
    rows = [(idx := np.unique(rng.integers(0, 64, 6)), rng.random(len(idx))) for _ in range(30)]
    labels = (rng.random(30) < 0.4).astype(float)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        if i < 64 and abs(z[i]) <= ftrl.l1:
            return 0.0
        free = i == 64
        return -(z[i] - (0 if free else math.copysign(ftrl.l1, z[i]))) / ((ftrl.beta + math.sqrt(n[i])) / ftrl.alpha + (0 if free else ftrl.l2))

    turn = np.random.default_rng(ftrl.seed)
    for _ in range(max(ftrl.epochs, math.ceil(ftrl.min_updates / 30))):
        for r in turn.permutation(30):
            x = {**dict(zip(rows[r][0].tolist(), rows[r][1].tolist())), 64: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - labels[r]) * v * (ftrl.positive if labels[r] else 1)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / ftrl.alpha * w[i]
                n[i] += g * g
    assert np.allclose(ftrl.fit(rows, labels), [weight(i) for i in range(65)], atol=1e-9)


def test_score_is_a_plain_sum(spark):
    """The broadcast form of op3 gives the same as adding the weights of all features of a text."""
    texts = [words(40, i) + (" scum" if i % 3 == 0 else "") for i in range(90)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id bigint, toxic int")
    w = op3_toxicity.fit(docs, labels)
    for r in op3_toxicity.score(docs, w).collect():
        raw = np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8)
        _, idx, _ = op3_toxicity.features(raw, np.array([0, len(raw)]))
        assert math.isclose(r.score, 1 / (1 + math.exp(-(w[idx].sum() + w[-1]))), rel_tol=1e-9)


@pytest.mark.parametrize(("op", "label"), [(op2_quality_classifier, "quality"), (op3_toxicity, "toxic")])
def test_ids_that_are_strings(spark, op, label):
    docs = [(i, words(60, i) + (" scum GOOD scum GOOD" if i % 3 == 0 else "")) for i in range(600)]
    labels = [(i, int(i % 3 == 0)) for i in range(600)]
    text = lambda rows: [(f"d{i}", x) for i, x in rows]
    got = op.classify(spark.createDataFrame(text(docs), "doc_id string, text string"), spark.createDataFrame(text(labels), f"doc_id string, {label} int")).collect()
    assert len(got) == 600 and sum(r.predicted == (int(r.doc_id[1:]) % 3 == 0) for r in got if r.held_out) > 0.95 * sum(r.held_out for r in got)


def test_gathered_features_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, words(50, i)) for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    sample = linear.labelled_sample(labels, "doc_id", "toxic", 100)
    every, _ = linear.collect_features(docs, sample, "doc_id", "text", op3_toxicity.features)
    monkeypatch.setattr(linear, "MAX_FEATURES", 1000)
    some, _ = linear.collect_features(docs, sample, "doc_id", "text", op3_toxicity.features)
    assert 0 < len(some) < len(every) and sum(len(i) for i, _ in some) <= 1000


def test_conversations_with_other_ids_and_their_loss_spans(spark):
    rows = [("a", 0, "user", "hi"), ("a", 1, "assistant", "one </s> two"), ("a", 2, "user", "[INST]"), ("a", 3, "assistant", "é\\"), ("b", 0, "assistant", ""), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    whole = {r.conv_id: r for r in op9_chat_format.formatted(df).collect()}
    assert {r.conv_id for r in op9_chat_format.digests(op9_chat_format.with_probe(df)).collect()} == {"a", "b", None, "-1"}
    for key, r in whole.items():
        said = [op9_chat_format.unescape(r.formatted[a:b]) for a, b in r.loss_spans]
        assert "".join(said) == "".join(t for k, _, role, t in rows if k == key and role == "assistant")
