import random

import numpy as np

from ledger_analytics.llm import toxicity


def test_score_does_not_depend_on_the_cut_of_a_class(spark, docs_of):
    rng = random.Random(7)
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(plain) for _ in range(20)]
        if i % 10 == 0:
            words[3] = words[9] = "stupid"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 10 == 0 or i % 30 == 1)))  # a few are toxic without a hit
    docs, labels = docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = docs_of([(0, "wak wbl wcm")])
    whole, cut = (toxicity.train(docs, labels, rows=n) for n in (5000, 150))
    a, b = (toxicity.with_toxicity(probe, m).first().toxicity for m in (whole, cut))
    assert 0.02 < a < 0.06 and abs(a - b) < 0.03
    # without terms: the ratio of all labels
    same = docs_of([(i, "wak wbl") for i in range(1500)])
    model = toxicity.train(same, labels, rows=50)
    toxic = labels.where("toxic = 1").count()
    assert not model.terms and np.isclose(model.bias, np.log(toxic / (1500 - toxic)))


def test_apostrophes_within_words_are_no_quotation():
    machine = toxicity.automaton(["stupid"], [False])
    texts = ["she said you're so stupid that's all", "m’as dit stupid j’ai", "he wrote 'stupid' here", "the word ‘stupid’", "said x'", "stupid y"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), off, machine, np.array([False]))
    quoted = got[:, toxicity.FEATURES.index("quoted")] > 0
    assert quoted.tolist() == [False, False, True, True, False, False]
    assert (got[:, toxicity.FEATURES.index("exact")] > 0).tolist() == [True, True, False, False, False, True]


def test_a_varied_lexicon_is_learned_whole(spark, docs_of):
    """More abusive words than fit into any short list, each in a few documents."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    make = lambda n: ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(n)]
    bad, plain = make(600), make(300)
    rows, labels = [], []
    for i in range(3600):
        words = [rng.choice(plain) for _ in range(20)]
        toxic = i % 3 == 0
        if toxic:
            j = i // 3
            words[2], words[9], words[15] = bad[j % 600], bad[(7 * j + 1) % 600], bad[(11 * j + 5) % 600]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    model = toxicity.train(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(model.terms) > 400
    probe = [(i, " ".join(rng.choice(plain) for _ in range(20))) for i in range(300)]
    probe += [(1000 + i, " ".join([*(rng.choice(plain) for _ in range(15)), rng.choice(bad), rng.choice(plain)])) for i in range(300)]
    got = {r.doc_id: r.toxicity >= 0.3 for r in toxicity.with_toxicity(docs_of(probe), model).collect()}
    assert sum(got[i] for i in range(300)) < 6 and sum(got[1000 + i] for i in range(300)) > 270


def test_cues_are_parameters(spark, docs_of):
    machine = toxicity.automaton(["stupid"], [False])
    raw = ['ze sprak "een stupid man" toen'.encode()]
    off = np.array([0, len(raw[0])])
    count = lambda **cues: toxicity.features(np.frombuffer(raw[0], np.uint8), off, machine, np.array([False]), **cues)[0]
    quoted, exact = toxicity.FEATURES.index("quoted"), toxicity.FEATURES.index("exact")
    assert count()[exact] > 0 == count()[quoted]
    assert count(quoting=frozenset(["sprak"]))[quoted] > 0
