import random
import zlib

import numpy as np
import pytest
from tessera.llm import nbsvm, queries, toxicity
from tessera.llm.labelled import training_labels


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(n, seed=1):
    turn = random.Random(seed)
    words = ["".join(turn.choices("abcdeé", k=turn.randint(2, 7))) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        w = turn.choices(words, k=turn.randint(20, 60))
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            w = [x + turn.choice(["###", "%%%"]) for x in w]
        if toxic:
            for _ in range(4):
                w[turn.randrange(len(w))] = turn.choice(["zidiot", "zmoron", "zscum"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, make):
    docs, labels = corpus(400)
    odd = [(None, "no id here"), (1000, None), (1001, ""), (1002, " \n"), (1003, "long text " * 20000), (7, docs[7][1])]
    lab = spark.createDataFrame(labels + [(None, 1, 1), (500, None, None), (0, None, None)], "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text", "1 as y")
    return docs + odd, make(docs + odd), lab, {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize("module, column, k", [(nbsvm, "quality", 0), (toxicity, "toxic", 1)])
def test_held_out_accuracy_and_odd_rows(tables, module, column, k):
    docs, df, labels, known = tables
    got = queries._judged(module.score(df, module.fit(df, labels)), 0.5).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    tested = [r for r in got if r.doc_id in known and r.held_out]
    assert sum(r.predicted == known[r.doc_id][k] for r in tested) >= 0.97 * len(tested) > 50
    blank = {r.score for r in got if r.doc_id in (1000, 1001, 1002)}
    assert len(blank) == 1
    assert len({r.score for r in got if r.doc_id == 7}) == 1


def test_held_out_labels_are_never_learnt(spark, tables):
    docs, df, labels, known = tables
    seen = {r.doc_id for r in training_labels(labels, "quality").collect()}
    assert seen == {i for i in known if not held(i)}
    flipped = spark.createDataFrame([(i, 1 - q if held(i) else q, 1 - t if held(i) else t) for i, (q, t) in known.items()], "doc_id long, quality int, toxic int")
    same = spark.createDataFrame([(i, q, t) for i, (q, t) in known.items()], "doc_id long, quality int, toxic int")
    for module, column in ((nbsvm, "quality"), (toxicity, "toxic")):
        a, b = ({(r.doc_id, round(r.score, 9)) for r in module.score(df, module.fit(df, x, column)).collect()} for x in (flipped, same))
        assert a == b


@pytest.mark.parametrize("module, column", [(nbsvm, "quality"), (toxicity, "toxic")])
def test_without_labels_or_rows(spark, make, module, column):
    none = spark.createDataFrame([], f"doc_id long, {column} int")
    one = spark.createDataFrame([(1, 1), (3, 1)], f"doc_id long, {column} int")
    docs = make([(1, "a text"), (3, None)])
    assert {round(r.score, 2) for r in module.score(docs, module.fit(docs, none)).collect()} == {0.5}
    assert len({r.score for r in module.score(docs, module.fit(docs, one)).collect()}) == 1
    assert module.score(make([]), module.fit(make([]), none)).count() == 0


def test_dual_descent_reaches_the_primal_optimum():
    turn = np.random.default_rng(0)
    a = turn.normal(size=(60, 4))
    y = np.where(a @ [1, -2, 0.5, 0] + turn.normal(size=60) > 0, 1.0, -1.0)
    w = nbsvm.hinge_descent([(np.arange(4), r) for r in a], y, np.full(60, 0.5), 4, epochs=500)
    loss = lambda v: v @ v / 2 + 0.5 * np.maximum(0, 1 - y * (a @ v)).sum()
    assert all(loss(w) <= loss(w + d) + 1e-3 for d in 0.05 * turn.normal(size=(200, 4)))


def test_counterfactuals_take_the_weight_of_identity_terms():
    assert toxicity.counterfactual("Hi. The women left. ok", 0, ["women", "men"]) == "Hi. The men left. ok"
    assert toxicity.counterfactual("plain text", 1, ["women", "men"]) == "men plain text"
    # Column 0 is an insult, 1 and 2 name groups; 1 stands in toxic rows only.
    turn = random.Random(3)
    x, y = [], []
    for i in range(200):
        bad = i % 2
        x.append(np.array(sorted({0} if bad else set()) + ([1] if bad and turn.random() < 0.7 else []) + ([2] if turn.random() < 0.2 else []), dtype=np.int64))
        y.append(bad)
    swap = {1: 2, 2: 1}
    change = [(r, np.array(sorted({swap.get(j, j) for j in r}), dtype=np.int64)) for r in x]
    y = np.array(y, float)
    free, _ = toxicity.logistic(x, y, change, 3, fairness=0.0)
    fair, _ = toxicity.logistic(x, y, change, 3, fairness=5.0)
    assert abs(free[1] - free[2]) > 1 and abs(fair[1] - fair[2]) < 0.2 and fair[0] > 1


def test_all_sentences_are_swapped():
    assert toxicity.counterfactual("The women left. Women came! ok men", 0, ["women", "men"]) == "The men left. men came! ok women"


def test_long_words_count_whole():
    a, b = b"x" * 70 + b"alpha", b"x" * 70 + b"omega"
    assert set(toxicity.hashed(a)) != set(toxicity.hashed(b))
    assert nbsvm.features(b"-_" * 20 + b"!").tolist() != nbsvm.features(b"-_" * 20 + b"?").tolist()


def test_neutral_group_mentions_are_flagged_less_with_the_penalty(spark):
    import random
    rnd = random.Random(3)
    groups, plain = ["women", "muslims", "refugees", "gays"], [f"word{i}" for i in range(150)]
    text = lambda n, more: " ".join(rnd.sample(plain, n) + more)
    rows = []
    for i in range(1200):  # toxic texts name groups far more often than others do
        y = i % 4 == 0
        more = ([rnd.choice(groups)] if rnd.random() < (0.9 if y else 0.03) else []) + (["vile"] if y and rnd.random() < 0.6 else [])
        rows.append((i, text(12, more), int(y)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(i, text(12, [groups[i % 4]])) for i in range(80)], "doc_id long, text string")
    hits = {}
    for fairness in (0.0, 1.0):
        model = toxicity.fit(docs, labels, identity=groups, fairness=fairness)
        hits[fairness] = sum(r.score >= 0.3 for r in toxicity.score(neutral, model).collect())
        assert model.score(b"word1 word2 vile") >= 0.3
    assert hits[0.0] >= 60 and hits[1.0] <= 8, hits
