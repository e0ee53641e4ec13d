import random

import corpus_pipeline as P
import pytest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good prose, bad prose, near copies, a repeated line, a leak and odd rows."""
    turn = random.Random(5)
    words = ["".join(turn.choices("abcdefghiéñ", k=turn.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(turn.choices(words, k=n))
    item = prose(25)
    docs = [(i, prose(60)) for i in range(120)]
    docs += [(i, " ".join(w + "%%%" for w in prose(60).split())) for i in range(120, 160)]
    long = prose(400)
    docs += [(200, long), (201, long + " one"), (202, prose(40) + " " + item.upper() + " " + prose(30))]
    docs += [(i, f"{prose(30)}\nThe very same line in all of them.") for i in range(210, 214)]
    docs += [(300, None), (301, ""), (None, prose(50)), (5, docs[5][1]), (302, prose(3000))]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(not 120 <= i < 160), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_in_order(spark, folder, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == COLUMNS
            kept[name] = {r.doc_id: r for r in docs.collect()}
    assert not any(i is not None and 120 <= i < 160 for i in kept["quality"]) and {*range(120), 200, 201, 202, 302} <= set(kept["quality"])
    lines = kept["line_dedup"]
    assert ["same line" in lines[i].text for i in (210, 211, 212, 213)] == [False, False, False, True]
    assert all(r.n_chars == len(r.text or "") for r in lines.values()) and set(lines) == set(kept["quality"])
    near = set(kept["near_dedup"])
    assert 200 in near and 201 not in near and {*range(120)} <= near
    clean = set(kept["decontamination"])
    assert near - clean == {202}
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == clean
    assert sum(r.length for r in pieces if r.doc_id == 7) == next(r.doc_tokens for r in pieces if r.doc_id == 7)


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        got = stage(spark, docs, folder)
        assert got.count() == 0
