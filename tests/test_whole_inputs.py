"""Rows that were once lost or wrong: null groups, items without outputs, sparse
numbers, malformed UTF-8, null messages, unreadable tables, late records."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tessera.functions.codec import ByteCodec, bytes_to_text
from tessera.functions.index import prefix_sum
from tessera.operators import captions as C
from tessera.operators import chat as CH
from tessera.operators import evaluate as EV
from tessera.operators import packing as P
from tessera.operators import runs as RN
from tessera.streaming.corpus import _run_metrics_fn


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7)], "g string, o long, v long")
    got = {(r.g, r.o): (r.idx, r.before) for r in prefix_sum(df, "o", "v", by=["g"], buckets=2).collect()}
    assert got == {(None, 1): (0, 0), (None, 2): (1, 5), ("a", 1): (0, 0)}
    lens = spark.createDataFrame([(1, 9, None, 0), (2, 9, 0, 0)], "doc_id long, len long, grp long, ord long")
    assert {(r.grp, r.doc_id, r["len"]) for r in P.pack_concat(lens, 7).collect()} == {(None, 1, 8), (0, 2, 8)}
    m = spark.createDataFrame([(None, 1, 3.0), (None, 2, 5.0)], "r long, o long, v double")
    assert sorted((r.o, r.best) for r in RN.running_min(m, "v", "o", ["r"], "best").collect()) == [(1, 3.0), (2, 3.0)]


def test_null_devices_stay(spark):
    steps = spark.createDataFrame([(1, 0, 1.0, "H100", 10, 2.0, 1, 5), (1, 1, 1.0, None, 10, 2.0, 1, 5)],
                                  "run_id long, step long, dt double, device string, batch_tokens long, flops_per_token double, world long, num_iterations long")
    peaks = spark.createDataFrame([(["h100"], 1e15, 0)], "patterns array<string>, peak_flops double, priority int")
    assert sorted((r.step, r.mfu > 0) for r in RN.throughput(steps, peaks).collect()) == [(0, True), (1, False)]


def test_items_without_outputs_are_wrong(spark):
    gold = spark.createDataFrame([(0, 1), (1, 0)], "idx long, gold int")
    losses = spark.createDataFrame([(0, 0, 0, 2.0), (0, 1, 0, 1.0)], "idx long, opt int, pos int, loss double")
    spans = spark.createDataFrame([(i, o, 1, 2) for i in (0, 1) for o in (0, 1)], "idx long, opt int, start int, end int")
    assert {(r.idx, r.pred, r.correct) for r in EV.score_options(losses, spans, gold).collect()} == {(0, 1, 1), (1, None, 0)}
    preds = spark.createDataFrame([(0, 0, 7, 8), (0, 1, 8, 9)], "idx long, pos int, actual int, pred int")
    lm = spark.createDataFrame([(0, 1, 2), (1, 1, 2), (2, 1, 3)], "idx long, start int, end int")
    assert {(r.idx, r.correct) for r in EV.score_lm(preds, lm).collect()} == {(0, 1), (1, 0), (2, 0)}
    items = spark.createDataFrame([(0, ["A", "B"], 1), (1, ["A", "B"], 0)], "idx long, letters array<string>, answer int")
    logits = spark.createDataFrame([(0, "A", 0.1), (0, "B", 0.3)], "idx long, letter string, logit double")
    assert {(r.idx, r.pred, r.correct) for r in EV.categorical_eval(logits, items).collect()} == {(0, "B", 1), (1, None, 0)}


def test_a_task_without_baseline_leaves_no_metric(spark):
    acc = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.5)], "model string, task string, accuracy double")
    base = spark.createDataFrame([("a", 25.0)], "task string, baseline double")
    assert [(r.core_metric, r.n_tasks) for r in EV.core_metric(acc, base).collect()] == [(None, 2)]


def test_null_subject_is_not_the_total(spark):
    v = spark.createDataFrame([("x", 1), (None, 0)], "subject string, correct int")
    assert {(r.subject, r.n) for r in EV.subject_accuracy(v).collect()} == {("x", 1), (None, 1), ("ALL", 2)}


def test_sparse_item_numbers_are_refused(spark):
    items = spark.createDataFrame([(i * 1000,) for i in range(5)], "idx long")
    with pytest.raises(ValueError, match="number the items"):
        EV.sample_fewshot(items, 2)


def test_malformed_bytes_become_replacement_characters(spark):
    got = spark.range(1).select(bytes_to_text(F.array(*[F.lit(x) for x in (104, 0xC3, 105, 300)])).alias("t")).first()["t"]
    assert got == "h�i"


def test_null_messages_are_invalid(spark):
    c = spark.createDataFrame([(1, None)], "conv_id long, messages array<struct<role:string,content:string,parts:array<struct<type:string,text:string>>>>")
    for check in (CH.validate_conversations, CH.validate_smoltalk, CH.validate_synthetic, CH.conversation_limits):
        assert [(r.valid, r.reason) for r in check(c).collect()] == [(False, "no_messages")]


def test_an_unreadable_table_is_an_error_and_keys_stay_unique(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    C.write_token_table(t, str(tmp_path / "t"), ["id"])
    C.write_token_table(t, str(tmp_path / "t"), ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        C.write_token_table(t, str(tmp_path / "bad"), ["id"])


class _State:
    exists, get = False, None

    def update(self, x):
        self.exists, self.get = True, x


def test_late_records_count():
    fn, state = _run_metrics_fn(0.9), _State()
    cols = ["step", "loss", "val_bpb", "dt"]
    a = pd.concat(fn((1,), iter([pd.DataFrame([(20, 1.0, 0.9, 2.0)], columns=cols)]), state))
    b = pd.concat(fn((1,), iter([pd.DataFrame([(15, 3.0, 0.5, 4.0)], columns=cols)]), state))
    assert a.min_val_bpb.tolist() == [0.9] and b.min_val_bpb.tolist() == [0.5] and b.total_training_time.tolist() == [6.0]
    assert all(x is None or math.isnan(x) for x in b.smooth_loss)


def test_spans_of_items_against_whole_prompts(spark):
    rows = [(0, "fé ", ["ab", "abc", "axc"], " end"), (1, "xx", ["", "x", "xx"], " e"), (2, "ab", ["same", "same"], "!"), (3, "", ["é", "è"], "z")]
    df = spark.createDataFrame(rows, "idx long, before string, options array<string>, after string")
    for kind in ("mc", "schema"):
        got = {(r.idx, r.opt): (list(r.ids), r.start, r.end) for r in EV.option_spans_items(df, kind).collect()}
        for i, before, options, after in rows:
            ids = [[ByteCodec().bos, *(before + o + after).encode()] for o in options]
            seqs = ids if kind == "mc" else [x[::-1] for x in ids]
            n = 0
            while n < min(map(len, seqs)) and len({x[n] for x in seqs}) == 1:
                n += 1
            if kind == "mc":  # the compared text ends with the shortest option
                n = min(n, 1 + len(before.encode()) + min(len(o.encode()) for o in options))
            for k, x in enumerate(ids):
                assert got[i, k] == (x, n if kind == "mc" else len(x) - n, len(x))
