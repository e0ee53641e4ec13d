"""Steps whose time must not grow faster than their input."""

import hashlib
import time

from pyspark.sql import functions as F

import views as V
from tessera.functions import hashing as HS
from tessera.operators import evaluate as EV
from tessera.operators import runs as RN
from tessera.operators import tasks as TK
from tessera.operators import tokenize as TZ


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_smoothed_loss_starts_no_python_group_for_each_run(spark):
    rows = [(r, s, float((r * 7 + s) % 5)) for r in range(3) for s in range(40)]
    df = spark.createDataFrame(rows, "run_id long, step long, loss double")
    out = RN.smoothed_loss(df, chunk=9)
    assert "FlatMapGroupsInPandas" not in _plan(out)
    got = {(x.run_id, x.step): x.smooth_loss for x in out.collect()}
    for r in range(3):
        ema = 0.0
        for s in range(40):
            ema = 0.9 * ema + 0.1 * float((r * 7 + s) % 5)
            assert abs(got[r, s] - ema / (1 - 0.9 ** (s + 1))) < 1e-9


def test_policy_objective_joins_a_row_for_each_sample(spark):
    logp = spark.createDataFrame([(1, -1.0, 5), (1, -2.0, -1), (1, -3.0, 7), (2, -4.0, -1), (3, -5.0, 1), (4, -6.0, 1), (5, -1.0, None), (None, -1.0, 1)],
                                 "sample long, logp double, target int")
    adv = spark.createDataFrame([(1, 0.5, 0), (1, 0.25, 0), (2, 1.0, 1), (3, None, 2), (4, -0.5, 0), (5, 1.0, 3)], "sample long, advantage double, step int")
    out = EV.policy_objective(logp, adv, ["step"], passes=2, examples=1)
    got = {r.step: (r.n_valid, r.objective) for r in out.collect()}
    assert got == {0: (5, 0.0), 1: (0, 0.0), 2: (1, None), 3: (0, 0.0)}
    plan = _plan(out)
    assert plan.index("Join") < plan.rindex("Aggregate [sample")


def test_split_bpb_writes_its_cut_into_the_read(spark, tmp_path):
    spark.range(600).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text")).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    losses = d.select("doc_id", F.posexplode(F.split("text", "")).alias("pos", "c")).select(
        "doc_id", "pos", F.ascii("c").alias("target"), F.lit(1.0).alias("loss"), F.when(F.col("doc_id") < 300, "a").otherwise("b").alias("split"))
    lengths = spark.createDataFrame([(i, 1) for i in range(256)], "token_id int, n_bytes int")
    out = EV.split_bpb(losses, lengths, 100, 1, ["doc_id", "pos"])
    assert {(r.split, r.total_bytes) for r in out.collect()} == {("a", 100), ("b", 100)}
    assert "doc_id#" in _plan(out) and "> 333" in _plan(out) and "> 33)" in _plan(out)


def test_an_answer_is_matched_once_a_row(spark):
    items = TK.gsm_conversations(spark.createDataFrame([(1, "q", "a <<1+1=2>>2.\n#### 1,002"), (2, "q", "no mark"), (3, "q", None)], "problem long, question string, answer string"))
    done = spark.createDataFrame([(1, 0, "#### 1,002"), (1, 1, "#### 7"), (2, 0, "none"), (3, 0, None)], "problem long, sample int, completion string")
    out = EV.answer_match(items, done)
    got = {(r.problem, r.sample): (r.ref, r.pred, r.correct, r.both_missing) for r in out.collect()}
    assert got == {(1, 0): ("1002", "1002", 1, False), (1, 1): ("1002", "7", 0, False), (2, 0): (None, None, 1, True), (3, 0): (None, None, 1, True)}
    assert _plan(out).count("regexp_extract(") <= 3 and _plan(out).count("regexp_extract_all(") == 1


def test_roundtrip_counts_tokens_in_the_same_pass(spark):
    codec = TZ.BpeCodec(TZ.build_vocab(spark.createDataFrame([(0, 97, 98, 256, 3)], "rank int, left_id int, right_id int, new_id int, pair_count long")))
    e = codec.encode(spark.createDataFrame([(1, "abab"), (2, None), (3, "xäb")], "doc_id long, text string"), "text")
    out = TZ.tokenizer_roundtrip(TZ.decode_tokens(e, "ids", codec.table, "back"), "back", ids="ids")
    assert tuple(out.first()) == (3, 0, 6)
    assert _plan(out).count("ArrowEvalPython") == 1


def test_logs_of_many_runs_lie_in_few_files(spark, tmp_path):
    from tessera.sources import logs as LG
    rows = [(r, n, f"line {r}-{n}") for r in [None, *range(200)] for n in (3, 1, 2)] + [(7, 4, None), (8, 9, "last")]
    lines = spark.createDataFrame(rows, "run_id long, line_no long, line string")
    LG.write_run_logs(lines, str(tmp_path / "many"))
    assert len(list((tmp_path / "many").rglob("*.txt"))) < 50
    want = []
    for r in [None, *range(200)]:
        own = sorted((n, x) for k, n, x in rows if k == r)
        want += [(r, i, x) for i, (_, x) in enumerate(own) if x]
    got = LG.read_run_logs(spark, str(tmp_path / "many"), many=True).select(F.col("run_id").cast("long"), "line_no", "line")
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_step_stream_calls_python_for_groups_of_runs(monkeypatch):
    import pandas as pd

    from tessera.streaming import corpus as STR

    class State:
        exists = False

        def update(self, values):
            self.exists, self.get = True, values

    state, fn, out = State(), STR._run_metrics_fn(0.9), []
    for lo in (0, 20):
        d = pd.DataFrame([(r, s, float(r + s), 1.0 / (1 + s), 0.5) for s in range(lo, lo + 20) for r in (2, 5, 1 << 60)], columns=STR._RECORD)
        out += [tuple(x) for p in fn((0,), [d], state) for x in p.itertuples(index=False)]
    assert len(out) == 120
    got = {(r, s): (a, b, c) for r, s, a, b, c in out}
    for r in (2, 5, 1 << 60):
        ema = 0.0
        for s in range(40):
            ema = 0.9 * ema + 0.1 * float(r + s)
            a, b, c = got[r, s]
            assert abs(a / (ema / (1 - 0.9 ** (s + 1))) - 1) < 1e-9 and b == 1.0 / (1 + s) and c == max(0, s - 10) * 0.5


def test_common_bytes_of_options_encode_nothing(spark):
    rows = [(0, "be", ["xäa", "yäa", "äa"], "."), (1, "", ["ab", "ab"], ""), (2, "q", ["", "z"], "!"), (3, "q", ["aab", None, "ab"], None), (4, "q", [None, "z"], ""), (5, "q", ["a" * 300 + "b", "a" * 300 + "c"], "")]
    parts = spark.createDataFrame(rows, "idx long, before string, options array<string>, after string")
    for kind in ("mc", "schema"):
        flat = parts.select("idx", F.posexplode("options").alias("opt", "o"), "before", "after").select("idx", "opt", F.concat("before", "o", "after").alias("prompt"))
        whole = EV.option_spans(EV.tokenize_prompts(flat.filter("idx not in (3, 4)")), kind)
        want = {(r.idx, r.opt): (r.start, r.end, list(r.ids)) for r in whole.collect()}
        spans = EV.option_spans_items(parts, kind)
        assert {(r.idx, r.opt): (r.start, r.end, list(r.ids)) for r in spans.filter("idx not in (3, 4)").collect()} == want
    bounds = EV.option_spans_items(parts, "mc").select("idx", "start", "end")
    assert "split" not in _plan(bounds)
    assert {r[1] for r in bounds.filter("idx = 3").collect()} == {3} and {r[1] for r in bounds.filter("idx = 4").collect()} == {2}


def test_draws_made_together_are_those_of_one_key():
    prefixes, counts = [b"sq:1:", b"sq:", b"", b"k" * 52 + b":"], [12_345, 101, 1, 1_200]
    for p, n, got in zip(prefixes, counts, HS.heads_up_to(prefixes, counts)):
        assert got.tolist() == [int(hashlib.md5(p + b"%d" % i).hexdigest()[:8], 16) for i in range(n)]


def test_marked_sequences_equal_single_draws(spark, tmp_path):
    rows = [(7, "ab é日 " * 300), (8, ""), (9, None), (None, "x" * 1200), (7, "y"), (123456, "z" * 40_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.ids, r.prompt_len) for r in V.sequences(spark, str(tmp_path)).collect()), key=str)
    want = []
    for key, text in rows:
        h = lambda seed, *p: int(hashlib.md5(":".join(map(str, (seed, *([] if key is None else [key]), *p))).encode()).hexdigest()[:8], 16)  # noqa: B023, E731
        ids = None
        if text is not None:
            ids = []
            for p, x in enumerate([V.BOS, *text.encode()]):
                ids += [256 + h("sv", p) % 6] * (h("sq", p) / 2**32 < 0.03) + [x]
        want.append((key, ids, 10 + h("pl") % 20))
    assert got == sorted(want, key=str) and any(max(ids or [0]) > 255 for _, ids, _ in got)


def test_masks_of_a_batch_don_t_run_into_each_other(spark):
    a, z = 258, 259
    rows = [(0, [a, 1, a, 2, z, 3], 1), (1, [], 0), (2, [a, a], 0), (3, [4, z, 5, a, 6, z, z, 7], 2), (4, None, 3), (5, [1, a, 2], 9), (6, [z, 1], 0), (7, [], 4)]
    df = spark.createDataFrame(rows, "k int, ids array<int>, prompt_len int").coalesce(1)
    want = {0: [0, 1, 0, 0, 0, 1], 1: [], 2: [0, 0], 3: [0, 0, 1, 0, 0, 0, 1, 1], 4: None, 5: [0, 0, 0], 6: [1, 1], 7: []}
    assert {r.k: r["mask"] for r in EV.completion_mask(df).collect()} == want


def test_packed_ids_give_the_same_spans_and_crops(spark):
    sizes = [0, 1, 2, 6, 7, 8, 9, 40]
    rows = [(i, "é" * (n // 2) + "x" * (n % 2), ["ab", "", "日本", None, "a"], "." * (i % 3)) for i, n in enumerate(sizes)]
    rows += [(90, None, ["a"], ""), (91, "q", ["", ""], ""), (92, "q", None, "z"), (93, "", ["same", "same"], None)]
    parts = spark.createDataFrame(rows, "idx long, before string, options array<string>, after string")
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    cols = ["idx", "opt", "ids", "start", "end", "crop_ok"]
    for kind in ("mc", "schema"):
        whole, packed = EV.option_spans_items(parts, kind), EV.option_spans_items(parts, kind, packed=True)
        for n in (0, 1, 8, 1000):
            assert order(EV.left_crop(packed, n).select(cols)) == order(EV.left_crop(whole, n).select(cols))
    texts = ["", "a", " a", "a ", "é日", "x" * 7, "x" * 8, "x" * 9, None]
    lm = spark.createDataFrame([(i * 10 + j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "idx long, a string, b string")

    def spans(**how):
        d = EV.tokenize_prompts(EV.tokenize_prompts(lm, col="a", out="ids_without", **how), col="b", out="ids_with", **how)
        return EV.option_spans(d, "lm").withColumn("opt", F.lit(0))

    for n in (0, 1, 8, 1000):
        assert order(EV.left_crop(spans(packed=True), n).select(*cols, "valid")) == order(EV.left_crop(spans(), n).select(*cols, "valid"))


def test_left_crop_makes_arrays_of_kept_ids_only(spark, tmp_path):
    import catalog
    spark.createDataFrame([(i, "é word " * (i + 1), "s") for i in range(6)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert dict(catalog._spans_all(spark, str(tmp_path)).dtypes)["ids"] == "binary"
    assert catalog.Q["left_crop"](spark, str(tmp_path)).count() == 6 * 9


def test_shots_gathered_once_give_the_prompts_of_each_kind(spark, tmp_path):
    import catalog
    texts = ["é word " * 9, "", " \n ", None, "abcde", "aaaaaaaaaa", "　x y  ", "日本語 text " * 40]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    lm = EV.tokenize_prompts(EV.tokenize_prompts(catalog._lm_prompts(spark, sf), col="prompt_without", out="ids_without"), col="prompt_with", out="ids_with")
    alone = {k: catalog._item_spans(spark, sf, k).withColumn("valid", F.lit(True)) for k in ("mc", "schema")}
    alone["lm"] = EV.option_spans(lm, "lm").withColumn("opt", F.lit(0))
    together = EV.left_crop(catalog._spans_all(spark, sf), 64)
    cols = ["idx", "opt", "start", "end", "valid", "ids", "crop_ok"]
    for kind, spans in alone.items():
        got = order(together.filter(F.col("kind") == kind).select(cols))
        assert got == order(EV.left_crop(spans, 64).select(cols)) and len(got) == len(rows) * (1 if kind == "lm" else 4)


def test_gathered_shots_of_repeated_and_missing_keys(spark):
    rows = [(0, "q0", ["a", "b"], 0), (1, "q1", ["c", None], 1), (1, "q2", ["d", "e"], 1), (3, None, ["f"], 0), (None, "q4", None, None)]
    items = spark.createDataFrame(rows, "idx long, query string, choices array<string>, gold int")
    shots = spark.createDataFrame([(0, [1, 3]), (1, [0, 3]), (1, [3, 0]), (3, []), (None, [0])], "idx long, shots array<long>")
    gathered = EV.gather_shots(items, shots, ["query", "choices", "gold"])
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    for kind, shape in (("mc", lambda m: m), ("schema", V.as_schema)):
        assert order(EV.option_parts(shape(gathered), None, kind)) == order(EV.option_parts(shape(items), shots, kind))
    assert order(EV.prompts_lm(V.as_lm(gathered), None)) == order(EV.prompts_lm(V.as_lm(items), shots))


def test_strips_by_the_ends_equal_the_pattern(spark):
    ends = ["", " ", "\n", "\r\n", "\x1c", "​", "᠎", "a", *EV.SPACES, EV.SPACES]
    df = spark.createDataFrame([(a + x + "b c" + b, b + y + a) for a in ends for b in ends for x, y in (("", ""), ("d", "\t"), (" ", "é"))] + [(None, "a"), ("a", None)], "a string, b string")
    whole = F.regexp_replace(F.concat("a", "b"), r"(?U)^\s+|\s+$", "")
    own = F.regexp_replace("b", r"(?U)^\s+|\s+$", "")
    same = F.col("s").eqNullSafe(whole) & F.col("t").eqNullSafe(own)
    assert df.withColumn("s", EV._strip_joined(F.col("a"), F.col("b"))).withColumn("t", EV.py_strip(F.col("b"))).filter(~same).count() == 0
    every = spark.range(1, 0x10000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    assert {r.c for r in every.filter(F.regexp_replace("c", r"(?U)\s", "") == "").collect()} == set(EV.SPACES)
