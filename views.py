"""Fixture views: how each operator gets its input from the driver tables.

Fixture shaping lives here, never in the library. Each view has a twin SQL
definition in ``oracle.py`` that DuckDB runs on the same parquet files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tessera.functions.codec import utf8_ids
from tessera.functions.hashing import TWO32, heads_up_to

BOS = 261
DOCS_PER_SHARD = 256
RG_DOCS = 32
#: Texts that get their marks at a time.
MARKED_ROWS = 256


def t(spark: SparkSession, sf_dir: str, name: str, waves: int = 1) -> DataFrame:
    """A driver table. The test tables are single-row-group files, so a scan
    is one task; like the many input splits of a real corpus, a table that
    arrives in fewer partitions than there are cores is hash-partitioned on
    its key column (deterministic, so recomputation gives the same split).
    ``waves``: partitions for each core, where a row becomes many."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.sparkContext.defaultParallelism * waves
    if df.rdd.getNumPartitions() < n:
        df = df.repartition(n, df.columns[0])
    return df


def U(key) -> F.Column:
    """u(x): first 8 hex digits of md5(x) as a fraction of 2^32."""
    k = key if isinstance(key, F.Column) else F.col(key)
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("bigint") / F.lit(TWO32)


def docs(spark, sf_dir) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return d.select(
        (F.col("doc_id") / DOCS_PER_SHARD).cast("int").alias("shard_id"),
        ((F.col("doc_id") % DOCS_PER_SHARD) / RG_DOCS).cast("int").alias("rg_id"),
        (F.col("doc_id") % RG_DOCS).cast("int").alias("pos_in_rg"),
        "doc_id", "text", "lang", "source", "n_chars")


def lens(spark, sf_dir) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", (F.octet_length("text") + 1).cast("bigint").alias("len"),
                    F.floor(F.col("doc_id") / DOCS_PER_SHARD).alias("grp"), F.col("doc_id").alias("ord"))


def doc_bytes(spark, sf_dir) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.array(F.lit(BOS)), utf8_ids(F.col("text"))).alias("ids"))


MSG_T = "array<struct<role:string,content:string,parts:array<struct<type:string,text:string>>>>"
PARTS_T = "array<struct<type:string,text:string>>"


def convs(spark, sf_dir) -> DataFrame:
    """conversations grouped by conv_id, messages ordered by turn."""
    c = t(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return g.select("conv_id", F.transform("m", lambda x: F.struct(
        x["role"].alias("role"), x["text"].alias("content"), F.lit(None).cast(PARTS_T).alias("parts")))
        .alias("messages"))


def convs_ok(spark, sf_dir) -> DataFrame:
    """convs passing validate_smoltalk, cut to end on an assistant turn."""
    from tessera.operators.chat import validate_smoltalk
    v = validate_smoltalk(convs(spark, sf_dir)).filter("valid").drop("valid", "reason")
    m = F.col("messages")
    last_user = F.get(m, F.size(m) - 1)["role"] == "user"
    return v.withColumn("messages", F.when(last_user, F.slice(m, 1, F.size(m) - 1)).otherwise(m))


def images(spark, sf_dir) -> DataFrame:
    """Every document is an image."""
    return t(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"))


def annotations(spark, sf_dir) -> DataFrame:
    """Every document is a caption (its whole text) of image doc_id − doc_id % 2:
    even images have two captions, odd images none."""
    d = t(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("ann_id"), (F.col("doc_id") - F.col("doc_id") % 2).alias("image_id"),
                    F.col("text").alias("caption"))


def emb(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), "embedding")


def HK(*parts) -> F.Column:
    """h of a key string 'p0:p1:…' (first 8 hex digits of md5 as a long)."""
    key = F.concat_ws(":", *[p if isinstance(p, F.Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def UK(*parts) -> F.Column:
    return HK(*parts) / F.lit(TWO32)


def mc_items(spark, sf_dir) -> DataFrame:
    """A document cut into five consecutive parts: the question and four choices."""
    d = t(spark, sf_dir, "documents")
    tx = F.col("text")
    c = F.ceil(F.length(tx) / 5).cast("int")
    part = lambda k: tx.substr((F.lit(1) + k * c).cast("int"), c)  # noqa: E731  (five parts cover the text)
    return d.select(F.col("doc_id").alias("idx"), part(0).alias("query"),
                    F.array(*[part(i) for i in range(1, 5)]).alias("choices"),
                    (F.col("doc_id") % 4).cast("int").alias("gold"), F.col("source").alias("subject"))


def _reshaped(m: DataFrame, cols: dict) -> DataFrame:
    """``cols`` of items, and of the items gathered as their shots."""
    out = [f(F.col).alias(n) for n, f in cols.items()]
    if "shot_items" in m.columns:
        out.append(F.transform("shot_items", lambda x: F.struct(x["_pos"].alias("_pos"), *[f(lambda c: x[c]).alias(n) for n, f in cols.items()])).alias("shot_items"))
    return m.select("idx", *out)


def as_schema(m: DataFrame) -> DataFrame:
    return _reshaped(m, {"context_options": lambda c: c("choices"), "continuation": lambda c: c("query"), "gold": lambda c: c("gold")})


def as_lm(m: DataFrame) -> DataFrame:
    # the continuation is the whole rest of the text
    return _reshaped(m, {"context": lambda c: c("query"), "continuation": lambda c: F.array_join(c("choices"), "")})


def schema_items(spark, sf_dir) -> DataFrame:
    return as_schema(mc_items(spark, sf_dir))


def lm_items(spark, sf_dir) -> DataFrame:
    return as_lm(mc_items(spark, sf_dir))


def option_losses(spark, sf_dir) -> DataFrame:
    m = mc_items(spark, sf_dir).select("idx")
    e = m.withColumn("opt", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn(
        "pos", F.explode(F.sequence(F.lit(0), F.lit(19))))
    return e.withColumn("loss", F.round(UK("ol", F.col("idx"), F.col("opt"), F.col("pos")) * 10, 3))


def option_score_spans(spark, sf_dir) -> DataFrame:
    m = mc_items(spark, sf_dir).select("idx").withColumn("opt", F.explode(F.sequence(F.lit(0), F.lit(3))))
    hk = HK("sp", F.col("idx"), F.col("opt"))
    return m.withColumn("start", (1 + hk % 10).cast("int")).withColumn("end", (F.col("start") + 5 + hk % 5).cast("int"))


def lm_preds(spark, sf_dir) -> DataFrame:
    m = mc_items(spark, sf_dir).select("idx").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(19))))
    nxt = HK("ac", F.col("idx"), F.col("pos") + 1) % 256
    return m.select("idx", "pos", (HK("ac", F.col("idx"), F.col("pos")) % 256).cast("int").alias("actual"),
                    F.when(UK("pr", F.col("idx"), F.col("pos")) < 0.05, (nxt + 1) % 256).otherwise(nxt)
                    .cast("int").alias("pred"))


def lm_spans(spark, sf_dir) -> DataFrame:
    m = mc_items(spark, sf_dir).select("idx")
    return m.select("idx", (10 + HK("ls", F.col("idx")) % 5).cast("int").alias("start"), F.lit(20).alias("end"))


LETTERS = ["A", "B", "C", "D"]


def logits(spark, sf_dir) -> DataFrame:
    m = mc_items(spark, sf_dir).select("idx")
    e = m.withColumn("letter", F.explode(F.array(*[F.lit(x) for x in LETTERS + ["E"]])))
    return e.withColumn("logit", F.round(UK("lg", F.col("idx"), F.col("letter")), 2))


def gsm(spark, sf_dir) -> DataFrame:
    li = t(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    n = F.col("l_linenumber")
    r = q * n
    s = lambda c: c.cast("string")
    return li.select(
        F.conv(F.substring(F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), 1, 15),
               16, 10).cast("bigint").alias("problem"),
        F.concat(F.lit("A crate holds "), s(q), F.lit(" boxes. How many boxes are in "), s(n), F.lit(" crates?"))
        .alias("question"),
        F.concat(F.lit("Each crate holds "), s(q), F.lit(". Total <<"), s(q), F.lit("*"), s(n), F.lit("="), s(r),
                 F.lit(">>"), s(r), F.lit(".\n#### "), s(r)).alias("answer"),
        r.alias("result"))


def completions(spark, sf_dir) -> DataFrame:
    g = gsm(spark, sf_dir).select("problem", "result").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(7))))
    g = g.withColumn("_u", UK("cp", F.col("problem"), F.col("sample")))  # drawn once, compared twice
    u = F.col("_u")
    txt = (F.when(u >= 0.95, F.lit("I am not sure."))
            .when(u >= 0.6, F.concat(F.lit("#### "), (F.col("result") + 1).cast("string")))
            .otherwise(F.concat(F.lit("So the answer is\n#### "), F.col("result").cast("string"))))
    return g.select("problem", "sample", txt.alias("completion"))


@F.arrow_udf(ArrayType(IntegerType()))
def _marked(ids: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """BOS and the bytes of each text, with a special token 256 + h("sv", key, p) % 6
    before place p where u("sq", key, p) < 0.03."""
    most = int(0.03 * TWO32)  # u < 0.03: the draw is no larger
    for keys, texts in ids:
        for at in range(0, len(texts), MARKED_ROWS):
            some = [("" if k is None else f"{k}:", t) for k, t in zip(keys[at : at + MARKED_ROWS].to_pylist(), texts[at : at + MARKED_ROWS].to_pylist())]
            rows = [None if t is None else np.append(np.int32(BOS), np.frombuffer(t, np.uint8)) for _, t in some]
            draws = heads_up_to([f"sq:{k}".encode() for k, _ in some], [0 if r is None else len(r) for r in rows])
            for i, (row, draw) in enumerate(zip(rows, draws)):
                if row is not None:
                    places = np.flatnonzero(draw <= most)
                    key = f"sv:{some[i][0]}".encode()
                    values = [256 + int(hashlib.md5(key + b"%d" % p).hexdigest()[:8], 16) % 6 for p in places.tolist()]
                    rows[i] = np.insert(row, places, values)
            sizes = [0 if r is None else len(r) for r in rows]
            values = np.concatenate([np.zeros(0, np.int32), *(r for r in rows if r is not None)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(values), mask=pa.array([r is None for r in rows]))


def sequences(spark, sf_dir) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    # a draw for each byte: made many at a time, the same as UK and HK
    ids = _marked(F.col("doc_id").cast("string"), F.encode(F.col("text"), "UTF-8"))
    return d.select("doc_id", ids.alias("ids"), (10 + HK("pl", F.col("doc_id")) % 20).cast("int").alias("prompt_len"))


def rollouts(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "events", waves=8)
    return e.select(F.col("user_id").alias("prompt"), F.col("event_id").alias("sample"),
                    (F.col("event_type") == "purchase").cast("double").alias("reward"),
                    (1 + F.floor("value")).cast("bigint").alias("length"),
                    F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("step"))


def token_losses(spark, sf_dir) -> DataFrame:
    b = doc_bytes(spark, sf_dir)
    e = b.select("doc_id", F.posexplode("ids").alias("pos", "tok"))
    last = (t(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]) // DOCS_PER_SHARD
    # per-token draws: Weyl fractions of (doc_id, pos) -- plain double arithmetic, identical in both engines
    frac = lambda a, b: (F.col("doc_id") * a + F.col("pos") * b) - F.floor(F.col("doc_id") * a + F.col("pos") * b)
    return e.select("doc_id", "pos",
                    F.when(frac(0.6180339887498949, 0.7548776662466927) < 0.1, -1).otherwise(F.col("tok")).alias("target"),
                    F.round(frac(0.5698402909980532, 0.3247179572447460) * 10, 3).alias("loss"),
                    F.when((F.col("doc_id") / DOCS_PER_SHARD).cast("int") == last, "val").otherwise("train").alias("split"))


# Random-guess baselines of the five acc tasks (percent and fraction).
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
BASELINE_PCT = {"AUTOMOBILE": 25.0, "BUILDING": 0.0, "FURNITURE": 25.0, "HOUSEHOLD": 50.0, "MACHINERY": 25.0}
BASELINE_FRAC = {"AUTOMOBILE": 0.25, "FURNITURE": 0.25, "HOUSEHOLD": 0.5, "MACHINERY": 0.25}


def acc(spark, sf_dir) -> DataFrame:
    """(model = nation, task = segment): share of customers with a positive balance."""
    c = t(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("model"), F.col("c_mktsegment").alias("task")).agg(
        F.avg((F.col("c_acctbal") > 0).cast("double")).alias("accuracy"))


def baselines_pct(spark) -> DataFrame:
    return spark.createDataFrame(sorted(BASELINE_PCT.items()), "task string, baseline double")


def baselines_frac(spark) -> DataFrame:
    return spark.createDataFrame(sorted(BASELINE_FRAC.items()), "task string, baseline double")


def programs(spark, sf_dir) -> DataFrame:
    """HumanEval-shaped rows built from part: prompt with import lines, a
    fenced or bare completion, a test and an entry point."""
    p = t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    ks, sz = k.cast("string"), F.col("p_size").cast("string")
    sig = F.concat(F.lit("def f_"), ks, F.lit("(x: int) -> int:\n    \"\"\""), F.col("p_name"), F.lit("\"\"\"\n"))
    prompt = (F.when(k % 3 == 0, F.concat(F.lit("import math\nfrom typing import List\n\n"), sig))
               .when(k % 3 == 1, F.concat(F.lit("# header\n  import re\n\nx = 1\nimport os\n"), sig))
               .otherwise(sig))
    body = F.concat(F.lit("def f_"), ks, F.lit("(x):\n    return x * "), sz)
    completion = F.when(k % 2 == 0, F.concat(F.lit("Here is code:\n```python\n"), body, F.lit("\n```\nDone."))).otherwise(
        F.concat(F.lit("  "), body, F.lit("  \n")))
    return p.select(k.alias("task_id"), prompt.alias("prompt"),
                    F.concat(F.lit("    return x * "), sz).alias("solution"), completion.alias("completion"),
                    F.concat(F.lit("def check(fn):\n    assert fn(1) == "), sz, F.lit("\n")).alias("test"),
                    F.concat(F.lit("f_"), ks).alias("entry_point"))


def results(spark, sf_dir) -> DataFrame:
    u = UK("res", F.col("task_id"))
    out = F.when(u < 0.6, "success").when(u < 0.8, "error").when(u < 0.9, "timeout").otherwise("memory")
    return programs(spark, sf_dir).select("task_id", out.alias("outcome"))


def tool_calls(spark, sf_dir) -> DataFrame:
    """Calculator calls: gsm tags, word counts from part names, and rejects."""
    g = gsm(spark, sf_dir).select(F.lit("gsm").alias("src"), F.col("problem").alias("id"),
                                  F.regexp_extract("answer", r"<<([^=]+)=", 1).alias("expr"))
    p = t(spark, sf_dir, "part")
    w = F.split("p_name", " ").getItem(0)
    k = F.col("p_partkey")
    e = (F.when(k % 100 == 0, F.concat(F.lit("2**"), F.col("p_size").cast("string")))
          .when(k % 100 == 1, F.lit("__import__('os')"))
          .when(k % 100 == 2, F.lit("abs(-3)"))
          .when(k % 100 == 3, F.concat(F.lit("1,000 + "), F.col("p_size").cast("string")))
          .when(k % 100 == 4, F.lit("open('x') + 1;"))
          .otherwise(F.concat(F.lit("'"), w, F.lit("'.count('"), F.substring(w, 2, 1), F.lit("')"))))
    return g.unionByName(p.select(F.lit("part").alias("src"), k.alias("id"), e.alias("expr")))


# Device names given to the runs of the steps view.
DEVICES = ["NVIDIA H100 80GB HBM3", "NVIDIA A100-SXM4-80GB", "NVIDIA GeForce RTX 4090", "Mystery Accelerator 9000"]


def steps(spark, sf_dir) -> DataFrame:
    """events as step logs: run = user, step = rank by (ts, event_id)."""
    from tessera.functions.index import prefix_sum
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    # microseconds since the epoch of the zone-free timestamp (no session time zone involved)
    e = e.withColumn("_o", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    e = prefix_sum(e, ["_o", "event_id"], None, by=["user_id"], idx="step", before="_b")
    dev = F.element_at(F.array(*[F.lit(d) for d in DEVICES]), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select(F.col("user_id").alias("run_id"), "step", F.col("value").alias("loss"),
                    (F.col("value") / 10).alias("val_bpb"), (0.1 + UK("dt", F.col("event_id"))).alias("dt"),
                    dev.alias("device"), F.lit(524288).cast("bigint").alias("batch_tokens"),
                    F.lit(6.0e8).alias("flops_per_token"), F.lit(8).alias("world"),
                    F.lit(5000).cast("bigint").alias("num_iterations"))


def runs(spark, sf_dir) -> DataFrame:
    """part as a scaling-law run table."""
    p = t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pt = (F.lit(1000000) * (k + 1)).cast("bigint")
    lm = (pt / 10).cast("bigint")
    eff = (pt + lm).cast("double")
    lx = F.log10(eff) - 8
    bpb = F.when(UK("vn", k) < 0.02, F.lit(None).cast("double")).otherwise(1 + 0.05 * lx * lx + 0.01 * UK("vb", k))
    return p.select(
        k.alias("run"), F.col("p_size").cast("double").alias("flops_budget"), (4 + k % 20).cast("int").alias("depth"),
        ((4 + k % 20) * 64).cast("int").alias("model_dim"),
        (pt / 10).cast("bigint").alias("params_wte"), (pt / 20).cast("bigint").alias("params_value_embeds"),
        lm.alias("params_lm_head"), pt.alias("params_transformer"), F.lit(100).cast("bigint").alias("params_scalars"),
        (pt + (pt / 10).cast("bigint") + (pt / 20).cast("bigint") + lm + 100).alias("params_total"),
        F.floor(20 * eff * (0.5 + UK("tk", k))).cast("bigint").alias("tokens_trained"),
        bpb.alias("val_bpb"), UK("cs", k).alias("core_score"))


def features(spark, sf_dir) -> DataFrame:
    li = t(spark, sf_dir, "lineitem")
    g = li.groupBy("l_suppkey").agg((F.avg("l_quantity") / 50).alias("f_qty"), (F.avg("l_extendedprice") / 1e5).alias("f_price"),
                                    F.avg("l_discount").alias("f_disc"), F.avg("l_tax").alias("f_tax"))
    y = (0.3 * F.col("f_qty") + 0.2 * F.col("f_price") + 1.5 * F.col("f_disc") + 2.0 * F.col("f_tax")
         + 0.05 * UK("y", F.col("l_suppkey")))
    return g.withColumn("y", y)


FEATURES = ["f_qty", "f_price", "f_disc", "f_tax"]


def words(spark, sf_dir) -> DataFrame:
    """Distinct p_name words with ids from 3 (0 unknown, 1 SOS, 2 EOS).

    The vocabulary is the small set of distinct words, so numbering it in a
    single ordered window is bounded by the vocabulary, not by the data."""
    from pyspark.sql import Window
    p = t(spark, sf_dir, "part")
    w = p.select(F.explode(F.split("p_name", " ")).alias("word")).filter("word <> ''").distinct()
    return w.withColumn("id", (F.row_number().over(Window.orderBy("word")) + 2).cast("int"))


def log_lines(spark, sf_dir) -> DataFrame:
    """Text log lines per run built from the steps view: header lines, a
    validation line for every step (repeated keys: the last wins) and a CORE
    line (twice) for even runs only."""
    st = steps(spark, sf_dir)
    per = st.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    r = F.col("run_id")
    fmt = lambda c: F.format_number(c, 0)
    header = per.select("run_id", F.posexplode(F.array(
        F.concat(F.lit("depth: "), (4 + r % 20).cast("string")),
        F.concat(F.lit("wte                     : "), fmt((r + 1) * 1000003)),
        F.concat(F.lit("lm_head                 : "), fmt((r + 1) * 1000003)),
        F.concat(F.lit("total                   : "), fmt((r + 1) * 5000011)),
        F.concat(F.lit("Calculated number of iterations: "), fmt(F.col("n") * 10)),
        F.concat(F.lit("Total batch size "), fmt(F.lit(524288)), F.lit(" => gradient accumulation steps: 1")))).alias("line_no", "line"))
    vals = st.select(
        "run_id", (F.col("step") + 10).alias("line_no"),
        F.concat(F.lit("step "), F.lpad(F.col("step").cast("string"), 5, "0"), F.lit(" | Validation bpb: "),
                 F.format_string("%.4f", F.col("val_bpb"))).alias("line"))
    core = per.filter(r % 2 == 0).select("run_id", F.posexplode(F.array(
        F.lit("CORE metric: 0.1000"),
        F.concat(F.lit("CORE metric: "), F.format_string("%.4f", UK("core", r))))).alias("k", "line")).select(
        "run_id", (F.lit(10 ** 9) + F.col("k")).alias("line_no"), "line")
    return header.unionByName(vals).unionByName(core)


SECTION_FILES = ["header.md", "tokenizer-training.md", "base-model-training.md", "base-model-evaluation.md",
                 "chat-sft.md", "chat-evaluation-sft.md", "chat-rl.md", "chat-evaluation-rl.md"]
METRIC_OF_SEGMENT = {"AUTOMOBILE": "ARC-Easy", "BUILDING": "ARC-Challenge", "FURNITURE": "MMLU",
                     "HOUSEHOLD": "GSM8K", "MACHINERY": "HumanEval"}


def sections(spark, sf_dir) -> DataFrame:
    """Report sections per run (run = nation) built from acc."""
    a = acc(spark, sf_dir)
    wide = a.groupBy("model").pivot("task", SEGMENTS).agg(F.first("accuracy"))
    m = F.col("model")
    f4 = lambda c: F.when(c.isNotNull(), F.format_string("%.4f", c))  # noqa: E731  (missing value: no line)
    start = F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), (m % 5).cast("int"), F.lit(0), F.lit(0))
    stamp = lambda i: F.concat(F.lit("timestamp: "), F.date_format(
        start + F.make_interval(mins=((i + 1) * (37 + m)).cast("int")), "yyyy-MM-dd HH:mm:ss"))
    rows = [F.struct(F.lit("header.md").alias("file"), F.lit(0).alias("line_no"),
                     F.concat(F.lit("Run started: "), F.date_format(start, "yyyy-MM-dd HH:mm:ss")).alias("line"))]
    for i, f in enumerate(SECTION_FILES[1:]):
        ts = stamp(i)
        if f == "chat-evaluation-sft.md":
            ts = F.when(m % 7 != 0, ts)
        rows.append(F.struct(F.lit(f).alias("file"), F.lit(0).alias("line_no"), ts.alias("line")))
    mean = sum((F.col(s) for s in SEGMENTS), F.lit(0.0)) / len(SEGMENTS)
    rows.append(F.struct(F.lit("base-model-evaluation.md").alias("file"), F.lit(1).alias("line_no"),
                         F.concat(F.lit("CORE: "), f4(mean)).alias("line")))
    for j, s in enumerate(SEGMENTS):
        rows.append(F.struct(F.lit("chat-evaluation-sft.md").alias("file"), F.lit(1 + j).alias("line_no"),
                             F.concat(F.lit(METRIC_OF_SEGMENT[s] + ": "), f4(F.col(s))).alias("line")))
    rows.append(F.struct(F.lit("chat-evaluation-sft.md").alias("file"), F.lit(9).alias("line_no"),
                         F.concat(F.lit("ChatCORE: "), f4(mean - 0.25)).alias("line")))
    rows.append(F.struct(F.lit("chat-evaluation-rl.md").alias("file"), F.lit(1).alias("line_no"),
                         F.when(m % 2 == 0, F.concat(F.lit("GSM8K: "), f4(F.col("HOUSEHOLD") + 0.01))).alias("line")))
    e = wide.select(F.col("model").alias("run"), F.explode(F.array(*rows)).alias("s"))
    return e.select("run", "s.file", "s.line_no", "s.line").filter(F.col("line").isNotNull())
