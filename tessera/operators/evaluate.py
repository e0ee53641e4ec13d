"""Evaluation over tables of model outputs.

No model runs here: losses, predictions, logits and completions arrive as
tables and every metric is a join plus a partial/final aggregation.
Per-group statistics are computed with ``groupBy`` and joined back rather
than with a window over the group, so a hot key does not pin one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.codec import ByteCodec
from ..functions.hashing import h
from ..functions.index import prefix_sum

# ------------------------------------------------------------------ few-shot


def sample_fewshot(items: DataFrame, k: int, seed: int = 1234, idx: str = "idx", n: int | None = None) -> DataFrame:
    """``k`` distinct other items per item, drawn by the seeded hash.

    Floyd's algorithm runs inside ``aggregate`` over k steps, so exactly k
    distinct indices come out without candidate slack or a pair join; the
    pool excludes the item itself by shifting indices at or above it.
    Adds ``shots array<bigint>`` (order as drawn).
    """
    if n is None:
        low, high, n = items.agg(F.min(idx), F.max(idx), F.count(F.lit(1))).first()
        if n and (low != 0 or high != n - 1):
            raise ValueError(f"{idx} must number the items 0 to {n - 1}; it runs from {low} to {high} (see functions.index.global_index)")
    pool = n - 1
    if k > 0 and pool < k:
        raise ValueError(f"need at least {k + 1} items for {k} shots, got {n}")
    if k == 0:
        return items.withColumn("shots", F.array().cast("array<bigint>"))
    i = F.col(idx)

    def step(acc, j):
        m = F.lit(pool - k).cast("bigint") + j
        t = F.pmod(h(seed, i, j), m + 1)
        return F.when(F.array_contains(acc, t), F.concat(acc, F.array(m))).otherwise(F.concat(acc, F.array(t)))

    drawn = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")),
                        F.array().cast("array<bigint>"), step)
    return items.withColumn("shots", F.transform(drawn, lambda c: F.when(c >= i, c + 1).otherwise(c)))


def _collect_shots(items: DataFrame, shots: DataFrame, idx: str, **cols: Column) -> DataFrame:
    """(idx, shot_items): ``cols`` of an item's shots, each with its place among them."""
    e = shots.select(F.col(idx).alias("_item"), F.posexplode("shots").alias("_pos", "_shot"))
    src = items.select(F.col(idx).alias("_shot"), *[c.alias(n) for n, c in cols.items()])
    g = e.join(src, "_shot").groupBy("_item").agg(F.collect_list(F.struct("_pos", *cols)).alias("shot_items"))
    return g.withColumnRenamed("_item", idx)


def gather_shots(items: DataFrame, shots: DataFrame, cols: list[str], idx: str = "idx") -> DataFrame:
    """Adds ``shot_items``, ``cols`` of an item's shots. Prompts of several kinds over
    the same items and shots take such items, with None for shots, and so share
    what is read and shuffled."""
    return items.join(_collect_shots(items, shots, idx, **{c: F.col(c) for c in cols}), idx, "left")


def _with_fewshot(items, shots, block, idx):
    """Adds ``fewshot``, the ordered concatenation of the blocks of an item's shots;
    ``block`` makes one from a function that gives columns by name."""
    text = lambda blocks: F.array_join(F.transform(F.array_sort(blocks), lambda x: x["_block"]), "")
    if shots is None:
        own = F.transform("shot_items", lambda x: F.struct(x["_pos"].alias("_pos"), block(lambda c: x[c]).alias("_block")))
        d = items.withColumn("fewshot", text(own))
    else:
        g = _collect_shots(items, shots, idx, _block=block(F.col))
        d = items.join(g.select(idx, text(F.col("shot_items")).alias("fewshot")), idx, "left")
    return d.withColumn("fewshot", F.coalesce(F.col("fewshot"), F.lit("")))


def _mc_block(delim):
    return lambda c: F.concat(c("query"), F.lit(delim), F.get(c("choices"), c("gold")), F.lit("\n\n"))


def _schema_block(delim):
    return lambda c: F.concat(F.get(c("context_options"), c("gold")), F.lit(delim), c("continuation"), F.lit("\n\n"))


def prompts_mc(items: DataFrame, shots: DataFrame | None, delim: str = " ", idx: str = "idx") -> DataFrame:
    """Few-shot blocks ``query+delim+gold choice`` + blank line, then one
    prompt per choice. Items: (idx, query, choices, gold)."""
    d = _with_fewshot(items, shots, _mc_block(delim), idx)
    e = d.select(idx, "fewshot", "query", F.posexplode("choices").alias("opt", "choice"))
    return e.select(idx, "opt", F.concat("fewshot", "query", F.lit(delim), "choice").alias("prompt"))


def prompts_schema(items: DataFrame, shots: DataFrame | None, delim: str = " ", idx: str = "idx") -> DataFrame:
    """Contexts vary, continuation fixed. Items: (idx, context_options, continuation, gold)."""
    d = _with_fewshot(items, shots, _schema_block(delim), idx)
    e = d.select(idx, "fewshot", "continuation", F.posexplode("context_options").alias("opt", "ctx"))
    return e.select(idx, "opt", F.concat("fewshot", "ctx", F.lit(delim), "continuation").alias("prompt"))


# What the pattern \s matches in Unicode.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def py_strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def _strip_joined(a: Column, b: Column) -> Column:
    """``py_strip(concat(a, b))`` for a long ``a`` and a short ``b``: unless ``b`` is
    blank, only ``b`` is searched for the end."""
    end = F.rtrim(b, F.lit(SPACES))
    return F.when(end != "", F.ltrim(F.concat(a, end), F.lit(SPACES))).otherwise(py_strip(F.concat(a, b)))


def prompts_lm(items: DataFrame, shots: DataFrame | None, delim: str = " ", idx: str = "idx") -> DataFrame:
    """Two prompts per item: without (stripped) and with the continuation.
    Items: (idx, context, continuation)."""
    block = lambda c: F.concat(py_strip(c("context")), F.lit(delim), c("continuation"), F.lit("\n\n"))
    d = _with_fewshot(items, shots, block, idx)
    own = F.concat(py_strip(F.col("context")), F.lit(delim))
    return d.select(idx, _strip_joined(F.col("fewshot"), own).alias("prompt_without"),
                    F.concat("fewshot", own, "continuation").alias("prompt_with"))


# ------------------------------------------------------------------ spans


def _common_len(arrs: Column) -> Column:
    """Shared leading length of an array of arrays: the minimum over options
    of the common prefix with the first option (one ``zip_with`` pass each)."""
    first = F.get(arrs, 0)

    def lcp(o):
        eq = F.zip_with(first, o, lambda x, y: F.coalesce(x == y, F.lit(False)))
        pos = F.array_position(eq, False)
        return F.when(pos == 0, F.size(eq)).otherwise(pos - 1)

    return F.coalesce(F.array_min(F.transform(arrs, lcp)), F.lit(0)).cast("int")


def common_prefix_len(options: DataFrame, idx: str = "idx", ids: str = "ids") -> DataFrame:
    """Length shared at the front by all option sequences of an item."""
    g = options.groupBy(idx).agg(F.collect_list(ids).alias("_o"))
    return g.select(idx, _common_len(F.col("_o")).alias("prefix_len"))


def common_suffix_len(options: DataFrame, idx: str = "idx", ids: str = "ids") -> DataFrame:
    g = options.groupBy(idx).agg(F.collect_list(F.reverse(F.col(ids))).alias("_o"))
    return g.select(idx, _common_len(F.col("_o")).alias("suffix_len"))


def tokenize_prompts(prompts: DataFrame, codec: ByteCodec | None = None, col: str = "prompt",
                     out: str = "ids", packed: bool = False) -> DataFrame:
    """BOS and the ids of each prompt. ``packed``: all ids as binary, a byte each,
    with BOS left out (byte codec; an array takes four bytes an id and a string
    for each while it is made). ``option_spans`` and ``left_crop`` take both."""
    codec = codec or ByteCodec()
    if packed:
        return prompts.withColumn(out, codec.packed_col(F.col(col)))
    return prompts.withColumn(out, F.concat(F.array(F.lit(codec.bos)), codec.encode_col(F.col(col))))


def _is_packed(df: DataFrame, ids: str) -> bool:
    return isinstance(df.schema[ids].dataType, BinaryType)


def option_spans(options: DataFrame, kind: str, idx: str = "idx") -> DataFrame:
    """(start, end) of the scored tokens of each option.

    mc: start = common prefix; schema: start = end − common suffix;
    lm: options has ``ids_without``/``ids_with``; start = len(without), which
    must be a true prefix (``valid``)."""
    if kind == "mc":
        p = common_prefix_len(options, idx)
        return options.join(p, idx).withColumn("start", F.col("prefix_len")).withColumn("end", F.size("ids"))
    if kind == "schema":
        s = common_suffix_len(options, idx)
        return (options.join(s, idx).withColumn("end", F.size("ids"))
                       .withColumn("start", F.col("end") - F.col("suffix_len")))
    if kind == "lm":
        wo, wi = F.col("ids_without"), F.col("ids_with")
        if _is_packed(options, "ids_with"):
            n_wo, n_wi, begins = 1 + F.octet_length(wo), 1 + F.octet_length(wi), wi.startswith(wo)
        else:
            n_wo, n_wi, begins = F.size(wo), F.size(wi), F.slice(wi, 1, F.size(wo)) == wo
        return (options.withColumn("start", n_wo).withColumn("end", n_wi)
                       .withColumn("ids", wi).withColumn("valid", (n_wo < n_wi) & begins))
    raise ValueError(kind)


def left_crop(spans: DataFrame, max_len: int, codec: ByteCodec | None = None) -> DataFrame:
    """Keep the last ``max_len`` tokens and shift the span; a span pushed
    below 0 is invalid. Packed ids (``tokenize_prompts``) are cropped as they
    are, and those kept become an array."""
    if _is_packed(spans, "ids"):
        codec = codec or ByteCodec()
        n = 1 + F.octet_length("ids")
        crop = F.greatest(n - F.lit(max_len), F.lit(0))
        # BOS is the first to go, so the crop is also the place of the first byte kept
        head = F.when(crop > 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(codec.bos)))
        tail = F.when(crop > 0, F.substring("ids", crop, F.lit(max_len))).otherwise(F.col("ids"))
        ids = F.concat(head, codec.unpacked_col(tail))
    else:
        n = F.size("ids")
        crop = F.greatest(n - F.lit(max_len), F.lit(0))
        ids = F.when(crop > 0, F.slice("ids", crop + 1, F.lit(max_len))).otherwise(F.col("ids"))
    out = spans.withColumns({"ids": ids, "start": F.col("start") - crop, "end": F.col("end") - crop})
    return out.withColumn("crop_ok", F.col("start") >= 0)


# ------------------------------------------------------------------ scoring


def score_options(losses: DataFrame, spans: DataFrame, gold: DataFrame, idx: str = "idx") -> DataFrame:
    """Mean loss over positions ``[start-1, end-1)`` per option; lowest mean
    wins (first option on ties); correct = winner is gold.
    losses (idx, opt, pos, loss), spans (idx, opt, start, end), gold (idx, gold)."""
    j = losses.join(spans.select(idx, "opt", "start", "end"), [idx, "opt"])
    j = j.filter((F.col("pos") >= F.col("start") - 1) & (F.col("pos") < F.col("end") - 1))
    m = j.groupBy(idx, "opt").agg(F.round(F.avg("loss"), 9).alias("mean_loss"))  # exact ties stay ties
    best = m.groupBy(idx).agg(F.min_by("opt", F.struct("mean_loss", "opt")).alias("pred"))
    # an item without losses has no prediction, which is wrong
    return (gold.join(best, idx, "left")
                .withColumn("correct", F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).cast("int"))
                .select(idx, "pred", *[c for c in gold.columns if c != idx], "correct"))


def score_lm(preds: DataFrame, spans: DataFrame, idx: str = "idx") -> DataFrame:
    """Correct iff every token in ``[start, end)`` was predicted at the
    position before it. preds (idx, pos, actual, pred), spans (idx, start, end)."""
    # the prediction at the position before, in one grouping by item
    w = Window.partitionBy(idx).orderBy("pos")
    p = preds.select(idx, "pos", "actual", F.lag("pred").over(w).alias("_p"), F.lag("pos").over(w).alias("_q"))
    j = p.filter(F.col("_q") == F.col("pos") - 1).join(spans.select(idx, "start", "end"), idx)
    j = j.filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    got = j.groupBy(idx).agg(F.bool_and(F.col("_p").eqNullSafe(F.col("actual"))).alias("_ok"), F.count(F.lit(1)).alias("_n"))
    # an item lacks a prediction somewhere in its span: wrong, like one without any
    want = spans.select(idx, (F.col("end") - F.col("start")).alias("_want")).distinct()
    return want.join(got, idx, "left").select(idx, F.coalesce(F.col("_ok") & (F.col("_n") >= F.col("_want")), F.lit(False)).cast("int").alias("correct"))


def task_accuracy(verdicts: DataFrame, task: str = "task") -> DataFrame:
    return verdicts.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("correct"), 6).alias("accuracy"))


def core_metric(acc: DataFrame, baselines_pct: DataFrame, model: str = "model") -> DataFrame:
    """Centred accuracy ``(a − 0.01b)/(1 − 0.01b)`` per task (b in percent),
    then the mean over tasks per model; null if a task has no baseline.
    baselines (task, baseline)."""
    j = acc.join(baselines_pct, "task", "left")
    b = F.col("baseline") * 0.01
    c = j.withColumn("centered", (F.col("accuracy") - b) / (1.0 - b))
    whole = F.count("baseline") == F.count(F.lit(1))
    return c.groupBy(model).agg(F.when(whole, F.round(F.avg("centered"), 6)).alias("core_metric"),
                                F.count(F.lit(1)).alias("n_tasks"))


def chatcore_metric(acc: DataFrame, baselines: DataFrame, tasks: list[str], model: str = "model") -> DataFrame:
    """Centred with b in 0–1 (missing b = 0); null unless every task of
    ``tasks`` is present for the model."""
    j = acc.filter(F.col("task").isin(tasks)).join(baselines, "task", "left")
    b = F.coalesce(F.col("baseline"), F.lit(0.0))
    c = j.withColumn("centered", (F.col("accuracy") - b) / (1.0 - b))
    g = c.groupBy(model).agg(F.avg("centered").alias("_m"), F.count_distinct("task").alias("n_tasks"))
    return g.select(model, "n_tasks",
                    F.when(F.col("n_tasks") == len(tasks), F.round("_m", 6)).alias("chatcore_metric"))


def categorical_eval(logits: DataFrame, items: DataFrame, idx: str = "idx") -> DataFrame:
    """Argmax over the item's own letters (first letter on ties); letters
    must encode to one byte. items (idx, letters, answer)."""
    il = items.select(idx, F.posexplode("letters").alias("lpos", "letter"), "letters", "answer")
    j = il.join(logits.select(idx, "letter", "logit"), [idx, "letter"], "left")
    # an item without logits keeps its row: no prediction, wrong
    seen = F.when(F.col("logit").isNotNull(), F.struct("logit", -F.col("lpos")))
    g = j.groupBy(idx).agg(F.max_by("letter", seen).alias("pred"),
                           F.first("letters").alias("letters"), F.first("answer").alias("answer"))
    valid = F.forall("letters", lambda x: F.octet_length(x) == 1)
    return g.select(idx, "pred", valid.alias("letters_ok"),
                    F.coalesce(F.col("pred") == F.get(F.col("letters"), F.col("answer")), F.lit(False)).cast("int").alias("correct"))


def subject_accuracy(verdicts: DataFrame, subject: str = "subject") -> DataFrame:
    r = verdicts.rollup(subject).agg(F.grouping(subject).alias("_all"), F.count(F.lit(1)).alias("n"),
                                     F.round(F.avg("correct"), 6).alias("accuracy"))
    return r.withColumn(subject, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(subject))).drop("_all")


# ------------------------------------------------------------------ completions


def trim_completions(seqs: DataFrame, prompt_len: str = "prompt_len", codec: ByteCodec | None = None) -> DataFrame:
    """Drop the prompt, cut before the first assistant_end or BOS, decode."""
    codec = codec or ByteCodec()
    ids = F.col("ids")
    comp = F.slice(ids, F.col(prompt_len) + 1, F.greatest(F.size(ids) - F.col(prompt_len), F.lit(0)))
    e, b = F.array_position(comp, codec.special("assistant_end")), F.array_position(comp, codec.bos)
    stop = F.when((e > 0) & (b > 0), F.least(e, b)).when(e > 0, e).when(b > 0, b)
    cut = F.when(stop.isNotNull(), F.slice(comp, 1, stop - 1)).otherwise(comp)
    return seqs.withColumn("completion", cut).withColumn("text", codec.decode_col(F.col("completion")))


#: Sequences whose masks are made at a time.
MASKED_ROWS = 256


def _mask_batch(ids: pa.ListArray, plen: pa.Array, o_start: int, o_end: int) -> pa.ListArray:
    """Masks of a batch of sequences, which lie end to end."""
    rows = len(ids)
    there = ids.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(there, pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    prompt = np.clip(pc.fill_null(plen, 0).to_numpy(zero_copy_only=False).astype(np.int64), 0, sizes)
    after = np.arange(len(flat)) - np.repeat(ends - sizes, sizes) >= np.repeat(prompt, sizes)
    # markers are counted only after the prompt; an end marker is itself inside
    opened = np.cumsum((flat == o_start) & after)
    closes = (flat == o_end) & after
    closed = np.cumsum(closes) - closes
    depth = np.append(0, opened - closed - closes)[ends - sizes] if len(flat) else np.zeros(rows, np.int64)
    inside = opened - closed > np.repeat(depth, sizes)
    mask = (after & ~inside).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(mask), mask=pa.array(~there))


def completion_mask(seqs: DataFrame, prompt_len: str = "prompt_len", codec: ByteCodec | None = None) -> DataFrame:
    """Mask of a finished rollout: prompt 0, sampled 1, tool output from
    output_start through output_end 0.

    A running count over each array; Spark has no array scan, so this is a
    vectorised UDF (numpy cumulative sums over the rows of Arrow batches).
    """
    codec = codec or ByteCodec()
    o_s, o_e = codec.special("output_start"), codec.special("output_end")

    @F.arrow_udf("array<int>")
    def mask_udf(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, plen in batches:
            for at in range(0, len(ids), MASKED_ROWS):
                yield _mask_batch(ids[at : at + MASKED_ROWS], plen[at : at + MASKED_ROWS], o_s, o_e)

    return seqs.withColumn("mask", mask_udf(F.col("ids"), F.col(prompt_len)))


# ------------------------------------------------------------------ generative


# Fixed value: the answer mark of the grade-school problems.
GSM_RE = r"#### (\-?[0-9\.\,]+)"


def extract_answer(col) -> Column:
    """First ``#### number`` with commas removed, else null."""
    c = F.col(col) if isinstance(col, str) else col
    m = F.regexp_extract(c, GSM_RE, 1)  # empty only without a match: the pattern takes one character at least
    return F.when(m != "", F.replace(m, F.lit(","), F.lit("")))


def with_answer(df: DataFrame, text: str, out: str) -> DataFrame:
    """``extract_answer`` as a column, matching once a row."""
    d = df.withColumn("_answer", F.regexp_extract(F.col(text), GSM_RE, 1))
    return d.withColumn(out, F.when(F.col("_answer") != "", F.replace("_answer", F.lit(","), F.lit("")))).drop("_answer")


def answer_match(items: DataFrame, completions: DataFrame, key: str = "problem") -> DataFrame:
    """Reference answer from the last part of the assistant message,
    predicted answer from the completion; null equals null. A problem without a
    completion keeps one row, with null sample and prediction, that isn't correct."""
    last = items.select(key, F.get(F.reverse("messages"), F.lit(0)).alias("_msg"))
    last = last.select(key, F.get(F.reverse("_msg.parts"), F.lit(0)).alias("_part"), F.col("_msg.content").alias("_content"))
    ref = with_answer(last.select(key, F.coalesce(F.col("_part.text"), F.col("_content")).alias("_text")), "_text", "ref").drop("_text")
    # the answer is read before the shuffle: whole completions don't travel
    c = with_answer(completions, "completion", "pred").drop("completion").withColumn("_there", F.lit(True))
    j = ref.join(c, key, "left")
    there = F.coalesce(F.col("_there"), F.lit(False))
    return (j.withColumn("correct", (there & F.col("pred").eqNullSafe(F.col("ref"))).cast("int"))
             .withColumn("both_missing", there & F.col("pred").isNull() & F.col("ref").isNull()).drop("_there"))


def generative_eval(outcomes: DataFrame, key: str = "problem") -> DataFrame:
    """A problem passes if any sample passes; passed / total."""
    per = outcomes.groupBy(key).agg(F.max("correct").alias("passed"))
    return per.agg(F.count(F.lit(1)).alias("n_problems"), F.sum("passed").cast("bigint").alias("n_passed"),
                   F.round(F.avg("passed"), 6).alias("accuracy"))


def pass_at_k(outcomes: DataFrame, K: int, key: str = "problem", sample: str = "sample") -> DataFrame:
    """For k = 1..K, the share of problems with a success among their first k
    samples (empirical)."""
    first = outcomes.groupBy(key).agg(F.min(F.when(F.col("correct") == 1, F.col(sample))).alias("_first"))
    e = first.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(K))))
    return e.groupBy("k").agg(F.round(F.avg(F.coalesce((F.col("_first") < F.col("k")).cast("int"), F.lit(0))), 6)
                              .alias("pass_at_k"))


def program_pass_rate(results: DataFrame) -> DataFrame:
    """Share of programs per outcome (success, error, timeout, memory)."""
    from pyspark.sql import Window
    g = results.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the few outcome rows, not the results
    return g.select("outcome", "n", F.round(F.col("n") / total, 6).alias("share"))


# ------------------------------------------------------------------ RL


def rollout_advantages(rollouts: DataFrame, prompt: str = "prompt") -> DataFrame:
    """reward − mean reward of the same prompt (no std). The mean is a
    grouped aggregate joined back: a hot prompt is split by AQE's skew join,
    not funnelled through one window task."""
    mu = rollouts.groupBy(prompt).agg(F.avg("reward").alias("_mu"))
    return rollouts.join(mu, prompt).withColumn("advantage", F.col("reward") - F.col("_mu")).drop("_mu")


def rollout_stats(rollouts: DataFrame, step: str = "step", prompt: str = "prompt") -> DataFrame:
    """Per step: mean of per-prompt mean rewards; mean length over all sequences."""
    per = rollouts.groupBy(step, prompt).agg(F.avg("reward").alias("_r"), F.sum("length").alias("_l"),
                                             F.count(F.lit(1)).alias("_n"))
    return per.groupBy(step).agg(F.round(F.avg("_r"), 6).alias("mean_reward"),
                                 F.round(F.sum("_l") / F.sum("_n"), 6).alias("mean_length"))


def policy_objective(logp: DataFrame, advantages: DataFrame, keys: list[str], passes: int,
                     examples: int, sample: str = "sample") -> DataFrame:
    """Σ logp·advantage over valid targets / (max(valid, 1) · passes · examples)
    per pass. logp (sample, pos, logp, target); advantages (sample, advantage, *keys)."""
    # the advantage is one number a sample: targets are summed up before the join
    valid = F.coalesce(F.col("target") >= 0, F.lit(False))
    own = logp.groupBy(sample).agg(F.sum(F.when(valid, F.col("logp"))).alias("_l"), F.count_if(valid).alias("_n"),
                                   F.bool_or(~valid).alias("_masked"))
    j = own.join(advantages.select(sample, "advantage", *keys), sample)
    part = F.coalesce(F.col("_l") * F.col("advantage"), F.when(F.col("_masked"), 0.0))
    g = j.groupBy(*keys).agg(F.sum(part).alias("_s"), F.sum("_n").alias("n_valid"))
    return g.withColumn("objective", F.round(
        F.col("_s") / (F.greatest(F.col("n_valid"), F.lit(1)) * passes * examples), 6)).drop("_s")


# ------------------------------------------------------------------ bits per byte


def token_byte_lengths(vocab: DataFrame) -> DataFrame:
    """Bytes of each token decoded alone (a partial UTF-8 token decodes to
    U+FFFD, 3 bytes); 0 for specials. vocab (token_id, token binary, is_special)."""
    text = F.make_valid_utf8(F.col("token").cast("string"))
    return vocab.select("token_id", F.when(F.col("is_special"), 0).otherwise(F.octet_length(text)).alias("n_bytes"),
                        F.octet_length("token").alias("raw_bytes"), "is_special")


def token_byte_stats(lengths: DataFrame) -> DataFrame:
    nz = F.when(F.col("n_bytes") > 0, F.col("n_bytes"))
    return lengths.agg(F.min(nz).alias("min_bytes"), F.max(nz).alias("max_bytes"),
                       F.round(F.avg(nz), 6).alias("mean_bytes"), F.round(F.stddev_samp(nz), 6).alias("std_bytes"),
                       F.count_if(F.col("n_bytes") == 0).alias("n_zero"))


def _bpb(nats: Column, nbytes: Column) -> Column:
    return F.when(nbytes == 0, F.lit(float("inf"))).otherwise(nats / (F.lit(math.log(2)) * nbytes))


def bits_per_byte(losses: DataFrame, byte_lengths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Σ loss / (ln 2 · Σ bytes) over targets ≥ 0 whose token has bytes;
    no bytes → infinity. The byte-length table is vocabulary sized (a
    fixed bound), so it is broadcast."""
    by = by or []
    bl = F.broadcast(byte_lengths.select(F.col("token_id").alias("target"), "n_bytes"))
    # per token first: a few rows per group meet the table, not one per target
    tok = losses.filter(F.col("target") >= 0).groupBy(*by, "target").agg(F.sum("loss").alias("_nats"), F.count(F.lit(1)).alias("_n"))
    j = tok.join(bl, "target", "left")
    nb = F.coalesce(F.col("n_bytes"), F.lit(0))
    g = j.groupBy(*by).agg(F.sum(F.when(nb > 0, F.col("_nats")).otherwise(0.0)).alias("total_nats"),
                           F.sum(nb * F.col("_n")).cast("bigint").alias("total_bytes"))
    return g.select(*by, F.round("total_nats", 2).alias("total_nats"), "total_bytes",
                    F.round(_bpb(F.col("total_nats"), F.col("total_bytes")), 6).alias("bpb"))


#: Splits whose cut is written out in a filter.
SPLITS_SENT = 100


def split_bpb(losses: DataFrame, byte_lengths: DataFrame, split_tokens: int, tokens_per_step: int,
              order: list[str]) -> DataFrame:
    """bpb per split over its first ``split_tokens`` tokens, rounded down to
    whole steps of ``tokens_per_step``. ``order`` (document, then place) is a
    unique key within a split.

    Two levels: token counts of documents are summed up in order, which finds
    each split's documents before the cut and the one that crosses it; only the
    tokens of that one are put in order.
    """
    budget = (split_tokens // tokens_per_step) * tokens_per_step
    doc, rest = order[0], order[1:]
    sizes = losses.groupBy("split", doc).agg(F.count(F.lit(1)).alias("_c"))
    if not rest:
        firsts = prefix_sum(losses, order, None, by=["split"], idx="_i", before="_b").filter(F.col("_i") < budget)
        return bits_per_byte(firsts, byte_lengths, by=["split"])
    at = prefix_sum(sizes, doc, "_c", by=["split"], idx="_i", before="_b")
    # the first document past the cut and the tokens it may still give; a row per split
    cut = at.filter(F.col("_b") + F.col("_c") > budget).groupBy(F.col("split").alias("_s")).agg(
        F.min_by(F.struct(F.col(doc).alias("d"), (F.lit(budget) - F.col("_b")).alias("left")), "_i").alias("_cut"))
    known = cut.select("_s", "_cut.d").limit(SPLITS_SENT + 1).collect()
    if 0 < len(known) <= SPLITS_SENT:  # written out, the cut is applied where documents are read
        whose = [F.col("split").eqNullSafe(F.lit(r["_s"])) for r in known]
        beyond = F.lit(False)
        for own, r in zip(whose, known):
            beyond = beyond | (own & F.coalesce(F.col(doc) > F.lit(r["d"]), F.lit(False)))
        losses = losses.filter(~beyond)
    j = losses.join(F.broadcast(cut), F.col("split").eqNullSafe(F.col("_s")), "left")
    whole = j.filter(F.col("_cut").isNull() | (F.col(doc) < F.col("_cut.d")))
    cross = j.filter(F.col(doc) == F.col("_cut.d"))
    cross = cross.withColumn("_r", F.row_number().over(Window.partitionBy("split").orderBy(*rest))).filter(F.col("_r") <= F.col("_cut.left"))
    cols = ["split", "target", "loss"]
    return bits_per_byte(whole.select(cols).unionByName(cross.select(cols)), byte_lengths, by=["split"])


# ------------------------------------------------------------------ item-level (no shuffle) spans


def option_parts(items: DataFrame, shots: DataFrame | None, kind: str, delim: str = " ", idx: str = "idx") -> DataFrame:
    """(idx, before, options array<string>, after): the prompt of an option is
    ``before + option + after``. What the options share is on the row once."""
    if kind == "mc":
        block = _mc_block(delim)
        parts = (F.concat(F.col("fewshot"), F.col("query"), F.lit(delim)), F.col("choices"), F.lit(""))
    elif kind == "schema":
        block = _schema_block(delim)
        parts = (F.col("fewshot"), F.col("context_options"), F.concat(F.lit(delim), F.col("continuation")))
    else:
        raise ValueError(kind)
    before, options, after = parts
    return _with_fewshot(items, shots, block, idx).select(idx, before.alias("before"), options.alias("options"), after.alias("after"))


def _shared_bytes(texts: list[bytes]) -> int:
    low, high = min(texts), max(texts)  # what these begin with in common, all do
    done, n = 0, min(len(low), len(high))
    while done < n and low[done] == high[done]:
        step = 1
        while done + step <= n and low[done : done + step] == high[done : done + step]:
            done, step = done + step, step * 2
    return done


def _common_bytes(ends: bool):
    """A column function: how many bytes all strings of an array begin (``ends``:
    end) with in common; nulls don't count, and 0 if the first is null or absent."""
    @F.arrow_udf("int")
    def common(options: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in options:
            out = []
            for o in batch.cast(pa.list_(pa.binary())).to_pylist():
                texts = [x[::-1] if ends else x for x in o or () if x is not None]
                out.append(_shared_bytes(texts) if o and o[0] is not None else 0)
            yield pa.array(out, pa.int32())

    return common


def option_spans_items(parts: DataFrame, kind: str, codec: ByteCodec | None = None, idx: str = "idx",
                       packed: bool = False) -> DataFrame:
    """Spans of every option from ``option_parts``: (idx, opt, ids, start, end);
    ``packed``: ids as in ``tokenize_prompts``.

    The shared text is encoded once and only the options are compared: the
    common prefix (mc) is BOS, ``before`` and what the options have in common;
    the common suffix (schema) is ``after`` and what the options end with in
    common, going on into ``before`` if an option is an ending of all others.
    With bytes, ids of a concatenation are the concatenated ids. A merging codec
    encodes ``before`` and ``after`` once and, for each option, the pieces that
    touch its bounds, up to where the split is that of ``after`` again."""
    codec = codec or ByteCodec()
    if codec.kind != "byte":
        spans = codec.option_spans(kind)(F.col("before"), F.col("options"), F.col("after"))
        return parts.select(idx, F.posexplode(spans).alias("opt", "_s")).select(idx, "opt", "_s.ids", "_s.start", "_s.end")
    head = F.array(F.lit(codec.bos))
    n_before, n_after = codec.length_col("before"), codec.length_col("after")
    common = _common_bytes(kind != "mc")(F.col("options"))
    if kind == "mc":
        d = parts.withColumn("_c", 1 + n_before + common)
    else:
        d = parts.withColumn("_ends", common)
        shortest = F.array_min(F.transform("options", lambda o: codec.length_col(o)))
        further = _common_len(F.transform("options", lambda o: F.reverse(F.concat(head, codec.encode_col("before"), codec.encode_col(o)))))
        d = d.withColumn("_c", n_after + F.when(F.col("_ends") < shortest, F.col("_ends")).otherwise(further))
    # options stay texts until their ids are asked for; what they share is packed once.
    # An inner explode would have Spark filter the items by it when they are read: their
    # texts would be cut twice, and other kinds couldn't share that read
    as_ids = codec.packed_col if packed else F.col
    d = d.select(idx, as_ids("before").alias("before"), as_ids("after").alias("after"), (1 + n_before + n_after).alias("_n"), "_c",
                 F.posexplode_outer("options").alias("opt", "_text")).filter(F.col("opt").isNotNull())
    end = F.col("_n") + codec.length_col("_text")
    if packed:
        ids = F.concat("before", codec.packed_col("_text"), "after")
    else:
        ids = F.concat(head, codec.encode_col("before"), codec.encode_col("_text"), codec.encode_col("after"))
    start = F.col("_c") if kind == "mc" else end - F.col("_c")
    return d.select(idx, "opt", ids.alias("ids"), start.cast("int").alias("start"), end.cast("int").alias("end"))
