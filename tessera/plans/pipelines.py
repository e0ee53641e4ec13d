"""End-to-end flows, each one lazy plan built from library operators.

* ``pretraining_rows`` — corpus → tokens → best-fit layout → token rows →
  (inputs, targets). Packing works on lengths only; tokens are joined back
  per (document, piece) and re-assembled per row (a row is a small group).
* ``caption_sft_rows`` — annotations → one conversation per caption → split →
  validate → render → embeddings → placeholders → padded rows → shift.
* ``core_prompts`` / ``core_scores`` — the two CORE jobs: prompts and spans
  for any model runner, then scoring of the losses it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import ByteCodec
from ..operators import captions as CP
from ..operators import chat as CH
from ..operators import evaluate as EV
from ..operators import packing as P
from ..operators import selection as S


def pretraining_rows(docs: DataFrame, T: int, group: F.Column, codec: ByteCodec | None = None,
                     buffer: int = 1000, refill: int = 128) -> DataFrame:
    """docs (doc_id, text) → (grp, row_id, inputs, targets), every row T+1
    tokens starting with BOS (best-fit with cropping). ``group`` names the
    stream of a document, packed by one task in order; take one that grows with
    the corpus, such as the shard."""
    codec = codec or ByteCodec()
    toks = docs.select("doc_id", F.concat(F.array(F.lit(codec.bos)), codec.encode_col(F.col("text"))).alias("ids"))
    lens = toks.select("doc_id", F.size("ids").cast("bigint").alias("len"), group.alias("grp"), F.col("doc_id").alias("ord"))
    layout = P.pack_bestfit_crop(lens, T, buffer=buffer, refill=refill)
    pieces = layout.join(toks, "doc_id").select(
        "grp", "row_id", "pos", F.slice("ids", F.col("start") + 1, F.col("len")).alias("piece"))
    rows = pieces.groupBy("grp", "row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("_p"))
    rows = rows.select("grp", "row_id", F.flatten(F.transform("_p", lambda p: p["piece"])).alias("ids"))
    return P.shift_targets(rows, mask=None).select("grp", "row_id", "inputs", "targets")


def caption_sft_rows(images: DataFrame, annotations: DataFrame, emb: DataFrame, T: int, split: str = "train",
                     train: float = 0.8, val: float = 0.1, codec: ByteCodec | None = None) -> DataFrame:
    """One padded SFT row per caption of the chosen split, with the image
    placeholders after BOS and the embedding attached."""
    codec = codec or ByteCodec()
    convs = CP.captions_expand(images, annotations).withColumn("key", F.concat_ws(":", "image_id", "ann_id"))
    convs = S.split_fractions(convs, train, val, "key").filter(F.col("split") == split)
    ok = CH.validate_conversations(convs).filter("valid").drop("valid", "reason")
    rendered = CH.render_conversation(ok, codec, max_tokens=T + 1).filter("valid")
    with_emb = CP.attach_embeddings(rendered, emb)
    placed = CP.inject_placeholders(with_emb.withColumn("n_img", F.size("embedding")), "n_img")
    rows = CH.sft_rows(placed, T, codec.bos)
    return P.shift_targets(rows).select("image_id", "ann_id", "inputs", "targets", "embedding")


def core_prompts(items: DataFrame, k: int, kind: str = "mc", delim: str = " ", max_len: int | None = None,
                 codec: ByteCodec | None = None) -> DataFrame:
    """Prompt job: few-shot prompts, token ids and scored spans per option
    (mc: items (idx, query, choices, gold))."""
    codec = codec or ByteCodec()
    shots = EV.sample_fewshot(items.select("idx"), k)
    if kind == "mc":
        p = EV.prompts_mc(items, shots, delim)
    elif kind == "schema":
        p = EV.prompts_schema(items, shots, delim)
    else:
        raise ValueError(kind)
    spans = EV.option_spans(EV.tokenize_prompts(p, codec), kind)
    if max_len is None:
        return spans.select("idx", "opt", "ids", "start", "end", F.lit(True).alias("crop_ok"))
    return EV.left_crop(spans, max_len).select("idx", "opt", "ids", "start", "end", "crop_ok")


def core_scores(losses: DataFrame, spans: DataFrame, gold: DataFrame, baselines_pct: DataFrame,
                task: str = "task") -> DataFrame:
    """Score job: option losses → verdicts → accuracy per task → CORE."""
    v = EV.score_options(losses, spans, gold)
    acc = v.groupBy(task).agg(F.avg("correct").alias("accuracy")).withColumn("model", F.lit("model"))
    return EV.core_metric(acc, baselines_pct)
