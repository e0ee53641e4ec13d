"""Conversations: validation, limits, system merge, rendering with loss masks.

A conversation is one row: ``messages array<struct<role, content, parts>>``
where ``parts`` (``array<struct<type, text>>``) is set instead of ``content``
for tool-using assistant turns. Every rule is an array expression over the
row, so validation and rendering are narrow transformations: no shuffle.
Failures become ``(valid, reason)`` columns instead of aborting the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import ByteCodec

MSG = "messages"
PARTS_T = "array<struct<type:string,text:string>>"


def ensure_parts(c: DataFrame) -> DataFrame:
    """Give messages a (null) ``parts`` field when the input has none."""
    from pyspark.sql.types import ArrayType, StructType
    t = c.schema[MSG].dataType
    if isinstance(t, ArrayType) and isinstance(t.elementType, StructType) and "parts" not in t.elementType.names:
        return c.withColumn(MSG, F.transform(F.col(MSG), lambda m: m.withField("parts", F.lit(None).cast(PARTS_T))))
    return c


def _first_reason(reasons: Column) -> Column:
    """First non-null entry of an array of reason strings (null if none)."""
    return F.get(F.filter(reasons, lambda r: r.isNotNull()), 0)


def _is_blank(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "") == F.lit("")


def _alternation(msgs: Column, with_content_check: str | None) -> Column:
    """Per message: first failing rule among role present, content present,
    expected role (user, assistant, user, …), content is a string."""

    def per(m, i):
        expected = F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
        c = F.when(m["role"].isNull(), F.concat(F.lit("missing_role:"), i.cast("string")))
        c = c.when(m["content"].isNull() & m["parts"].isNull(), F.concat(F.lit("missing_content:"), i.cast("string")))
        c = c.when(m["role"] != expected, F.concat(F.lit("bad_role:"), i.cast("string")))
        c = c.when(m["content"].isNull(), F.concat(F.lit("content_not_string:"), i.cast("string")))
        if with_content_check == "blank":
            c = c.when(_is_blank(m["content"]), F.concat(F.lit("empty_content:"), i.cast("string")))
        return c

    return _first_reason(F.transform(msgs, per))


def _with_verdict(df: DataFrame, reason: Column) -> DataFrame:
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def validate_conversations(c: DataFrame) -> DataFrame:
    """≥ 2 messages, role and content present, user/assistant alternate from
    user, content is a string."""
    c = ensure_parts(c)
    m = F.col(MSG)
    reason = F.when(m.isNull(), F.lit("no_messages")).when(F.size(m) < 2, F.lit("too_short")).otherwise(_alternation(m, None))
    return _with_verdict(c, reason)


def _drop_system(m: Column) -> Column:
    return F.when(F.get(m, 0)["role"] == "system", F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)


def validate_smoltalk(c: DataFrame) -> DataFrame:
    """As ``validate_conversations`` after an optional leading system message."""
    c = ensure_parts(c)
    m = F.col(MSG)
    rest = _drop_system(m)
    reason = (F.when(m.isNull(), F.lit("no_messages"))
               .when(F.size(m) < 1, F.lit("empty"))
               .when(F.size(rest) < 2, F.lit("too_short"))
               .otherwise(_alternation(rest, None)))
    return _with_verdict(c, reason)


def validate_synthetic(c: DataFrame) -> DataFrame:
    """≥ 2 messages, alternation, no blank content."""
    c = ensure_parts(c)
    m = F.col(MSG)
    reason = F.when(m.isNull(), F.lit("no_messages")).when(F.size(m) < 2, F.lit("too_short")).otherwise(_alternation(m, "blank"))
    return _with_verdict(c, reason)


def synthetic_summary(checked: DataFrame) -> DataFrame:
    """Kept and rejected counts of a ``validate_synthetic`` result."""
    return checked.agg(F.count_if(F.col("valid")).alias("kept"), F.count_if(~F.col("valid")).alias("errors"))


def conversation_limits(c: DataFrame, max_messages: int = 500, max_chars: int = 8000,
                        max_total: int = 32000) -> DataFrame:
    """Request limits, first failing rule in order: count, then per message
    empty / too long, then total length, then roles."""
    m = F.col(MSG)
    n = F.size(m)

    def per(x, i):
        ln = F.coalesce(F.length(x["content"]), F.lit(0))
        return (F.when(ln == 0, F.concat(F.lit("empty_content:"), i.cast("string")))
                 .when(ln > max_chars, F.concat(F.lit("message_too_long:"), i.cast("string"))))

    total = F.aggregate(m, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(F.length(x["content"]), F.lit(0)))
    bad_role = _first_reason(F.transform(m, lambda x, i: F.when(
        ~x["role"].isin("user", "assistant") | x["role"].isNull(), F.concat(F.lit("invalid_role:"), i.cast("string")))))
    reason = (F.when(m.isNull() | (n == 0), F.lit("no_messages"))
               .when(n > max_messages, F.lit("too_many_messages"))
               .otherwise(F.coalesce(_first_reason(F.transform(m, per)),
                                     F.when(total > max_total, F.lit("total_too_long")),
                                     bad_role)))
    return _with_verdict(c, reason)


def merge_system(c: DataFrame) -> DataFrame:
    """Leading system text is joined to the next (user) message with a blank
    line; a system message not followed by a user message is invalid."""
    c = ensure_parts(c)
    m = F.col(MSG)
    first, second = F.get(m, 0), F.get(m, 1)
    has_sys = F.coalesce(first["role"] == "system", F.lit(False))
    merged = F.transform(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(1))), lambda x, i: F.when(
        i == 0, x.withField("content", F.concat(first["content"], F.lit("\n\n"), x["content"]))).otherwise(x))
    ok = ~has_sys | F.coalesce(second["role"] == "user", F.lit(False))
    return (c.withColumn("merge_ok", ok)
             .withColumn(MSG, F.when(has_sys & ok, merged).otherwise(m)))


# ------------------------------------------------------------------ rendering

def _seg(ids: Column, mask: int) -> Column:
    return F.struct(ids.alias("ids"), F.lit(mask).alias("m"))


def _one(x: int) -> Column:
    return F.array(F.lit(x))


def _render_segments(msgs: Column, codec: ByteCodec) -> tuple[Column, Column]:
    """(segments, error) for messages that must alternate user/assistant."""
    sp = codec.special
    enc = codec.encode_col

    def part_segs(p):
        t = p["type"]
        txt = enc(F.coalesce(p["text"], F.lit("")))
        return (F.when(t == "text", F.array(_seg(txt, 1)))
                 .when(t == "python", F.array(_seg(_one(sp("python_start")), 1), _seg(txt, 1),
                                              _seg(_one(sp("python_end")), 1)))
                 .when(t == "python_output", F.array(_seg(_one(sp("output_start")), 0), _seg(txt, 0),
                                                     _seg(_one(sp("output_end")), 0))))

    def msg_segs(m, i):
        expected = F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
        user = F.array(_seg(_one(sp("user_start")), 0), _seg(enc(m["content"]), 0), _seg(_one(sp("user_end")), 0))
        body = F.when(m["content"].isNotNull(), F.array(_seg(enc(m["content"]), 1))).otherwise(
            F.flatten(F.transform(m["parts"], part_segs)))
        asst = F.concat(F.array(_seg(_one(sp("assistant_start")), 0)), body,
                        F.array(_seg(_one(sp("assistant_end")), 1)))
        return F.when(m["role"] != expected, F.lit(None)).when(m["role"] == "user", user).otherwise(asst)

    per_msg = F.transform(msgs, msg_segs)
    bad_role = _first_reason(F.transform(msgs, lambda m, i: F.when(
        m["role"] != F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")),
        F.concat(F.lit("bad_role:"), i.cast("string")))))
    bad_part = _first_reason(F.transform(msgs, lambda m, i: F.when(
        F.exists(F.coalesce(m["parts"], F.array()), lambda p: ~p["type"].isin("text", "python", "python_output")),
        F.concat(F.lit("unknown_part:"), i.cast("string")))))
    err = F.coalesce(bad_role, F.when(m_user_parts(msgs), F.lit("user_parts")), bad_part)
    segs = F.concat(F.array(_seg(_one(codec.bos), 0)), F.flatten(per_msg))
    return segs, err


def m_user_parts(msgs: Column) -> Column:
    return F.exists(msgs, lambda m: (m["role"] == "user") & m["content"].isNull())


def _ids_mask(segs: Column) -> tuple[Column, Column]:
    ids = F.flatten(F.transform(segs, lambda s: s["ids"]))
    mask = F.flatten(F.transform(segs, lambda s: F.array_repeat(s["m"], F.size(s["ids"]))))
    return ids, mask


def render_conversation(c: DataFrame, codec: ByteCodec | None = None, max_tokens: int = 2048) -> DataFrame:
    """BOS; user turns masked 0; assistant_start 0, content and assistant_end 1;
    python parts 1 with their markers, tool output 0 with its markers; a
    leading system message is merged into the first user turn; cut to
    ``max_tokens``. Adds ``ids``, ``mask``, ``valid``, ``reason``."""
    codec = codec or ByteCodec()
    d = merge_system(c)
    segs, err = _render_segments(F.col(MSG), codec)
    err = F.coalesce(F.when(~F.col("merge_ok"), F.lit("system_not_followed_by_user")),
                     F.when(F.size(F.col(MSG)) < 1, F.lit("empty")), err)
    ids, mask = _ids_mask(segs)
    d = d.withColumn("reason", err).withColumn("valid", F.col("reason").isNull())
    ok = F.col("valid")
    return (d.withColumn("ids", F.when(ok, F.slice(ids, 1, max_tokens)))
             .withColumn("mask", F.when(ok, F.slice(mask, 1, max_tokens)))
             .drop("merge_ok"))


def render_for_completion(c: DataFrame, codec: ByteCodec | None = None, max_tokens: int = 2048) -> DataFrame:
    """Drop the last (assistant) message, render, then append assistant_start
    (after the cut, as the reference does)."""
    codec = codec or ByteCodec()
    m = F.col(MSG)
    last_ok = F.coalesce(F.get(m, F.size(m) - 1)["role"] == "assistant", F.lit(False))
    d = c.withColumn("_last_ok", last_ok).withColumn(MSG, F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(1))))
    r = render_conversation(d, codec, max_tokens)
    r = (r.withColumn("reason", F.when(~F.col("_last_ok"), F.lit("last_not_assistant")).otherwise(F.col("reason")))
          .withColumn("valid", F.col("reason").isNull()))
    return (r.withColumn("ids", F.when(F.col("valid"), F.concat(F.col("ids"), _one(codec.special("assistant_start")))))
             .drop("mask", "_last_ok"))


def render_chat_prompt(c: DataFrame, codec: ByteCodec | None = None) -> DataFrame:
    """Serving form: BOS, user and assistant turns with their markers (other
    roles skipped), no truncation, ends with assistant_start."""
    codec = codec or ByteCodec()
    sp, enc = codec.special, codec.encode_col

    def one(m):
        return (F.when(m["role"] == "user", F.concat(_one(sp("user_start")), enc(m["content"]), _one(sp("user_end"))))
                 .when(m["role"] == "assistant", F.concat(_one(sp("assistant_start")), enc(m["content"]),
                                                          _one(sp("assistant_end"))))
                 .otherwise(F.array().cast("array<int>")))

    ids = F.concat(_one(codec.bos), F.flatten(F.transform(F.col(MSG), one)), _one(sp("assistant_start")))
    return c.withColumn("ids", ids)


def supervision_stats(rendered: DataFrame) -> DataFrame:
    """Supervised and total tokens per rendered conversation."""
    sup = F.aggregate(F.col("mask"), F.lit(0), lambda a, x: a + x)
    return (rendered.withColumn("n_tokens", F.size("ids"))
                    .withColumn("n_supervised", sup)
                    .withColumn("supervised_share", F.round(F.col("n_supervised") / F.col("n_tokens"), 6)))


def flatten_parts(c: DataFrame, col: str = "parts", out: str = "text") -> DataFrame:
    """Parts back to readable text: python as ``<<expr=``, output as ``result>>``."""
    def one(p):
        return (F.when(p["type"] == "python", F.concat(F.lit("<<"), p["text"], F.lit("=")))
                 .when(p["type"] == "python_output", F.concat(p["text"], F.lit(">>")))
                 .otherwise(p["text"]))
    return c.withColumn(out, F.array_join(F.transform(F.col(col), one), ""))


def sft_rows(rendered: DataFrame, T: int, pad: int) -> DataFrame:
    """One conversation per row of T+1: cut, then pad with ``pad`` (mask 0)."""
    C = T + 1
    ids = F.slice(F.col("ids"), 1, C)
    mask = F.slice(F.col("mask"), 1, C)
    rest = F.greatest(F.lit(C) - F.size(ids), F.lit(0))
    return rendered.withColumns({"ids": F.concat(ids, F.array_repeat(F.lit(pad), rest)),
                                 "mask": F.concat(mask, F.array_repeat(F.lit(0), rest))})
