from pyspark.sql import functions as F

import reference_impl as R
from tessera.functions.codec import BYTE_SPECIALS
from tessera.operators import chat as CH

MT = "array<struct<role:string,content:string,parts:array<struct<type:string,text:string>>>>"


def _df(spark, convs):
    rows = [(i, m) for i, m in enumerate(convs)]
    return spark.createDataFrame(rows, f"conv_id long, messages {MT}")


def _msg(role, content=None, parts=None):
    return {"role": role, "content": content, "parts": parts}


CONVS = [
    [_msg("system", "Be brief."), _msg("user", "Hi 你好"), _msg("assistant", "Hello 🌍")],
    [_msg("user", "2+3?"), _msg("assistant", None, [{"type": "text", "text": "It is "},
                                                      {"type": "python", "text": "2+3"},
                                                      {"type": "python_output", "text": "5"},
                                                      {"type": "text", "text": ". #### 5"}])],
    [_msg("user", "x" * 3000), _msg("assistant", "y")],
]


def test_render_matches_reference(spark):
    out = {r["conv_id"]: r for r in CH.render_conversation(_df(spark, CONVS)).collect()}
    for i, c in enumerate(CONVS):
        ids, mask = R.render([{k: v for k, v in m.items()} for m in c], BYTE_SPECIALS)
        assert out[i]["valid"]
        assert list(out[i]["ids"]) == ids and list(out[i]["mask"]) == mask
        assert len(out[i]["ids"]) == len(out[i]["mask"]) <= 2048


def test_system_only_and_bad_roles_are_invalid(spark):
    bad = [[_msg("system", "s")], [_msg("assistant", "a"), _msg("user", "u")],
           [_msg("user", "u"), _msg("assistant", None, [{"type": "image", "text": "?"}])]]
    out = {r["conv_id"]: r for r in CH.render_conversation(_df(spark, bad)).collect()}
    assert [out[i]["valid"] for i in range(3)] == [False, False, False]
    assert out[1]["reason"] == "bad_role:0"
    assert out[2]["reason"] == "unknown_part:1"


def test_validations_first_failing_rule(spark):
    convs = [[_msg("user", "a")], [_msg("user", "a"), _msg("user", "b")], [_msg("user", "a"), _msg("assistant", "  ")],
             [_msg("system", "s"), _msg("user", "a"), _msg("assistant", "b")]]
    df = _df(spark, convs)
    v = {r["conv_id"]: r["reason"] for r in CH.validate_conversations(df).collect()}
    assert v == {0: "too_short", 1: "bad_role:1", 2: None, 3: "bad_role:0"}
    s = {r["conv_id"]: r["reason"] for r in CH.validate_smoltalk(df).collect()}
    assert s[3] is None and s[0] == "too_short"
    y = {r["conv_id"]: r["reason"] for r in CH.validate_synthetic(df).collect()}
    assert y[2] == "empty_content:1"


def test_limits_order(spark):
    convs = [[_msg("user", "")], [_msg("user", "a" * 8001)], [_msg("user", "a" * 8000)] * 5,
             [_msg("system", "ok"), _msg("user", "b")]]
    r = {x["conv_id"]: x["reason"] for x in CH.conversation_limits(_df(spark, convs)).collect()}
    assert r == {0: "empty_content:0", 1: "message_too_long:0", 2: "total_too_long", 3: "invalid_role:0"}


def test_sft_rows_pad_and_shift(spark):
    from tessera.operators.packing import shift_targets
    r = CH.sft_rows(CH.render_conversation(_df(spark, CONVS[:1])), T=63, pad=261)
    row = shift_targets(r).first()
    assert len(row["ids"]) == 64 and len(row["mask"]) == 64
    assert len(row["inputs"]) == len(row["targets"]) == 63
    assert all(t == -1 for t, m in zip(row["targets"], row["mask"][1:]) if m == 0)
