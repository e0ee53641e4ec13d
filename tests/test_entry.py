import duckdb

import __spark_entry__ as E
from given import SF

FAST = ["scan_corpus", "byte_encode", "pack_concat", "packing_report", "validate_conversations", "render_conversation",
        "captions_first", "sample_fewshot", "score_options", "core_metric", "parse_gsm8k", "smoothed_loss", "isoflop_fit"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and "util_pct" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return float(f"{v:.6g}")
    return v


def test_oracle_agrees_on_smoke_data(spark):
    con = duckdb.connect()
    for t in ["documents", "conversations", "lineitem", "part", "customer", "events", "embeddings"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    for k in FAST:
        s = qs[k](spark, SF)
        a = sorted((tuple(_norm(x) for x in r) for r in s.select(*sorted(s.columns)).collect()), key=repr)
        cur = con.execute(sql[k])
        cols = [d[0] for d in cur.description]
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        b = sorted((tuple(_norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)
        assert sorted(cols) == sorted(s.columns), k
        assert a == b, k
