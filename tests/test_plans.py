from pyspark.sql import functions as F

from given import SF
import views as V
from tessera.plans import pipelines as PL


def test_pretraining_rows_are_full_and_start_with_bos(spark):
    docs = V.docs(spark, SF).select("doc_id", "text")
    rows = PL.pretraining_rows(docs, T=255, group=F.col("doc_id") % 2, buffer=20, refill=8)
    r = rows.select(F.size("inputs").alias("n"), F.get("inputs", 0).alias("first"), "inputs", "targets").collect()
    assert len(r) > 0
    assert all(x["n"] == 255 and x["first"] == 261 for x in r)
    assert all(list(x["inputs"][1:]) == list(x["targets"][:-1]) for x in r)


def test_caption_sft_rows_have_placeholders(spark):
    rows = PL.caption_sft_rows(V.images(spark, SF), V.annotations(spark, SF), V.emb(spark, SF), T=127).collect()
    assert rows
    for x in rows[:20]:
        n_img = len(x["embedding"])
        assert len(x["inputs"]) == 127
        assert list(x["inputs"][: n_img + 1]) == [261] * (n_img + 1)


def test_core_prompt_and_score_jobs(spark):
    items = V.mc_items(spark, SF)
    spans = PL.core_prompts(items, k=2, max_len=128)
    assert spans.filter("crop_ok <> (start >= 0)").count() == 0
    assert spans.filter("size(ids) > 128").count() == 0
    s = PL.core_prompts(items, k=2).select("idx", "opt", "start", "end")
    losses = (s.select("idx", "opt", F.explode(F.sequence(F.lit(0), F.col("end"))).alias("pos"))
               .withColumn("loss", F.rand(1)))
    gold = items.select("idx", "gold", F.col("subject").alias("task"))
    core = PL.core_scores(losses, s, gold, V.baselines_pct(spark).limit(0).unionByName(
        spark.createDataFrame([(f"src{i}", 25.0) for i in range(20)], "task string, baseline double"))).first()
    assert core["n_tasks"] >= 1
