"""Captions and image embeddings.

Captions and embeddings are as large as the image set, so every look-up is
a shuffle join on ``image_id`` (never a broadcast of either side); only the
single default embedding is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import ByteCodec

PROMPT = "Describe this image."


def _conv(caption: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), F.lit(PROMPT).alias("content")),
                   F.struct(F.lit("assistant").alias("role"), caption.alias("content")))


def captions_first(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """One conversation per image with its first caption (file order), or ''."""
    first = annotations.groupBy("image_id").agg(F.min_by("caption", "ann_id").alias("caption"))
    return (images.join(first, "image_id", "left")
                  .select("image_id", _conv(F.coalesce(F.col("caption"), F.lit(""))).alias("messages")))


def captions_expand(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """One conversation per caption; one with '' for an image without any."""
    return (images.join(annotations.select("image_id", "ann_id", "caption"), "image_id", "left")
                  .select("image_id", "ann_id", _conv(F.coalesce(F.col("caption"), F.lit(""))).alias("messages")))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def caption_tokens(annotations: DataFrame, codec: ByteCodec | None = None) -> DataFrame:
    """Keyed ``(image_id, j)`` with ``j`` the caption's original index for its
    image; blank captions skipped; ids = BOS + tokens + assistant_end."""
    codec = codec or ByteCodec()
    j = F.row_number().over(Window.partitionBy("image_id").orderBy("ann_id")) - 1
    a = annotations.withColumn("j", j.cast("int")).withColumn("_c", _strip(F.col("caption")))
    a = a.filter(F.col("_c") != "")
    ids = F.concat(F.array(F.lit(codec.bos)), codec.encode_col(F.col("_c")),
                   F.array(F.lit(codec.special("assistant_end"))))
    return a.select("image_id", "j", ids.alias("ids"))


def write_token_table(tokens: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Append only rows whose keys are not in the table at ``path`` yet.

    Returns the rows written. Existing keys are found with a left-anti join
    against the stored key columns (only those columns are read).
    """
    spark = tokens.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = tokens.dropDuplicates(keys)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # a table that can't be read is an error
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    w = new.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return new


def as_matrix(emb: DataFrame, col: str = "embedding", rows: int = 1) -> DataFrame:
    """Lift a flat vector to ``rows`` × (d/rows) (1-D is 1×d)."""
    d = F.size(F.col(col))
    per = (d / rows).cast("int")
    m = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.slice(F.col(col), r * per + 1, per))
    return emb.withColumn(col, m)


def attach_embeddings(convs: DataFrame, emb: DataFrame, strict: bool = False,
                      zeros_shape: tuple[int, int] = (50, 768)) -> DataFrame:
    """Embedding (``array<array<float>>``) per conversation by ``image_id``.

    Missing id or embedding → the default: the embedding with the smallest
    image_id (deterministic form of "first valid file"), else zeros. Strict
    mode raises if any conversation has no embedding of its own.
    """
    from pyspark.sql.types import ArrayType
    if not isinstance(emb.schema["embedding"].dataType.elementType, ArrayType):
        emb = emb.withColumn("embedding", F.array(F.col("embedding")))  # 1-D is lifted to 1×d
    e = emb.select(F.col("image_id").alias("_eid"), F.col("embedding").alias("_emb"))
    joined = convs.join(e, convs["image_id"] == e["_eid"], "left")
    if strict:
        missing = joined.filter(F.col("_eid").isNull()).limit(1).count()
        if missing:
            raise ValueError("conversation without an image embedding (strict mode)")
    default = emb.orderBy("image_id").limit(1).select(F.col("embedding").alias("_default"), F.lit(1).alias("_k"))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), zeros_shape[1]), zeros_shape[0])
    # one row (the smallest image id): the only broadcast in this operator
    out = joined.withColumn("_k", F.lit(1)).join(F.broadcast(default), "_k", "left").drop("_k")
    return (out.withColumn("used_default", F.col("_eid").isNull())
               .withColumn("embedding", F.coalesce(F.col("_emb"), F.col("_default"), zeros))
               .drop("_eid", "_emb", "_default"))


def inject_placeholders(rendered: DataFrame, n_col: str) -> DataFrame:
    """After BOS insert one BOS per image token (mask 0)."""
    ids, mask, n = F.col("ids"), F.col("mask"), F.col(n_col)
    bos = F.get(ids, 0)
    rest = F.greatest(F.size(ids) - 1, F.lit(0))
    return rendered.withColumns({
        "ids": F.concat(F.array(bos), F.array_repeat(bos, n), F.slice(ids, 2, rest)),
        "mask": F.concat(F.array(F.get(mask, 0)), F.array_repeat(F.lit(0), n), F.slice(mask, 2, rest)),
    })


def embedding_coverage(images: DataFrame, emb: DataFrame, tokens: DataFrame) -> DataFrame:
    """Counts of images with and without embeddings and captions, and of
    embeddings without an image (full outer joins on image_id)."""
    i = images.select("image_id").distinct().withColumn("_img", F.lit(True))
    e = emb.select("image_id").distinct().withColumn("_emb", F.lit(True))
    c = tokens.select("image_id").distinct().withColumn("_cap", F.lit(True))
    j = i.join(e, "image_id", "full").join(c, "image_id", "full")
    img, em, cap = (F.coalesce(F.col(x), F.lit(False)) for x in ("_img", "_emb", "_cap"))
    return j.agg(
        F.count_if(img).alias("n_images"),
        F.count_if(img & em).alias("n_with_embedding"),
        F.count_if(img & cap).alias("n_with_caption"),
        F.count_if(img & ~em).alias("n_missing_embedding"),
        F.count_if(img & ~cap).alias("n_missing_caption"),
        F.count_if(em & ~img).alias("n_embedding_without_image"),
    )


def cosine(a: Column, b: Column) -> Column:
    a = F.transform(a, lambda x: x.cast("double"))
    b = F.transform(b, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (na * nb)


def caption_similarity(pairs: DataFrame, gen: str = "generated", target: str = "target") -> DataFrame:
    """Cosine similarity per pair, then the mean over pairs (the reference
    collects the scores but never sets the mean it logs)."""
    s = pairs.withColumn("sim", cosine(F.col(gen), F.col(target)))
    return s.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("sim"), 6).alias("mean_similarity"))


def expand_existing(lines: DataFrame, annotations: DataFrame, line_col: str = "line", key: str = "line_no") -> DataFrame:
    """Rewrite chat JSONL lines with every caption of their image.

    For a line with an ``image_id`` that has captions: one output line per
    caption (in annotation order) where the first assistant message takes
    the caption, or an assistant message is appended, or — without a
    ``messages`` list — the standard two-message conversation is made.
    Lines that are not JSON, have no image_id or no captions stay as they
    are. ``image_id`` is matched as an integer when it parses as one. All other
    keys of the line and of its messages keep their place, value and type: they
    pass through as variants. Lines without an image never meet the join.
    Output: (line_no, caption_idx, changed, image_id, messages, line).
    """
    t = "struct<image_id:string,messages:array<struct<role:string,content:string>>>"
    v = lines.withColumn("_obj", F.from_json(F.col(line_col), t)).withColumn(
        "_ok", F.try_parse_json(F.col(line_col)).isNotNull() & F.trim(F.col(line_col)).startswith("{"))
    v = v.withColumn("_img", F.when(F.col("_ok"), F.col("_obj.image_id").try_cast("bigint")))
    caps = annotations.select(F.col("image_id").alias("_img"), "ann_id", "caption")
    none = v.filter(F.col("_img").isNull()).withColumns({"ann_id": F.lit(None).cast(caps.schema["ann_id"].dataType), "caption": F.lit(None).cast("string")})
    w = Window.partitionBy(key).orderBy("ann_id")
    j = v.filter(F.col("_img").isNotNull()).join(caps, "_img", "left").withColumn("_n", F.row_number().over(w) - 1)
    j = j.unionByName(none.withColumn("_n", F.lit(0)))
    changed = F.col("ann_id").isNotNull()
    bare = F.when(F.trim(F.col(line_col)).startswith("["),
                  F.from_json(F.col(line_col), "array<struct<role:string,content:string>>"))
    m = F.coalesce(F.col("_obj.messages"), bare)
    first_asst = F.array_position(F.transform(m, lambda x: x["role"]), "assistant")
    cap = F.col("caption")
    replaced = F.transform(m, lambda x, i: F.when(i + 1 == first_asst, x.withField("content", cap)).otherwise(x))
    appended = F.concat(m, F.array(F.struct(F.lit("assistant").alias("role"), cap.alias("content"))))
    fresh = F.array(F.struct(F.lit("user").alias("role"), F.lit(PROMPT).alias("content")),
                    F.struct(F.lit("assistant").alias("role"), cap.alias("content")))
    new_msgs = F.when(F.col("_obj.messages").isNull(), fresh).when(first_asst > 0, replaced).otherwise(appended)
    out = j.withColumn("_line", F.when(changed, _with_caption(F.col(line_col), cap, F.col("_obj.messages").isNull(), first_asst)))
    return out.select(key, F.when(changed, F.col("_n")).alias("caption_idx"), changed.alias("changed"),
                      F.col("_img").alias("image_id"), F.when(changed, new_msgs).otherwise(m).alias("messages"),
                      F.coalesce("_line", line_col).alias("line"))


def _with_caption(line: Column, caption: Column, fresh: Column, first_asst: Column) -> Column:
    """A chat line with its caption put in, other keys and types untouched."""
    var = lambda c: c.cast("variant")
    told = lambda role, text: F.create_map(F.lit("role"), var(F.lit(role)), F.lit("content"), var(text))

    def put(d: Column, k: str, value: Column) -> Column:
        """A map with one key set, in its place or at the end."""
        return F.when(F.map_contains_key(d, k), F.transform_values(d, lambda a, b: F.when(a == k, value).otherwise(b))).otherwise(
            F.map_concat(d, F.create_map(F.lit(k), value)))

    whole = F.from_json(line, "map<string,variant>")
    msgs = F.from_json(line, "struct<messages:array<map<string,variant>>>")["messages"]
    replaced = F.transform(msgs, lambda x, i: F.when(i + 1 == first_asst, put(x, "content", var(caption))).otherwise(x))
    appended = F.concat(msgs, F.array(told("assistant", caption)))
    new = F.when(fresh, F.array(told("user", F.lit(PROMPT)), told("assistant", caption))).when(first_asst > 0, replaced).otherwise(appended)
    return F.to_json(put(whole, "messages", F.to_variant_object(new)))
