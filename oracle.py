"""DuckDB oracle SQL, one statement per query key.

Views of ``views.py`` are restated here as CTE text. Every computed column is
aliased to the same name as on the Spark side, and cast to the same type.
"""

from __future__ import annotations

U = "(('0x' || substr(md5({x}),1,8))::BIGINT / 4294967296.0)"


def u(x: str) -> str:
    return U.format(x=x)


DOCS = """docs AS (
  SELECT CAST(doc_id // 256 AS INTEGER) AS shard_id, CAST((doc_id % 256) // 32 AS INTEGER) AS rg_id,
         CAST(doc_id % 32 AS INTEGER) AS pos_in_rg, doc_id, text, lang, source, n_chars
  FROM documents)"""

LENS = """lens AS (
  SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS len, doc_id // 256 AS grp, doc_id AS ord FROM documents)"""

# byte ids of the whole text, BOS first
DOC_BYTES = """doc_bytes AS (
  SELECT doc_id, list_concat([261], list_transform(regexp_extract_all(hex(text), '..'), lambda p: ('0x' || p)::INTEGER)) AS ids
  FROM documents)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


Q: dict[str, str] = {}

# ------------------------------------------------------------------ step 0

PACK_CONCAT = with_(LENS, """pre AS (
  SELECT *, CAST(coalesce(sum(len) OVER (PARTITION BY grp ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bef,
         CAST(sum(len) OVER (PARTITION BY grp) AS BIGINT) // 2049 AS n_rows
  FROM lens)""", """pieces AS (
  SELECT grp, doc_id, bef, len, n_rows, unnest(range(bef // 2049, (bef + len - 1) // 2049 + 1)) AS row_id FROM pre)""") + """
SELECT CAST(grp AS BIGINT) AS grp, CAST(row_id AS BIGINT) AS row_id,
       CAST(greatest(row_id*2049, bef) - row_id*2049 AS BIGINT) AS pos, doc_id,
       CAST(greatest(row_id*2049, bef) - bef AS BIGINT) AS start,
       CAST(least((row_id+1)*2049, bef+len) - greatest(row_id*2049, bef) AS BIGINT) AS len
FROM pieces WHERE row_id < n_rows"""
Q["pack_concat"] = PACK_CONCAT


def report_sql(layout_sql: str, algo: str, C: int = 2049) -> str:
    return f"""WITH {LENS[:]},
layout AS ({layout_sql}),
li AS (SELECT CAST(sum(len) AS BIGINT) AS input_tokens, CAST(sum(greatest(len - {C}, 0)) AS BIGINT) AS beyond FROM lens),
lo AS (SELECT CAST(sum(len) AS BIGINT) AS placed_tokens, CAST(count(DISTINCT (grp, row_id)) AS BIGINT) AS n_rows FROM layout)
SELECT '{algo}' AS algo, n_rows, input_tokens, placed_tokens,
       CAST(n_rows*{C} - placed_tokens AS BIGINT) AS pad_tokens,
       CAST(input_tokens - placed_tokens AS BIGINT) AS dropped_tokens,
       round(placed_tokens * 100.0 / (n_rows*{C}), 4) AS util_pct,
       round((input_tokens - placed_tokens) * 100.0 / input_tokens, 4) AS crop_pct,
       round((n_rows*{C} - placed_tokens) * 100.0 / (n_rows*{C}), 4) AS pad_pct,
       round(beyond * 100.0 / input_tokens, 4) AS lower_bound_pct
FROM li, lo"""


def _strip_with(sql: str) -> str:
    """Turn a full WITH … SELECT statement into a subquery body."""
    return sql


GREEDY_BASE = """o AS (SELECT grp, doc_id, len, row_number() OVER (PARTITION BY grp ORDER BY ord) AS i FROM lens)"""

GREEDY_CROP = "WITH RECURSIVE " + LENS + ",\n" + GREEDY_BASE + """,
r AS (
  SELECT grp, i, doc_id, CAST(0 AS BIGINT) AS row_id, CAST(0 AS BIGINT) AS pos, least(len, 2049) AS take, least(len, 2049) AS endpos
  FROM o WHERE i = 1
  UNION ALL
  SELECT o.grp, o.i, o.doc_id, r.row_id + CASE WHEN r.endpos = 2049 THEN 1 ELSE 0 END,
         CASE WHEN r.endpos = 2049 THEN 0 ELSE r.endpos END,
         least(o.len, 2049 - CASE WHEN r.endpos = 2049 THEN 0 ELSE r.endpos END),
         CASE WHEN r.endpos = 2049 THEN 0 ELSE r.endpos END + least(o.len, 2049 - CASE WHEN r.endpos = 2049 THEN 0 ELSE r.endpos END)
  FROM r JOIN o ON o.grp = r.grp AND o.i = r.i + 1)
SELECT CAST(grp AS BIGINT) AS grp, row_id, pos, doc_id, CAST(0 AS BIGINT) AS start, CAST(take AS BIGINT) AS len FROM r
WHERE (grp, row_id) IN (SELECT (grp, row_id) FROM r WHERE endpos = 2049)"""

GREEDY_PAD = "WITH RECURSIVE " + LENS + ",\n" + GREEDY_BASE + """,
r AS (
  SELECT grp, i, doc_id, CAST(0 AS BIGINT) AS row_id, CAST(0 AS BIGINT) AS pos, least(len, 2049) AS take, least(len, 2049) AS endpos
  FROM o WHERE i = 1
  UNION ALL
  SELECT grp, i, doc_id, row_id, pos, least(len, 2049), pos + least(len, 2049) FROM (
    SELECT o.grp, o.i, o.doc_id, o.len,
           r.row_id + CASE WHEN r.endpos = 2049 OR (r.endpos > 0 AND o.len > 2049 - r.endpos) THEN 1 ELSE 0 END AS row_id,
           CASE WHEN r.endpos = 2049 OR (r.endpos > 0 AND o.len > 2049 - r.endpos) THEN 0 ELSE r.endpos END AS pos
    FROM r JOIN o ON o.grp = r.grp AND o.i = r.i + 1))
SELECT CAST(grp AS BIGINT) AS grp, row_id, pos, doc_id, CAST(0 AS BIGINT) AS start, CAST(take AS BIGINT) AS len FROM r"""

Q["pack_greedy_crop"] = GREEDY_CROP
Q["pack_greedy_pad"] = GREEDY_PAD


def report_sql_any(layout_sql: str, algo: str, C: int = 2049) -> str:
    return f"""(WITH {LENS},
li AS (SELECT CAST(sum(len) AS BIGINT) AS input_tokens, CAST(sum(greatest(len - {C}, 0)) AS BIGINT) AS beyond FROM lens),
lo AS (SELECT CAST(sum(len) AS BIGINT) AS placed_tokens, CAST(count(DISTINCT (grp, row_id)) AS BIGINT) AS n_rows FROM ({layout_sql}))
SELECT '{algo}' AS algo, n_rows, input_tokens, placed_tokens,
       CAST(n_rows*{C} - placed_tokens AS BIGINT) AS pad_tokens,
       CAST(input_tokens - placed_tokens AS BIGINT) AS dropped_tokens,
       round(placed_tokens * 100.0 / (n_rows*{C}), 4) AS util_pct,
       round((input_tokens - placed_tokens) * 100.0 / input_tokens, 4) AS crop_pct,
       round((n_rows*{C} - placed_tokens) * 100.0 / (n_rows*{C}), 4) AS pad_pct,
       round(beyond * 100.0 / input_tokens, 4) AS lower_bound_pct
FROM li, lo)"""


Q["packing_report"] = (report_sql_any(PACK_CONCAT, "concat") + " UNION ALL " + report_sql_any(GREEDY_CROP, "greedy_crop")
                       + " UNION ALL " + report_sql_any(GREEDY_PAD, "greedy_pad"))

# First fit over documents by length, a document a step: the free space of each row.
FFD = "WITH RECURSIVE " + LENS + """,
ordered AS (SELECT grp, doc_id, least(len, 2049) AS n, row_number() OVER (PARTITION BY grp ORDER BY len DESC, ord) AS i FROM lens),
ffd AS (
  SELECT grp, 0::BIGINT AS i, []::BIGINT[] AS room, NULL::BIGINT AS doc_id, NULL::BIGINT AS row_id, NULL::BIGINT AS pos, NULL::BIGINT AS len FROM (SELECT DISTINCT grp FROM lens)
  UNION ALL
  SELECT grp, i, CASE WHEN r IS NULL THEN list_append(room, 2049 - n) ELSE list_transform(room, lambda x, k: CASE WHEN k = r THEN x - n ELSE x END) END,
         doc_id, coalesce(r - 1, len(room)), CASE WHEN r IS NULL THEN 0 ELSE 2049 - room[r] END, n
  FROM (SELECT f.grp, o.i, f.room, o.doc_id, o.n, nullif(coalesce(list_position(list_transform(f.room, lambda x: x >= o.n), true), 0), 0) AS r
        FROM ffd f JOIN ordered o ON o.grp = f.grp AND o.i = f.i + 1))
SELECT grp, row_id, pos, doc_id, CAST(0 AS BIGINT) AS start, len FROM ffd WHERE i > 0"""

Q["pack_ffd"] = FFD

# Best fit: a step lets 16 documents in while fewer than 100 wait, else places one.
# A waiting document is length * 2**20 + arrival.
BESTFIT = "WITH RECURSIVE " + LENS + """,
arrived AS (SELECT grp, doc_id, len, row_number() OVER (PARTITION BY grp ORDER BY ord) - 1 AS a FROM lens),
streams AS (SELECT grp, list(len * 1048576 + a ORDER BY a) AS codes FROM arrived GROUP BY grp),
fit AS (
  SELECT grp, 0::BIGINT AS step, 0::BIGINT AS entered, []::BIGINT[] AS buf, 0::BIGINT AS row_now, 0::BIGINT AS pos_now,
         NULL::BIGINT AS pick, NULL::BIGINT AS row_id, NULL::BIGINT AS pos, NULL::BIGINT AS take FROM streams
  UNION ALL
  SELECT grp, step + 1, CASE WHEN pick IS NULL THEN least(entered + 16, len(codes)) ELSE entered END,
         CASE WHEN pick IS NULL THEN list_concat(buf, codes[entered + 1:entered + 16]) ELSE list_filter(buf, lambda x: x <> pick) END,
         CASE WHEN pos_now + take = 2049 THEN row_now + 1 ELSE row_now END, CASE WHEN pick IS NULL THEN pos_now WHEN pos_now + take = 2049 THEN 0 ELSE pos_now + take END,
         pick, row_now, pos_now, take
  FROM (
    SELECT *, CASE WHEN pick IS NULL THEN 0 ELSE least(pick // 1048576, 2049 - pos_now) END AS take FROM (
      SELECT *, CASE WHEN entered < len(codes) AND len(buf) < 100 THEN NULL
                     WHEN len(can) = 0 THEN list_min(buf)
                     ELSE list_min(list_filter(can, lambda x: x // 1048576 = list_max(can) // 1048576)) END AS pick
      FROM (SELECT f.* EXCLUDE (pick, row_id, pos, take), s.codes, list_filter(f.buf, lambda x: x // 1048576 <= 2049 - f.pos_now) AS can
            FROM fit f JOIN streams s USING (grp) WHERE f.entered < len(s.codes) OR len(f.buf) > 0)))),
whole AS (SELECT grp, max(row_now) AS n FROM fit GROUP BY grp)
SELECT fit.grp, row_id, pos, doc_id, CAST(0 AS BIGINT) AS start, take AS len
FROM fit JOIN whole USING (grp) JOIN arrived ON arrived.grp = fit.grp AND arrived.a = pick % 1048576 WHERE pick IS NOT NULL AND row_id < n"""

Q["pack_bestfit_crop"] = BESTFIT

Q["packing_report_all"] = Q["packing_report"] + " UNION ALL " + report_sql_any(FFD, "ffd") + " UNION ALL " + report_sql_any(BESTFIT, "bestfit_crop")

Q["byte_encode"] = with_(DOC_BYTES) + """
SELECT doc_id, array_to_string(ids, ',') AS ids, CAST(len(ids) AS INTEGER) AS n_ids FROM doc_bytes"""

Q["scan_corpus"] = """
SELECT CAST(0 AS INTEGER) AS shard_id, CAST(doc_id // 256 AS INTEGER) AS rg_id, CAST(doc_id % 256 AS INTEGER) AS pos_in_rg,
       doc_id, CAST(strlen(text) AS INTEGER) AS n_bytes
FROM documents"""

# ------------------------------------------------------------------ 2.1 sources

Q["split_last_shard"] = with_(DOCS) + """
SELECT doc_id, shard_id, CASE WHEN shard_id = (SELECT max(shard_id) FROM docs) THEN 'val' ELSE 'train' END AS split FROM docs"""

Q["stride_row_groups"] = with_(DOCS) + """
SELECT doc_id, shard_id, rg_id FROM docs WHERE rg_id >= 1 AND (rg_id - 1) % 3 = 0"""

Q["doc_batches"] = with_(DOCS) + """
SELECT shard_id, rg_id, CAST(pos_in_rg // 8 AS INTEGER) AS batch_id, count(*) AS n_docs,
       CAST(sum(length(text)) AS BIGINT) AS n_chars, min(doc_id) AS first_doc, max(doc_id) AS last_doc
FROM docs GROUP BY ALL"""

RESUME = """(rg_id >= 1 AND (rg_id - 1) % 3 = 0 AND (shard_id > 1 OR (shard_id = 1 AND rg_id >= (2 // 3 + 1) * 3 + 1)))"""
Q["resume_cursor"] = with_(DOCS) + f"""
SELECT doc_id, shard_id, rg_id FROM docs WHERE {RESUME}"""

Q["repeat_epochs"] = with_(DOCS) + f"""
SELECT 1 AS epoch, doc_id, shard_id, rg_id FROM docs WHERE {RESUME}
UNION ALL
SELECT e.epoch, doc_id, shard_id, rg_id FROM docs, (SELECT unnest([2, 3]) AS epoch) e
WHERE rg_id >= 1 AND (rg_id - 1) % 3 = 0"""

REPACK = """o AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS c,
         row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || doc_id),1,8))::BIGINT, doc_id) - 1 AS order_idx
  FROM documents),
b AS (SELECT order_idx // 32 AS block, CAST(sum(c) AS BIGINT) AS bchars FROM o GROUP BY 1),
r AS (
  SELECT block, bchars AS acc, 0 AS shard, block AS first_block FROM b WHERE block = 0
  UNION ALL
  SELECT b.block,
         CASE WHEN r.acc >= 50000 THEN b.bchars ELSE r.acc + b.bchars END,
         CASE WHEN r.acc >= 50000 THEN r.shard + 1 ELSE r.shard END,
         CASE WHEN r.acc >= 50000 THEN b.block ELSE r.first_block END
  FROM r JOIN b ON b.block = r.block + 1),
fin AS (SELECT shard, arg_max(acc, block) AS last_acc FROM r GROUP BY shard),
packed AS (
  SELECT o.doc_id, o.text, CAST(r.shard AS BIGINT) AS new_shard, CAST(r.block - r.first_block AS BIGINT) AS new_rg,
         CAST(o.order_idx % 32 AS INTEGER) AS pos_in_rg, CAST(o.order_idx AS BIGINT) AS order_idx
  FROM o JOIN r ON o.order_idx // 32 = r.block JOIN fin ON fin.shard = r.shard
  WHERE fin.last_acc >= 50000)"""

Q["repackage_shards"] = "WITH RECURSIVE " + REPACK + """
SELECT doc_id, new_shard, new_rg, pos_in_rg, order_idx FROM packed"""

Q["write_shards"] = "WITH RECURSIVE " + REPACK + """
SELECT doc_id, new_shard, new_rg, pos_in_rg, CAST(length(text) AS INTEGER) AS n_chars FROM packed"""

Q["scan_shards"] = "WITH RECURSIVE " + REPACK + """
SELECT CAST(new_shard AS INTEGER) AS shard_id, CAST(new_rg AS INTEGER) AS rg_id, pos_in_rg,
       (new_shard << 32) + new_rg * 32 + pos_in_rg AS doc_id, md5(text) AS text_md5 FROM packed"""

# ------------------------------------------------------------------ 2.2 selection

Q["crop_docs"] = """
SELECT doc_id, CAST(length(substr(text, 1, 1000)) AS INTEGER) AS n_chars, md5(substr(text, 1, 1000)) AS text_md5 FROM documents"""

Q["char_budget"] = """
WITH c AS (SELECT doc_id, CAST(coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before FROM documents)
SELECT doc_id, chars_before FROM c WHERE chars_before <= 500000"""


def hsql(seed, *cols) -> str:
    inner = " || ':' || ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"('0x' || substr(md5({inner}),1,8))::BIGINT"


Q["seeded_shuffle"] = f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY {hsql(42, 'doc_id')}, doc_id) - 1 AS BIGINT) AS shuffle_idx FROM documents"""

Q["take_n"] = f"""
SELECT doc_id, lang FROM documents ORDER BY {hsql(1337, 'doc_id')}, doc_id LIMIT 5"""

Q["split_fractions"] = f"""
WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY {hsql(42, 'doc_id')}, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN i < floor(n*0.8) THEN 'train' WHEN i < floor(n*0.8) + floor(n*0.1) THEN 'val' ELSE 'test' END AS split FROM s"""

Q["slice_rows"] = """
SELECT doc_id, CAST((doc_id - 5) // 7 AS BIGINT) AS slice_idx FROM documents WHERE doc_id >= 5 AND doc_id < 500 AND (doc_id - 5) % 7 = 0"""

LANG_TASKS = ",\n".join(f"""{x} AS (SELECT doc_id, row_number() OVER (ORDER BY {hsql(0, 'doc_id')}, doc_id) - 1 AS idx FROM documents WHERE lang = '{x}')"""
                        for x in ("en", "fr", "de", "es"))

Q["mix_tasks"] = f"""WITH {LANG_TASKS},
u AS (SELECT 0 AS task, 0 AS copy, idx, doc_id FROM en
      UNION ALL SELECT 1, c.copy, idx, doc_id FROM fr, (SELECT unnest([0, 1]) AS copy) c
      UNION ALL SELECT 2, 0, idx, doc_id FROM de
      UNION ALL SELECT 3, c.copy, idx, doc_id FROM es, (SELECT unnest([0, 1, 2]) AS copy) c)
SELECT CAST(row_number() OVER (ORDER BY {hsql(42, 'task', 'copy', 'idx')}, task, copy, idx) - 1 AS BIGINT) AS mix_idx,
       CAST(task AS INTEGER) AS task, CAST(copy AS INTEGER) AS copy, CAST(idx AS BIGINT) AS idx, doc_id FROM u"""

Q["sequence_tasks"] = f"""WITH {LANG_TASKS},
n AS (SELECT (SELECT count(*) FROM en) AS e, (SELECT count(*) FROM fr) AS f, (SELECT count(*) FROM de) AS d)
SELECT CAST(idx AS BIGINT) AS seq_idx, 0 AS task, CAST(idx AS BIGINT) AS idx, doc_id FROM en
UNION ALL SELECT CAST(idx + e AS BIGINT), 1, CAST(idx AS BIGINT), doc_id FROM fr, n
UNION ALL SELECT CAST(idx + e + f AS BIGINT), 2, CAST(idx AS BIGINT), doc_id FROM de, n
UNION ALL SELECT CAST(idx + e + f + d AS BIGINT), 3, CAST(idx AS BIGINT), doc_id FROM es, n"""

Q["rank_shards"] = """SELECT doc_id, CAST(doc_id % 8 AS INTEGER) AS rank FROM documents"""

# ------------------------------------------------------------------ 2.5 conversations


def B(x: str) -> str:
    """UTF-8 byte ids of a string expression."""
    return f"list_transform(regexp_extract_all(hex({x}), '..'), lambda p: ('0x' || p)::INTEGER)"


def REP(v: int, n: str) -> str:
    return f"list_transform(range({n}), lambda i: {v})"


CONVS = """convs AS (
  SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)"""

ALT = """list_filter(list_transform({m}, lambda x, i: CASE
    WHEN x.role IS NULL THEN 'missing_role:' || (i-1)
    WHEN x.content IS NULL THEN 'missing_content:' || (i-1)
    WHEN x.role <> CASE WHEN (i-1) % 2 = 0 THEN 'user' ELSE 'assistant' END THEN 'bad_role:' || (i-1)
    {extra} END), lambda r: r IS NOT NULL)[1]"""


def alt(m: str, extra: str = "") -> str:
    return ALT.format(m=m, extra=extra)


SMOL = f"""smol AS (
  SELECT conv_id, messages, CASE WHEN messages[1].role = 'system' THEN messages[2:] ELSE messages END AS rest FROM convs),
smolv AS (
  SELECT conv_id, messages, CASE WHEN len(messages) < 1 THEN 'empty' WHEN len(rest) < 2 THEN 'too_short' ELSE {alt('rest')} END AS reason
  FROM smol)"""

CONVS_OK = SMOL + """,
convs_ok AS (
  SELECT conv_id, CASE WHEN messages[len(messages)].role = 'user' THEN messages[1:len(messages)-1] ELSE messages END AS messages
  FROM smolv WHERE reason IS NULL)"""

Q["validate_conversations"] = with_(CONVS) + f"""
SELECT conv_id, reason IS NULL AS valid, reason FROM (
  SELECT conv_id, CASE WHEN len(messages) < 2 THEN 'too_short' ELSE {alt('messages')} END AS reason FROM convs)"""

Q["validate_smoltalk"] = with_(CONVS, SMOL) + """
SELECT conv_id, reason IS NULL AS valid, reason FROM smolv"""

Q["validate_synthetic"] = with_(CONVS) + f"""
SELECT conv_id, reason IS NULL AS valid, reason FROM (
  SELECT conv_id, CASE WHEN len(messages) < 2 THEN 'too_short'
    ELSE {alt('messages', "WHEN regexp_matches(x.content, '^\\\\s*$') THEN 'empty_content:' || (i-1)")} END AS reason FROM convs)"""

Q["conversation_limits"] = with_(CONVS) + """
SELECT conv_id, reason IS NULL AS valid, reason FROM (
  SELECT conv_id, CASE WHEN len(messages) = 0 THEN 'no_messages' WHEN len(messages) > 500 THEN 'too_many_messages'
    ELSE coalesce(
      list_filter(list_transform(messages, lambda x, i: CASE WHEN coalesce(length(x.content), 0) = 0 THEN 'empty_content:' || (i-1)
                                                         WHEN length(x.content) > 8000 THEN 'message_too_long:' || (i-1) END),
                  lambda r: r IS NOT NULL)[1],
      CASE WHEN list_sum(list_transform(messages, lambda x: coalesce(length(x.content), 0))) > 32000 THEN 'total_too_long' END,
      list_filter(list_transform(messages, lambda x, i: CASE WHEN x.role IS NULL OR x.role NOT IN ('user', 'assistant') THEN 'invalid_role:' || (i-1) END),
                  lambda r: r IS NOT NULL)[1]) END AS reason FROM convs)"""

MERGE = """CASE WHEN messages[1].role = 'system' AND messages[2].role = 'user'
  THEN list_concat([{'role': 'user', 'content': messages[1].content || chr(10) || chr(10) || messages[2].content}], messages[3:])
  ELSE messages END"""

Q["merge_system"] = with_(CONVS) + f"""
SELECT conv_id, coalesce(messages[1].role <> 'system' OR messages[2].role = 'user', false) AS merge_ok,
       CAST(len(m) AS INTEGER) AS n_messages, array_to_string(list_transform(m, lambda x: x.role), ',') AS roles,
       md5(array_to_string(list_transform(m, lambda x: x.content), '|')) AS content_md5
FROM (SELECT conv_id, messages, {MERGE} AS m FROM convs)"""


def render_ids(m: str) -> str:
    return f"""list_concat([261], flatten(list_transform({m}, lambda x: CASE WHEN x.role = 'user'
        THEN list_concat([262], {B('x.content')}, [263]) ELSE list_concat([264], {B('x.content')}, [260]) END)))"""


def render_mask(m: str) -> str:
    return f"""list_concat([0], flatten(list_transform({m}, lambda x: CASE WHEN x.role = 'user'
        THEN {REP(0, 'strlen(x.content) + 2')} ELSE list_concat([0], {REP(1, 'strlen(x.content) + 1')}) END)))"""


RENDERED = CONVS_OK + f""",
rendered AS (
  SELECT conv_id, ({render_ids('m')})[1:2048] AS ids, ({render_mask('m')})[1:2048] AS mask
  FROM (SELECT conv_id, {MERGE} AS m FROM convs_ok))"""

Q["render_conversation"] = with_(CONVS, RENDERED) + """
SELECT conv_id, array_to_string(ids, ',') AS ids, array_to_string(mask, ',') AS mask, CAST(len(ids) AS INTEGER) AS n_tokens
FROM rendered"""

Q["render_for_completion"] = with_(CONVS, CONVS_OK) + f"""
SELECT conv_id, array_to_string(list_concat(({render_ids('m')})[1:2048], [264]), ',') AS ids
FROM (SELECT conv_id, {MERGE.replace('messages', 'mm')} AS m FROM (SELECT conv_id, messages[1:len(messages)-1] AS mm FROM convs_ok))"""

Q["render_chat_prompt"] = with_(CONVS) + f"""
SELECT conv_id, md5(array_to_string(list_concat([261], flatten(list_transform(messages, lambda x: CASE
      WHEN x.role = 'user' THEN list_concat([262], {B('x.content')}, [263])
      WHEN x.role = 'assistant' THEN list_concat([264], {B('x.content')}, [260]) ELSE []::INTEGER[] END)), [264]), ',')) AS ids_md5
FROM convs"""

Q["supervision_stats"] = with_(CONVS, RENDERED) + """
SELECT conv_id, CAST(len(ids) AS INTEGER) AS n_tokens, CAST(list_sum(mask) AS INTEGER) AS n_supervised,
       round(list_sum(mask) / len(ids), 6) AS supervised_share FROM rendered"""

SFT = RENDERED + """,
sft AS (
  SELECT conv_id, list_concat(ids[1:2049], list_transform(range(greatest(2049 - len(ids), 0)), lambda i: 261)) AS ids,
         list_concat(mask[1:2049], list_transform(range(greatest(2049 - len(ids), 0)), lambda i: 0)) AS mask FROM rendered)"""

Q["sft_rows"] = with_(CONVS, SFT) + """
SELECT conv_id, CAST(len(ids) AS INTEGER) AS n, md5(array_to_string(ids, ',')) AS ids_md5, md5(array_to_string(mask, ',')) AS mask_md5 FROM sft"""

Q["shift_targets"] = with_(CONVS, SFT) + """
SELECT conv_id, md5(array_to_string(ids[1:2048], ',')) AS inputs_md5,
       md5(array_to_string(list_transform(ids[2:2049], lambda x, i: CASE WHEN mask[i+1] = 0 THEN -1 ELSE x END), ',')) AS targets_md5,
       CAST(len(list_filter(mask[2:2049], lambda k: k = 0)) AS INTEGER) AS n_ignored FROM sft"""

Q["pad_batches"] = with_(CONVS, RENDERED) + """
SELECT conv_id, CAST(conv_id // 8 AS BIGINT) AS batch, CAST(max(len(ids)) OVER (PARTITION BY conv_id // 8) AS INTEGER) AS padded_len,
       md5(array_to_string(list_concat(ids, list_transform(range(max(len(ids)) OVER (PARTITION BY conv_id // 8) - len(ids)), lambda i: 261)), ',')) AS ids_md5
FROM rendered"""

for _k in ("render_conversation", "render_for_completion", "supervision_stats", "sft_rows", "shift_targets", "pad_batches"):
    Q[_k] = f"""SELECT *, CAST(NULL AS VARCHAR) AS reason FROM ({Q[_k]})
UNION ALL BY NAME
SELECT conv_id, reason FROM ({with_(CONVS, SMOL)}SELECT conv_id, reason FROM smolv WHERE reason IS NOT NULL)"""

# ------------------------------------------------------------------ 2.6 captions, json sources

CAPV = """img AS (SELECT doc_id AS image_id FROM documents),
ann AS (SELECT doc_id AS ann_id, doc_id - doc_id % 2 AS image_id, text AS caption FROM documents),
firstcap AS (SELECT img.image_id, coalesce(f.caption, '') AS caption FROM img LEFT JOIN
             (SELECT image_id, arg_min(caption, ann_id) AS caption FROM ann GROUP BY image_id) f USING (image_id))"""

SUMMARY = "CAST(2 AS INTEGER) AS n_messages, 'user,assistant' AS roles, md5('Describe this image.|' || {c}) AS content_md5"

Q["captions_first"] = with_(CAPV) + f"""
SELECT image_id, {SUMMARY.format(c='caption')} FROM firstcap"""

Q["captions_expand"] = with_(CAPV) + f"""
SELECT img.image_id, ann.ann_id, {SUMMARY.format(c="coalesce(ann.caption, '')")} FROM img LEFT JOIN ann USING (image_id)"""

CAPTOK = """captok AS (
  SELECT image_id, j, list_concat([261], """ + B("c") + """, [260]) AS ids FROM (
    SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY ann_id) - 1 AS INTEGER) AS j,
           regexp_replace(caption, '^\\s+|\\s+$', '', 'g') AS c FROM ann) WHERE c <> '')"""

Q["caption_tokens"] = with_(CAPV, CAPTOK) + """
SELECT image_id, j, array_to_string(ids, ',') AS ids FROM captok"""
Q["write_token_table"] = Q["caption_tokens"]

Q["attach_embeddings"] = with_(CAPV) + """
SELECT f.image_id, e.vec_id IS NULL AS used_default, CAST(1 AS INTEGER) AS n_img_tokens,
       round(list_sum(coalesce(e.embedding, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1))::DOUBLE[]), 3) AS emb_sum
FROM firstcap f LEFT JOIN embeddings e ON e.vec_id = f.image_id"""

Q["inject_placeholders"] = with_(CAPV) + f""",
rr AS (SELECT image_id,
         (list_concat([261, 262], {B("'Describe this image.'")}, [263, 264], {B('caption')}, [260]))[1:2048] AS ids,
         (list_concat([0], {REP(0, "strlen('Describe this image.') + 3")}, {REP(1, 'strlen(caption) + 1')}))[1:2048] AS mask
       FROM firstcap)
SELECT image_id, md5(array_to_string(list_concat([ids[1]], [261, 261, 261, 261], ids[2:]), ',')) AS ids_md5,
       md5(array_to_string(list_concat([mask[1]], [0, 0, 0, 0], mask[2:]), ',')) AS mask_md5,
       CAST(len(ids) + 4 AS INTEGER) AS n_tokens
FROM rr"""

Q["embedding_coverage"] = with_(CAPV, CAPTOK) + """,
i AS (SELECT DISTINCT image_id, true AS _img FROM img),
e AS (SELECT DISTINCT vec_id AS image_id, true AS _emb FROM embeddings),
c AS (SELECT DISTINCT image_id, true AS _cap FROM captok),
j AS (SELECT coalesce(_img, false) AS im, coalesce(_emb, false) AS em, coalesce(_cap, false) AS cap
      FROM i FULL JOIN e USING (image_id) FULL JOIN c USING (image_id))
SELECT count(*) FILTER (WHERE im) AS n_images, count(*) FILTER (WHERE im AND em) AS n_with_embedding,
       count(*) FILTER (WHERE im AND cap) AS n_with_caption, count(*) FILTER (WHERE im AND NOT em) AS n_missing_embedding,
       count(*) FILTER (WHERE im AND NOT cap) AS n_missing_caption, count(*) FILTER (WHERE em AND NOT im) AS n_embedding_without_image
FROM j"""

Q["caption_similarity"] = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.v AS g, b.v AS t FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT count(*) AS n_pairs,
       round(avg(list_dot_product(g, t) / (sqrt(list_dot_product(g, g)) * sqrt(list_dot_product(t, t)))), 6) AS mean_similarity
FROM p"""

Q["read_chat_jsonl"] = with_(CONVS) + """
SELECT CASE WHEN conv_id % 2 = 1 THEN conv_id END AS image_id, true AS valid, CAST(len(messages) AS INTEGER) AS n_messages,
       array_to_string(list_transform(messages, lambda x: x.role), ',') AS roles,
       CAST(list_sum(list_transform(messages, lambda x: length(x.content))) AS BIGINT) AS content_chars
FROM convs
UNION ALL
SELECT NULL, false, NULL, NULL, NULL FROM convs WHERE conv_id % 10 = 0"""

Q["write_chat_jsonl"] = Q["captions_first"]

Q["read_caption_annotations"] = """
SELECT doc_id AS ann_id, doc_id - doc_id % 2 AS image_id, text AS caption,
       (SELECT count(*) FROM documents) AS n_images
FROM documents WHERE doc_id % 97 <> 5"""

# ------------------------------------------------------------------ 2.8 evaluation


def hk(*parts: str) -> str:
    """h of 'p0:p1:…' where parts are SQL expressions."""
    inner = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5({inner}),1,8))::BIGINT"


def uk(*parts: str) -> str:
    return f"({hk(*parts)} / 4294967296.0)"


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


ITEMS = """items AS (
  SELECT doc_id AS idx, substr(text, 1, c) AS query,
         [substr(text, 1 + c, c), substr(text, 1 + 2 * c, c), substr(text, 1 + 3 * c, c), substr(text, 1 + 4 * c, c)] AS choices,
         CAST(doc_id % 4 AS INTEGER) AS gold, source AS subject
  FROM (SELECT *, CAST(ceil(length(text) / 5) AS INTEGER) AS c FROM documents))"""


def floyd(k: int = 3, seed: int = 1234) -> str:
    out = ["items_n AS (SELECT idx, (SELECT count(*) FROM documents) - 1 AS pool FROM items)"]
    for j in range(k):
        m = f"(pool - {k} + {j})"
        t = f"({hk(repr(str(seed)), 'idx', str(j))} % ({m} + 1))"
        if j == 0:
            out.append(f"s0 AS (SELECT idx, pool, [{t}] AS acc FROM items_n)")
        else:
            out.append(f"s{j} AS (SELECT idx, pool, CASE WHEN list_contains(acc, {t}) THEN list_append(acc, {m}) "
                       f"ELSE list_append(acc, {t}) END AS acc FROM s{j-1})")
    out.append(f"shots AS (SELECT idx, list_transform(acc, lambda c: CASE WHEN c >= idx THEN c + 1 ELSE c END) AS shots FROM s{k-1})")
    return ",\n".join(out)


SHOTS = ITEMS + ",\n" + floyd()

Q["sample_fewshot"] = with_(SHOTS) + """
SELECT idx, array_to_string(shots, ',') AS shots FROM shots"""


def fewshot(name: str, block: str) -> str:
    return f"""{name} AS (
  SELECT s.idx, string_agg({block}, '' ORDER BY s.pos) AS fewshot
  FROM (SELECT idx, unnest(shots) AS shot, generate_subscripts(shots, 1) AS pos FROM shots) s
  JOIN items i ON i.idx = s.shot GROUP BY s.idx)"""


NL2 = "chr(10) || chr(10)"
PM = fewshot("fs_mc", f"i.query || ' ' || i.choices[i.gold + 1] || {NL2}") + """,
pm AS (
  SELECT idx, CAST(opt - 1 AS INTEGER) AS opt, coalesce(fewshot, '') || query || ' ' || choice AS prompt FROM (
    SELECT i.idx, f.fewshot, i.query, unnest(i.choices) AS choice, generate_subscripts(i.choices, 1) AS opt
    FROM items i LEFT JOIN fs_mc f USING (idx)))"""

PS = fewshot("fs_sc", f"i.choices[i.gold + 1] || ' ' || i.query || {NL2}") + """,
ps AS (
  SELECT idx, CAST(opt - 1 AS INTEGER) AS opt, coalesce(fewshot, '') || ctx || ' ' || query AS prompt FROM (
    SELECT i.idx, f.fewshot, i.query, unnest(i.choices) AS ctx, generate_subscripts(i.choices, 1) AS opt
    FROM items i LEFT JOIN fs_sc f USING (idx)))"""

PL = fewshot("fs_lm", f"{STRIP('i.query')} || ' ' || array_to_string(i.choices, '') || {NL2}") + f""",
pl AS (
  SELECT idx, {STRIP('base')} AS prompt_without, base || cont AS prompt_with FROM (
    SELECT i.idx, coalesce(f.fewshot, '') || {STRIP('i.query')} || ' ' AS base, array_to_string(i.choices, '') AS cont
    FROM items i LEFT JOIN fs_lm f USING (idx)))"""

Q["prompts_mc"] = with_(SHOTS, PM) + """
SELECT idx, opt, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS n_chars FROM pm"""

Q["prompts_schema"] = with_(SHOTS, PS) + """
SELECT idx, opt, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS n_chars FROM ps"""

Q["prompts_lm"] = with_(SHOTS, PL) + """
SELECT idx, md5(prompt_without) AS without_md5, md5(prompt_with) AS with_md5 FROM pl"""


def common_len(src: str, name: str, out: str, reverse: bool) -> str:
    ids = "list_reverse(ids)" if reverse else "ids"
    return f"""{name} AS (
  SELECT idx, CAST(CASE WHEN mn <= 0 THEN 0 WHEN coalesce(list_position(eq, false), 0) = 0 THEN mn
                   ELSE list_position(eq, false) - 1 END AS INTEGER) AS {out} FROM (
    SELECT idx, mn, list_transform(range(mn), lambda p: len(list_filter(o, lambda a: a[p + 1] <> o[1][p + 1])) = 0) AS eq FROM (
      SELECT idx, o, list_min(list_transform(o, lambda a: len(a))) AS mn FROM (
        SELECT idx, list({ids}) AS o FROM {src} GROUP BY idx))))"""


# Options with the text before and after them; only the options are compared, and
# whole prompts where an option is an ending of all others.
OPTIONS = fewshot("fs_mc", f"i.query || ' ' || i.choices[i.gold + 1] || {NL2}") + """,
mo AS (SELECT i.idx, coalesce(f.fewshot, '') || i.query || ' ' AS before, unnest(i.choices) AS o,
              CAST(generate_subscripts(i.choices, 1) - 1 AS INTEGER) AS opt FROM items i LEFT JOIN fs_mc f USING (idx)),
""" + fewshot("fs_sc", f"i.choices[i.gold + 1] || ' ' || i.query || {NL2}") + f""",
so AS (SELECT i.idx, coalesce(f.fewshot, '') AS before, unnest(i.choices) AS o, ' ' || i.query AS after,
              CAST(generate_subscripts(i.choices, 1) - 1 AS INTEGER) AS opt FROM items i LEFT JOIN fs_sc f USING (idx)),
mt AS (SELECT idx, opt, {B('o')} AS ids FROM mo),
st AS (SELECT idx, opt, {B('o')} AS ids FROM so),
""" + common_len("mt", "cm", "n", False) + ",\n" + common_len("st", "cs0", "n", True) + f""",
edge AS (SELECT idx FROM cs0 JOIN (SELECT idx, min(len(ids)) AS mn FROM st GROUP BY idx) USING (idx) WHERE n = mn),
ft AS (SELECT idx, opt, list_concat([261], {B('before || o')}) AS ids FROM so WHERE idx IN (SELECT idx FROM edge)),
""" + common_len("ft", "cf", "n", True) + """,
cs AS (SELECT idx, coalesce(cf.n, cs0.n) AS n FROM cs0 LEFT JOIN cf USING (idx))"""

Q["common_prefix_len"] = with_(SHOTS, OPTIONS) + """
SELECT idx, CAST(1 + strlen(before) + n AS INTEGER) AS prefix_len FROM mo JOIN cm USING (idx) WHERE opt = 0"""

Q["common_suffix_len"] = with_(SHOTS, OPTIONS) + """
SELECT idx, CAST(strlen(after) + n AS INTEGER) AS suffix_len FROM so JOIN cs USING (idx) WHERE opt = 0"""

SPANS = OPTIONS + ",\n" + PL + """,
spans AS (
  SELECT 'mc' AS kind, idx, opt, 1 + strlen(before) + n AS start, 1 + strlen(before || o) AS "end", before || o AS p, true AS valid FROM mo JOIN cm USING (idx)
  UNION ALL
  SELECT 'schema', idx, opt, 1 + strlen(before || o) - n, 1 + strlen(before || o || after), before || o || after, true FROM so JOIN cs USING (idx)
  UNION ALL
  SELECT 'lm', idx, 0, 1 + strlen(prompt_without), 1 + strlen(prompt_with), prompt_with,
         strlen(prompt_without) < strlen(prompt_with) AND starts_with(prompt_with, prompt_without) FROM pl)"""

Q["option_spans"] = with_(SHOTS, SPANS) + """
SELECT kind, idx, opt, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", valid FROM spans"""

Q["left_crop"] = with_(SHOTS, SPANS) + f"""
SELECT kind, idx, opt, CAST(start - c AS INTEGER) AS start, CAST("end" - c AS INTEGER) AS "end", start - c >= 0 AS crop_ok,
       md5(array_to_string(CASE WHEN c > 0 THEN t[len(t) - 63:] ELSE list_concat([261], t) END, ',')) AS ids_md5
FROM (SELECT *, {B("right(p, 64)")} AS t, greatest("end" - 64, 0) AS c FROM spans)"""

MCV = f"""ol AS (
  SELECT idx, CAST(opt AS INTEGER) AS opt, CAST(pos AS INTEGER) AS pos, round({uk("'ol'", 'idx', 'opt', 'pos')} * 10, 3) AS loss
  FROM items CROSS JOIN range(4) AS t(opt) CROSS JOIN range(20) AS p(pos)),
osp AS (
  SELECT idx, CAST(opt AS INTEGER) AS opt, CAST(1 + {hk("'sp'", 'idx', 'opt')} % 10 AS INTEGER) AS start,
         CAST(1 + {hk("'sp'", 'idx', 'opt')} % 10 + 5 + {hk("'sp'", 'idx', 'opt')} % 5 AS INTEGER) AS "end"
  FROM items CROSS JOIN range(4) AS t(opt)),
om AS (
  SELECT ol.idx, ol.opt, round(avg(loss), 9) AS mean_loss FROM ol JOIN osp USING (idx, opt)
  WHERE pos >= start - 1 AND pos < "end" - 1 GROUP BY ol.idx, ol.opt),
verdicts AS (
  SELECT b.idx, b.opt AS pred, i.gold, CAST(b.opt = i.gold AS INTEGER) AS correct, i.subject FROM
    (SELECT idx, opt, row_number() OVER (PARTITION BY idx ORDER BY mean_loss, opt) AS rn FROM om) b
    JOIN items i USING (idx) WHERE rn = 1)"""

Q["score_options"] = with_(ITEMS, MCV) + """
SELECT idx, pred, gold, correct FROM verdicts"""

Q["score_lm"] = with_(ITEMS) + f""",
lp AS (
  SELECT idx, pos, CAST({hk("'ac'", 'idx', 'pos')} % 256 AS INTEGER) AS actual,
         CAST(CASE WHEN {uk("'pr'", 'idx', 'pos')} < 0.05 THEN ({hk("'ac'", 'idx', 'pos + 1')} % 256 + 1) % 256
              ELSE {hk("'ac'", 'idx', 'pos + 1')} % 256 END AS INTEGER) AS pred
  FROM items CROSS JOIN range(20) AS p(pos)),
ls AS (SELECT idx, 10 + {hk("'ls'", 'idx')} % 5 AS start, 20 AS "end" FROM items)
SELECT a.idx, CAST(bool_and(p.pred = a.actual) AS INTEGER) AS correct
FROM lp a JOIN lp p ON p.idx = a.idx AND p.pos + 1 = a.pos JOIN ls ON ls.idx = a.idx
WHERE a.pos >= ls.start AND a.pos < ls."end" GROUP BY a.idx"""

Q["task_accuracy"] = with_(ITEMS, MCV) + """
SELECT subject AS task, count(*) AS n, round(avg(correct), 6) AS accuracy FROM verdicts GROUP BY subject"""

Q["subject_accuracy"] = with_(ITEMS, MCV) + """
SELECT coalesce(subject, 'ALL') AS subject, count(*) AS n, round(avg(correct), 6) AS accuracy FROM verdicts GROUP BY ROLLUP (subject)"""

ACC = """acc AS (
  SELECT c_nationkey AS model, c_mktsegment AS task, avg(CAST(c_acctbal > 0 AS DOUBLE)) AS accuracy FROM customer GROUP BY ALL)"""

Q["core_metric"] = with_(ACC) + """,
b AS (SELECT * FROM (VALUES ('AUTOMOBILE', 25.0), ('BUILDING', 0.0), ('FURNITURE', 25.0), ('HOUSEHOLD', 50.0), ('MACHINERY', 25.0)) v(task, baseline))
SELECT model, round(avg((accuracy - 0.01 * baseline) / (1.0 - 0.01 * baseline)), 6) AS core_metric, count(*) AS n_tasks
FROM acc JOIN b USING (task) GROUP BY model"""

Q["chatcore_metric"] = with_(ACC) + """,
b AS (SELECT * FROM (VALUES ('AUTOMOBILE', 0.25), ('FURNITURE', 0.25), ('HOUSEHOLD', 0.5), ('MACHINERY', 0.25)) v(task, baseline)),
c AS (SELECT model, task, (accuracy - coalesce(baseline, 0.0)) / (1.0 - coalesce(baseline, 0.0)) AS centered
      FROM acc LEFT JOIN b USING (task) WHERE NOT (model % 7 = 3 AND task = 'BUILDING'))
SELECT model, count(DISTINCT task) AS n_tasks, CASE WHEN count(DISTINCT task) = 5 THEN round(avg(centered), 6) END AS chatcore_metric
FROM c GROUP BY model"""

Q["categorical_eval"] = with_(ITEMS) + f""",
lg AS (SELECT idx, letter, round({uk("'lg'", 'idx', 'letter')}, 2) AS logit FROM items CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(letter)),
il AS (SELECT idx, gold, unnest(['A', 'B', 'C', 'D']) AS letter, generate_subscripts(['A', 'B', 'C', 'D'], 1) AS lpos FROM items),
r AS (SELECT il.idx, il.letter, il.gold, row_number() OVER (PARTITION BY il.idx ORDER BY lg.logit DESC, il.lpos) AS rn
      FROM il JOIN lg USING (idx, letter))
SELECT idx, letter AS pred, true AS letters_ok, CAST(letter = ['A', 'B', 'C', 'D'][gold + 1] AS INTEGER) AS correct FROM r WHERE rn = 1"""

SEQS = DOC_BYTES + f""",
seqs AS (
  SELECT doc_id, flatten(list_transform(ids, lambda x, p: CASE WHEN {uk("'sq'", 'doc_id', 'p - 1')} < 0.03
           THEN [CAST(256 + {hk("'sv'", 'doc_id', 'p - 1')} % 6 AS INTEGER), x] ELSE [x] END)) AS ids,
         CAST(10 + {hk("'pl'", 'doc_id')} % 20 AS INTEGER) AS plen
  FROM doc_bytes)"""

Q["trim_completions"] = with_(SEQS) + """
SELECT doc_id, array_to_string(cut, ',') AS completion, CAST(len(cut) AS INTEGER) AS n FROM (
  SELECT doc_id, CASE WHEN e > 0 AND b > 0 THEN comp[1:least(e, b) - 1] WHEN e > 0 THEN comp[1:e - 1]
                      WHEN b > 0 THEN comp[1:b - 1] ELSE comp END AS cut FROM (
    SELECT doc_id, comp, coalesce(list_position(comp, 260), 0) AS e, coalesce(list_position(comp, 261), 0) AS b FROM (
      SELECT doc_id, ids[plen + 1:len(ids)] AS comp FROM seqs)))"""

Q["completion_mask"] = with_(SEQS) + """,
m AS (SELECT doc_id, plen, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS p FROM seqs),
c AS (SELECT doc_id, p, plen,
             sum(CASE WHEN p >= plen AND x = 258 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened,
             coalesce(sum(CASE WHEN p >= plen AND x = 259 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed
      FROM m)
SELECT doc_id, string_agg(CASE WHEN p < plen OR opened > closed THEN '0' ELSE '1' END, ',' ORDER BY p) AS mask
FROM c GROUP BY doc_id"""

GSM_RE = "'#### (\\-?[0-9\\.\\,]+)'"


def EXTRACT(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {GSM_RE}) THEN replace(trim(regexp_extract({x}, {GSM_RE}, 1)), ',', '') END"


GSMV = """gsm AS (
  SELECT ('0x' || substr(md5(l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey), 1, 15))::BIGINT AS problem, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS n,
         CAST(l_quantity AS INTEGER) * l_linenumber AS r FROM lineitem)"""

MATCHES = GSMV + f""",
comp AS (
  SELECT problem, CAST(sample AS INTEGER) AS sample,
         CASE WHEN {uk("'cp'", 'problem', 'sample')} >= 0.95 THEN 'I am not sure.'
              WHEN {uk("'cp'", 'problem', 'sample')} >= 0.6 THEN '#### ' || (r + 1)
              ELSE 'So the answer is' || chr(10) || '#### ' || r END AS completion
  FROM gsm CROSS JOIN range(8) AS s(sample)),
refs AS (SELECT problem, {EXTRACT("r || '.' || chr(10) || '#### ' || r")} AS ref FROM gsm),
matches AS (
  SELECT problem, sample, {EXTRACT('completion')} AS pred, ref FROM comp JOIN refs USING (problem)),
outcomes AS (
  SELECT problem, sample, pred, ref, CAST(pred IS NOT DISTINCT FROM ref AS INTEGER) AS correct,
         pred IS NULL AND ref IS NULL AS both_missing FROM matches)"""

Q["answer_match"] = with_(MATCHES) + """
SELECT problem, sample, pred, ref, correct, both_missing FROM outcomes"""

Q["generative_eval"] = with_(MATCHES) + """
SELECT count(*) AS n_problems, CAST(sum(passed) AS BIGINT) AS n_passed, round(avg(passed), 6) AS accuracy
FROM (SELECT problem, max(correct) AS passed FROM outcomes GROUP BY problem)"""

Q["pass_at_k"] = with_(MATCHES) + """
SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN f < k THEN 1 ELSE 0 END), 6) AS pass_at_k
FROM (SELECT problem, min(CASE WHEN correct = 1 THEN sample END) AS f FROM outcomes GROUP BY problem)
CROSS JOIN range(1, 9) AS kk(k) GROUP BY k"""

ROLL = """roll AS (
  SELECT user_id AS prompt, event_id AS sample, CAST(event_type = 'purchase' AS DOUBLE) AS reward,
         CAST(1 + floor(value) AS BIGINT) AS length, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS step
  FROM events),
adv AS (SELECT r.*, r.reward - m.mu AS advantage FROM roll r JOIN (SELECT prompt, avg(reward) AS mu FROM roll GROUP BY prompt) m USING (prompt))"""

Q["rollout_advantages"] = with_(ROLL) + """
SELECT prompt, sample, reward, round(advantage, 6) AS advantage FROM adv"""

Q["rollout_stats"] = with_(ROLL) + """
SELECT step, round(avg(r), 6) AS mean_reward, round(sum(l) / sum(n), 6) AS mean_length FROM (
  SELECT step, prompt, avg(reward) AS r, sum(length) AS l, count(*) AS n FROM roll GROUP BY step, prompt) GROUP BY step"""

Q["policy_objective"] = with_(ROLL) + f""",
lp AS (
  SELECT sample, pos, -10 * {uk("'lp'", 'sample', 'pos')} AS logp,
         CASE WHEN {uk("'tg'", 'sample', 'pos')} < 0.1 THEN -1 ELSE 1 END AS target
  FROM (SELECT sample, unnest(range(length)) AS pos FROM roll))
SELECT step, prompt, CAST(sample % 2 AS INTEGER) AS pass_idx, count(*) FILTER (WHERE target >= 0) AS n_valid,
       round(sum(CASE WHEN target >= 0 THEN logp * advantage ELSE 0.0 END) / (greatest(count(*) FILTER (WHERE target >= 0), 1) * 2 * 1), 6) AS objective
FROM lp JOIN adv USING (sample) GROUP BY step, prompt, CAST(sample % 2 AS INTEGER)"""

TBL = """tbl AS (
  SELECT CAST(range AS INTEGER) AS token_id, CASE WHEN range < 128 THEN 1 ELSE 3 END AS n_bytes, 1 AS raw_bytes FROM range(256)
  UNION ALL SELECT * FROM (VALUES (256, 0, 16), (257, 0, 14), (258, 0, 16), (259, 0, 14), (260, 0, 17), (261, 0, 7),
                                  (262, 0, 14), (263, 0, 12), (264, 0, 19)) v(token_id, n_bytes, raw_bytes))"""

def WEYL(a: str, b: str) -> str:
    x = f"(doc_id * {a}::DOUBLE + pos * {b}::DOUBLE)"
    return f"({x} - floor({x}))"


TLOSS = DOC_BYTES + f""",
tl AS (
  SELECT doc_id, pos, CASE WHEN {WEYL('0.6180339887498949', '0.7548776662466927')} < 0.1 THEN -1 ELSE tok END AS target,
         round({WEYL('0.5698402909980532', '0.3247179572447460')} * 10, 3) AS loss,
         CASE WHEN doc_id // 256 = (SELECT max(doc_id) FROM documents) // 256 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT doc_id, unnest(ids) AS tok, generate_subscripts(ids, 1) - 1 AS pos FROM doc_bytes)),
""" + TBL


def bpb_sql(src: str, by: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {sel}round(total_nats, 2) AS total_nats, total_bytes,
       round(CASE WHEN total_bytes = 0 THEN 'inf'::DOUBLE ELSE total_nats / (ln(2) * total_bytes) END, 6) AS bpb FROM (
  SELECT {sel}sum(CASE WHEN coalesce(n_bytes, 0) > 0 THEN loss ELSE 0.0 END) AS total_nats, CAST(sum(coalesce(n_bytes, 0)) AS BIGINT) AS total_bytes
  FROM {src} LEFT JOIN tbl ON tbl.token_id = target WHERE target >= 0 {grp})"""


Q["bits_per_byte"] = with_(TLOSS) + bpb_sql("tl")
Q["split_bpb"] = with_(TLOSS) + """,
tb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id, pos) - 1 AS i FROM tl) WHERE i < 18000)
""" + bpb_sql("tb", "split")

# ------------------------------------------------------------------ 2.7 task builders

MSUM = "CAST(len(m) AS INTEGER) AS n_messages, array_to_string(list_transform(m, lambda x: x.role), ',') AS roles, md5(array_to_string(list_transform(m, lambda x: x.content), '|')) AS content_md5"


def RENDER_MC(q: str, letters: str, choices: str) -> str:
    return (f"'Multiple Choice question: ' || {q} || chr(10) || array_to_string(list_transform(list_zip({choices}, {letters}), "
            f"lambda z: '- ' || z[1] || '=' || z[2] || chr(10)), '') || chr(10) || 'Respond only with the letter of the correct answer.'")


Q["render_mc"] = with_(ITEMS) + f"""
SELECT idx, md5(p) AS prompt_md5, CAST(length(p) AS INTEGER) AS n_chars FROM (
  SELECT idx, {RENDER_MC('query', "['A', 'B', 'C', 'D']", 'choices')} AS p FROM items)"""

Q["build_arc"] = with_(ITEMS) + f""",
arc AS (SELECT idx, query, choices, labels, CASE WHEN idx % 50 = 7 THEN 'E' ELSE labels[gold + 1] END AS answer_key FROM (
  SELECT *, CASE WHEN idx % 5 = 0 THEN ['1', '2', '3', '4'] ELSE ['A', 'B', 'C', 'D'] END AS labels FROM items))
SELECT idx, list_contains(labels, answer_key) AS valid, {MSUM} FROM (
  SELECT idx, labels, answer_key, [{{'role': 'user', 'content': {RENDER_MC('query', 'labels', 'choices')}}},
                                   {{'role': 'assistant', 'content': answer_key}}] AS m FROM arc)"""

Q["build_mmlu"] = with_(ITEMS) + f""",
mm AS (SELECT idx, query, CASE WHEN idx % 40 = 9 THEN choices[1:3] ELSE choices END AS choices, gold, subject FROM items)
SELECT idx, len(choices) = 4 AND gold BETWEEN 0 AND 3 AS valid, subject, {MSUM} FROM (
  SELECT idx, choices, gold, subject, [{{'role': 'user', 'content': {RENDER_MC('query', "['A', 'B', 'C', 'D']", 'choices')}}},
                                       {{'role': 'assistant', 'content': ['A', 'B', 'C', 'D'][gold + 1]}}] AS m FROM mm)"""

# answer text of the gsm view: text, python, output, text parts
GSM_PARTS = GSMV + """,
gp AS (SELECT problem, q, n, r,
  [{'type': 'text', 'text': 'Each crate holds ' || q || '. Total '}, {'type': 'python', 'text': q || '*' || n},
   {'type': 'python_output', 'text': CAST(r AS VARCHAR)}, {'type': 'text', 'text': r || '.' || chr(10) || '#### ' || r}] AS parts
  FROM gsm)"""

Q["parse_gsm8k"] = with_(GSM_PARTS) + """
SELECT problem, CAST(len(parts) AS INTEGER) AS n_parts, array_to_string(list_transform(parts, lambda x: x.type), ',') AS types,
       array_to_string(list_transform(parts, lambda x: x.text), '|') AS texts FROM gp"""

Q["flatten_parts"] = with_(GSM_PARTS) + """
SELECT problem, array_to_string(list_transform(parts, lambda x: CASE WHEN x.type = 'python' THEN '<<' || x.text || '='
   WHEN x.type = 'python_output' THEN x.text || '>>' ELSE x.text END), '') AS text FROM gp"""

Q["extract_answer"] = with_(MATCHES) + f"""
SELECT problem, sample, {EXTRACT('completion')} AS answer FROM comp"""

TOOLS = GSMV + """,
tools AS (
  SELECT 'gsm' AS src, problem AS id, q || '*' || n AS expr FROM gsm
  UNION ALL
  SELECT 'part', p_partkey, CASE WHEN p_partkey % 100 = 0 THEN '2**' || p_size WHEN p_partkey % 100 = 1 THEN '__import__(''os'')'
    WHEN p_partkey % 100 = 2 THEN 'abs(-3)' WHEN p_partkey % 100 = 3 THEN '1,000 + ' || p_size
    WHEN p_partkey % 100 = 4 THEN 'open(''x'') + 1;'
    ELSE '''' || split_part(p_name, ' ', 1) || '''.count(''' || substr(split_part(p_name, ' ', 1), 2, 1) || ''')' END
  FROM part),
cls AS (SELECT src, id, expr, e, CASE
    WHEN regexp_full_match(e, '[0-9*+\\-/.() ]*') THEN CASE WHEN contains(e, '**') THEN 'rejected_power' ELSE 'arith' END
    WHEN NOT regexp_full_match(e, '[a-zA-Z0-9''"()._ ]*') THEN 'rejected_charset'
    WHEN """ + " OR ".join(f"contains(lower(e), '{d}')" for d in [
        "__", "import", "exec", "eval", "compile", "open", "file", "input", "raw_input", "globals", "locals", "vars", "dir",
        "getattr", "setattr", "delattr", "hasattr"]) + """ THEN 'rejected_pattern'
    WHEN NOT contains(e, '.count(') THEN 'rejected_method' ELSE 'count' END AS kind
  FROM (SELECT *, replace(expr, ',', '') AS e FROM tools))"""

BIN = "'^\\s*(-?[0-9.]+)\\s*([*+/-])\\s*(-?[0-9.]+)\\s*$'"
CNT = """'^\\s*''(.*)''\\.count\\(''(.*)''\\)\\s*$'"""

Q["check_tool_calls"] = with_(TOOLS) + f"""
SELECT src, id, expr, kind, round(CASE
  WHEN kind = 'arith' THEN (CASE regexp_extract(e, {BIN}, 2)
      WHEN '*' THEN TRY_CAST(regexp_extract(e, {BIN}, 1) AS DOUBLE) * TRY_CAST(regexp_extract(e, {BIN}, 3) AS DOUBLE)
      WHEN '+' THEN TRY_CAST(regexp_extract(e, {BIN}, 1) AS DOUBLE) + TRY_CAST(regexp_extract(e, {BIN}, 3) AS DOUBLE)
      WHEN '-' THEN TRY_CAST(regexp_extract(e, {BIN}, 1) AS DOUBLE) - TRY_CAST(regexp_extract(e, {BIN}, 3) AS DOUBLE)
      WHEN '/' THEN CASE WHEN TRY_CAST(regexp_extract(e, {BIN}, 3) AS DOUBLE) <> 0 THEN
                    TRY_CAST(regexp_extract(e, {BIN}, 1) AS DOUBLE) / TRY_CAST(regexp_extract(e, {BIN}, 3) AS DOUBLE) END END)
  WHEN kind = 'count' AND regexp_matches(e, {CNT}) AND length(regexp_extract(e, {CNT}, 2)) > 0 THEN
      CAST((length(regexp_extract(e, {CNT}, 1)) - length(replace(regexp_extract(e, {CNT}, 1), regexp_extract(e, {CNT}, 2), '')))
           / length(regexp_extract(e, {CNT}, 2)) AS DOUBLE) END, 6) AS value
FROM cls"""

PROGS = """progs AS (
  SELECT p_partkey AS task_id, CASE WHEN p_partkey % 3 = 0 THEN 'import math' || chr(10) || 'from typing import List' || chr(10) || chr(10) || sig
     WHEN p_partkey % 3 = 1 THEN '# header' || chr(10) || '  import re' || chr(10) || chr(10) || 'x = 1' || chr(10) || 'import os' || chr(10) || sig
     ELSE sig END AS prompt,
    '    return x * ' || p_size AS solution,
    CASE WHEN p_partkey % 2 = 0 THEN 'Here is code:' || chr(10) || '```python' || chr(10) || body || chr(10) || '```' || chr(10) || 'Done.'
         ELSE '  ' || body || '  ' || chr(10) END AS completion,
    'def check(fn):' || chr(10) || '    assert fn(1) == ' || p_size || chr(10) AS test, 'f_' || p_partkey AS entry_point
  FROM (SELECT *, 'def f_' || p_partkey || '(x: int) -> int:' || chr(10) || '    ' || repeat(chr(34), 3) || p_name || repeat(chr(34), 3) || chr(10) AS sig,
               'def f_' || p_partkey || '(x):' || chr(10) || '    return x * ' || p_size AS body FROM part))"""

FENCE = "'(?s)```(?:python)?\\s*\\n(.*?)\\n```'"


def CODE(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {FENCE}) THEN {STRIP(f'regexp_extract({x}, {FENCE}, 1)')} ELSE {STRIP(x)} END"


def IMPORTS(x: str) -> str:
    lines = f"list_transform(string_split({x}, chr(10)), lambda s: {STRIP('s')})"
    stop = (f"coalesce(list_position(list_transform({lines}, lambda s: NOT (starts_with(s, 'import ') OR starts_with(s, 'from ')) "
            f"AND s <> '' AND NOT starts_with(s, '#')), true), 0)")
    head = f"CASE WHEN {stop} > 0 THEN ({lines})[1:{stop} - 1] ELSE {lines} END"
    return f"array_to_string(list_filter({head}, lambda s: starts_with(s, 'import ') OR starts_with(s, 'from ')), chr(10))"


Q["build_humaneval"] = with_(PROGS) + f"""
SELECT task_id, entry_point, {MSUM} FROM (
  SELECT task_id, entry_point, [{{'role': 'user', 'content': prompt}}, {{'role': 'assistant', 'content': prompt || chr(10) || solution}}] AS m FROM progs)"""

Q["extract_code"] = with_(PROGS) + f"""
SELECT task_id, {CODE('completion')} AS code FROM progs"""

Q["extract_imports"] = with_(PROGS) + f"""
SELECT task_id, {IMPORTS('prompt')} AS imports FROM progs"""

Q["assemble_programs"] = with_(PROGS) + f"""
SELECT task_id, md5({IMPORTS('prompt')} || chr(10) || chr(10) || {CODE('completion')} || chr(10) || chr(10) || test || chr(10) || 'check(' || entry_point || ')') AS program_md5 FROM progs"""

Q["program_pass_rate"] = f"""
WITH r AS (SELECT CASE WHEN u < 0.6 THEN 'success' WHEN u < 0.8 THEN 'error' WHEN u < 0.9 THEN 'timeout' ELSE 'memory' END AS outcome
           FROM (SELECT {uk("'res'", 'p_partkey')} AS u FROM part))
SELECT outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM r GROUP BY outcome"""

# ------------------------------------------------------------------ 2.9 run analytics

RUNS = f"""runs AS (
  SELECT run, flops_budget, depth, pt, lm, CAST(pt + lm AS DOUBLE) AS eff, tokens_trained,
         CASE WHEN {uk("'vn'", 'run')} < 0.02 THEN NULL
              ELSE 1 + 0.05 * (log10(CAST(pt + lm AS DOUBLE)) - 8) * (log10(CAST(pt + lm AS DOUBLE)) - 8) + 0.01 * {uk("'vb'", 'run')} END AS val_bpb,
         pt + pt // 10 + pt // 20 + lm + 100 AS params_total
  FROM (SELECT p_partkey AS run, CAST(p_size AS DOUBLE) AS flops_budget, CAST(4 + p_partkey % 20 AS INTEGER) AS depth,
               CAST(1000000 * (p_partkey + 1) AS BIGINT) AS pt, CAST(1000000 * (p_partkey + 1) AS BIGINT) // 10 AS lm,
               CAST(floor(20 * CAST(1100000 * (p_partkey + 1) AS DOUBLE) * (0.5 + {uk("'tk'", 'p_partkey')})) AS BIGINT) AS tokens_trained
        FROM part))"""

Q["pending_runs"] = with_(RUNS) + """
SELECT CAST(b AS DOUBLE) AS flops_budget, CAST(d AS INTEGER) AS depth FROM range(1, 61) t(b), range(4, 26) u(d)
WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.flops_budget = b AND runs.depth = d AND val_bpb IS NOT NULL AND val_bpb > 0)"""

FRUNS = RUNS + """,
fr AS (SELECT run, flops_budget, depth, val_bpb, tokens_trained, eff, log10(eff) AS x, val_bpb AS y, tokens_trained / eff AS ratio
       FROM runs WHERE val_bpb IS NOT NULL AND val_bpb > 0)"""

Q["filter_runs"] = with_(FRUNS) + """
SELECT run, flops_budget, depth, val_bpb FROM fr WHERE flops_budget NOT IN (7.0) AND depth NOT IN (23)"""

Q["effective_params"] = with_(RUNS) + """
SELECT run, convention, effective_params, round(tokens_trained / effective_params, 6) AS param_data_ratio FROM (
  SELECT run, 'all' AS convention, CAST(params_total AS DOUBLE) AS effective_params, tokens_trained FROM runs WHERE val_bpb > 0
  UNION ALL SELECT run, 'transformer_lm_head', eff, tokens_trained FROM runs WHERE val_bpb > 0
  UNION ALL SELECT run, 'transformer', CAST(pt AS DOUBLE), tokens_trained FROM runs WHERE val_bpb > 0)"""


def det3(a11, a12, a13, a21, a22, a23, a31, a32, a33):
    return (f"(({a11}) * (({a22}) * ({a33}) - ({a23}) * ({a32})) - ({a12}) * (({a21}) * ({a33}) - ({a23}) * ({a31}))"
            f" + ({a13}) * (({a21}) * ({a32}) - ({a22}) * ({a31})))")


S0 = "CAST(n AS DOUBLE)"
FIT = FRUNS + f""",
xm AS (SELECT flops_budget, avg(x) AS xm FROM fr GROUP BY flops_budget),
cu AS (SELECT fr.*, x - xm AS u, xm FROM fr JOIN xm USING (flops_budget)),
ps AS (SELECT flops_budget, count(*) AS n, any_value(xm) AS xm, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4,
              sum(u) AS s1, sum(y) AS t0, sum(u * y) AS t1, sum(u * u * y) AS t2, arg_min(x, y) AS bx, min(y) AS bestv
       FROM cu GROUP BY flops_budget),
cr AS (SELECT *, {det3('s4', 's3', 's2', 's3', 's2', 's1', 's2', 's1', S0)} AS d FROM ps),
fit0 AS (SELECT flops_budget, n, xm, bx, bestv,
                {det3('t2', 's3', 's2', 't1', 's2', 's1', 't0', 's1', S0)} / nullif(d, 0) AS a,
                {det3('s4', 't2', 's2', 's3', 't1', 's1', 's2', 't0', S0)} / nullif(d, 0) AS bb,
                {det3('s4', 's3', 't2', 's3', 's2', 't1', 's2', 's1', 't0')} / nullif(d, 0) AS cc FROM cr),
fit AS (SELECT flops_budget, n, a, bb - 2 * a * xm AS b, cc - bb * xm + a * xm * xm AS c,
               coalesce(n >= 3 AND a > 0, false) AS fitted,
               CASE WHEN coalesce(n >= 3 AND a > 0, false) THEN xm + (-bb / (2 * a)) ELSE bx END AS log_params,
               CASE WHEN coalesce(n >= 3 AND a > 0, false) THEN a * (-bb / (2 * a)) * (-bb / (2 * a)) + bb * (-bb / (2 * a)) + cc ELSE bestv END AS bpb
        FROM fit0)"""

Q["isoflop_fit"] = with_(FIT) + """
SELECT flops_budget, n, fitted, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(log_params, 6) AS log_params,
       round(bpb, 6) AS bpb FROM fit"""

OPT = FIT + """,
seg AS (SELECT flops_budget, x, tokens_trained AS t, ratio AS r,
               lead(x) OVER w AS nx, lead(tokens_trained) OVER w AS nt, lead(ratio) OVER w AS nr
        FROM fr WINDOW w AS (PARTITION BY flops_budget ORDER BY x)),
lo AS (SELECT seg.flops_budget, arg_max({'x': x, 't': t, 'r': r, 'nx': nx, 'nt': nt, 'nr': nr}, x) AS lo
       FROM seg JOIN fit USING (flops_budget) WHERE x <= log_params GROUP BY seg.flops_budget),
fst AS (SELECT flops_budget, arg_min({'x': x, 't': t, 'r': r}, x) AS f FROM seg GROUP BY flops_budget),
bst AS (SELECT flops_budget, arg_min({'t': tokens_trained, 'r': ratio}, val_bpb) AS bb FROM fr GROUP BY flops_budget),
optima AS (
  SELECT fit.flops_budget, fit.n, fit.fitted, fit.log_params, fit.bpb,
    CASE WHEN NOT fit.fitted THEN bst.bb.t WHEN lo.lo IS NULL THEN fst.f.t WHEN lo.lo.nx IS NULL THEN lo.lo.t
         ELSE lo.lo.t + (lo.lo.nt - lo.lo.t) * ((fit.log_params - lo.lo.x) / nullif(lo.lo.nx - lo.lo.x, 0)) END AS tokens,
    CASE WHEN NOT fit.fitted THEN bst.bb.r WHEN lo.lo IS NULL THEN fst.f.r WHEN lo.lo.nx IS NULL THEN lo.lo.r
         ELSE lo.lo.r + (lo.lo.nr - lo.lo.r) * ((fit.log_params - lo.lo.x) / nullif(lo.lo.nx - lo.lo.x, 0)) END AS ratio
  FROM fit LEFT JOIN lo USING (flops_budget) JOIN fst USING (flops_budget) JOIN bst USING (flops_budget))"""

Q["interp_at"] = with_(OPT) + """
SELECT flops_budget, fitted, round(log_params, 6) AS log_params, round(log10(tokens), 6) AS log_tokens, round(ratio, 4) AS ratio FROM optima"""

PLAW = OPT + """,
plaw AS (SELECT count(*) AS n_budgets, regr_slope(log_params, log10(flops_budget)) AS slope_n,
                regr_intercept(log_params, log10(flops_budget)) AS intercept_n,
                regr_slope(log10(tokens), log10(flops_budget)) AS slope_d, regr_intercept(log10(tokens), log10(flops_budget)) AS intercept_d,
                min(flops_budget) AS min_budget, max(flops_budget) AS max_budget, avg(ratio) AS mean_ratio, stddev_samp(ratio) AS std_ratio
         FROM optima)"""

Q["power_law_fit"] = with_(PLAW) + """
SELECT n_budgets, round(slope_n, 6) AS slope_n, round(intercept_n, 6) AS intercept_n, round(slope_d, 6) AS slope_d,
       round(intercept_d, 6) AS intercept_d FROM plaw"""

Q["optimal_ratio"] = with_(PLAW) + """
SELECT n_budgets,
  round(CASE WHEN n_budgets >= 2 THEN pow(10.0, (intercept_d + slope_d * (0.5 * (log10(min_budget) + log10(max_budget))))
                                           - (intercept_n + slope_n * (0.5 * (log10(min_budget) + log10(max_budget))))) END, 4) AS optimal_ratio,
  round(mean_ratio, 4) AS mean_ratio, round(std_ratio, 4) AS std_ratio,
  round(CASE WHEN n_budgets >= 2 THEN slope_d - slope_n END, 4) AS exponent_gap FROM plaw"""

Q["best_per_budget"] = with_(FRUNS) + """
SELECT flops_budget, b.depth AS depth, round(b.val_bpb, 6) AS val_bpb, round(b.ratio, 6) AS param_data_ratio FROM (
  SELECT flops_budget, arg_min({'depth': depth, 'val_bpb': val_bpb, 'ratio': ratio}, val_bpb) AS b FROM fr GROUP BY flops_budget)"""

CENTER = ACC + """,
bf AS (SELECT * FROM (VALUES ('AUTOMOBILE', 0.25), ('FURNITURE', 0.25), ('HOUSEHOLD', 0.5), ('MACHINERY', 0.25)) v(task, baseline)),
ce AS (SELECT model, task, (accuracy - coalesce(baseline, 0.0)) / (1.0 - coalesce(baseline, 0.0)) AS centered
       FROM acc LEFT JOIN bf USING (task))"""

Q["center_accuracy"] = with_(CENTER) + "\nSELECT model, " + ", ".join(
    f"round(max(centered) FILTER (WHERE task = '{s}'), 6) AS \"{s}\"" for s in
    ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + ", round(avg(centered), 6) AS mean_centered FROM ce GROUP BY model"

FEAT = f"""feat AS (
  SELECT l_suppkey, f_qty, f_price, f_disc, f_tax,
         0.3 * f_qty + 0.2 * f_price + 1.5 * f_disc + 2.0 * f_tax + 0.05 * {uk("'y'", 'l_suppkey')} AS y FROM (
    SELECT l_suppkey, avg(l_quantity) / 50 AS f_qty, avg(l_extendedprice) / 1e5 AS f_price, avg(l_discount) AS f_disc,
           avg(l_tax) AS f_tax FROM lineitem GROUP BY l_suppkey))"""

_XS = ["f_qty", "f_price", "f_disc", "f_tax"]
_G = "[" + ", ".join("[" + ", ".join(f"covar_pop({a}, {b}) * count(*)" for b in _XS) + "]" for a in _XS) + "]"
# Centred normal equations, solved by Gauss-Jordan elimination, a step a column.
RIDGE = f"""mom AS (
  SELECT {_G} AS g, [{", ".join(f"covar_pop({a}, y) * count(*)" for a in _XS)}] AS b, [{", ".join(f"avg({a})" for a in _XS)}] AS mx,
         avg(y) AS my, var_pop(y) * count(*) AS syy FROM feat),
al AS (SELECT unnest([0.0, 0.001, 0.01, 0.1, 1.0]::DOUBLE[]) AS alpha),
gj AS (
  SELECT alpha, 0 AS step, list_transform(g, lambda r, i: list_append(list_transform(r, lambda v, j: v + CASE WHEN i = j THEN alpha ELSE 0.0 END), b[i])) AS a FROM mom, al
  UNION ALL
  SELECT alpha, step + 1, list_transform(a, lambda r, i: CASE WHEN i = step + 1 THEN list_transform(r, lambda v: v / r[step + 1])
    ELSE list_transform(r, lambda v, j: v - r[step + 1] / a[step + 1][step + 1] * a[step + 1][j]) END) FROM gj WHERE step < 4),
sol AS (SELECT alpha, list_transform(a, lambda r: r[5]) AS w FROM gj WHERE step = 4),
ridge AS (
  SELECT alpha, w, my - list_sum(list_transform(w, lambda v, i: v * mx[i])) AS intercept,
         1 - (syy - 2 * list_sum(list_transform(w, lambda v, i: v * b[i])) + list_sum(list_transform(g, lambda r, i: w[i] * list_sum(list_transform(r, lambda v, j: v * w[j]))))) / syy AS r2
  FROM sol, mom)"""

Q["ridge_fit"] = "WITH RECURSIVE " + FEAT + ",\n" + RIDGE + """
SELECT alpha, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(sqrt(list_sum(list_transform(w, lambda v: v * v))), 6) AS weight_norm FROM ridge"""

Q["predict_core"] = "WITH RECURSIVE " + FEAT + ",\n" + RIDGE + f""",
m AS (SELECT *, (f_qty + f_price + f_disc + f_tax) / 4 AS mean FROM feat),
simple AS (SELECT regr_slope(y, mean) AS s, regr_intercept(y, mean) AS i FROM m),
one AS (SELECT arg_max([s, i], r2) AS best, arg_max(k, r2) AS k FROM ({" UNION ALL ".join(f"SELECT {k} AS k, regr_r2(y, {x}) AS r2, regr_slope(y, {x}) AS s, regr_intercept(y, {x}) AS i FROM feat" for k, x in enumerate(_XS, 1))})),
p AS (SELECT l_suppkey, simple.i + simple.s * mean AS ps, intercept + f_qty * w[1] + f_price * w[2] + f_disc * w[3] + f_tax * w[4] AS pr,
             best[2] + best[1] * ([f_qty, f_price, f_disc, f_tax])[one.k] AS pb FROM m, simple, one, ridge WHERE alpha = 0.01)
SELECT l_suppkey, round(ps, 6) AS pred_simple, round(pr, 6) AS pred_ridge, round(pb, 6) AS pred_best, round((ps + pr) / 2, 6) AS pred_final FROM p"""

Q["ols_fit"] = with_(FEAT) + """
SELECT count(*) AS n, round(regr_slope(y, f_qty), 6) AS slope, round(regr_intercept(y, f_qty), 6) AS intercept,
       round(regr_r2(y, f_qty), 6) AS r2 FROM feat"""

Q["rank_predictors"] = with_(FEAT) + """,
lng AS (SELECT 'f_qty' AS feature, f_qty AS x, y FROM feat UNION ALL SELECT 'f_price', f_price, y FROM feat
        UNION ALL SELECT 'f_disc', f_disc, y FROM feat UNION ALL SELECT 'f_tax', f_tax, y FROM feat),
g AS (SELECT feature, regr_r2(y, x) AS r2, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM lng GROUP BY feature)
SELECT feature, CAST(row_number() OVER (ORDER BY r2 DESC, feature) AS INTEGER) AS rank, round(r2, 6) AS r2, round(slope, 6) AS slope,
       round(intercept, 6) AS intercept FROM g"""

STEPS = """st AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value AS loss,
         value / 10 AS val_bpb, event_id, 0.1 + """ + uk("'dt'", 'event_id') + """ AS dt,
         ['NVIDIA H100 80GB HBM3', 'NVIDIA A100-SXM4-80GB', 'NVIDIA GeForce RTX 4090', 'Mystery Accelerator 9000'][user_id % 4 + 1] AS device
  FROM events)"""

Q["smoothed_loss"] = with_(STEPS) + """
SELECT run_id, step, round(0.1 * list_sum(list_transform(h, lambda e: pow(0.9, CAST(step - e.s AS DOUBLE)) * e.x))
                           / (1 - pow(0.9, CAST(step + 1 AS DOUBLE))), 6) AS smooth_loss FROM (
  SELECT run_id, step, list({'s': step, 'x': loss}) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 350 PRECEDING AND CURRENT ROW) AS h
  FROM st)"""

Q["running_min_bpb"] = with_(STEPS) + """
SELECT run_id, step, min(val_bpb) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS min_val_bpb FROM st"""

PEAKS_SQL = "(VALUES " + ", ".join(
    f"({i}, {pats!r}, {v!r})".replace("'", "'") for i, (pats, v) in enumerate([
        (["gb200"], 2.5e15), (["grace blackwell"], 2.5e15), (["b200"], 2.25e15), (["b100"], 1.8e15),
        (["h200", "nvl"], 836e12), (["h200", "pcie"], 836e12), (["h200"], 989e12), (["h100", "nvl"], 835e12),
        (["h100", "pcie"], 756e12), (["h100"], 989e12), (["h800", "nvl"], 989e12), (["h800"], 756e12),
        (["a100"], 312e12), (["a800"], 312e12), (["a40"], 149.7e12), (["a30"], 165e12), (["l40s"], 362e12),
        (["l40-s"], 362e12), (["l40 s"], 362e12), (["l4"], 121e12), (["mi355"], 2.5e15), (["mi325"], 1.3074e15),
        (["mi300x"], 1.3074e15), (["mi300a"], 980.6e12), (["mi250x"], 383e12), (["mi250"], 362.1e12),
        (["5090"], 209.5e12), (["4090"], 165.2e12), (["3090"], 71e12)])) + ") pk(priority, patterns, peak)"

Q["throughput"] = with_(STEPS) + f""",
dev AS (SELECT d.device, coalesce(arg_min(pk.peak, pk.priority), 'inf'::DOUBLE) AS peak_flops
        FROM (SELECT DISTINCT device FROM st) d LEFT JOIN {PEAKS_SQL}
        ON len(list_filter(pk.patterns, lambda p: NOT contains(lower(d.device), p))) = 0 GROUP BY d.device),
s2 AS (SELECT st.*, peak_flops, sum(CASE WHEN step > 10 THEN dt ELSE 0.0 END) OVER (PARTITION BY run_id ORDER BY step
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM st JOIN dev USING (device))
SELECT run_id, step, CAST(floor(524288 / dt) AS BIGINT) AS tok_per_sec, round(6.0e8 * 524288 / dt, 0) AS flops_per_sec,
       round(100 * (6.0e8 * 524288 / dt) / (peak_flops * 8), 6) AS mfu, round(total, 6) AS total_training_time,
       6.0e8 * 524288 * step AS flops_so_far,
       round(CASE WHEN step - 10 > 0 THEN (5000 - step) * total / (step - 10) END, 3) AS eta_seconds
FROM s2"""

# ------------------------------------------------------------------ 2.3 tokenization

# RE2 has no look-ahead: a mark (a private-use sign) goes before the last of several
# white spaces that another sign follows, unless that is a line end; no piece holds it.
_MARK = "chr(57344)"
_PIECE_RE = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}\x{E000}]?\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}\x{E000}]+[\r\n]*|\s*[\r\n]|\s+".replace("'", "''")
PIECES = rf"""doc_pieces AS (
  SELECT doc_id, text, regexp_extract_all(regexp_replace(text, '(\s)([^\S\r\n])(\S)', '\1' || {_MARK} || '\2\3', 'g'), '{_PIECE_RE}') AS ps
  FROM documents)"""

Q["pretokenize"] = f"""WITH {PIECES}
SELECT doc_id, array_to_string(ps, '') = text AS lossless, CAST(length(text) AS INTEGER) AS n_chars,
       CAST(len(ps) AS INTEGER) AS n_pieces, md5(array_to_string(ps, chr(1))) AS pieces_md5 FROM doc_pieces"""

Q["pretoken_counts"] = f"""WITH {PIECES}
SELECT piece, count(*) AS count FROM (SELECT unnest(ps) AS piece FROM doc_pieces) GROUP BY piece"""

# Byte-pair training, one merge a step: a piece is its tokens as <id><id>…, so a
# merge is a plain replacement from left to right.
BPE = f"""{PIECES},
own AS (SELECT piece, count(*)::BIGINT AS cnt FROM (SELECT unnest(ps) AS piece FROM doc_pieces) GROUP BY piece),
start AS (SELECT piece, cnt, (SELECT string_agg('<' || (('0x' || substr(hex(encode(piece)), 2 * i - 1, 2))::INTEGER) || '>', '' ORDER BY i)
                              FROM (SELECT unnest(range(1, strlen(piece) + 1)) AS i)) AS s FROM own),
bpe AS (
  SELECT 0 AS step, piece, cnt, s, NULL::INTEGER AS a, NULL::INTEGER AS b, NULL::BIGINT AS n FROM start
  UNION ALL
  SELECT step + 1, piece, cnt, replace(s, '<' || best.a || '><' || best.b || '>', '<' || (256 + step) || '>'), best.a, best.b, best.n
  FROM bpe, (
    SELECT a, b, sum(cnt)::BIGINT AS n FROM (
      SELECT cnt, unnest(l[:-2]) AS a, unnest(l[2:]) AS b
      FROM (SELECT cnt, list_transform(string_split(s[2:-2], '><'), lambda x: x::INTEGER) AS l FROM bpe) WHERE len(l) > 1)
    GROUP BY a, b ORDER BY n DESC, a, b LIMIT 1) best
  WHERE step < 64),
merges AS MATERIALIZED (SELECT DISTINCT step - 1 AS rank, a AS left_id, b AS right_id, 255 + step AS new_id, n AS pair_count FROM bpe WHERE step > 0)"""

Q["train_bpe"] = f"""WITH RECURSIVE {BPE}
SELECT CAST(rank AS INTEGER) AS rank, left_id, right_id, CAST(new_id AS INTEGER) AS new_id, pair_count FROM merges"""

BPE_VOCAB = f"""{BPE},
toks AS (
  SELECT 0 AS step, list_transform(range(256), lambda i: upper(printf('%02x', i))) AS t
  UNION ALL
  SELECT step + 1, list_append(t, t[left_id + 1] || t[right_id + 1]) FROM toks JOIN merges ON rank = step),
bytes AS (SELECT arg_max(t, step) AS t FROM toks),
vocab AS (
  SELECT unnest(range(len(t))) AS token_id, unnest(t) AS token_hex, false AS is_special FROM bytes
  UNION ALL
  SELECT len(t) + i, upper(hex(encode(name))), true FROM bytes, (SELECT unnest(range(9)) AS i, unnest(['<|bos|>', '<|user_start|>', '<|user_end|>', '<|assistant_start|>', '<|assistant_end|>', '<|python_start|>', '<|python_end|>', '<|output_start|>', '<|output_end|>']) AS name))"""

Q["build_vocab"] = f"""WITH RECURSIVE {BPE_VOCAB}
SELECT CAST(token_id AS INTEGER) AS token_id, token_hex, is_special FROM vocab"""

BPE_IDS = f"""{BPE},
coded AS (SELECT piece, list_transform(string_split(s[2:-2], '><'), lambda x: x::INTEGER) AS ids FROM bpe WHERE step = (SELECT max(step) FROM bpe)),
bos AS (SELECT 256 + max(step) AS id FROM bpe),
doc_ids AS (
  SELECT doc_id, list_prepend(bos.id, flatten(list(ids ORDER BY pos))) AS ids
  FROM (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos FROM doc_pieces) JOIN coded USING (piece), bos GROUP BY doc_id, bos.id)"""

Q["encode_corpus"] = f"""WITH RECURSIVE {BPE_IDS}
SELECT doc_id, CAST(len(coalesce(i.ids, [bos.id])) AS INTEGER) AS n_tokens, md5(array_to_string(coalesce(i.ids, [bos.id]), ',')) AS ids_md5
FROM documents LEFT JOIN doc_ids i USING (doc_id), bos"""

WORDS = """words AS (
  SELECT word, CAST(row_number() OVER (ORDER BY word) + 2 AS INTEGER) AS id FROM (
    SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> '')"""


def WORD_IDS(src: str, key: str, col: str) -> str:
    return f"""(SELECT s.{key}, list_concat([1], coalesce(list(coalesce(w.id, 0) ORDER BY s.wpos) FILTER (WHERE s.word IS NOT NULL), []), [2]) AS ids
  FROM (SELECT {key}, unnest(ws) AS word, generate_subscripts(ws, 1) AS wpos FROM (
          SELECT {key}, list_filter(regexp_split_to_array(lower({col}), '\\s+'), lambda x: x <> '') AS ws FROM {src})) s
  LEFT JOIN words w USING (word) GROUP BY s.{key})"""


Q["word_encode"] = with_(WORDS) + f""",
ann AS (SELECT doc_id AS ann_id, text AS caption FROM documents),
enc AS {WORD_IDS('ann', 'ann_id', 'caption')}
SELECT a.ann_id, array_to_string(coalesce(e.ids, [1, 2]), ',') AS ids FROM ann a LEFT JOIN enc e USING (ann_id)"""

Q["decode_tokens"] = """
SELECT doc_id, text FROM documents"""

# A token decoded alone: valid UTF-8 signs keep their bytes, each malformed part (the
# longest beginning of a sign, else one byte) becomes U+FFFD, three bytes. On hex pairs.
_T = "[89AB][0-9A-F]"
_V = rf"""(?:[0-7][0-9A-F]|(?:C[2-9A-F]|D[0-9A-F]){_T}|E0[AB][0-9A-F]{_T}|(?:E[1-9ABCEF]){_T}{_T}|ED[89][0-9A-F]{_T}|F0[9AB][0-9A-F]{_T}{_T}|F[1-3]{_T}{_T}{_T}|F48[0-9A-F]{_T}{_T})"""
_PART = rf"""(?:E0[AB][0-9A-F]|E[1-9ABCEF]{_T}|ED[89][0-9A-F]|F0[9AB][0-9A-F](?:{_T})?|F[1-3]{_T}(?:{_T})?|F48[0-9A-F](?:{_T})?)"""
TRAINED_LENGTHS = f"""{BPE_VOCAB},
tbl AS (
  SELECT CAST(token_id AS INTEGER) AS token_id, CAST(len(token_hex) // 2 AS INTEGER) AS raw_bytes,
         CAST(CASE WHEN is_special THEN 0 ELSE list_sum(list_transform(regexp_extract_all(token_hex, '{_V}|{_PART}|..'),
              lambda x: CASE WHEN regexp_full_match(x, '{_V}') THEN len(x) // 2 ELSE 3 END)) END AS INTEGER) AS n_bytes
  FROM vocab)"""

Q["token_byte_lengths"] = f"""WITH RECURSIVE {TRAINED_LENGTHS}
SELECT token_id, n_bytes, raw_bytes FROM tbl"""

Q["token_byte_stats"] = f"""WITH RECURSIVE {TRAINED_LENGTHS}
SELECT CAST(min(n_bytes) FILTER (WHERE n_bytes > 0) AS INTEGER) AS min_bytes, CAST(max(n_bytes) FILTER (WHERE n_bytes > 0) AS INTEGER) AS max_bytes,
       round(avg(n_bytes) FILTER (WHERE n_bytes > 0), 6) AS mean_bytes, round(stddev_samp(n_bytes) FILTER (WHERE n_bytes > 0), 6) AS std_bytes,
       count(*) FILTER (WHERE n_bytes = 0) AS n_zero FROM tbl"""

Q["tokenizer_roundtrip"] = f"""WITH RECURSIVE {BPE_IDS},
{BPE_VOCAB.removeprefix(BPE + ",").strip()},
hexes AS (SELECT list(token_hex ORDER BY token_id) AS h FROM vocab)
SELECT count(*) AS n_docs, count(*) FILTER (WHERE array_to_string(list_transform(ids[2:], lambda i: h[i + 1]), '') <> upper(hex(encode(text)))) AS n_mismatch,
       CAST(sum(len(ids) - 1) AS BIGINT) AS n_tokens
FROM (SELECT text, coalesce(ids, [0]) AS ids FROM documents LEFT JOIN doc_ids USING (doc_id)), hexes"""

# Whole prompts, encoded: their distinct pieces go through all merges in order.
SPANS_BPE = f"""{BPE},
{ITEMS},
prompts AS (
  SELECT 'mc' AS kind, idx, CAST(opt - 1 AS INTEGER) AS opt, query || ' ' || o AS p FROM (SELECT idx, query, unnest(choices) AS o, generate_subscripts(choices, 1) AS opt FROM items)
  UNION ALL
  SELECT 'schema', idx, CAST(opt - 1 AS INTEGER), o || ' ' || query FROM (SELECT idx, query, unnest(choices) AS o, generate_subscripts(choices, 1) AS opt FROM items)),
split AS (SELECT kind, idx, opt, regexp_extract_all(regexp_replace(p, '(\\s)([^\\S\\r\\n])(\\S)', '\\1' || {_MARK} || '\\2\\3', 'g'), '{_PIECE_RE}') AS ps FROM prompts),
known AS (SELECT DISTINCT unnest(ps) AS piece FROM split),
enc AS (
  SELECT 0 AS step, piece, (SELECT string_agg('<' || (('0x' || substr(hex(encode(piece)), 2 * i - 1, 2))::INTEGER) || '>', '' ORDER BY i)
                            FROM (SELECT unnest(range(1, strlen(piece) + 1)) AS i)) AS s FROM known
  UNION ALL
  SELECT step + 1, piece, replace(s, '<' || left_id || '><' || right_id || '>', '<' || new_id || '>') FROM enc JOIN merges ON rank = step),
done AS (SELECT piece, list_transform(string_split(s[2:-2], '><'), lambda x: x::INTEGER) AS ids FROM enc WHERE step = (SELECT max(step) FROM enc)),
seqs AS (
  SELECT kind, idx, opt, list_concat([(SELECT 256 + max(step) FROM bpe)], coalesce(flatten(list(ids ORDER BY pos) FILTER (WHERE ids IS NOT NULL)), [])) AS ids
  FROM (SELECT kind, idx, opt, unnest(CASE WHEN len(ps) = 0 THEN [NULL] ELSE ps END) AS piece, generate_subscripts(CASE WHEN len(ps) = 0 THEN [NULL] ELSE ps END, 1) AS pos FROM split)
  LEFT JOIN done USING (piece) GROUP BY kind, idx, opt),
mt AS (SELECT idx, opt, ids FROM seqs WHERE kind = 'mc'),
st AS (SELECT idx, opt, ids FROM seqs WHERE kind = 'schema'),
{common_len("mt", "cm", "n", False)},
{common_len("st", "cs", "n", True)}"""

Q["option_spans_bpe"] = f"""WITH RECURSIVE {SPANS_BPE}
SELECT 'mc' AS kind, idx, opt, n AS start, CAST(len(ids) AS INTEGER) AS "end", md5(array_to_string(ids, ',')) AS ids_md5 FROM mt JOIN cm USING (idx)
UNION ALL
SELECT 'schema', idx, opt, CAST(len(ids) AS INTEGER) - n, CAST(len(ids) AS INTEGER), md5(array_to_string(ids, ',')) FROM st JOIN cs USING (idx)"""

RATIOS = WORDS + f""",
wenc AS {WORD_IDS('documents', 'doc_id', 'text')},
word AS (SELECT lang, source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(len(coalesce(e.ids, [1, 2]))) AS BIGINT) AS tokens
         FROM documents d LEFT JOIN wenc e USING (doc_id) GROUP BY lang, source),
byte AS (SELECT lang, source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(strlen(text)) AS BIGINT) AS tokens
         FROM documents GROUP BY lang, source)"""

Q["compression_ratio"] = with_(RATIOS) + """
SELECT lang, source, bytes, tokens, round(bytes / tokens, 6) AS ratio FROM word"""

Q["compare_tokenizers"] = with_(RATIOS) + """
SELECT lang, source, b.tokens AS base_tokens, o.tokens AS ours_tokens,
       round((b.tokens - o.tokens) / b.tokens * 100, 4) AS relative_diff_pct,
       CASE WHEN b.bytes / b.tokens > o.bytes / o.tokens THEN 'base' WHEN o.bytes / o.tokens > b.bytes / b.tokens THEN 'ours' ELSE 'tie' END AS better
FROM byte b JOIN word o USING (lang, source)"""

# ------------------------------------------------------------------ logs and reports

LOGS = STEPS + """,
per AS (SELECT run_id, count(*) AS n, max(step) AS lvs FROM st GROUP BY run_id),
lines AS (
  SELECT run_id, 'depth: ' || (4 + run_id % 20) AS line FROM per
  UNION ALL SELECT run_id, 'wte                     : ' || printf('%,d', (run_id + 1) * 1000003) FROM per
  UNION ALL SELECT run_id, 'lm_head                 : ' || printf('%,d', (run_id + 1) * 1000003) FROM per
  UNION ALL SELECT run_id, 'total                   : ' || printf('%,d', (run_id + 1) * 5000011) FROM per
  UNION ALL SELECT run_id, 'Calculated number of iterations: ' || printf('%,d', n * 10) FROM per
  UNION ALL SELECT run_id, 'Total batch size 524,288 => gradient accumulation steps: 1' FROM per
  UNION ALL SELECT run_id, 'step ' || lpad(CAST(step AS VARCHAR), 5, '0') || ' | Validation bpb: ' || printf('%.4f', val_bpb) FROM st
  UNION ALL SELECT run_id, 'CORE metric: 0.1000' FROM per WHERE run_id % 2 = 0
  UNION ALL SELECT run_id, 'CORE metric: ' || printf('%.4f', """ + uk("'core'", 'run_id') + """) FROM per WHERE run_id % 2 = 0)"""

Q["read_run_logs"] = with_(LOGS) + """
SELECT run_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM lines GROUP BY run_id"""

Q["extract_run_metrics"] = with_(LOGS) + """
SELECT per.run_id, CAST(4 + per.run_id % 20 AS INTEGER) AS depth, CAST((4 + per.run_id % 20) * 64 AS INTEGER) AS model_dim,
       (per.run_id + 1) * 1000003 AS params_wte, (per.run_id + 1) * 1000003 AS params_lm_head, (per.run_id + 1) * 5000011 AS params_total,
       n * 10 AS num_iterations, CAST(524288 AS BIGINT) AS batch_size, n * 10 * 524288 AS tokens_trained,
       CAST(printf('%.4f', st.val_bpb) AS DOUBLE) AS val_bpb,
       CASE WHEN per.run_id % 2 = 0 THEN CAST(printf('%.4f', """ + uk("'core'", 'per.run_id') + """) AS DOUBLE) ELSE 0.0 END AS core_score
FROM per JOIN st ON st.run_id = per.run_id AND st.step = per.lvs"""

SECTIONS = ACC + """,
w AS (SELECT model, max(accuracy) FILTER (WHERE task = 'AUTOMOBILE') AS a1, max(accuracy) FILTER (WHERE task = 'BUILDING') AS a2,
             max(accuracy) FILTER (WHERE task = 'FURNITURE') AS a3, max(accuracy) FILTER (WHERE task = 'HOUSEHOLD') AS a4,
             max(accuracy) FILTER (WHERE task = 'MACHINERY') AS a5, make_timestamp(2024, 1, 1, model % 5, 0, 0) AS start
      FROM acc GROUP BY model),
files AS (SELECT * FROM (VALUES ('tokenizer-training.md', 0), ('base-model-training.md', 1), ('base-model-evaluation.md', 2),
                                ('chat-sft.md', 3), ('chat-evaluation-sft.md', 4), ('chat-rl.md', 5), ('chat-evaluation-rl.md', 6)) v(file, i)),
sections AS (
  SELECT model AS run, 'header.md' AS file, 0 AS line_no, 'Run started: ' || strftime(start, '%Y-%m-%d %H:%M:%S') AS line FROM w
  UNION ALL
  SELECT model, file, 0, 'timestamp: ' || strftime(start + to_minutes(CAST((i + 1) * (37 + model) AS BIGINT)), '%Y-%m-%d %H:%M:%S')
  FROM w, files WHERE NOT (file = 'chat-evaluation-sft.md' AND model % 7 = 0)
  UNION ALL SELECT model, 'base-model-evaluation.md', 1, 'CORE: ' || printf('%.4f', (a1 + a2 + a3 + a4 + a5) / 5) FROM w
  UNION ALL SELECT model, 'chat-evaluation-sft.md', 1, 'ARC-Easy: ' || printf('%.4f', a1) FROM w
  UNION ALL SELECT model, 'chat-evaluation-sft.md', 2, 'ARC-Challenge: ' || printf('%.4f', a2) FROM w
  UNION ALL SELECT model, 'chat-evaluation-sft.md', 3, 'MMLU: ' || printf('%.4f', a3) FROM w
  UNION ALL SELECT model, 'chat-evaluation-sft.md', 4, 'GSM8K: ' || printf('%.4f', a4) FROM w
  UNION ALL SELECT model, 'chat-evaluation-sft.md', 5, 'HumanEval: ' || printf('%.4f', a5) FROM w
  UNION ALL SELECT model, 'chat-evaluation-sft.md', 9, 'ChatCORE: ' || printf('%.4f', (a1 + a2 + a3 + a4 + a5) / 5 - 0.25) FROM w
  UNION ALL SELECT model, 'chat-evaluation-rl.md', 1, 'GSM8K: ' || printf('%.4f', a4 + 0.01) FROM w WHERE model % 2 = 0)"""

Q["report_summary"] = with_(SECTIONS) + """,
keys AS (SELECT * FROM (VALUES ('base-model-evaluation.md', 'base', 'CORE'), ('chat-evaluation-sft.md', 'sft', 'ARC-Easy'),
   ('chat-evaluation-sft.md', 'sft', 'ARC-Challenge'), ('chat-evaluation-sft.md', 'sft', 'MMLU'), ('chat-evaluation-sft.md', 'sft', 'GSM8K'),
   ('chat-evaluation-sft.md', 'sft', 'HumanEval'), ('chat-evaluation-sft.md', 'sft', 'ChatCORE'), ('chat-evaluation-rl.md', 'rl', 'GSM8K')) v(file, stage, metric)),
hits AS (SELECT s.run, k.stage, k.metric, arg_max(trim(split_part(s.line, ':', 2)), s.line_no) AS value
         FROM sections s JOIN keys k ON s.file = k.file AND trim(split_part(s.line, ':', 1)) = k.metric
         WHERE len(string_split(s.line, ':')) > 1 GROUP BY s.run, k.stage, k.metric)
SELECT run, metric, coalesce(max(value) FILTER (WHERE stage = 'base'), '-') AS base,
       coalesce(max(value) FILTER (WHERE stage = 'sft'), '-') AS sft, coalesce(max(value) FILTER (WHERE stage = 'rl'), '-') AS rl,
       CASE WHEN metric = 'CORE' THEN 0 WHEN metric = 'ChatCORE' THEN 2 ELSE 1 END AS metric_order
FROM hits GROUP BY run, metric"""

Q["run_duration"] = with_(SECTIONS) + """,
ord AS (SELECT * FROM (VALUES ('tokenizer-training.md', 1), ('tokenizer-evaluation.md', 2), ('base-model-training.md', 3),
   ('base-model-loss.md', 4), ('base-model-evaluation.md', 5), ('chat-sft.md', 6), ('chat-evaluation-sft.md', 7), ('chat-rl.md', 8),
   ('chat-evaluation-rl.md', 9)) v(file, fo)),
ts AS (SELECT run, file, line_no, try_strptime(trim(substr(line, instr(line, ':') + 1)), '%Y-%m-%d %H:%M:%S') AS t, line FROM sections),
st0 AS (SELECT run, arg_min(t, line_no) AS start FROM ts WHERE file = 'header.md' AND starts_with(line, 'Run started:') AND t IS NOT NULL GROUP BY run),
sec AS (SELECT ts.run, ord.fo, arg_min(CASE WHEN starts_with(line, 'timestamp:') THEN t END, CASE WHEN starts_with(line, 'timestamp:') AND t IS NOT NULL THEN line_no END) AS t
        FROM ts JOIN ord USING (file) WHERE NOT contains(ts.file, 'rl') GROUP BY ts.run, ord.fo),
en AS (SELECT sec.run, sec.t AS e FROM sec JOIN (SELECT run, max(fo) AS mf FROM sec GROUP BY run) m ON sec.run = m.run AND sec.fo = m.mf)
SELECT coalesce(st0.run, en.run) AS run,
       CASE WHEN start IS NOT NULL AND e IS NOT NULL THEN
         CAST(date_diff('second', start, e) // 3600 AS VARCHAR) || 'h' || CAST((date_diff('second', start, e) % 3600) // 60 AS VARCHAR) || 'm'
       ELSE 'unknown' END AS duration
FROM st0 FULL JOIN en USING (run)"""

# ------------------------------------------------------------------ 2.10 streaming

Q["stream_corpus"] = with_(DOC_BYTES) + """
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tokens, md5(array_to_string(ids, ',')) AS ids_md5, CAST(doc_id // 256 AS INTEGER) AS shard_id FROM doc_bytes"""

Q["stream_run_metrics"] = with_(STEPS) + """
SELECT run_id, step, round(0.1 * list_sum(list_transform(h, lambda e: pow(0.9, CAST(step - e.s AS DOUBLE)) * e.x))
                           / (1 - pow(0.9, CAST(step + 1 AS DOUBLE))), 6) AS smooth_loss, min_val_bpb,
       round(total, 6) AS total_training_time FROM (
  SELECT run_id, step, list({'s': step, 'x': loss}) OVER w350 AS h, min(val_bpb) OVER wall AS min_val_bpb,
         sum(CASE WHEN step > 10 THEN dt ELSE 0.0 END) OVER wall AS total
  FROM st WINDOW w350 AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 350 PRECEDING AND CURRENT ROW),
                 wall AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

Q["stream_run_metrics_late"] = Q["stream_run_metrics"]

# ------------------------------------------------------------------ 2.7 generators

from tessera.operators.synth import PROMPT_TEMPLATE, USER_MSG_TEMPLATES  # noqa: E402  (fixed values)


def sq(x: str) -> str:
    """SQL string literal (newlines as chr(10))."""
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SPELL_TEMPLATES = "[" + ", ".join(sq(t) for t in USER_MSG_TEMPLATES) + "]"
Q1 = "'" + "''" + "'"          # a one-quote string literal
NL = "chr(10)"

SPELL = f"""wl AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_idx FROM (
            SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> ''),
nw AS (SELECT count(*) AS n FROM wl),
ex AS (SELECT p_partkey AS idx, p_partkey AS s FROM part),
pw AS (SELECT ex.idx, ex.s, wl.word FROM ex CROSS JOIN nw JOIN wl ON wl.word_idx = {hk("'w'", 's')} % nw.n),
pl AS (SELECT idx, s, word, CASE WHEN {uk("'pl'", 's')} < 0.9 THEN substr(word, CAST({hk("'lw'", 's')} % length(word) + 1 AS INTEGER), 1)
                              ELSE substr('abcdefghijklmnopqrstuvwxyz', CAST({hk("'la'", 's')} % 26 + 1 AS INTEGER), 1) END AS letter FROM pw),
pc AS (SELECT *, CAST(length(word) - length(replace(word, letter, '')) AS INTEGER) AS count,
              CASE WHEN {uk("'lc'", 's')} < 0.3 THEN lower(tp) ELSE tp END AS tpl,
              ['', {Q1}, '"'][{hk("'lq'", 's')} % 3 + 1] AS lq, ['', {Q1}, '"'][{hk("'wq'", 's')} % 3 + 1] AS wq
       FROM (SELECT *, ({SPELL_TEMPLATES})[{hk("'t'", 's')} % 51 + 1] AS tp FROM pl)),
pm AS (SELECT *, replace(replace(tpl, '{{letter}}', lq || letter || lq), '{{word}}', wq || word || wq)
                 || CASE WHEN {uk("'qm'", 's')} < 0.5 THEN '?' ELSE '' END AS msg,
              array_to_string(list_transform(range(1, length(word) + 1), lambda i: CASE WHEN substr(word, i, 1) = letter
                 THEN i || ':' || substr(word, i, 1) || ' hit! count=' || (length(substr(word, 1, i)) - length(replace(substr(word, 1, i), letter, ''))) || {NL}
                 ELSE i || ':' || substr(word, i, 1) || {NL} END), '') AS steps
       FROM pc)"""

Q["gen_spelling_bee"] = with_(SPELL) + f"""
SELECT idx, word, letter, count, md5(msg) AS user_md5,
  md5('text:' || {sq("We are asked to find the number '")} || letter || {sq("' in the word '")} || word
      || {sq("'. Let me try a manual approach first.\n\nFirst spell the word out:\n")} || word || ':' || array_to_string(string_split(word, ''), ',')
      || {sq("\n\nThen count the occurrences of '")} || letter || {sq("':\n")} || steps || {sq("\nThis gives us ")} || count || '.'
      || '|text:' || {sq("\n\nLet me double check this using Python:\n\n")}
      || '|python:' || {Q1} || word || {sq("'.count('")} || letter || {sq("')")} || '|python_output:' || count
      || '|text:' || {sq("\n\nPython gives us ")} || count || {sq(".\n\nMy final answer is:\n\n#### ")} || count)
  AS assistant_md5 FROM pm"""

Q["gen_spelling"] = f"""
WITH wl AS (SELECT word, row_number() OVER (ORDER BY {hk("'42'", 'word')}, word) - 1 AS word_idx FROM (
            SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> ''),
nw AS (SELECT count(*) AS n FROM wl),
ex AS (SELECT p_partkey AS idx, p_partkey + 10000000 AS s FROM part)
SELECT ex.idx, wl.word, 'Spell the word: ' || wl.word AS user, wl.word || ':' || array_to_string(string_split(wl.word, ''), ',') AS assistant
FROM ex CROSS JOIN nw JOIN wl ON wl.word_idx = {hk("'sw'", 's')} % nw.n"""

Q["gen_prompts"] = f"""
WITH topics AS (SELECT r_name AS category, list(DISTINCT n_name ORDER BY n_name) AS ts FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name),
cats AS (SELECT list(category ORDER BY category) AS cs FROM topics),
pers AS (SELECT list(DISTINCT p ORDER BY p) AS ps FROM (SELECT c_mktsegment || ' buyer' AS p FROM customer)),
dyns AS (SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS ds FROM orders),
fm AS (SELECT p_type AS category, list(DISTINCT p_name ORDER BY p_name) AS ms FROM part GROUP BY p_type),
fmc AS (SELECT list(category ORDER BY category) AS fcs FROM fm),
base AS (
  SELECT o_orderkey AS idx, cs[{hk("'0'", 'o_orderkey', "'cat'")} % len(cs) + 1] AS category,
         ps[{hk("'0'", 'o_orderkey', "'persona'")} % len(ps) + 1] AS persona,
         ds[{hk("'0'", 'o_orderkey', "'dynamic'")} % len(ds) + 1] AS dynamic,
         list_transform(list_sort(list_transform(fcs, lambda c: {{'k': {hk("'0'", 'o_orderkey', "'fmc'", 'c')}, 'c': c}}))[1:3], lambda z: z.c) AS chosen
  FROM orders CROSS JOIN cats CROSS JOIN pers CROSS JOIN dyns CROSS JOIN fmc),
ex AS (SELECT b.idx, string_agg('- ' || fm.ms[{hk("'0'", 'b.idx', "'fmm'", 'b.c')} % len(fm.ms) + 1], chr(10) ORDER BY b.pos) AS examples
       FROM (SELECT idx, unnest(chosen) AS c, generate_subscripts(chosen, 1) AS pos FROM base) b JOIN fm ON fm.category = b.c GROUP BY b.idx),
fl AS (SELECT base.*, t.ts[{hk("'0'", 'base.idx', "'topic'")} % len(t.ts) + 1] AS topic, ex.examples
       FROM base JOIN topics t USING (category) JOIN ex USING (idx))
SELECT idx, category, topic, persona, dynamic, array_to_string(chosen, ',') AS example_categories,
       md5(replace(replace(replace(replace({sq(PROMPT_TEMPLATE)}, '{{topic}}', topic), '{{persona}}', persona), '{{dynamic}}', dynamic),
                   '{{first_message_examples}}', examples)) AS prompt_md5
FROM fl"""

Q["expand_existing"] = with_(CAPV) + """,
lines AS (SELECT image_id AS line_no, image_id % 10 AS kind, caption FROM firstcap),
j AS (SELECT l.line_no, l.kind, l.caption AS old, a.ann_id, a.caption FROM lines l
      LEFT JOIN ann a ON a.image_id = l.line_no AND l.kind NOT IN (3, 4))
SELECT line_no,
  CASE WHEN ann_id IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY line_no ORDER BY ann_id) - 1 AS INTEGER) END AS caption_idx,
  ann_id IS NOT NULL AS changed,
  CASE WHEN kind IN (3, 4) THEN NULL ELSE line_no END AS image_id,
  CAST(CASE WHEN kind = 0 AND ann_id IS NULL THEN NULL WHEN kind = 1 AND ann_id IS NULL THEN 1 WHEN kind = 3 THEN NULL ELSE 2 END AS INTEGER) AS n_messages,
  CASE WHEN kind = 0 AND ann_id IS NULL THEN NULL WHEN kind = 1 AND ann_id IS NULL THEN 'user' WHEN kind = 3 THEN NULL ELSE 'user,assistant' END AS roles,
  CASE WHEN kind = 0 AND ann_id IS NULL THEN NULL WHEN kind = 3 THEN NULL
       WHEN kind = 1 AND ann_id IS NULL THEN md5('Describe this image.')
       WHEN ann_id IS NULL THEN md5('Describe this image.|' || old)
       ELSE md5('Describe this image.|' || caption) END AS content_md5
FROM j"""

Q["read_eval_bundle"] = """
WITH t AS (SELECT * FROM (VALUES ('task_src0', 'multiple_choice', 'src0', 3, ' ', 25.0), ('task_src1', 'schema', 'src1', 0, ' ', 50.0),
                                 ('task_src2', 'language_modeling', 'src2', 1, chr(10), 0.0), ('task_src3', 'multiple_choice', 'src3', 2, ' ', 25.0))
           v(label, task_type, src, num_fewshot, continuation_delimiter, baseline)),
i AS (SELECT 'src' || (doc_id % 4) AS source, substr(text, 1, CAST(ceil(length(text) / 5) AS INTEGER)) AS txt FROM documents)
SELECT label, task_type, CAST(num_fewshot AS INTEGER) AS num_fewshot, continuation_delimiter, CAST(baseline AS DOUBLE) AS baseline,
       count(*) AS n_items, CAST(sum(('0x' || substr(md5(txt),1,8))::BIGINT) AS BIGINT) AS text_hash
FROM t JOIN i ON i.source = t.src GROUP BY ALL"""
