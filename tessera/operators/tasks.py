"""Task and synthetic-data builders: string work as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MSG_PARTS_T = "array<struct<type:string,text:string>>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def render_mc(question, letters, choices) -> Column:
    """``Multiple Choice question: q`` + ``- choice=letter`` lines + instruction
    (no space before the letter)."""
    # The wording of a multiple-choice question.
    lines = F.zip_with(_c(choices), _c(letters),
                       lambda c, l: F.concat(F.lit("- "), c, F.lit("="), l, F.lit("\n")))
    return F.concat(F.lit("Multiple Choice question: "), _c(question), F.lit("\n"), F.array_join(lines, ""),
                    F.lit("\nRespond only with the letter of the correct answer."))


def _mc_conv(user: Column, answer: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), user.alias("content")),
                   F.struct(F.lit("assistant").alias("role"), answer.alias("content")))


def build_arc(df: DataFrame) -> DataFrame:
    """Rows (question, choices, labels, answer_key): letters come from the
    row; the answer must be one of them (``valid``)."""
    ok = F.array_contains("labels", F.col("answer_key"))
    return df.select("*", ok.alias("valid"),
                     _mc_conv(render_mc("question", "labels", "choices"), F.col("answer_key")).alias("messages"),
                     F.col("labels").alias("letters"))


LETTERS = ["A", "B", "C", "D"]


def build_mmlu(df: DataFrame) -> DataFrame:
    """Exactly four choices; answer index → A–D; the subject is kept."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    ok = (F.size("choices") == 4) & F.col("answer").between(0, 3)
    return df.select("*", ok.alias("valid"), letters.alias("letters"),
                     _mc_conv(render_mc("question", letters, "choices"), F.get(letters, F.col("answer"))).alias("messages"))


def parse_gsm8k(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Assistant parts from a worked answer: text between ``<<…>>`` tags is
    kept (also when empty); each tag becomes a python part (up to the last
    ``=``) and a python_output part (after it, or empty)."""
    a = F.col(answer)
    # columns of their own: inside the function below they would be matched again for each part
    d = df.withColumn("_texts", F.split(a, r"<<[^>]+>>", -1)).withColumn("_tags", F.regexp_extract_all(a, F.lit(r"<<([^>]+)>>"), 1))
    texts, tags = F.col("_texts"), F.col("_tags")
    n = F.size(tags)

    def one(i):
        txt = F.array(F.struct(F.lit("text").alias("type"), F.get(texts, i).alias("text")))
        tag = F.get(tags, i)
        has_eq = F.instr(tag, "=") > 0
        expr = F.when(has_eq, F.regexp_extract(tag, r"^(.*)=", 1)).otherwise(tag)
        res = F.when(has_eq, F.substring_index(tag, "=", -1)).otherwise(F.lit(""))
        call = F.array(F.struct(F.lit("python").alias("type"), expr.alias("text")),
                       F.struct(F.lit("python_output").alias("type"), res.alias("text")))
        return F.when(i < n, F.concat(txt, call)).otherwise(txt)

    parts = F.flatten(F.transform(F.sequence(F.lit(0), n), one))
    return d.withColumn("parts", parts).drop("_texts", "_tags")


def gsm_conversations(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    p = parse_gsm8k(df, answer)
    msgs = F.array(
        F.struct(F.lit("user").alias("role"), F.col(question).alias("content"),
                 F.lit(None).cast(MSG_PARTS_T).alias("parts")),
        F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"),
                 F.col("parts").alias("parts")))
    return p.withColumn("messages", msgs)


# ------------------------------------------------------------------ code tasks

# Fixed value: a fenced code block.
FENCE_RE = r"(?s)```(?:python)?\s*\n(.*?)\n```"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def extract_code(col) -> Column:
    """First fenced block (stripped), else the whole text stripped."""
    c = _c(col)
    return F.when(c.rlike(FENCE_RE), _strip(F.regexp_extract(c, FENCE_RE, 1))).otherwise(_strip(c))


def extract_imports(col) -> Column:
    """Leading import lines; stop at the first other non-blank, non-comment line."""
    lines = F.transform(F.split(_c(col), "\n", -1), _strip)
    is_imp = lambda s: s.startswith("import ") | s.startswith("from ")
    stop = F.array_position(F.transform(lines, lambda s: ~is_imp(s) & (s != "") & ~s.startswith("#")), True)
    head = F.when(stop > 0, F.slice(lines, 1, stop - 1)).otherwise(lines)
    return F.array_join(F.filter(head, is_imp), "\n")


def build_humaneval(df: DataFrame) -> DataFrame:
    """user = prompt, assistant = prompt + newline + solution; entry point and
    tests kept."""
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
                   F.struct(F.lit("assistant").alias("role"),
                            F.concat(F.col("prompt"), F.lit("\n"), F.col("solution")).alias("content")))
    return df.withColumn("messages", msgs)


def assemble_programs(df: DataFrame, prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """imports + code + tests + ``check(entry_point)``: the program table.
    Running the programs is outside this library."""
    prog = F.concat(extract_imports(prompt), F.lit("\n\n"), extract_code(completion), F.lit("\n\n"),
                    F.col("test"), F.lit("\n"), F.lit("check("), F.col("entry_point"), F.lit(")"))
    return df.withColumn("program", prog)


# ------------------------------------------------------------------ tool calls

ARITH_CHARS = r"^[0-9*+\-/.() ]*$"
STRING_CHARS = r"""^[a-zA-Z0-9'"()._ ]*$"""
# Substrings that reject a string expression.
DANGEROUS = ["__", "import", "exec", "eval", "compile", "open", "file",
             "input", "raw_input", "globals", "locals", "vars", "dir",
             "getattr", "setattr", "delattr", "hasattr"]
BIN_RE = r"^\s*(-?[0-9.]+)\s*([*+/-])\s*(-?[0-9.]+)\s*$"
COUNT_RE = r"""^\s*(['"])(.*)\1\.count\((['"])(.*)\3\)\s*$"""


def check_tool_calls(df: DataFrame, expr: str = "expr") -> DataFrame:
    """Classify calculator calls as the tool would (commas removed): an
    arithmetic charset without ``**``, or a string charset without banned
    words that contains ``.count(``. ``value`` recomputes ``a op b`` and
    ``'word'.count('x')``; anything else that passes is left null."""
    e = F.regexp_replace(F.col(expr), ",", "")
    low = F.lower(e)
    danger = F.lit(False)
    for d in DANGEROUS:
        danger = danger | (F.instr(low, d) > 0)
    kind = (F.when(e.rlike(ARITH_CHARS), F.when(F.instr(e, "**") > 0, F.lit("rejected_power")).otherwise(F.lit("arith")))
             .when(~e.rlike(STRING_CHARS), F.lit("rejected_charset"))
             .when(danger, F.lit("rejected_pattern"))
             .when(F.instr(e, ".count(") == 0, F.lit("rejected_method"))
             .otherwise(F.lit("count")))
    a = F.regexp_extract(e, BIN_RE, 1).try_cast("double")
    op = F.regexp_extract(e, BIN_RE, 2)
    b = F.regexp_extract(e, BIN_RE, 3).try_cast("double")
    arith = (F.when(op == "*", a * b).when(op == "+", a + b).when(op == "-", a - b)
              .when((op == "/") & (b != 0), a / b))
    w = F.regexp_extract(e, COUNT_RE, 2)
    c = F.regexp_extract(e, COUNT_RE, 4)
    cnt = F.when(e.rlike(COUNT_RE) & (F.length(c) > 0),
                 ((F.length(w) - F.length(F.replace(w, c, F.lit("")))) / F.length(c)).cast("double"))
    value = F.when(kind == "arith", arith).when(kind == "count", cnt)
    return df.withColumn("kind", kind).withColumn("value", F.round(value, 6))
