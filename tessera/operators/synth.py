"""Synthetic task data: spelling tasks and conversation-generation prompts.

Every random decision of the reference is one seeded hash of
``(seed, index, decision)``, so an example depends only on its index and
examples are generated in parallel from any index table. Word lists and
dimension tables are numbered once and joined by a hashed position; the fixed
template list is an array literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h, u
from ..functions.index import global_index

# Letters for the 10 % "any letter" draw.
LETTERS = "abcdefghijklmnopqrstuvwxyz"

# User message templates of the spelling-bee task.
USER_MSG_TEMPLATES = [
    "How many {letter} are in the word {word}",
    "How many {letter} are in {word}",
    "Count the number of {letter} in {word}",
    "How many times does {letter} appear in {word}",
    "What's the count of {letter} in {word}",
    "In the word {word}, how many {letter} are there",
    "How many letter {letter} are in the word {word}",
    "Count how many {letter} appear in {word}",
    "Tell me the number of {letter} in {word}",
    "How many occurrences of {letter} are in {word}",
    "Find the count of {letter} in {word}",
    "Can you count the {letter} letters in {word}",
    "What is the frequency of {letter} in {word}",
    "How many {letter}s are in {word}",
    "How many {letter}'s are in {word}",
    "Count all the {letter} in {word}",
    "How many times is {letter} in {word}",
    "Number of {letter} in {word}",
    "Total count of {letter} in {word}",
    "How many {letter} does {word} have",
    "How many {letter} does {word} contain",
    "What's the number of {letter} in {word}",
    "{word} has how many {letter}",
    "In {word}, count the {letter}",
    "How many {letter} appear in {word}",
    "Count the {letter} in {word}",
    "Give me the count of {letter} in {word}",
    "How many instances of {letter} in {word}",
    "Show me how many {letter} are in {word}",
    "Calculate the number of {letter} in {word}",
    "¿Cuántas {letter} hay en {word}?",
    "¿Cuántas veces aparece {letter} en {word}?",
    "Cuenta las {letter} en {word}",
    "¿Cuántas letras {letter} tiene {word}?",
    "{word}中有多少个{letter}",
    "{word}里有几个{letter}",
    "数一下{word}中的{letter}",
    "{word}这个词里有多少{letter}",
    "{word}에 {letter}가 몇 개 있나요",
    "{word}에서 {letter}의 개수는",
    "{word}에 {letter}가 몇 번 나오나요",
    "{word}라는 단어에 {letter}가 몇 개",
    "Combien de {letter} dans {word}",
    "Combien de fois {letter} apparaît dans {word}",
    "Compte les {letter} dans {word}",
    "Wie viele {letter} sind in {word}",
    "Wie oft kommt {letter} in {word} vor",
    "Zähle die {letter} in {word}",
    "{word}に{letter}は何個ありますか",
    "{word}の中に{letter}がいくつ",
    "{word}に{letter}が何回出てくる",
]

QUOTES = ["", "'", '"']
TEST_SEED_OFFSET = 10_000_000


def number_words(words: DataFrame, col: str = "word", seed: int | None = None) -> DataFrame:
    """(word_idx, word): dense positions in word order, or in a seeded
    shuffle (a different order, as the simple spelling task uses). The word
    list is a bounded dictionary, numbered by one ordered window."""
    w = words.select(F.col(col).alias("word")).distinct()
    key = [F.col("word")] if seed is None else [h(seed, "word"), F.col("word")]
    return w.withColumn("word_idx", (F.row_number().over(Window.orderBy(*key)) - 1).cast("bigint"))


def _pick_word(idx: DataFrame, words: DataFrame, n_words: int, seed_col: Column, tag: str) -> DataFrame:
    pos = F.pmod(h(tag, seed_col), F.lit(n_words))
    return idx.withColumn("word_idx", pos).join(words, "word_idx")


def gen_spelling_bee(words: DataFrame, indices: DataFrame, split: str = "train", idx: str = "idx") -> DataFrame:
    """One letter-counting conversation per index: word, letter (90 % from
    the word, 10 % any letter), one of the templates, 30 % lower case,
    optional quotes, 50 % question mark; the answer spells the word with a
    running count, calls the tool and ends with ``#### n``."""
    assert split in ("train", "test")
    nw = number_words(words)
    n_words = nw.count()
    seed = F.col(idx) + (TEST_SEED_OFFSET if split == "test" else 0)
    d = _pick_word(indices.select(idx).withColumn("_seed", seed), nw, n_words, F.col("_seed"), "w")
    s = F.col("_seed")
    word = F.col("word")
    from_word = u("pl", s) < 0.9
    letter = F.when(from_word, F.substring(word, (F.pmod(h("lw", s), F.length(word)) + 1).cast("int"), 1)).otherwise(
        F.substring(F.lit(LETTERS), (F.pmod(h("la", s), F.lit(26)) + 1).cast("int"), 1))
    d = d.withColumn("letter", letter)
    L = F.col("letter")
    count = F.size(F.filter(F.split(word, ""), lambda c: c == L))
    tpl = F.element_at(F.array(*[F.lit(t) for t in USER_MSG_TEMPLATES]),
                       (F.pmod(h("t", s), F.lit(len(USER_MSG_TEMPLATES))) + 1).cast("int"))
    tpl = F.when(u("lc", s) < 0.3, F.lower(tpl)).otherwise(tpl)
    qs = F.array(*[F.lit(q) for q in QUOTES])
    lq = F.element_at(qs, (F.pmod(h("lq", s), F.lit(3)) + 1).cast("int"))
    wq = F.element_at(qs, (F.pmod(h("wq", s), F.lit(3)) + 1).cast("int"))
    msg = F.replace(F.replace(tpl, F.lit("{letter}"), F.concat(lq, L, lq)), F.lit("{word}"), F.concat(wq, word, wq))
    msg = F.when(u("qm", s) < 0.5, F.concat(msg, F.lit("?"))).otherwise(msg)
    chars = F.split(word, "")
    steps = F.transform(chars, lambda c, i: F.when(
        c == L, F.concat((i + 1).cast("string"), F.lit(":"), c, F.lit(" hit! count="),
                         F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == L)).cast("string"), F.lit("\n"))
    ).otherwise(F.concat((i + 1).cast("string"), F.lit(":"), c, F.lit("\n"))))
    # The assistant's wording, here and in ``steps`` and ``parts``.
    manual = F.concat(
        F.lit("We are asked to find the number '"), L, F.lit("' in the word '"), word,
        F.lit("'. Let me try a manual approach first.\n\nFirst spell the word out:\n"), word, F.lit(":"),
        F.array_join(chars, ","), F.lit("\n\nThen count the occurrences of '"), L, F.lit("':\n"),
        F.array_join(steps, ""), F.lit("\nThis gives us "), count.cast("string"), F.lit("."))
    part = lambda t, x: F.struct(F.lit(t).alias("type"), x.alias("text"))
    parts = F.array(part("text", manual), part("text", F.lit("\n\nLet me double check this using Python:\n\n")),
                    part("python", F.concat(F.lit("'"), word, F.lit("'.count('"), L, F.lit("')"))),
                    part("python_output", count.cast("string")),
                    part("text", F.concat(F.lit("\n\nPython gives us "), count.cast("string"),
                                          F.lit(".\n\nMy final answer is:\n\n#### "), count.cast("string"))))
    msgs = F.array(
        F.struct(F.lit("user").alias("role"), msg.alias("content"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("parts")),
        F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"), parts.alias("parts")))
    return d.select(idx, "word", "letter", count.alias("count"), msgs.alias("messages"))


def gen_spelling(words: DataFrame, indices: DataFrame, split: str = "train", idx: str = "idx",
                 shuffle_seed: int = 42) -> DataFrame:
    """``Spell the word: w`` → ``w:w,o,r,d`` over a differently ordered word list."""
    nw = number_words(words, seed=shuffle_seed)
    n_words = nw.count()
    seed = F.col(idx) + (TEST_SEED_OFFSET if split == "test" else 0)
    d = _pick_word(indices.select(idx).withColumn("_seed", seed), nw, n_words, F.col("_seed"), "sw")
    w = F.col("word")
    return d.select(idx, "word", F.concat(F.lit("Spell the word: "), w).alias("user"),
                    F.concat(w, F.lit(":"), F.array_join(F.split(w, ""), ",")).alias("assistant"))


# Fixed value: the prompt of the synthetic-data generator.
PROMPT_TEMPLATE = ("Write a conversation about: {topic}\nThe user is: {persona}\nThe conversation is: {dynamic}\n"
                   "Example first messages:\n{first_message_examples}")


def _numbered(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Distinct rows of a dimension with ``_at``, their place (in order) within ``by``."""
    return global_index(df.select(*cols).distinct(), [c for c in cols if c not in by], by=by, idx="_at")


def _draw(d: DataFrame, values: DataFrame, size, *tags) -> DataFrame:
    """Join each row with the value at the place that its hash draws."""
    by = [c for c in d.columns if c in values.columns]
    return d.withColumn("_at", F.pmod(h(*tags), size)).join(values, [*by, "_at"]).drop("_at")


def gen_prompts(indices: DataFrame, topics: DataFrame, personas: DataFrame, dynamics: DataFrame,
                first_messages: DataFrame, seed: int = 0, idx: str = "idx", n_categories: int = 3) -> DataFrame:
    """Per index: a topic category then a topic in it, a persona, a dynamic,
    ``n_categories`` distinct first-message categories (the smallest hashes)
    with one example each, and the prompt text.

    Values of a dimension are numbered and joined by category and position, so
    dimension tables may have any size. Only the list of first-message
    categories goes to all rows, as one broadcast row.
    """
    i = F.col(idx)
    cats, per, dyn = (_numbered(t, [c], []) for t, c in ((topics, "category"), (personas, "persona"), (dynamics, "dynamic")))
    tops = _numbered(topics, ["category", "topic"], ["category"])
    d = _draw(indices.select(idx), cats, F.lit(cats.count()), seed, i, F.lit("cat"))
    d = d.join(tops.groupBy("category").agg(F.count(F.lit(1)).alias("_n")), "category")
    d = _draw(d, tops, F.col("_n"), seed, i, F.lit("topic")).drop("_n")
    d = _draw(d, per, F.lit(per.count()), seed, i, F.lit("persona"))
    d = _draw(d, dyn, F.lit(dyn.count()), seed, i, F.lit("dynamic"))
    # examples: the categories with the smallest hashes, one message of each
    msgs = _numbered(first_messages, ["category", "message"], ["category"]).withColumnRenamed("category", "fmc")
    sizes = msgs.groupBy("fmc").agg(F.count(F.lit(1)).alias("_n"))
    all_cats = sizes.agg(F.array_sort(F.collect_list("fmc")).alias("_cats")).withColumn("_k", F.lit(1))
    ranked = F.array_sort(F.transform("_cats", lambda c: F.struct(h(seed, i, F.lit("fmc"), c).alias("k"), c.alias("c"))))
    e = (indices.select(idx).withColumn("_k", F.lit(1)).join(F.broadcast(all_cats), "_k")
         .select(idx, F.posexplode(F.slice(ranked, 1, n_categories)).alias("_o", "_c")).select(idx, "_o", F.col("_c.c").alias("fmc")))
    e = _draw(e.join(sizes, "fmc"), msgs, F.col("_n"), seed, i, F.lit("fmm"), F.col("fmc")).drop("_n")
    g = e.groupBy(idx).agg(F.array_sort(F.collect_list(F.struct("_o", "fmc", "message"))).alias("_e"))
    g = g.select(idx, F.transform("_e", lambda x: x["fmc"]).alias("example_categories"),
                 F.array_join(F.transform("_e", lambda x: F.concat(F.lit("- "), x["message"])), "\n").alias("first_message_examples"))
    d = d.join(g, idx)
    prompt = F.lit(PROMPT_TEMPLATE)
    for k in ("topic", "persona", "dynamic", "first_message_examples"):
        prompt = F.replace(prompt, F.lit("{" + k + "}"), F.col(k))
    return d.withColumn("prompt", prompt)
