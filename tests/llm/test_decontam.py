import random

from tessera.llm.decontam import Matcher, matches, myers, normal


def distance_to_substring(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(turn, text, k):
    for _ in range(k):
        i = turn.randrange(1, len(text) - 1)
        text = turn.choice([text[:i] + text[i + 1 :], text[:i] + turn.choice("abcé ") + text[i:], text[:i] + "x" + text[i + 1 :]])
    return text


def test_myers_against_the_table():
    turn = random.Random(4)
    for _ in range(300):
        p, t = ("".join(turn.choices("abé ", k=turn.randint(1, n))) for n in (80, 120))
        masks = {}
        for i, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << i
        assert myers(masks, len(p), t) == distance_to_substring(p, t)


def items(turn, n):
    return [" ".join("".join(turn.choices("abcdefgé", k=turn.randint(2, 7))) for _ in range(turn.randint(6, 30))) for _ in range(n)]


def test_no_match_within_the_budget_is_missed():
    turn = random.Random(6)
    own = sorted({normal(x) for x in items(turn, 12) if len(x) >= 24})
    m = Matcher(own)
    for _ in range(150):
        j = turn.randrange(len(own))
        k = m.budget[j]
        text = normal(" ".join(items(turn, 2)) + " " + edited(turn, own[j], turn.randint(0, k + 2)) + " " + items(turn, 1)[0])
        assert m.find(text) == {i: d for i, x in enumerate(own) if (d := distance_to_substring(x, text)) <= int(0.05 * len(x))}


def test_rows_against_brute_force(spark, make):
    turn = random.Random(8)
    bench = [(i, x) for i, x in enumerate(items(turn, 10))] + [(20, None), (21, ""), (22, "too short"), (None, "an item that has no id but a text"), (3, "another text of the same item id")]
    texts = [b or "" for _, b in bench]
    docs = [(i, " ".join(items(turn, 2)) + "\n" + edited(turn, texts[i % 10], i % 4).upper().replace(" ", " \t") + " " + items(turn, 1)[0]) for i in range(30)]
    docs += [(50, None), (51, ""), (None, texts[13]), (52, texts[14] + " " + texts[3]), (4, docs[4][1]), (53, "long word " * 20000 + texts[5])]
    b = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as distance")
    want = {}
    for d, t in docs:
        for i, x in bench:
            if len(x or "") >= 24 and len(t or "") < 5000 and (e := distance_to_substring(normal(x), normal(t))) <= int(0.05 * len(normal(x))):
                want[d, i] = min(e, want.get((d, i), 99))
    want[53, 5] = 0
    for block in (1 << 20, 300):
        got = matches(make(docs), b, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id): r.distance for r in got} == want and len(got) == len(want)


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert matches(make([(1, "a text")]), none).count() == 0 and matches(make([]), none).count() == 0


def test_short_items_match_whole_at_word_bounds(spark, make):
    b = spark.createDataFrame([(1, "What is 12 times 12?"), (2, "pi"), (3, "  "), (4, "?!")], "item_id long, text string")
    docs = [(1, "Q: what is 12\ttimes 12? A: 144"), (2, "a spiral"), (3, "is PI, here"), (4, "wow?!"), (5, "what is 12 times 1 2?"), (6, None)]
    assert {(r.doc_id, r.item_id, r.distance) for r in matches(make(docs), b).collect()} == {(1, 1, 0), (3, 2, 0), (4, 4, 0)}
