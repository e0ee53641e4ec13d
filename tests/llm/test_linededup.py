from collections import defaultdict


from tessera.llm.common import scratch
from tessera.llm.linededup import LineIndex, dedup_documents, dedup_lines

A, B, C = "A line of twenty chars", "another shared line here", "  \tANOTHER shared line HERE\r"
PAIRS = [(1, f"{A}\nown one\n{B}"), (2, f"{C}\n{A}\n{A}"), (3, f"{A}\nshort\nshort"), (4, B), (5, "short"), (6, ""), (7, None), (None, f"{A}\nx"), (8, "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ"), (9, "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ"), (10, "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ!!!"), (4, B), (11, f"{'long ' * 30000}\n{A}")]
UP = {i: i + 32 for i in range(65, 91)}


def brute(pairs, gone=()):
    low = -(1 << 62)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    held = defaultdict(set)
    for i, t in pairs:
        if i not in gone:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 20:
                    held[key(x)].add(low if i is None else i)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and (low if i is None else i) in held[key(x)] and (low if i is None else i) != max(held[key(x)]))]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


def test_lines_against_brute_force(make):
    assert rows(dedup_lines(make(PAIRS))) == brute(PAIRS)


def test_empty_table(make):
    assert rows(dedup_lines(make([]))) == []
    assert dedup_documents(make([])).count() == 0


def test_insertions_in_batches_and_deletions_give_the_exact_table(spark, make):
    index = LineIndex(spark, scratch(spark, "test"), shards=3)
    index.insert(make(PAIRS[:4]))
    index.insert(make(PAIRS[2:]))
    whole = LineIndex(spark, scratch(spark, "test"), shards=3)
    whole.insert(make(PAIRS))
    table = lambda x: sorted((bytes(r.key), r.n_docs, r.max_doc) for r in x.counts().collect())
    assert table(index) == table(whole) and len(table(index)) >= 4
    index.delete(make([(3, None), (11, None), (99, None)]))
    index.delete(make([(10, None)]))
    rest = [p for p in PAIRS if p[0] not in (3, 10, 11)]
    fresh = LineIndex(spark, scratch(spark, "test"), shards=3)
    fresh.insert(make(rest))
    assert table(index) == table(fresh)
    live = index.refs().select("key").distinct()
    gone = whole.refs().select("key").distinct().subtract(live)
    assert index.maybe_live(live).filter("not maybe").count() == 0
    assert gone.count() and index.maybe_live(gone).filter("maybe").count() == 0
    index.insert(make([p for p in PAIRS if p[0] in (3, 10, 11)]))
    assert table(index) == table(whole)


def test_documents_keep_their_columns(make):
    docs = make(PAIRS)
    got = {(r.doc_id, r.text, r.n_chars, r.key) for r in dedup_documents(docs).collect()}
    assert dedup_documents(docs).columns == docs.columns
    assert (7, None, 0, 7) in got and (6, "", 0, 7) in got and (1, "own one\nanother shared line here", 32, 7) not in got
    assert (3, "short\nshort", 11, 7) in got and not any(i == 2 for i, *_ in got)


def test_few_keys_reach_the_join(spark, make):
    from tessera.llm.linededup import indexed
    pairs = [(i, f"only document {i} holds this line\n{'shared by many documents' if i % 3 else 'nothing'}\n{A if i < 2 else ''}") for i in range(300)]
    index = indexed(make(pairs))
    met = {bytes(r.key) for r in index.met_again().collect()}
    held = {bytes(r.key): r.n_docs for r in index.counts().collect()}
    assert len(held) == 302 and {k for k, n in held.items() if n > 1} <= met and len(met) < 20
    assert index.generation == 3 and rows(dedup_lines(make(pairs))) == brute(pairs)
