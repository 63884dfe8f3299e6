import re

import pytest

from hostlens.llm import decontaminate as dc

W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(W, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=10):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in wins}:
                x = tuple(w[k : k + n])
                if len(x) == n and x in wins:
                    hit |= set(range(k, k + n))
                    found |= {i for i in wins[x] if i is not None}
        out.append((doc_id, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=str)


A = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, A), (2, "Short item HERE"), (3, A.upper() + " thirteen"), (None, "null id item text"), (4, None), (5, "!!! ..."), (6, "solo"), (2, "x y z w v u t s r q p"), (7, "a a a a a a a a a a a"), (8, "É é two-part W0RD, five six seven eight nine ten zz")]
DOCS = [
    (1, f"start {A} end"), (2, f"{A} {A}"), (3, A.replace("six", "6")), (4, "a short, item here and SHORT-ITEM-HERE"), (5, None), (6, ""), (7, "null id item text"), (8, "solo solo"), (9, "a " * 30),
    (1, f"start {A} end"), (1, f"start {A} end"), (None, A), (None, None), (10, "one two three four five six seven eight nine"), (11, "É é two part w0rd five six seven eight nine ten"), (12, "é é two part w0rd five six seven eight nine ten"),
    (13, "short item"), (14, "word " * 20000 + A),
]


@pytest.mark.parametrize("block", [400_000, 30])
def test_against_brute_force(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = []
    for r in dc.contamination(docs, items, block_words=block).collect():
        got += [(r.doc_id, r.n_words, r.n_hit, list(r.item_ids))] * r.copies
    assert sorted(got, key=str) == brute(DOCS, ITEMS)


def test_clean_keeps_columns_and_clean_rows(spark, edge, nothing, edge_rows):
    bad = edge_rows[0][1]
    items = spark.createDataFrame([(1, " ".join(bad.split()[5:40]))], "item_id long, text string")
    out = dc.clean(edge, items)
    assert out.columns == edge.columns
    # The passage is in four rows: two ids' copies, the repeated row and the copy in other case.
    assert out.count() == len(edge_rows) - 4
    assert dc.clean(nothing, items).count() == 0
    assert dc.clean(edge, items.limit(0)).count() == len(edge_rows)


def test_a_long_run_between_words_costs_little(spark):
    import time

    run = " -" * (1 << 19)
    rows = [(1, f"{run}a b c d e f g h i j{run}"), (2, run), (3, f"x{run}y"), (4, "é" + "=" * (1 << 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    dc.contamination(docs.limit(1), items).collect()  # plans and code
    start = time.perf_counter()
    got = {r.doc_id: (r.n_words, r.n_hit) for r in dc.contamination(docs, items).collect()}
    assert got == {1: (10, 10), 2: (0, 0), 3: (2, 0), 4: (1, 0)}
    assert time.perf_counter() - start < 20


def test_a_window_that_many_items_share(spark):
    items = spark.createDataFrame([(k, "one two three") for k in range(3000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three"), (2, "one two")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in dc.contamination(docs, items).collect()}
    assert got == {1: (3, 3000), 2: (0, 0)}
