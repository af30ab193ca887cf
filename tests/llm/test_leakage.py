import random

from quillspark.llm.leakage import Finder, leaks, letters, myers, report


def distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        row = [i]
        for j, b in enumerate(t, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (a != b)))
        prev = row
    return min(prev)


def test_myers_against_table():
    r = random.Random(1)
    for _ in range(400):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 90)))
        assert myers(p, t) == distance(p, t)


def test_letters():
    assert letters("Á-b\n１ ﬁ²!") == "ab1fi2"
    assert letters("A_b 1!") == "ab1" and letters("...") == ""


def longest(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else 0)
        best, prev = max(best, *row), row
    return best


def test_finder_against_brute_force():
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    items = [(i, word(r.randint(5, 200))) for i in range(12)] + [(90, "ab" * 60), (91, "ab" * 45 + word(30))]
    find, n_cases = Finder(items, 70, 1), 0
    for _ in range(150):
        doc = word(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            t = r.choice(items)[1]
            a = r.randint(0, len(t))
            doc += t[a : a + r.choice([50, 69, 70, 71, 120])] + word(r.randint(0, 3))
        got = {i for i, n, *_ in find(doc) if n >= 70}
        want = {i for i, t in items if longest(doc, t) >= 70}
        n_cases += len(want)
        assert got == want
    assert n_cases > 50


def test_leaks_and_edges(spark):
    passage = "The quick brown fox " * 5
    docs = spark.createDataFrame(
        [(1, "x " + passage.upper().replace(" ", "\n") + " y", "a", 1), (1, passage, "a", 1), (2, passage[:60], "b", 1), (3, None, "c", 1), (4, "", "c", 1), (5, "z" * 200000 + passage, "c", 1)],
        "doc_id long, text string, item_id string, run int",
    )
    items = spark.createDataFrame([(7, passage, 1), (7, passage, 1), (8, "short", 1), (9, None, 1), (10, "", 1)], "item_id int, text string, doc_id int")
    got = sorted((r.item_id, r.doc_id) for r in leaks(docs, items, "doc_id", "text", "item_id", "text").where("run >= 70").collect())
    assert got == [(7, 1), (7, 5)]
    assert leaks(docs.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0
    assert leaks(docs, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    from quillspark.llm import leakage

    texts = [f"item number {i} " * 9 for i in range(9)]
    docs = spark.createDataFrame([(i, texts[i] + texts[(i + 1) % 9]) for i in range(9)], "d long, t string")
    items = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    one = {tuple(r) for r in leaks(docs, items, "d", "t", "i", "t").collect()}
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 300)
    assert {tuple(r) for r in leaks(docs, items, "d", "t", "i", "t").collect()} == one and len(one) >= 18


def changed(r, t, edits):
    for _ in range(edits):
        k = r.randrange(5, len(t) - 5)
        t = r.choice([t[:k] + "z" + t[k + 1 :], t[:k] + t[k + 1 :], t[:k] + "z" + t[k:]])
    return t


def test_near_passages_against_brute_force():
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    items = [(i, word(r.randint(40, 160))) for i in range(8)]
    for budget in (1, 2):
        find, n_cases, missed = Finder(items, 70, budget), 0, 0
        for k in range(120):
            i, t = r.choice(items)
            w = min(70, len(t))
            a = r.randint(0, len(t) - w)
            doc = word(r.randint(0, 30)) + changed(r, t[a : a + w + r.randint(0, 8)], k % (budget + 3)) + word(20)
            want = {j for j, x in items if min(distance(x[b : b + min(70, len(x))], doc) for b in range(len(x) - min(70, len(x)) + 1)) <= budget}
            got = {j: d for j, _, _, d in find(doc)}
            assert set(got) <= want and all(d <= budget for d in got.values())
            n_cases += len(want)
            missed += len(want - set(got))
        assert n_cases > 40 and missed == 0, (n_cases, missed)


def test_one_letter_changed_in_the_middle(spark):
    passage = letters("The harbour master shall keep a register of all vessels, and every owner of a vessel shall file a return with the office before the end of the year, stating the cargo.")[:139]
    near = passage[:69] + "q" + passage[70:]
    docs = spark.createDataFrame([(1, "x " + near + " y"), (2, passage), (3, near[:60])], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (8, "too short"), (9, None)], "item_id long, text string")
    found = leaks(docs, items, "doc_id", "text", "item_id", "text")
    assert sorted(tuple(r) for r in found.collect()) == [(7, 1, 69, len(passage), 1), (7, 2, len(passage), len(passage), 0)]
    rows = {r.item_id: r for r in report(found, items, "item_id", "text").collect()}
    assert (rows[7].documents, rows[7].near_documents, rows[7].searched) == (1, 1, True)
    assert (rows[8].documents, rows[8].searched, rows[9].letters, rows[9].searched) == (0, False, 0, False)
