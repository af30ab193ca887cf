import random

from pyspark.sql import functions as F

from quillspark.operators import aggregates, changes, checks, joins, ranking, retrieval, segments


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_select_cells_against_a_loop(spark):
    r = random.Random(3)
    data = [(c, i, r.choice([None, round(r.random(), 2)])) for c in "abcdef" for i in range(r.randint(1, 12))]
    got = rows(ranking.select_cells(spark.createDataFrame(data, "cell string, k long, score double"), ["cell"], "score", "k", F.lit(0.6), F.lit(3), F.lit(5)), "cell", "k", "band", "bound")
    want = []
    for c in "abcdef":
        cell = sorted((x for x in data if x[0] == c), key=lambda x: (x[2] is None, -(x[2] or 0), x[1]))
        taken = []
        for _, k, s in cell:
            if len(taken) < 5 and (s is not None and s >= 0.6 or len(taken) < 3):
                taken.append((k, "direct" if s is not None and s >= 0.65 else "gray"))
        t = sum(s is not None and s >= 0.6 for _, _, s in cell)
        n = len(taken)
        bound = "max" if len(cell) > n and n == 5 else ("exhausted" if len(cell) < 3 else "min") if t < 3 else "theta"
        want += [(c, k, b, bound) for k, b in taken]
    assert got == sorted(want)


def test_select_cells_with_sparse_top_up(spark):
    dense = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.7), ("a", 3, 0.1), (None, 5, 0.9)], "cell string, k long, score double")
    sparse = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("a", 9, 3), ("b", 7, 1), ("b", 7, 2), (None, 5, 1), (None, 6, 2)], "cell string, k long, rank int")
    args = (dense, ["cell"], "score", "k", F.lit(0.6), F.lit(1), F.lit(2))
    got = {tuple(r) for r in ranking.select_cells(*args, sparse=sparse, topup=F.lit(2)).select("cell", "k", "rank", "band", "bound").collect()}
    assert got == {("a", 1, 1, "direct", "max"), ("a", 2, 2, "direct", "max"), ("a", 3, 3, "gray", "max"), ("b", 7, 1, "gray", "exhausted"), (None, 5, 1, "direct", "theta"), (None, 6, 2, "gray", "theta")}
    assert ranking.select_cells(*args, sparse=sparse).count() == ranking.select_cells(*args).count() == 3


def test_latest_first_and_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "clear"), (None, 5, "n")], "k string, t int, v string")
    assert sorted((r.k or "", r.v) for r in ranking.latest(df, ["k"], ["t"], F.col("v") == "clear").collect()) == [("", "n"), ("a", "z")]
    assert sorted((r.k or "", r.v) for r in ranking.first_wins(df, ["k"], ["t"]).collect()) == [("", "n"), ("a", "x"), ("b", "clear")]


def test_widest_run(spark):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate([1, 2, 1, 2, 3, 9, 1, 2, 3, 4])], "doc string, at long, n long")
    assert rows(ranking.widest_run(df, ["doc"], "at", "n")) == [("d", 1, 2, 5, 4)]


def test_chunks_and_packing(spark):
    df = spark.createDataFrame([(1, "x" * 1300), (2, "y" * 50), (3, ""), (4, None), (5, "z" * 1200)], "id int, t string")
    assert rows(ranking.chunks(df, "t"), "id", "chunk", "start", F.length("body")) == [(1, 0, 0, 1200), (1, 1, 1050, 250), (5, 0, 0, 1200)]
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([3, 3, 5, 9, 1, 1, 1])], "g string, o int, s long")
    assert [b for *_, b in rows(ranking.bin_pack(df, "g", "o", "s", 6, 2), "o", "batch")] == [0, 0, 1, 2, 3, 3, 4]


def test_as_of_and_within(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("a", 1), ("b", 9)], "k string, at long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 10, "y"), ("a", 10, "z")], "k string, t long, v string")
    got = {(r.k, r.at): r.v for r in joins.as_of(left, right, ["k"], "at", "t", ["v"]).collect()}
    assert got == {("a", 5): "x", ("a", 10): "z", ("a", 1): None, ("b", 9): None}
    r = random.Random(5)
    pts = [("a", r.randint(0, 300)) for _ in range(60)] + [("a", None)]
    sp = [("a", i, s, s + r.randint(0, 50)) for i, s in enumerate(r.randint(0, 300) for _ in range(30))]
    got = rows(joins.within(spark.createDataFrame(pts, "k string, p long"), spark.createDataFrame(sp, "k string, i long, s long, e long"), ["k"], "p", "s", "e", 17, slack=3), "p", "i")
    assert got == sorted((p, i) for _, p in pts if p is not None for _, i, s, e in sp if s - 3 <= p < e + 3)


def test_precedence_fallback_and_matches(spark):
    a = spark.createDataFrame([("x", "1", None), ("y", None, "q")], "k string, v string, w string")
    b = spark.createDataFrame([("x", "2", "p"), ("z", "3", None)], "k string, v string, w string")
    assert rows(joins.merge_by_precedence([("a", a), ("b", b)], "k", ["v", "w"]).na.fill("-")) == [("x", "1", "a", "p", "b"), ("y", "-", "-", "q", "a"), ("z", "3", "b", "-", "-")]
    left = spark.createDataFrame([(1, "k1", "n1"), (2, "none", "n1"), (3, None, None)], "id int, k string, n string")
    right = spark.createDataFrame([("k1", "n9", 10), ("k2", "n1", 20), ("k3", "n1", 30)], "k string, n string, v int")
    got = joins.join_with_fallback(left, right.select("k", "n", "v"), [["k"], ["n"]], ["v"]).select("id", "v", "matched_on", "ambiguous").collect()
    assert sorted((r.id, r.v, r.matched_on, r.ambiguous) for r in got) == [(1, 10, 0, False), (2, 20, 1, True), (3, None, None, None)]


def test_aggregates(spark):
    df = spark.createDataFrame([("s", "a", 1), ("s", "b", None), ("s", "b", 0), ("s", None, 9), ("t", "c", 4)], "g string, v string, w int")
    assert rows(aggregates.weighted_mode(df, ["g"], "v", F.col("w"))) == [("s", "b", 2), ("t", "c", 4)]
    assert rows(aggregates.dominant(df, ["g"], "v", 0.9).na.fill("-")) == [("s", "-", 0.666667), ("t", "c", 1.0)]
    assert rows(aggregates.confusion(df, F.col("w") > 0, F.col("v") == "c")) == [(1, 0, 2, 2, 0.5)]
    v = spark.createDataFrame([(True, True, None), (True, False, True), (True, False, False), (None, True, True), (False, True, None)], "a boolean, b boolean, c boolean")
    assert [r[0] for r in v.select(aggregates.vote(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["agree", "tiebreak_upheld", "tiebreak_overturned", "error", "error"]


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "B")], "k int, v string")
    assert rows(changes.upsert(old, new, spark.createDataFrame([(2,), (3,)], "k int"), "k")) == [(1, "a"), (2, "B")]
    got = rows(changes.listing_changes(old, spark.createDataFrame([(1, "a"), (2, None), (4, "d")], "k int, v string"), "k", {"v": F.col("v")}))
    assert got == [(2, "changed", ["v"]), (3, "gone", []), (4, "new", [])]
    h = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "x")], "k string, t long, v string")
    assert [(r.version, r.valid_from, r.valid_to, r.seq) for r in changes.history(h, ["k"], "t", F.col("v")).orderBy("seq").collect()] == [("x", 1, 3, 1), (None, 3, 5, 2), ("x", 5, None, 3)]


def test_all_consecutive_snapshots(spark):
    # LA delivered nothing in b, as AU did; AU's law 2 comes in b, law 1 is gone in c
    data = [("AU", 1, "a", "x", "s", False), ("AU", 1, "b", "x", "t", False), ("AU", 2, "b", "y", "s", True), ("AU", 2, "c", "z", "s", True), ("LA", 1, "a", "x", "s", True), ("LA", 1, "c", None, "t", False), ("LA", 3, "c", "w", None, False), (None, 4, "a", "q", "s", True)]
    df = spark.createDataFrame(data, "src string, k_id int, day string, title string, status string, seen boolean")
    old, new = changes.consecutive(df, "src", "k_id", "day")
    got = rows(changes.listing_changes(old, new, "k", {c: F.col(c) for c in ("title", "status")}).select("k.*", "change", "reasons"))
    assert got == [("AU", 1, "b", "changed", ["status"]), ("AU", 1, "c", "gone", []), ("AU", 2, "b", "new", []), ("AU", 2, "c", "changed", ["title"]), ("LA", 1, "c", "changed", ["title", "status"]), ("LA", 3, "c", "new", [])]
    got = rows(changes.carried_over(df, "src", "k_id", "day", F.col("seen"), ["status"], "gone").drop("seen"))
    assert got == [("AU", 1, "b", "x", "s", None), ("AU", 1, "c", "x", "s", "gone"), ("AU", 2, "b", "y", "s", None), ("AU", 2, "c", "z", "s", None), ("LA", 1, "c", "x", "s", None), ("LA", 3, "c", "w", None, None)]


def test_checks(spark):
    df = spark.createDataFrame([("1", "Yes", ""), ("x", "0", "v"), (None, "maybe", None)], "n string, b string, o string")
    assert [tuple(r) for r in checks.coerced(df, ["n"], ["b"], ["o"]).collect()] == [(1, True, None), (None, False, "v"), (None, None, None)]
    rules = {"has_n": F.col("n").isNotNull(), "b_known": F.col("b") != "maybe"}
    assert rows(checks.rule_counts(df, rules)) == [("b_known", 1), ("has_n", 1)]
    assert [r.broken for r in checks.failures(df, "b", rules).collect()] == [["has_n", "b_known"]]


def test_bm25_against_a_loop(spark):
    import math
    import re

    docs = [(1, "the grain act of grain"), (2, "a clinic act"), (3, ""), (4, None), (5, "grain clinic grain clinic act")]
    qs = [(1, "grain clinic"), (2, "absent words")]
    got = rows(retrieval.bm25(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(qs, "q long, t string"), "q", "t", 5), "query_id", "doc_id", "score")
    bags = {d: [w for w in re.findall("[a-z0-9]+", t.lower()) if w not in retrieval.STOP] for d, t in docs if t}
    bags = {d: b for d, b in bags.items() if b}
    avg = sum(map(len, bags.values())) / len(bags)
    want = []
    for q, t in qs:
        for d, b in bags.items():
            s = 0
            for w in set(t.split()):
                df, tf = sum(w in x for x in bags.values()), b.count(w)
                if tf:
                    s += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(b) / avg))
            if s:
                want.append((q, d, round(s, 6)))
    assert got == sorted(want)


def test_segments(spark):
    body = "intro\nSection 1 aa\nbb\nSection 2A cc"
    df = spark.createDataFrame([(1, body), (2, "no heading"), (3, None)], "d int, t string")
    got = rows(segments.sections(df, "d", "t"), "d", "number", "start", "end")
    assert got == [(1, "1", 6, 22), (1, "2A", 22, len(body))]
    cases = [("b c", "a b c", "exact"), ("B  C", "a b c", "whitespace"), ("ｂ,c", "a b c", "normalised"), ("zz", "a b c", "none"), ("", "a", "none"), (None, "a", "none"), ("a", None, "none")]
    got = segments.anchored(spark.createDataFrame([(q, t) for q, t, _ in cases], "q string, t string"), "q", "t").collect()
    assert [r.how for r in got] == [h for *_, h in cases]
    assert [r.t[r.start : r.end] for r in got[:3]] == ["b c"] * 3
    pages = spark.createDataFrame([("d", 2, "second"), ("d", 1, "first"), ("d", 3, None)], "d string, p int, t string")
    r = segments.joined_pages(pages, "d", "p", "t").first()
    assert r.text == "first\nsecond\n" and [tuple(x) for x in r.pages] == [(1, 0), (2, 6), (3, 13)]
    g = spark.createDataFrame([("c", 1, ["a", "b"]), ("c", 2, ["b", "a", "x"]), ("c", 3, ["q"]), ("c", 4, None)], "g string, k int, w array<string>")
    assert [x[1] for x in rows(segments.greedy_groups(g, "g", "k", "w"), "k", "group_key")] == [1, 1, 3, 4]
    e = spark.createDataFrame([("ab  cd", "ab ce"), ("", "x")], "a string, b string")
    assert [r[0] for r in e.select(segments.error_rate(F.col("a"), F.col("b"))).collect()] == [0.2, None]


def test_small_counts_rows_and_bytes(spark):
    from quillspark.session import small

    df = spark.createDataFrame([(i, "x" * 1000, [1, 2]) for i in range(20)], "i long, s string, a array<int>")
    assert small(df, 20) and not small(df, 19) and not small(df, 20, most_bytes=15_000) and small(df.limit(0), 0)


def test_no_machine_local_folder_on_a_cluster():
    import pytest

    from quillspark import session

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Conf())

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster())
    Cluster.conf.get = lambda *_: "file:///shared/"
    assert session.shared_dir(Cluster()) == "file:///shared"


def test_terms_of_scripts_without_blanks(spark):
    from quillspark.operators.retrieval import terms

    df = spark.createDataFrame([("Policies of the boxes and registers, us",), ("ກົດໝາຍ",), ("กฎ 法",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(terms(F.col("t"))).collect()]
    assert got[0] == ["policy", "boxe", "register", "us"] and got[1] == ["ກົ", "ົດ", "ດໝ", "ໝາ", "າຍ"] and got[2] == ["法", "กฎ"] and got[3] == [] and got[4] is None


def test_repaired_sequences():
    assert segments.repair_sequence([1, 2, 8, 4, 5]) == ([1, 2, 3, 4, 5], 1)  # a number misread
    assert segments.repair_sequence([1, 2, 3, 1, 2]) == ([1, 2, 3, 1, 2], 0)  # a new count
    assert segments.repair_sequence([1, 4, None, 6]) == ([1, 4, 5, 6], 1)
    assert segments.repair_sequence([]) == ([], 0) and segments.repair_sequence([None]) == ([1], 1)


def test_stitched_bodies():
    # a table of contents, the body, a second part that goes on, a schedule with a count of its own
    assert segments.stitched_body([1, 2, 3, 1, 2, 3, 4, 5, 6, 6, 7, 1]) == [3, 4, 5, 6, 7, 8, 10]
    assert segments.stitched_body([4, 5, 6, 2, 3, 4, 5, 6, 7, 8]) == [3, 4, 5, 6, 7, 8, 9]
    assert segments.stitched_body([5, 1, 2, 3, 9, 2]) == [1, 2, 3, 4] and segments.stitched_body([]) == []


def test_bodies_and_nearest(spark):
    df = spark.createDataFrame([(1, "Section 1\na\nSection 2\nb\nSection 9\nc\nSection 4", "x"), (2, None, "x"), (3, "none", "x")], "k long, t string, numbers string")
    got = segments.bodies(df, "k", "t").collect()
    assert [(r.k, r.repaired, r.repairs, r.body) for r in got] == [(1, [1, 2, 3, 4], 1, [0, 1, 2, 3])]
    near = lambda t, n, h: spark.createDataFrame([(t, h)], "t string, h int").select(segments.nearest_occurrence(F.col("t"), n, F.col("h"))).first()[0]
    assert near("ab.ab.ab", "ab", 4) == 3 and near("xx", "ab", 0) is None and near("a.b a.b", "a.b", 100) == 4 and near(None, "a", 1) is None


def test_numbered_like_ranked(spark):
    rows_ = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 7}", random.Random(i).randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows_, "i int, k string, v int").repartition(5)
    order = [F.desc("v"), F.col("i")]
    pick = lambda x: sorted((r.i, r.rank) for r in x.collect())
    assert pick(ranking.numbered(df, ["k"], order)) == pick(ranking.ranked(df, ["k"], order))
    assert ranking.numbered(df.limit(0), ["k"], order).count() == 0


def test_sliding_over_stretches(spark, monkeypatch):
    df = spark.createDataFrame([("h" if i % 4 else None, i, "ok" if i % 3 else "bad") for i in range(120)], "h string, t int, o string")
    pick = lambda: sorted((r.t, r.seen, r.share) for r in ranking.sliding_mix(df, ["h"], ["t"], "o", 7).collect())
    whole = pick()
    monkeypatch.setattr(ranking, "STRETCH", 10)
    assert pick() == whole and len(whole) == 120


def test_best_overlap_against_all_pairs(spark):
    r = random.Random(4)
    some = lambda: sorted({r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 6))})
    left = [(i, r.choice(["x", "y", None]), some()) for i in range(80)]
    right = [(i, r.choice(["x", "y", None]), some()) for i in range(60)]
    schema = "{} int, c string, t array<string>"
    got = {x.i: (x.j, x.score) for x in joins.best_overlap(spark.createDataFrame(left, schema.format("i")), spark.createDataFrame(right, schema.format("j")), ["c"], "t", "i", "j", 0.7).collect()}
    want = {}
    for i, c, a in left:
        scored = [(-round(len(set(a) & set(b)) / min(len(a), len(b)), 6), j) for j, d, b in right if c == d and a and b]
        if scored and -min(scored)[0] >= 0.7:
            want[i] = (min(scored)[1], -min(scored)[0])
    assert got == want and len(want) > 30


def test_best_overlap_over_parts_and_blocks(spark, monkeypatch):
    """Of a hot cell nothing that grows with its rows or tokens is broadcast; parts and blocks change nothing."""
    r = random.Random(5)
    some = lambda i: None if i % 50 == 0 else sorted({r.choice("abcdefghijkl") for _ in range(r.randint(0, 8))} | ({f"only{i // 2}"} if i % 3 else set()))
    left = [(f"l{i}", None if i % 9 == 0 else "hot", some(i)) for i in range(300)]
    right = [(i, None if i % 7 == 0 else "hot", some(i)) for i in range(200)]
    left.append(("half", "half", [f"t{i}" for i in range(128)]))
    right.append((999, "half", [f"t{i}" for i in range(109)] + [f"u{i}" for i in range(91)]))  # 109/128 = 0.8515625 exactly
    want = {}
    for i, c, a in left:
        scored = [(-(int(1e6 * len(set(a) & set(b)) / min(len(a), len(b)) + 0.5) / 1e6), j) for j, d, b in right if c == d and a and b]
        if scored and -min(scored)[0] >= 0.7:
            want[i] = (min(scored)[1], -min(scored)[0])
    assert want["half"] == (999, 0.851563) and len(want) > 200

    small, sent = joins.broadcast_if_small, []
    monkeypatch.setattr(joins, "broadcast_if_small", lambda df, *a: (sent.append(df.count()), small(df, *a))[1])
    l, b = spark.createDataFrame(left, "i string, c string, t array<string>"), spark.createDataFrame(right, "j int, c string, t array<string>")  # noqa: E741
    got = lambda: {x.i: (x.j, x.score) for x in joins.best_overlap(l, b, ["c"], "t", "i", "j", 0.7).collect()}
    assert got() == want
    assert max(sent) <= 3  # one row per cell
    for name, n in (("PART", 40), ("BLOCK", 100), ("_MOST", 500)):
        monkeypatch.setattr(joins, name, n)
    assert got() == want
    assert joins.best_overlap(l, b.limit(0), ["c"], "t", "i", "j", 0.7).count() == joins.best_overlap(l.limit(0), b, ["c"], "t", "i", "j", 0.7).count() == 0


def test_column_headed_and_enclosing(spark):
    df = spark.createDataFrame([("a", "b", "c")], ["Note on law", "x", " notes "])
    assert checks.column_headed(df, "note") == "Note on law" and checks.column_headed(df, "note", 1) == " notes " and checks.column_headed(df, "law") is None
    rows_ = spark.createDataFrame([([10, 50, 90], 55, 60), ([], 5, 6), (None, 5, 6), ([9000], 10, 20)], "l array<int>, s int, e int")
    got = [tuple(r[0]) for r in rows_.select(segments.enclosing(F.col("l"), F.col("s"), F.col("e"))).collect()]
    assert got == [(50, 90), (5, 6), (5, 6), (10, 20)]


def test_stratified_fills_up(spark):
    df = spark.createDataFrame([(i, "a" if i < 100 else "b" if i < 105 else None if i < 110 else "other") for i in range(150)], "i int, s string")
    got = ranking.stratified(df, F.col("s"), {"a": 0.5, "b": 0.5}, 40, "i", 3, F.col("i") == 99).collect()
    n = {x: sum(r.stratum == x for r in got) for x in ("a", "b", "other", None)}
    assert n == {"a": 35, "b": 5, "other": 0, None: 0} and 99 in {r.i for r in got}
    assert ranking.stratified(df, F.col("s"), {"a": 0.5, "b": 0.5}, 400, "i", 3).count() == 105
