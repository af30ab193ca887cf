import itertools

import pytest

from quillspark.llm.canonical import canonical, fold, look_alike_pairs, repairs

SAME = [
    ("ﬁne ｔｅｘｔ", "fine text"),
    ("café", "café"),
    ("a​b­c﻿", "abc"),
    ("a   　b\n", "a b"),
    ("ນ້ໍາ", "ນ້ຳ"),
    ("ຫນ້າ", "ໜ້າ"),
    ("ເເ", "ແ"),
    ("⽤不", "用不"),
    ("ệ", "ệ"),
    ("１２", "12"),
]
DIFFERENT = ["m2", "m²", "①", "1", "a", "A", "e", "é", "ª", "ກ່າ", "ກາ", "ſ", "s"]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert fold(a) == fold(b)


def test_different():
    for a, b in itertools.combinations(DIFFERENT, 2):
        assert fold(a) != fold(b)


def test_fold_is_idempotent():
    for a, _ in SAME:
        assert fold(fold(a)) == fold(a)


def test_repairs_need_mixed_tokens():
    assert repairs("thе plаn") == [("plаn", "plan"), ("thе", "the")]
    assert repairs("план the") == []  # wholly Cyrillic, and not all of it looks Latin
    assert repairs("all with а word") == [("а", "a")]
    assert repairs("слово сo словом") == [("сo", "со")]


def rows(spark, data):
    return spark.createDataFrame(data, "tbl string, rid long, text string, canonical string, word string")


def test_repair_only_to_corpus_words(spark):
    df = rows(spark, [("x", 1, "thе end", "c", "w"), ("x", 2, "The end", "c", "w"), ("x", 3, "zqе end", "c", "w"), ("x", 4, None, "c", "w"), ("x", 5, "", "c", "w"), ("x", 6, "​ ", "c", "w")])
    got = {r.rid: r.canonical for r in canonical(df, "text").collect()}
    assert got == {1: "the end", 2: "The end", 3: "zqе end", 4: None, 5: "", 6: ""}


def test_pairs_against_brute_force(spark):
    texts = ["a b", "a b", "a b", "ａ b", "A b", None, "", "​", "the x", "thе x", "ນ້ຳ", "ນ້ໍາ", "x" * 50000, "x" * 50000 + "​"]
    df = rows(spark, [(t, i, x, "c", "w") for t in ("p", "q") for i, x in enumerate(texts)])
    forms = [x and fold(x.replace("е", "e")) for x in texts]
    want = {(t, i, j) for t in "pq" for i, j in itertools.combinations(range(len(texts)), 2) if forms[i] and forms[i] == forms[j] and texts[i] != texts[j]}
    for block in (1, 2000):
        assert {tuple(r) for r in look_alike_pairs(df, "tbl", "rid", "text", block).collect()} == want


def test_empty_table(spark):
    assert look_alike_pairs(rows(spark, []), "tbl", "rid", "text").count() == 0


def test_words_of_another_script_stay():
    from quillspark.llm.canonical import repairs

    assert repairs("we saw сосна and the rest") == []  # all its letters have Latin twins, but it mixes nothing


def test_classes(spark):
    from quillspark.llm.canonical import look_alike_classes

    df = spark.createDataFrame([(5, "a", "ｘ y"), (3, "a", "x y"), (4, "a", "x y"), (6, "a", "X y"), (7, "b", "x y"), (8, "a", None), (9, "a", ""), (9, "a", "\u200b")], "id long, s string, t string")
    got = sorted(tuple(r) for r in look_alike_classes(df, "s", "id", "t").collect())
    assert got == [("a", 3, 3, 2, 3), ("a", 4, 3, 2, 3), ("a", 5, 3, 2, 3), ("a", 6, 6, 1, 1), ("b", 7, 7, 1, 1)]
    assert look_alike_classes(df.limit(0), "s", "id", "t").count() == 0
