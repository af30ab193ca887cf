import numpy as np
import pytest

from quillspark.llm import residue as R

LEGAL = "The {a} shall keep the {b} register under regulation {n}. No {b} notice is valid before the {a} has signed the map."
A, B = ["warden", "broker", "steward", "trustee", "notary", "auditor"], ["grain", "cargo", "clinic", "parcel", "wharf", "quota"]


@pytest.mark.parametrize("text", ["Dear {{name}},", "See [[body]] here", "on ${date}", "<%= x %>", "__BODY__ signs", "404 Not Found", "Please enable JavaScript in your browser", "Lorem x ipsum", "请启用JavaScript后"])
def test_trusted(text):
    assert R.trusted(text)


@pytest.mark.parametrize("text", ["Date: ____ / ____ / 20__", "[Paragraph (b) repealed by Order 9]", "Section 404 and section 9", "where JavaScript is switched off by the user", "a page not found message", "", "___"])
def test_not_trusted(text):
    assert not R.trusted(text)


def test_passages():
    assert R.passages("One. Two [[x]]!\n\nSee No. 7 now.  \n一。二") == ["One.", "Two [[x]]!", "See No. 7 now.", "一。", "二", "[[x]]"]
    assert R.passages("") == [] and R.passages(" \n ") == []


def test_bags_agree_with_words_one_by_one():
    texts = ["The map, No. 7", "", "the MAP 20__ {{x}}", "ຂໍ້ມູນ 北屿"]
    found, owner = R.Bags(most=2)(texts)
    for k, t in enumerate(texts):
        words = [R._bin(w) for w in R._WORD.findall(t.lower())]
        pairs = [R.HALF + ((a * 40503 + b * 7 + 1) >> 3) % R.HALF for a, b in zip(words, words[1:])]
        assert sorted(found[owner == k]) == sorted([w % R.HALF for w in words] + pairs)
    s = R.evidence(np.ones(R.BINS), found, owner, len(texts))
    assert s[1] == 0 and s[0] == min(11, R.LENGTH)


def test_never_residue():
    parts = ["Gazette, page 3", "Name: ........", "[Paragraph 2 repealed by Order 9]", "The broker shall keep the quota map of every wharf.", "Gazette, page 4", "404 Not Found"]
    assert R.never_residue(parts) == [True, True, True, True, True, False]


def test_long_fields_and_words():
    assert R.trusted("{{" + "name_" * 50 + "x}}") and R.trusted("[insert " + "the name " * 30 + "]") and R.trusted("__" + "a" * 90 + "__")
    assert R.bins("x" * 60 + "a")[0] != R.bins("x" * 60 + "b")[0]


def corpus():
    rows = []
    for i in range(400):
        rows.append((i, " ".join(LEGAL.format(a=A[(i + k) % 6], b=B[(i * k) % 6], n=i) for k in range(3)), "x"))
    bad = {
        1001: "Please enable JavaScript in your browser to view this act.",
        1002: LEGAL.format(a="warden", b="grain", n=1) + "\n\n404 Not Found\nThe requested document was not found on this server.",
        1003: "The warden shall keep the {{gazette_no}} register under regulation 4.",
        1004: "Lorem dolor ipsum. " * 2000,
    }
    for d, t in bad.items():
        rows += [(d, t, "x"), (d + 100, t + "\n", "x")]
    rows += [(2001, None, "x"), (2002, "", "x"), (2003, "Name: .......... Date: ____ / ____", "x"), (2004, "The site must stay readable where JavaScript is switched off by the broker under regulation 7.", "x")]
    rows += [(2005, "[Paragraph (b) repealed by Order 9]", "x")] * 2
    return rows, set(bad) | {d + 100 for d in bad}


def test_documents(spark):
    rows, want = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, passage string")
    got = R.residue_documents(df, "doc_id", "text").collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)


def test_nothing_trusted_and_empty(spark):
    df = spark.createDataFrame([(1, "Only law.", "x"), (2, None, "x")], "doc_id long, text string, passage string")
    assert R.residue_documents(df, "doc_id", "text").count() == 0
    assert R.residue_documents(df.limit(0), "doc_id", "text").count() == 0


#: Messages by kind: what the model has to learn from the others when the sign of a kind is withheld.
KINDS = {
    r"enable javascript": "Please enable JavaScript in your browser to view this page.",
    r"javascript is disabled": "JavaScript is disabled in your browser.",
    r"not found": "404 Not Found on the portal server.",
    r"access denied": "Access denied by the portal server.",
    r"session has expired": "Your session has expired, sign in to the portal again.",
    r"unexpected error": "An unexpected error occurred on the portal.",
    r"lorem ipsum": "Lorem ipsum dolor sit amet.",
    r"placeholder": "This is a placeholder page, content follows.",
    r"modelo": "Texto modelo, substitua aqui.",
    r"coming soon": "Content coming soon to this page.",
}


@pytest.mark.parametrize("first", [0, 1])
def test_half_of_the_signs_withheld(spark, first):
    rng, texts = np.random.default_rng(5), list(KINDS.values())
    law = lambda: " ".join(LEGAL.format(a=A[rng.integers(6)], b=B[rng.integers(6)], n=rng.integers(99)) for _ in range(rng.integers(4, 24)))
    rows = [(i, law()) for i in range(6000)] + [(6000 + i, law() + f" The site must stay readable where JavaScript is switched off by the {A[i % 6]}.") for i in range(30)]
    kinds = {}
    for i in range(150):
        own = rng.permutation(len(texts))[: rng.integers(1, 5)]
        kinds[10_000 + i] = own
        rows.append((10_000 + i, " ".join(texts[k] for k in own) + ("\n\n" + law() if i % 2 else "")))
    signs = tuple((p, p) for p in list(KINDS)[first::2])
    got = {r.doc_id for r in R.residue_documents(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", signs).collect()}
    lost = {d for d, own in kinds.items() if all(k % 2 != first for k in own)}
    assert len(lost) > 20 and len(got & lost) >= 0.9 * len(lost)
    assert len(got & set(kinds)) >= 0.98 * len(got)
