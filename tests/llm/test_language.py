from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm.language import LANGUAGES, Sentences, fit, label_languages, labelled_sample, languages, mislabelled, segments

WORDS = {
    "lao": "ຜູ້ນຳເຂົ້າ ມີໜ້າທີ່ ຂຶ້ນທະບຽນ ຂໍ້ມູນ ທະນາຄານ ຕ້ອງ ລາຍງານ ບັນຊີ",
    "tha": "พนักงาน หน้าที่ ห้ามมิให้ โอนย้าย ทะเบียน ต้อง อุปกรณ์ ประเมิน",
    "eng": "the warden shall keep every register under clause and may not the notice within area",
    "fra": "le titulaire doit remettre les certificats sur le territoire sous la tutelle du ministère",
    "por": "o operador pode eliminar o equipamento no prazo dos títulos sob supervisão do ministério",
    "vie": "văn phòng đăng ký phải lưu giữ thiết bị viễn thông trong thời hạn ngày",
    "tet": "ema sira iha obrigasaun atu haree fali relatóriu nian ho lisensa husi na'in no selu",
    "ind": "badan pengawas harus memperbarui peralatan sesuai dengan pasal selama bulan wajib menyimpan",
}


def sentence(lang, k):
    w = WORDS[lang].split()
    return " ".join(w[(k * 3 + i * (1 + k % 2)) % len(w)] for i in range(9)) + "."


@pytest.fixture(scope="module")
def model():
    data = [(sentence(x, k), x if k % 10 else LANGUAGES[(LANGUAGES.index(x) + 3) % 8]) for x in LANGUAGES for k in range(40)]  # a tenth wrong
    return fit([t for t, _ in data], [c for _, c in data], sample=60)


@pytest.mark.parametrize(
    "label,codes",
    [("Portuguese", {"por"}), (" pt-TL ", {"por"}), ("PT", {"por"}), ("Tetum; Bahasa Indonesia", {"tet", "ind"}), ("en / por", {"eng", "por"}), ("ພາສາລາວ and fra", {"lao", "fra"}), ("Tetum and PT", {"tet", "por"}), ("n/a", set()), ("und", set()), ("?", set()), ("", set()), ("lo_LA, Thai", {"lao", "tha"}), ("zh-Hans", {"zho"})],
)
def test_labels(label, codes):
    assert label_languages(label) == frozenset(codes)


def test_sentences_and_predictions(model):
    for x in LANGUAGES:
        s = Sentences([sentence(x, k) for k in range(100, 110)])
        assert [LANGUAGES[i] for i in model.predict(s)[0]] == [x] * 10
    assert Sentences([]).n == 0


def test_frame(spark, model):
    por, ind, lao, tha = (sentence(x, 77) for x in ("por", "ind", "lao", "tha"))
    rows = [
        (1, por, "Portuguese", 0),
        (2, por, "en", 0),
        (3, por + " " + ind, "pt", 0),
        (4, por + " — " + ind, "pt; id", 0),
        (5, por[:-1] + " (Internet Service Provider).", "por", 0),
        (6, tha[:-1] + " " + lao, None, 0),
        (7, None, "pt", 0),
        (8, "", "pt", 0),
        (9, "123 / 45.", "pt", 0),
        (10, por * 3000, "?", 0),
        (11, por, "Portuguese / unknown", 0),
        (1, por, "Portuguese", 0),
    ]
    df = spark.createDataFrame(rows, "id long, text string, label string, confidence int")
    got = sorted((r.id, r.lang_code) for r in mislabelled(languages(df, ["id"], "text", "label", model), ["id"]).collect())
    assert got == [(2, "por"), (3, "ind"), (3, "por"), (6, "lao"), (6, "tha"), (10, "por")]
    segs = {i: [x.lang_code for x in sorted((r for r in segments(df, ["id"], "text", model).collect() if r.id == i), key=lambda r: r.segment)] for i in (3, 4, 6, 7, 9, 10)}
    assert segs == {3: ["por", "ind"], 4: ["por", "ind"], 6: segs[6], 7: [], 9: [], 10: ["por"]} and set(segs[6]) == {"lao", "tha"}
    assert languages(df.limit(0), ["id"], "text", "label", model).count() == 0


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(f"text {i}", "pt" if i % 3 else "English") for i in range(3000)] + [("x", None), (None, "pt"), ("y", "pt; en")], "t string, l string")
    got = labelled_sample(df, "t", "l", per_label=100)
    n = {c: sum(x == c for _, x in got) for c in ("por", "eng")}
    assert 50 < n["por"] < 200 and 50 < n["eng"] < 200
    assert labelled_sample(df.limit(0), "t", "l") == []


def test_sample_with_a_text_in_many_copies(spark):
    at = F.pmod(F.xxhash64("t"), F.lit(1_000_000))
    first = spark.range(4000).select(F.concat(F.lit("This provision has number "), "id").alias("t")).orderBy(at).first().t  # its hash is always taken
    rows = [(first, "en")] * 5000 + [(f"Esta disposição tem o número {i}", "pt") for i in range(40)] + [(f"Peraturan ini bernomor {i}", "id") for i in range(40)]
    got = Counter(labelled_sample(spark.createDataFrame(rows, "t string, l string").coalesce(1), "t", "l", per_label=10))
    assert got[(first, "eng")] == 1 and max(got.values()) == 1
    n = Counter(code for _, code in got)
    assert set(n) == {"eng", "por", "ind"} and max(n.values()) <= 30


def test_no_script_of_these_languages():
    from quillspark.llm.language import Sentences, _present

    s = Sentences(["ច្បាប់ស្តីពីការងារ", "The law on labour (" + "ច្បាប់" * 30 + ") holds."])
    assert list(_present(s, None)) == [False, True] and s.letters[1] == 19
