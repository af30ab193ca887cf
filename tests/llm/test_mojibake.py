import pytest

from quillspark.llm.mojibake import WRONG, damaged_texts, hits, repair

TITLES = ["Decreto-Lei n.º 23/1978 — Âmbito das Águas em Díli", "“Água” n.º 4 – Alteração à Lei", "Court’s Fee (£7 or €25) Act", "ຂໍ້ຕົກລົງວ່າດ້ວຍການຄຸ້ມຄອງ", "北屿渔业安全条例（2003年修订）"]
CLEAN = TITLES + ["LEI N.º 2/1988 — GESTÃO DA CIRCULAÇÃO", "“MANHÔ", "MANHÃ — DÍLI", "Order 7 [What is a Key?]", "Café Rules", "东莞脂润发", "Ãã", "", " ", "?"]


def show(text, enc):
    out = ""
    for b in text.encode():
        try:
            out += bytes([b]).decode(enc)
        except UnicodeDecodeError:
            out += chr(b)
    return out


@pytest.mark.parametrize("enc", [e for e in WRONG if e != "cp1250"])
@pytest.mark.parametrize("title", TITLES)
def test_round_trip(title, enc):
    assert repair(show(title, enc)) == (True, title, True)


@pytest.mark.parametrize("title", TITLES)
def test_read_wrongly_twice(title):
    assert repair(show(show(title, "cp1252"), "cp1252")) == (True, title, True)


def test_double_byte_both_ways():
    assert repair("北屿渔业安全条例".encode("gbk").decode("latin-1")) == (True, "北屿渔业安全条例", True)
    assert repair("Lei n.º 4 em Díli".encode().decode("gbk", "replace")) == (True, "Lei n.º 4 em Díli", True)


@pytest.mark.parametrize("title", CLEAN)
def test_clean_stays(title):
    assert not hits(title) and repair(title) == (False, title, False)


def test_lost_and_partial():
    assert repair("Com�rcio") == (True, "Com�rcio", False)
    assert repair("Proteção — EletrÃ³nico") == (True, "Proteção — Eletrónico", True)
    assert repair("Gest茫o 鈥� 潞")[0]


def test_frame(spark):
    df = spark.createDataFrame([(1, "CafÃ©", "x"), (1, "CafÃ©", "x"), (2, None, "x"), (3, "", "x"), (4, "plain", "x"), (5, "Ã©" * 30000, "x")], "id long, title string, restored string")
    got = sorted((r.id, r.restored[:8], r.complete) for r in damaged_texts(df, "title", ["id"]).collect())
    assert got == [(1, "Café", True), (1, "Café", True), (5, "é" * 8, True)]
    assert damaged_texts(df.limit(0), "title", ["id"]).count() == 0


def test_any_number_of_rounds():
    from quillspark.llm.mojibake import repair

    text = "Regulamento da aquisição pública"
    for _ in range(5):
        text = text.encode().decode("latin-1")
    assert repair(text) == (True, "Regulamento da aquisição pública", True)
