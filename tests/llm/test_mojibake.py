import pytest

from touchline.llm import mojibake as M

WORDS = ["città", "perché", "größer", "naïve", "señor", "façade", "über", "années", "Höhe", "fête", "après", "sélection", "Straße", "müssen", "zurück", "também"]


def garbled(docs):
    return {r["doc_id"] for r in M.garbled_documents(docs).collect()}


def test_transformations():
    assert M.transform("fÃªte", "cp1252>utf-8") == "fête"
    assert M.transform("“fÃªte—", "cp1252>utf-8") == "“fête—"
    assert M.transform("zur³ck", "cp850>cp1252") == "zurück"
    assert M.transform("fête", "cp1252>utf-8") is None
    assert M.decode_sequences("Vléjið│", "cp850") == ("Vléjiг", False)
    assert M.align("grÃ¶ÃŸer", "größer") == [("Ã¶ÃŸ", "öß")] and M.align("abc", "abd") == [] and M.align("fête", "fàete") == []
    assert "cp1252>utf-8" in M.explanations("Ã¶ÃŸ", "öß") and M.explanations("Ã¶", "é") == frozenset()
    assert "cp850>cp1252" in M.explanations("³", "ü") and "gb18030>utf-8" in M.explanations("茅", "é")


def test_documents(spark):
    clean = [f"{WORDS[i % 16]} und {WORDS[(i * 7 + 3) % 16]} nummer {i}" for i in range(400)]
    bad = {1000 + i: f"dort {w} eins {i}".encode().decode("cp1252", "replace") for i, w in enumerate(WORDS) if w not in ("città",)}
    bad |= {2000 + i: f"hier {w} zwei".encode("cp1252").decode("cp850") for i, w in enumerate(("zurück", "müssen", "größer", "sélection"))}
    twice = f"mal {WORDS[3]} drei".encode().decode("cp1252").encode().decode("cp1252")
    rows = [(i, t) for i, t in enumerate(clean)] + list(bad.items()) + [(3000, "verlor�en"), (3001, twice), (4000, None), (4001, ""), (4002, "plain ascii")]
    rows += [(5000 + i, bad[1001]) for i in range(200)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string")
    want = set(bad) | {3000, 3001} | {5000 + i for i in range(200)}
    assert garbled(docs) == want
    got = {r["doc_id"]: r for r in M.restored_documents(docs).collect()}
    assert set(got) == want and not got[3000]["fully"]
    assert got[1001]["restored"] == "dort perché eins 1" and got[2000]["restored"] == "hier zurück zwei" and got[3001]["restored"] == "mal naïve drei"
    assert M.garbled_documents(docs.limit(0)).count() == 0 and M.restored_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("read_as", ["cp437", "iso8859_9", "mac_latin2", "cp1258", "cp1256", "gb18030", "big5", "shift_jis"])
def test_readings_are_learned_from_twins(spark, read_as):
    """No reading is listed anywhere: each is inferred from near-twins; without the twins nothing is found."""
    rows = [(i, f"{WORDS[i % 16]} und {WORDS[(i * 7 + 3) % 16]} nummer {i}") for i in range(320)]
    bad = {}
    for i, w in enumerate(WORDS):
        try:
            bad[1000 + i] = f"dort {w} eins {i}".encode().decode(read_as)
        except UnicodeDecodeError:
            pass
    docs = spark.createDataFrame(rows + list(bad.items()), "doc_id long, text string")
    found = garbled(docs)
    assert not found - set(bad) and len(found) >= 0.9 * len(bad)
    alone = spark.createDataFrame([(i, f"{i} {'abc'[i % 3]}") for i in range(300)] + list(bad.items()), "doc_id long, text string")
    assert len(garbled(alone) - {k for k, t in bad.items() if any("\x80" <= c <= "\x9f" for c in t)}) == 0


def test_rare_script_beside_a_large_corpus(spark):
    greek = ["Ο προπονητής μίλησε για την άμυνα", "Η ομάδα έπαιξε με υπομονή", "Κανείς δεν ήθελε ρίσκο απόψε"]
    rows = [(i, f"les {WORDS[i % 16]} du jour {i}") for i in range(20_000)] + [(30_000 + i, f"{greek[i % 3]} {i}") for i in range(12)]
    one = lambda b: bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b)
    bad = {40_000 + i: "".join(map(one, f"{g} {90 + i}".encode())) for i, g in enumerate(greek)}
    docs = spark.createDataFrame(rows + list(bad.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["restored"] for r in M.restored_documents(docs).collect()} == {40_000 + i: f"{g} {90 + i}" for i, g in enumerate(greek)}


def test_letters_that_happen_to_be_sequences(spark):
    """Under a learned reading Latin neighbours may be a Cyrillic letter's bytes: no word of two scripts is restored."""
    rows = [(i, f"{WORDS[i % 16]} und {WORDS[(i * 7 + 3) % 16]} Вася {i}") for i in range(320)] + [(900, "Jogelinðør kam"), (901, "Лев и Яна"), (902, "Лев"), (903, "Л я"), (904, "Лев да")]
    bad = [(1000 + i, f"dort {w} eins {i}".encode().decode("cp850")) for i, w in enumerate(WORDS)]
    assert garbled(spark.createDataFrame(rows + bad, "doc_id long, text string")) == {i for i, _ in bad}


def test_spelling_variants_are_no_garbling(spark):
    rows = [(i, f"cant{'éá'[i % 2]} habl{'áé'[i % 3 == 0]} est{'é' if i % 5 else 'á'} voix {'ÎÏ'[i % 2]}lot num {i}") for i in range(600)]
    assert garbled(spark.createDataFrame(rows, "doc_id long, text string")) == set()
