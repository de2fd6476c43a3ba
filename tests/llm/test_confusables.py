import unicodedata

import pytest

from touchline.llm import confusables as C


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (None, None), ("", ""), ("  ​ ", ""), ("Ana Perez", "Ana Perez"), ("Аna Pеrez", "Ana Perez"), ("Ａｎａ　Ｐｅｒｅｚ", "Ana Perez"),
        ("Año", "Año"), ("A‍na  Pe­rez", "Ana Perez"), ("Κοnrad", "Konrad"), ("Иван Петрoв", "Иван Петров"), ("Иван Петров", "Иван Петров"),
        ("ﾊﾟｽ･ｶ", "パス・カ"), ("O’Neil", "O'Neil"), ("Al‑Said", "Al-Said"), ("ﬁn ĳs", "fin ijs"), ("Kurt", "Kurt"), ("Carlo ムシミ", "Carlo ムシミ"),
        ("PEREZ, Ana", "PEREZ, Ana"), ("Соса Nadal", "Coca Nadal"),
        ("Mօna Perez", "Mona Perez"), ("Ꭺna Perez", "Ana Perez"), ("Anа Pօrez", "Ana Porez"), ("ѕօр", "ѕор"), ("Հայկ", "Հայկ"), ("Հայկ Perez", "Հայկ Perez"),
        ("½ Ana²", "½ Ana²"), ("東京 タワー の", "東京 タワー の"),
    ],
)
def test_consistent(given, want):
    assert C.consistent(given) == want
    assert C.consistent(want) == want


def test_script_sets():
    assert C.intersect("Аna") == frozenset() and C.intersect("12.") is C.ALL and "LATIN" in C.intersect("Ana")


def test_fast_path_never_hides_a_change(spark):
    names = ["Ana", "Ana ", "Ana  B", "-Ana", "Ĳs", "Łukasz", "Aö", "Ao", None, "", "x" * 50_000 + "​"]
    df = spark.createDataFrame([(i, n, "extra") for i, n in enumerate(names)], "row_id int, player string, consistent string")
    got = {r["row_id"] for r in C.inconsistent(df, "player").collect()}
    assert got == {i for i, n in enumerate(names) if n is not None and C.consistent(n) != n}
    assert unicodedata.is_normalized("NFC", C.consistent("Aö"))
