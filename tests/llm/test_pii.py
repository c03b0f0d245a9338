import random

import pytest

from plotwright.llm.pii import _DISGUISE, _SPELLED, DIGIT_WORDS, _caseless, find_mentions, may_be_disguised, mentions, redact, redact_documents, transduce
from tests.fixtures import as_set

NB = chr(0xA0)
CASES = [
    ("Pytania: jan.kowal+oferty@firma-x.example.", [("email", "jan.kowal+oferty@firma-x.example")]),
    ("Napisz: biuro [at] firma-x.example lub iga(małpa)firma.invalid", [("email", "biuro [at] firma-x.example"), ("email", "iga(małpa)firma.invalid")]),
    ("biuro @ firma.example, iga małpa firma kropka pl", [("email", "biuro @ firma.example"), ("email", "iga małpa firma kropka pl")]),
    ("Obserwuj nas: @firma_estate i oznacz znajomych.", []),
    ("Dzwoń +48 985 915 414 albo 0048 364 236 052", [("phone", "+48 985 915 414"), ("phone", "0048 364 236 052")]),
    ("tel (98) 854 94 67, (+48) 366-476-053, 98 854-44-49", [("phone", "(98) 854 94 67"), ("phone", "(+48) 366-476-053"), ("phone", "98 854-44-49")]),
    ("tel 373.199.684; 989 / 245 / 858; 3 7 1 8 4 1 1 4 7; 369457815", [("phone", "373.199.684"), ("phone", "989 / 245 / 858"), ("phone", "3 7 1 8 4 1 1 4 7"), ("phone", "369457815")]),
    (f"tel +48{NB}386{NB}915{NB}211", [("phone", f"+48{NB}386{NB}915{NB}211")]),
    ("zadzwoń: pięć zero jeden dwa trzy cztery siedem osiem dziewięć dziś", [("phone", "pięć zero jeden dwa trzy cztery siedem osiem dziewięć")]),
    ("tytuł wpłaty 815660772, Numer oferty: 379950909, Wartość 479 927 000 zł, działka 3255/83, nr XX7Y/87069405/2", []),
    ("PESEL 26811215693, Nr ref. 37902074646", [("id_number", "26811215693")]),
    ("Dowód osobisty seria i numer EKS 339742, dowodem edd 646944, KKS 076 053 oraz KRC046676", [("id_number", "EKS 339742"), ("id_number", "edd 646944"), ("id_number", "KKS 076 053"), ("id_number", "KRC046676")]),
    ("Symbol KBM-843778 w bazie, tel 372 292 005", [("phone", "372 292 005")]),
    ("Adres: ul. gen. Gustawa Pstrąpaty 43. Lokal przy Ul. F. Osiedla 130c lok. 87, os. Miłe 77 m. 47", [("address", "ul. gen. Gustawa Pstrąpaty 43"), ("address", "Ul. F. Osiedla 130c lok. 87"), ("address", "os. Miłe 77 m. 47")]),
    ("Blisko ul. Idziego Nowaka kursuje autobus nr 6; W pobliżu ul. X oraz placu prof. Adama Nowaka powstaje park.", []),
    ("Viewings at al. Krótka 147, please call 217420690.", [("address", "al. Krótka 147"), ("phone", "217420690")]),
    ("Kontakt: Hanna Żartumińska, Nowacka Bożena, I. Mroczną", [("person", "Hanna Żartumińska"), ("person", "Nowacka Bożena"), ("person", "I. Mroczną")]),
    ("Pełnomocnik Róża KRUROWSKA-NOWA. Umowa z Kamilem Nowętlickim, LUKASZ GRZYWA", [("person", "Róża KRUROWSKA-NOWA"), ("person", "Kamilem Nowętlickim"), ("person", "LUKASZ GRZYWA")]),
    ("Widok na Góra Zamkowa, Stare Miasto. Pod domem sad.", []),
    ("", []), ("   ", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert [(k, text[a:b]) for a, b, k in mentions(text)] == want


def test_positions_survive_disguises():
    text = "x" * 10 + chr(0x200B) + " ｊａｎ＠firma.example i Κowalski, tel. ５０１ 234 567"
    assert [(k, text[a:b]) for a, b, k in mentions(text)] == [("email", "ｊａｎ＠firma.example"), ("phone", "５０１ 234 567")]
    p = transduce("a b [at] c.pl")
    assert p.text == "a b@c.pl" and p.source(2, 8) == (2, 13)
    mixed = "Kontakt: Аdam Kowalski"  # a Cyrillic first letter
    assert mentions(mixed) == [(9, 22, "person")]


def test_redaction_is_readable():
    assert redact("Kontakt: Hanna Nowa, tel. 501 234 567.") == "Kontakt: [PERSON], tel. [PHONE]."
    assert redact(None) is None and redact("") == ""


def test_documents(spark):
    long = "słowo " * 20_000 + "biuro@firma.example"
    df = spark.createDataFrame([(1, "tel 501 234 567", "a"), (2, "tel 501 234 567", "b"), (3, "", "c"), (4, None, "d"), (5, long, "e")], "doc_id bigint, text string, kind string")
    assert as_set(find_mentions(df).select("doc_id", "kind", "start_pos")) == {(1, "phone", 4), (2, "phone", 4), (5, "email", 120_000)}
    assert as_set(redact_documents(df).filter("doc_id < 5")) == {(1, "tel [PHONE]"), (2, "tel [PHONE]"), (3, ""), (4, None)}
    assert find_mentions(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,want", [
    ("tel: pięć zero sześć dziewięć zero pięć sześć pięć zero", [("phone", "pięć zero sześć dziewięć zero pięć sześć pięć zero")]),
    ("tel jeden\ndwa\ntrzy\npięć\npięć\nzero\nzero\nsześć\nsześć", [("phone", "jeden\ndwa\ntrzy\npięć\npięć\nzero\nzero\nsześć\nsześć")]),
    ("call five zero six nine zero five sıx five Nİne", [("phone", "five zero six nine zero five sıx five Nİne")]),
    ("jan at firma [dot] pl", [("email", "jan at firma [dot] pl")]),
    ("jan   at\tfirma\tdot\npl", [("email", "jan   at\tfirma\tdot\npl")]),
    ("jan     [at] firma.pl, iga[   małpa ]firma.pl, ewa(  @ )firma ( . ) pl", [("email", "jan     [at] firma.pl"), ("email", "iga[   małpa ]firma.pl"), ("email", "ewa(  @ )firma ( . ) pl")]),
])
def test_disguises_of_any_wording(text, want):
    assert [(k, text[a:b]) for a, b, k in mentions(text)] == want


@pytest.mark.parametrize("seed", range(3))
def test_gates_lose_no_disguise(seed):
    rng = random.Random(seed)
    bits = ["@", " ", "  ", "[", "]", "(", ")", "at", "dot", "kropka", "małpa", ".", "firma", "jan", "\t", "AT", "Dot", "MAŁPA"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 12)))
        assert not _DISGUISE.search(text) or may_be_disguised(_caseless(text)), text
        text = "".join(rng.choice([" ", ", ", "-", "\n", ""]) + rng.choice(list(DIGIT_WORDS)) for _ in range(8))
        assert not _SPELLED.search(text) or transduce(text).text != text, text


@pytest.mark.parametrize("local", ["a" * 81, "k" * 300 + "+" + "oferta.nr-" * 2000 + "7", "x" + "." * 90 + "y"])
def test_long_local_parts(local):
    text = f"Napisz: .+-{local}@firma.example teraz"
    assert [(k, text[a:b]) for a, b, k in mentions(text)] == [("email", f"{local}@firma.example")]
    assert redact(text) == "Napisz: .+-[EMAIL] teraz"


def test_names_of_several_languages_and_outside_the_lists():
    found = lambda t: [t[a:b] for a, b, k in mentions(t) if k == "person"]
    for name in ("John Smith", "Oksana Kowalenko", "Hans Müller", "Emily Clark", "Оксана Коваленко"):
        assert found(f"Wieczorem {name} pokaże dom") == [name]
    # Given names that no list has: announced by what stands before them.
    assert found("Kontakt: Brajan Nowak, po 18") == ["Brajan Nowak"] and found("pan Dżastin Kowalski") == ["Dżastin Kowalski"] and found("Frau Dagny Schmidt ruft an") == ["Dagny Schmidt"]
    for text in ("Das Haus liegt ruhig", "Kontakt Nowe Osady", "Ortsteil Stare Miasto", "ul. Emily Clark", "Contact us"):
        assert found(text) == [], text


def test_identity_numbers_need_a_day_that_exists():
    def number(ten):
        return ten + str(-sum(int(d) * k for d, k in zip(ten, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3))) % 10)

    kinds = lambda ten: [k for _, _, k in mentions(f"PESEL {number(ten)}")]
    assert kinds("9002281234") == ["id_number"] and kinds("0022291234") == ["id_number"]  # 2000 was a leap year
    assert kinds("9002311234") == [] and kinds("0102291234") == [] and kinds("9013011234") == []
