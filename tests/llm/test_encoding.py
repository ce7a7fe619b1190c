import random

import numpy as np
import pytest

from qaloom.llm import encoding as e

FRENCH = "La dernière vue nette date de midi ; l'agent y est coupé par le bord. À côté de la rate, le relevé demeure très étayé après la baisse de pression, où l'été dépassé paraît complet."
GERMAN = "Für etwa zwölf Sekunden ist die Nadel außerhalb der Schärfe, danach verdeckt die Fächerhülse das Bild. Der Übergabezettel zählt größere Stücke über dem großen Gekröse."
SPANISH = "Según la médica, el índice señala imágenes; ¿quién comprobó que el cálculo quedó detrás del hígado? La cánula de aspiración está allí."
ENGLISH = "The answer “in” the review form – as “seen” – is hard to repeat… at 37 °C and 30° with ½ turn."
SOUND = ["Label: À-Ã-Â are the drawing classes.", "The Romanian label says ÎNCĂRCARE and ÂNTÂI.", "A Cyrillic sticker «наклейка 12» was left.", "The Greek note says «σφουγγάρι» next to a ✓ mark.", "Table: │ clip │ 3 │ ├────┤", "Angle α = 30°, width 5 µm, spread ± 0,4.", "®Tessaval™ †old ‡older ¶ see ¿dónde?", "cut · cut ·."]
WRONG = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp1251")]


def corpus(n=200):
    rng = random.Random(1)
    texts = []
    for _ in range(n):
        for t in (FRENCH, GERMAN, SPANISH, ENGLISH):
            w = t.split(" ")
            k = rng.randrange(len(w) // 2)
            texts.append(" ".join(w[k:]))
    return texts + SOUND * 12


def model(texts):
    total = np.zeros(e.N_CLASSES**2, dtype=np.int64)
    for t in texts:
        np.add.at(total, *np.unique(e.pair_codes(t), return_counts=True))
    code = np.flatnonzero(total)
    return e.PairModel(code, total[code])


@pytest.fixture(scope="module")
def restorer():
    bad = [t.encode(a, "ignore").decode(b, "ignore") for a, b in WRONG for t in (FRENCH, GERMAN)]
    return e.Restorer(model(corpus() + bad))


@pytest.mark.parametrize("stored, read", WRONG)
@pytest.mark.parametrize("text", [FRENCH, GERMAN, SPANISH])
def test_round_trips(restorer, stored, read, text):
    whole = text.encode(stored)
    try:
        garbled = whole.decode(read)
    except UnicodeDecodeError:
        pytest.skip("not all bytes have a meaning there")
    found = restorer.restore(garbled)
    assert found is not None
    same = sum(a == b for a, b in zip(found[0], text))
    assert found[0] == text if stored == "utf-8" else same / len(text) > 0.97


def test_in_part_and_twice(restorer):
    part = ENGLISH + " " + GERMAN.encode().decode("cp1252", "replace").replace("�", "") + " " + FRENCH
    assert restorer.restore(part) is not None and FRENCH in restorer.restore(part)[0]
    twice = FRENCH.encode().decode("latin-1").encode().decode("latin-1")
    assert restorer.restore(twice)[0] == FRENCH


def test_lost_characters(restorer):
    got = restorer.restore("Le relev� demeure trop grossier.")
    assert got[2] == 1 and "�" in got[0]


@pytest.mark.parametrize("text", [FRENCH, GERMAN, SPANISH, ENGLISH, *SOUND, "", "plain ascii"])
def test_sound_texts(restorer, text):
    assert restorer.restore(text) is None


def test_maximal_segments_against_brute_force():
    def brute(score, lo, hi):  # the leftmost longest best segment, then both sides of it
        best, at = 0, None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                s = sum(score[i:j])
                if s > best + 1e-9:
                    best, at = s, (i, j)
        return [] if at is None else brute(score, lo, at[0]) + [at] + brute(score, at[1], hi)

    rng = random.Random(3)
    for _ in range(60):
        score = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 100 for _ in range(14)]
        assert e.maximal_segments(np.array(score)) == brute(score, 0, len(score))


def test_frame(spark):
    texts = corpus(60)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(90_001, FRENCH.encode().decode("cp1252"), 1), (90_001, FRENCH.encode().decode("cp1252"), 1), (90_002, None, 1), (None, "Ã©", 1), (90_003, "", 1), (90_004, "x�y " * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = {r["doc_id"]: r for r in e.restore_encoding(df).collect()}
    assert set(got) == {90_001, 90_004} and got[90_001]["restored"] == FRENCH and got[90_004]["lost"] == 5000
    assert e.restore_encoding(df.limit(0)).count() == 0


@pytest.mark.parametrize("stored, read", [("utf-8", "cp1252"), ("utf-8", "cp437"), ("cp1252", "mac_roman")])
def test_garbled_copies_of_a_third_of_the_rows(spark, stored, read):
    """Pair counts, runs and outcome are the same however often a garbled text is repeated."""
    texts = list(dict.fromkeys(corpus(100)))
    garbled = FRENCH.encode(stored, "ignore").decode(read, "ignore")
    copies = len(texts) // 2
    rows = [(i, t) for i, t in enumerate(texts)] + [(100_000 + i, garbled) for i in range(copies)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pairs = lambda d: {r["code"]: r["n"] for r in e.pair_counts(d).collect()}
    assert pairs(df) == pairs(df.where(f"doc_id <= {100_000}"))
    got = {r["doc_id"]: r["restored"] for r in e.restore_encoding(df).collect()}
    assert set(got) == set(range(100_000, 100_000 + copies)) and len(set(got.values())) == 1


def test_segments_near_wanted_positions():
    rng = random.Random(5)
    for _ in range(200):
        score = np.array([rng.choice([-4, -2, -1, 1, 2, 3]) + rng.random() / 100 for _ in range(80)])
        wanted = np.zeros(80, dtype=bool)
        wanted[rng.sample(range(80), 3)] = True
        everything, near = e.maximal_segments(score), e.maximal_segments(score, wanted)
        assert set(near) <= set(everything)
        assert {s for s in everything if wanted[s[0] : s[1]].any()} <= set(near)


def test_bits_do_not_depend_on_the_size_of_a_large_corpus():
    rng = np.random.default_rng(4)
    code = np.unique(rng.integers(0, e.N_CLASSES**2, 3000))
    n = rng.integers(1, 1_000_000, len(code))
    small, large, larger = (e.PairModel(code, n * k) for k in (1, 100, 1_000_000))
    assert n.sum() > e.REFERENCE and np.allclose(small.bits, large.bits) and np.allclose(large.bits, larger.bits)
    assert small.threshold == large.threshold == larger.threshold
