import pytest
from held_out_refusals import REFUSE, SOUND

from qaloom.llm import defects as d

ASK = "Did the Clip leave the picture between 01:16:41 and 01:18:14? Reply yes or no."
DE = "Wie viele Fremdkörper sind um 00:05:40 im Bild?"
FR = "Quelle classe de corps étranger se trouve derrière le côlon gauche après 02:04:27 ?"
ES = "¿Se vuelve a ver la gasa a las 00:10:45? Responda con sí o no."

CASES = [
    (ASK, None, "empty"), (ASK, "", "empty"), (ASK, " ​\n", "empty"), (ASK, "...", "empty"), (ASK, "[]", "empty"), (ASK, "N/A", "empty"), (ASK, "NaN", "empty"), (ASK, "null", "empty"), (ASK, "Answer: ", "empty"),
    (ASK, "none", None), (ASK, "0", None), (ASK, "12 %", None), (ASK, "01:02:03", None), (ASK, "Sponge, Specimen Bag", None), (ASK, "Specimen", None), (ASK, "1. Clip: top/left 2. Specimen Bag: bottom/right", None),
    (ASK, "01:02:", "truncated"), (ASK, "01:2", "truncated"), (ASK, "Sponge, Galls", "truncated"), (ASK, "Sponge,", "truncated"), (ASK, "Absorbable Hemo", "truncated"), (ASK, "1. Clip: top/left 2. Sponge: bott", "truncated"), (ASK, "1. Clip: top/left 2.", "truncated"), (ASK, "top/le", "truncated"), (ASK, "00:01:02, 00:0", "truncated"),
    (ASK, "The trainee asks for the hook because the field was", "truncated"), (ASK, "The trainee asks for the hook because it was dark.", None), (ASK, "The trainee asks for the hook because “it was dark.”", None), (ASK, "The nurse rates the label as “as", "truncated"), (ASK, "Quite clearly seen", None),
    (ASK, "I'm sorry, but I can't give an opinion on recordings of patients.", "refusal"), (ASK, "Leider muss ich diese Anfrage ablehnen.", "refusal"), (FR, "Il ne m'est pas permis d'évaluer cette séquence.", "refusal"), (ES, "Lo siento, pero no puedo opinar sobre estas imágenes.", "refusal"),
    (ASK, "The Clip cannot be seen after 01:17:00 because smoke covers it.", None), (ASK, "The team decline to move the Clip before 01:17:00.", None), (ASK, "I cannot see a change here: the Clip stays where it was.", None),
    (ASK, ASK, "copies_question"), (ASK, ASK.upper(), "copies_question"), (ASK, "You asked: " + ASK, "copies_question"), (ASK, "Did the Clip leave the picture between 01:16:41 and 01:18:14", "copies_question"), (ASK, ASK + " The Clip left it at 01:17:00 and was not seen again.", None), (ASK, "the clip leave picture", None),
    (DE, "ja", None), (DE, "yes", "other_language"), (ASK, "ja", "other_language"), (ES, "no", None), (ASK, "no", None), (DE, "no", "other_language"), (ASK, "aiguille", "other_language"), (FR, "aiguille", None), (FR, "Sponge", None), (DE, "top/left", None), (ASK, "arriba a la izquierda", "other_language"),
    (DE, "Zwei Lesende sind uneins: einmal ist die Nadel gut ausgeleuchtet, einmal fehlt jede Spur.", None), (DE, "The trainee asks for the hook because it was dark.", "other_language"), (ES, "Le porteur de caméra avait relevé 347 éléments, le compte rendu en donne 8.", "other_language"), (FR, "La segunda cirujana pide la pinza bipolar porque el campo se inundó.", "other_language"),
    (ASK, "unknown", "empty"), (ASK, "Not available.", "empty"), (None, "yes", None), ("  ", "aiguille", None), (None, None, "empty"), (ASK, "x " * 50_000 + "end.", None),
]


@pytest.mark.parametrize("question, answer, want", CASES)
def test_cases(question, answer, want):
    assert d.defect(question, answer) == want


def test_suffix_automaton_against_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(50):
        a = [rng.choice("abc") for _ in range(20)]
        b = [rng.choice("abcd") for _ in range(20)]
        got = d.SuffixAutomaton(a).matches(b)
        for i, n in enumerate(got):
            best = next(k for k in range(i + 1, -1, -1) if any(a[j : j + k] == b[i + 1 - k : i + 1] for j in range(len(a) - k + 1)))
            assert n == best


def test_frame(spark):
    rows = [("r", "1", ASK, "", 1), ("r", "1", ASK, "", 2), ("r", None, ASK, "", 3), ("r", "2", ASK, "yes", 4), ("s", "1", None, None, 5)]
    df = spark.createDataFrame(rows, "record_table string, record_key string, question string, answer string, defect int")
    assert sorted(tuple(r) for r in d.find_defects(df).collect()) == [("r", "1", "empty"), ("s", "1", "empty")]
    assert d.find_defects(df.limit(0)).count() == 0


def test_question_at_the_end(spark):
    rows = [("Frame: <image>\nQuestion: a\nQUESTION: b?",), ("no mark",), (None,), ("question:",)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(d.asked_last("u")).collect()]
    assert got == [" b?", "no mark", None, ""]


def test_held_out_refusals():
    found, wrong = sum(d.refuses(x) for x in REFUSE), sum(d.refuses(x) for x in SOUND)
    assert found >= 0.9 * len(REFUSE) and found >= 0.9 * (found + wrong)


def test_refusals_need_a_speech_act():
    assert d.refuses("I cannot really comment on it.") and not d.refuses("I cannot really lift it.")
    assert not d.refuses("I cannot judge the place because smoke hides the clip.")
    assert not d.refuses("") and not d.refuses(". . .") and d.refuses("The clip is there. I won't say anything more, but I must decline.")


def test_the_automaton_decides_on_copies(monkeypatch):
    asked = d.words("where is the clip at the end of the film and who held the mesh before it was cut")
    scattered = ["where", "clip", "end", "film", "held", "before", "cut"]  # in the question's order, but no stretch of it
    assert d.in_order(scattered, asked) and d.coverage(scattered, asked) == 0.0 and not d.copies(scattered, asked)
    stretch = d.words("at the end of the film and who held the mesh")
    assert d.copies(stretch, asked) and d.coverage(["well", *stretch], asked) == len(stretch) / (len(stretch) + 1)
    monkeypatch.setattr(d, "coverage", lambda *a: 1.0)
    assert d.copies(scattered, asked)
