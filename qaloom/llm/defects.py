"""Broken prompt and response pairs.

Each pair of question and answer gets at most one defect, tried in the order
``empty``, ``copies_question``, ``refusal``, ``truncated``, ``other_language``:

* the answer traverses a suffix automaton of the question's words, which gives
  the longest copied stretch at each word.  The copied coverage is the share of
  words in stretches of at least ``STRETCH`` words; an answer that is covered
  less than ``COVERAGE`` is no copy, one that is covered is confirmed by the
  order of its words.  Single words that also stand in the question are chance;
* refusals are composed of parts found by an automaton (see ``refusals``);
* a stack of delimiters, closing marks and the unfinished tails of the short
  answer forms (times, lists, positions, class names) show truncation;
* words vote for languages by stopword lists, and by the classes' and
  positions' names in each language, as short answers have no stopword; class
  names as the labels write them, numbers and positions have no vote.

Defined results: a null answer is empty; without a question (null or blank) an
answer can't copy it nor be in another language; rows without a key are no
case; repeated rows count once.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm.refusals import refuses

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


# --- fixed values ----------------------------------------------------------

#: Class names of foreign objects.
CLASS_NAMES = ("sponge", "clip", "specimen bag", "silicone loop", "external drain", "needle", "gallstone", "specimen", "mesh", "absorbable hemostatic agent")
#: Stand-ins for a missing value, as words joined by a blank.
STAND_INS = frozenset(
    "nan|null|undefined|nil|na|n a|void|missing|tbd|tba|nonetype|nul|nat|empty|blank|unknown|not available|not applicable|not provided|not given|no data|no value|no answer|no response|unspecified"
    "|unbekannt|keine angabe|keine angaben|k a|nicht verfügbar|inconnu|inconnue|non disponible|non renseigné|sans réponse|desconocido|desconocida|no disponible|sin datos|sin respuesta".split("|")
)
CLOSING_MARKS = ".!?…。"
DELIMITERS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»"}
#: Stopwords, which vote for a language.  A word of several languages shares its vote among them.
STOPWORDS = {
    "en": "the of and is are was were be been being in on at to with that this these those it its by for from which what when how who whom whose where why does did do not no yes nothing none every any each all some until while before after because although though since then than has have had having there their they them one would could should can will may must about around near between behind against beside during over under into onto out off up down above below through again once only just still very more most other another same such so if or but nor as your you i my we our he she his her him us me many much few several first second near also both neither nobody somebody something please upper lower left-hand close next across along within without upon yet too",
    "de": "der die das den dem des ein eine einen einem einer eines und ist sind war waren wurde wurden wird werden sein bin mit von vom zu zum zur im in am an auf aus bei nach vor für nicht kein keine keiner keinen keinem keines ja nein wie was wann wo wer wen wem warum welche welcher welches welchen oder aber um ab bis dass weil während obwohl sobald davon dabei damit dazu darin jedoch nur noch einmal es sich über unter hinter neben zwischen oben unten mitte ich sie er wir ihr ihm ihn man durch ohne gegen danach dann dort hier zuletzt auch als wenn schon sehr mehr weniger seit trotz statt etwa rund sowie dieser diese dieses diesem kaum bitte viele viel alle alles jede jeder jedes nichts etwas hat haben hatte kann können soll muss darf denn doch also außer bevor nachdem sonst wieder immer",
    "fr": "le la les l un une des du de d et est sont était étaient être au aux à dans sur sous par pour avec que qui quoi quand combien quelle quel quelles quels où comment pourquoi ne pas non oui aucun aucune ce cette ces cet il elle ils elles on se s y en dès bien car selon entre contre puis rien hormis haut bas milieu je tu nous vous mais donc ou plus moins très près derrière devant côté c qu n m a ont avait avant après lors pendant depuis comme tout tous toute toutes toujours encore aussi leur leurs son sa ses mon ma mes notre votre chez sans vers jusque quelques environ si même lorsque trop peu fait faire ni afin alors ainsi sauf malgré déjà jamais",
    "es": "el la los las un una unos unas de del y e es son era eran ser fue fueron al a en por para con sin que qué quién quiénes cuándo cuánto cuánta cuántos cuántas cómo dónde cuál cuáles no sí ninguno ninguna ningún nada nadie se su sus lo le les está están estaba según entre sobre bajo hasta desde pero muy ya arriba abajo centro yo como más menos o u salvo durante antes después hay esta este estos estas esto ese esa mientras aunque porque cuando donde sino tras cada todo toda todos todas otra otro otros otras algunos algunas algo también si ni me mi te tu nos junto cerca detrás delante dentro fuera tan poco mucho siempre nunca",
}
#: The classes and positions as each language names them; they vote like stopwords.
TERMS = {
    "en": "gauze corner swab quadrant",
    "de": "nadel netz bauchtuch tupfer kompresse bergebeutel beutel gallenstein drainage silikonschlinge schlinge metallclip klammer hämostyptikum präparat links rechts bild objekt fremdkörper",
    "fr": "aiguille compresse éponge sac recueil treillis filet calcul biliaire agent hémostatique drain externe boucle pièce opératoire gauche droite image objet corps étranger agrafe",
    "es": "aguja gasa compresa esponja malla bolsa extracción cálculo biliar hemostático drenaje externo lazo silicona pieza izquierda derecha imagen objeto cuerpo extraño grapa",
}
#: Letters that only one of the languages uses.
LETTER_VOTES = {"ß": "de", "ä": "de", "ö": "de", "ñ": "es", "¿": "es", "¡": "es", "ç": "fr", "œ": "fr", "ê": "fr", "è": "fr", "ù": "fr", "û": "fr", "î": "fr", "ô": "fr", "ó": "es", "í": "es", "á": "es", "ú": "es"}

LANGUAGES = tuple(STOPWORDS)
_VOTES: dict[str, tuple[int, ...]] = {}
for _k, _name in enumerate(LANGUAGES):
    for _w in sorted({*STOPWORDS[_name].split(), *TERMS[_name].split()}):
        _VOTES[_w] = (*_VOTES.get(_w, ()), _k)

# --- copies of the question ------------------------------------------------


class SuffixAutomaton:
    """Suffix automaton of a sequence of words."""

    __slots__ = ("length", "link", "next")

    def __init__(self, sequence: Iterable[str]):
        self.length, self.link, self.next = [0], [-1], [{}]
        last = 0
        for w in sequence:
            cur = self._state(self.length[last] + 1, {})
            p = last
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p == -1:
                self.link[cur] = 0
            else:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = self._state(self.length[p] + 1, dict(self.next[q]))
                    self.link[clone] = self.link[q]
                    while p != -1 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, length: int, following: dict[str, int]) -> int:
        self.length.append(length)
        self.link.append(0)
        self.next.append(following)
        return len(self.length) - 1

    def matches(self, sequence: Iterable[str]) -> list[int]:
        """At each word, the length of the longest stretch ending there that the sequence shares with the automaton's."""
        state, n, out = 0, 0, []
        for w in sequence:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                n = 0
            out.append(n)
        return out


@lru_cache(20_000)
def _automaton(question: tuple[str, ...]) -> SuffixAutomaton:
    return SuffixAutomaton(question)


def in_order(part: list[str], whole: list[str]) -> bool:
    it = iter(whole)
    return all(w in it for w in part)


STRETCH = 2  # words that a copied stretch has at least
COVERAGE = 0.5  # share of an answer's words that copied stretches cover at least


def coverage(answer: list[str], question: list[str], stretch: int = STRETCH) -> float:
    """Share of the answer's words that lie in stretches of at least ``stretch`` words copied from the question."""
    found = _automaton(tuple(question)).matches(answer)
    covered = reach = 0
    for n in reversed(found):
        reach = max(reach - 1, n if n >= stretch else 0)
        covered += reach > 0
    return covered / len(answer) if answer else 0.0


def copies(answer: list[str], question: list[str], lead_in: int = 3, least: int = 5) -> bool:
    """Whether the answer, but for a lead-in, is copied from the question, in its order."""
    if len(answer) < least or len(question) < least or len(answer) > len(question) + lead_in:
        return False
    if coverage(answer, question) < COVERAGE:
        return False
    for lead in range(lead_in + 1):
        rest = answer[lead:]
        # numbers and class names alone, as in a list of times, are no copy
        if len(rest) >= least and sum(w.isalpha() and w not in _CLASS_WORDS for w in rest) >= 3 and in_order(rest, question):
            return True
    return False


_CLASS_WORDS = frozenset(w for name in CLASS_NAMES for w in name.split())

# --- truncation ------------------------------------------------------------

_LEAD = re.compile(r"^\s*(?:final\s+)?answer\s*:\s*", re.IGNORECASE)
_ENTRY = rf"\d+\s*[.)]\s*(?:{'|'.join(sorted(CLASS_NAMES, key=len, reverse=True))})\s*:\s*(?:top|bottom|center|centre|middle)\s*/\s*(?:left|right|center|centre|middle)\s*[.;]?\s*"
_ENTRIES = re.compile(rf"(?:{_ENTRY})+", re.IGNORECASE)
_ENTRY_START = re.compile(rf"\s*\d+\s*[.)]\s*(?:{'|'.join(sorted(CLASS_NAMES, key=len, reverse=True))})", re.IGNORECASE)
_TIME = re.compile(r"\d{2,}:[0-5]\d:[0-5]\d")
_PART_OF_TIME = re.compile(r"\d{1,2}:(?:\d{0,2}|\d{2}:\d?)")
_POSITION = re.compile(r"(?:top|bottom|left|right|upper|lower)\s*[/-]\s*([a-z]*)", re.IGNORECASE)
_CLASS_SET = frozenset(CLASS_NAMES)
_PLAIN = re.compile(r"[\d\s.,:%/-]+")


def open_delimiter(text: str) -> bool:
    """Whether a delimiter is left on the stack at the end of the text."""
    stack: list[str] = []
    for c in text:
        if stack and c == stack[-1]:
            stack.pop()
        elif c in DELIMITERS:
            stack.append(DELIMITERS[c])
    return bool(stack)


def truncated(text: str) -> bool:
    core = _LEAD.sub("", text).strip().rstrip("﻿​")
    if not core:
        return False
    low = core.lower()
    if _PART_OF_TIME.fullmatch(low):
        return True
    if _ENTRY_START.match(core) or re.match(r"\s*\d+\s*[.)]\s+\w", core) and ":" in core:
        if _ENTRIES.fullmatch(core):
            return False
        if _ENTRY_START.match(core):
            return True
    items = [x.strip() for x in low.rstrip(".").split(",")]
    head, tail = items[:-1], items[-1]
    if all(x in _CLASS_SET for x in head):
        if tail in _CLASS_SET or tail == "none":
            return False
        if head and (not tail or any(c.startswith(tail) for c in CLASS_NAMES)):
            return True
        if not head and len(tail) >= 3 and any(c.startswith(tail) for c in CLASS_NAMES):
            return True
    if head and all(_TIME.fullmatch(x) for x in head):
        return not _TIME.fullmatch(tail)
    if m := _POSITION.fullmatch(low):
        return m.group(1) not in ("left", "right", "top", "bottom", "center", "centre", "middle")
    if _PLAIN.fullmatch(core):
        return False
    if open_delimiter(core):
        return True
    n = len(words(core))
    if n < 7:
        return False
    end = core.rstrip("\"'”’»)]*_ \t\n")
    return not end or end[-1] not in CLOSING_MARKS


# --- language --------------------------------------------------------------

_NO_VOTE = re.compile(rf"\b(?:{'|'.join(sorted(CLASS_NAMES, key=len, reverse=True))}|none|top|bottom|left|right)\b", re.IGNORECASE)


def votes(text: str) -> list[float]:
    """Votes for each of LANGUAGES."""
    out = [0.0] * len(LANGUAGES)
    low = _NO_VOTE.sub(" ", text.lower())
    for w in _WORD.findall(low):
        own = _VOTES.get(w, ())
        for k in own:
            out[k] += 1.0 / len(own)
    if not low.isascii():
        for c, n in Counter(c for c in low if c in LETTER_VOTES).items():
            out[LANGUAGES.index(LETTER_VOTES[c])] += 0.5 * min(n, 6)
    return out


@lru_cache(50_000)
def _question_language(shape: str) -> int:
    v = votes(shape)
    second, best = sorted(v)[-2:]
    return v.index(best) if best > 1.3 * second else -1


def other_language(answer: str, question: str) -> bool:
    asked = _question_language(re.sub(r"\d+", "0", question))
    if asked < 0:
        return False
    v = votes(_LEAD.sub("", answer))
    best = max(v)
    return best > 0 and v[asked] < 0.7 * best


# --- all together ----------------------------------------------------------


def defect(question: str | None, answer: str | None) -> str | None:
    """The defect of a pair, or None."""
    if answer is None:
        return "empty"
    w = words(answer)
    if not w or " ".join(w) in STAND_INS:
        return "empty"
    rest = _LEAD.sub("", answer)
    if rest != answer and (not (v := words(rest)) or " ".join(v) in STAND_INS):
        return "empty"
    asked = question if question and not question.isspace() else None
    if asked and len(w) >= 5 and copies(w, words(asked)):
        return "copies_question"
    if refuses(answer):
        return "refusal"
    if truncated(answer):
        return "truncated"
    if asked and other_language(answer, asked):
        return "other_language"
    return None


def find_defects(pairs: DataFrame, table: str = "record_table", key: str = "record_key", question: str = "question", answer: str = "answer") -> DataFrame:
    """(record_table, record_key, defect): the defective pairs.  pairs: string columns of these names."""

    def work(batches):
        for b in batches:
            rows = [(t, k, d) for t, k, q, a in zip(b["t"], b["k"], b["q"], b["a"]) if (d := defect(q, a))]
            yield pd.DataFrame(rows, columns=["record_table", "record_key", "defect"])

    rows = pairs.select(F.col(table).alias("t"), F.col(key).alias("k"), F.col(question).alias("q"), F.col(answer).alias("a")).where("t is not null and k is not null")
    return rows.mapInPandas(work, "record_table string, record_key string, defect string").distinct()


def asked_last(text: str) -> F.Column:
    """The question at the end of a prompt: what follows its last ``Question:``; the whole text if there is none."""
    found = F.regexp_extract(F.col(text), r"(?is)^.*\bquestion:(.*)$", 1)
    return F.when(F.col(text).rlike(r"(?i)\bquestion:"), found).otherwise(F.col(text))
