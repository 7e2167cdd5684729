"""Names of people and words about one person's health in text.

Each word of a text is tagged with a letter (capitalised, connector, other), words one blank apart stand together, and
names are runs that a pattern over the tags finds; lists of given and family names are the caller's.  Health words count
where their sentence is about one person: it holds a name, or speaks of one somebody.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Fixed values, folded: what makes a person of the name behind it, and which of them are no part of a name.
TRIGGERS = frozenset("NINA NINO SENORA SENOR RESIDENTE DONA DON PACIENTE MAMA PAPA ABUELITA ABUELITO SOR".split())
TITLES = frozenset("DONA DON SENORA SENOR SOR".split())
#: Saints, after whom places are called, and words within two of which a name is that of a place.
SAINTS = frozenset(("SAN", "SANTA", "SANTO"))
PLACES = frozenset(
    "HOGAR ASILO FUNDACION COLONIA CALLE AVENIDA AV PARROQUIA COLEGIO ESCUELA HOSPITAL INSTITUTO ORGANIZACION ASOCIACION CASA CENTRO"
    " CLINICA CAPILLA TEMPLO PLAZA BARRIO MUNICIPIO ESTADO CONGREGACION ORDEN ALCALDIA DELEGACION DEMARCACION".split()
)
CONNECTORS = frozenset(("de", "del", "la", "las", "los", "y"))
#: Words about health, whole or as beginnings of words, and who a sentence about one person speaks of.
HEALTH_WORDS = "DOSIS ALZHEIMER DEMENCIA VIH EPILEPSIA DISCAPACIDAD EXPEDIENTE TRATAMIENTO".split()
HEALTH_STEMS = "DIAGNOSTIC PADECE MEDICAMENT DIABET HIPERTENSI PSIQUIATRIC ALERGIA".split()
ONE_OF = "SENORA SENOR NINA NINO ABUELITA ABUELITO RESIDENTE PACIENTE JOVEN ADULTA ADULTO ANCIANA ANCIANO".split()
KIN = "MAMA PAPA HIJO HIJA ABUELA ABUELO".split()
ROOMS = ("CAMA", "HABITACION")
SENTENCE_ENDS = ".!?\n;"
#: How sure a name is with a trigger and without, a health word beside a name and without.
NAME_SURE, HEALTH_SURE = (0.9, 0.6), (0.9, 0.7)

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile("C(?:c?C){0,3}")


def _any(words: list[str] | tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


_HEALTH = re.compile(rf"\b(?:{_any(HEALTH_WORDS)}|{_any(HEALTH_STEMS)}\w*)\b")
_SOMEBODY = re.compile(rf"\b(?:(?:LA|EL|UNA|UN) {_any(ONE_OF)}|UNA DE LAS|UNO DE LOS|SU {_any(KIN)}|{_any(ROOMS)} \d+|ELLA)\b")


@dataclass(frozen=True)
class Lists:
    """Folded given and family names, and folded phrases that are nobody's name (the institution's own)."""

    given: frozenset[str]
    family: frozenset[str]
    safe: frozenset[str] = field(default_factory=frozenset)


class _Folded(dict):
    """Words by number, folded when they are first asked for: few of a text's words stand in or before a name."""

    def __init__(self, words: list[re.Match], fold):
        super().__init__()
        self.words, self.fold = words, fold

    def __missing__(self, i: int) -> str:
        self[i] = self.fold(self.words[i][0])
        return self[i]


def find_names(text: str, fold, lists: Lists) -> list[tuple[int, int, float]]:
    """(start, end, confidence) of each name: a given and a family name together, or a known name behind a trigger."""
    words = list(_WORD.finditer(text))
    folded = _Folded(words, fold)

    def tag(w: str) -> str:
        if w[0].isupper():
            return "C" if len(w) > 1 and not w.isupper() and any(c.islower() for c in w[1:]) else "c" if w.lower() in CONNECTORS else "."
        return "c" if len(w) <= 3 and w.lower() in CONNECTORS else "."

    tags, owner = [], []
    for i, m in enumerate(words):
        if i and text[words[i - 1].end() : m.start()] != " ":
            tags.append(" ")
            owner.append(-1)
        tags.append(tag(m[0]))
        owner.append(i)
    out = []
    for run in _RUN.finditer("".join(tags)):
        own = owner[run.start() : run.end()]
        first = own[0]
        trigger = run.start() > 0 and owner[run.start() - 1] >= 0 and folded[first - 1] in TRIGGERS
        while own and folded[own[0]] in TITLES:
            trigger = True
            own = own[1:]
        named = [i for i in own if words[i][0].lower() not in CONNECTORS or words[i][0][0].isupper()]
        named = [i for i in named if folded[i] not in SAINTS]
        if not named or any(folded[i] in PLACES for i in range(max(0, first - 2), first)):
            continue
        given, family = [folded[i] in lists.given for i in named], [folded[i] in lists.family for i in named]
        pair = any(f and any(g for n, g in enumerate(given) if n != k) for k, f in enumerate(family))
        if not (pair or trigger and (any(given) or any(family))):
            continue
        start, end = words[named[0]].start(), words[named[-1]].end()
        said = fold(text[start:end])
        if not any(s and (s in said or said in s) for s in lists.safe):
            out.append((start, end, NAME_SURE[0] if trigger else NAME_SURE[1]))
    return out


def find_health(folded: str, places: list[int] | range, names: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """(start, end, confidence) of the health words in sentences about one person; ``names`` in places of the original."""
    out = []
    for m in re.finditer(f"[^{re.escape(SENTENCE_ENDS)}]+", folded):
        hits = list(_HEALTH.finditer(m[0]))
        if not hits:
            continue
        first, last = places[m.start()], places[m.end() - 1] + 1
        beside = any(first <= a and b <= last for a, b, _ in names)
        if beside or _SOMEBODY.search(m[0]):
            sure = HEALTH_SURE[0] if beside else HEALTH_SURE[1]
            out += [(places[m.start() + h.start()], places[m.start() + h.end() - 1] + 1, sure) for h in hits]
    return out
