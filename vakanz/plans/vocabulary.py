"""Search vocabulary of the three intents, kept as data.

Notation of one entry: ``term`` exact, ``term~d`` within ``d`` edits, ``term~d/p`` within ``d``
edits with the first ``p`` letters equal, ``^w`` weight. ``( .. )^w`` multiplies the weights of
the entries inside.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vakanz.runtime import BROADCAST_BYTES
from vakanz.schemas import INTENT_TERMS

TASKS, REQUIREMENTS, BENEFITS = "tasks", "requirements", "benefits"
INTENTS = (TASKS, REQUIREMENTS, BENEFITS)

# The vocabulary as it is searched, including words that run together.
AS_PASSED = {
    TASKS: (
        "alltag arbeitsgebiet~1 are bringen^-0.5 ( aufgabe~1 aufgabenbereich~1 "
        "aufgabenbeschreibung aufgabenfeld aufgabengebiet~1 aufgabenschwerpunkt~1 "
        "aufgabenspektrum )^2 bietest challenge chance dein~1 dicheinsatz engagement^0.75 "
        "erwartet field ( hauptaufgaben~2/12 haupttätigkeit~2/14 )^2 herausforderung ihr~1 "
        "machst meine responsibilitie~2/15^1.5 schwerpunkt~1 sie task~1/4^3 themengebiet~2/12 "
        "tun umfasst unterstützen ( verantwortlichkeit~2/18 verantwortung~2/13 )^2 "
        "wirkungsfeld work workspace you~2/3"
    ),
    REQUIREMENTS: (
        "( anforderung~2/5 anforderungsprofil )^2 anwenderkenntnisse~1 are ausmacht auszeichnet "
        "background bedingungen berufserfahrung~2 bietest bist bringen~2/5^2 dein du "
        "einstellungsvoraussetzungen~2/25^3 erfahrungen~2/9^1.5 erforderlich~1 erwarten "
        "erwartungen~1/5^1.25 essential~1 experiences~1/7 fachgebietfachliche~1/8 fachrichtung "
        "fähigkeiten^2 hast have ich ihr~1 kannst kenntnisse~1/8 kompetenz~2/9^2 "
        "kompetenzprofil meine mitbringen mitbringst optimal~3/7 pluspunkt~1^1.25 profil~2/4 "
        "punkten ( qualifications~2/13 qualifikation~2/13 )^2 reference required requirements^2 "
        "sich skills^3 solltensolltest steckbrief stellenanforderung~2/18^2 talent ticken "
        "( voraussetzung~2/13 vorkenntniss~2/12 )^2 wonach worauf you~2/3 zusätzliche"
    ),
    BENEFITS: (
        "angebot are attraktiv ( bekommen bekommst benefit~1 bieten )^2 dein~1 dich dir^1.5 "
        "freuengeboten^1.5 ihnen ihr~1 erwarten kannst konditionen leistungen mehrwert mein "
        "mitarbeitervorteile^3 offer our^1.5 perks^2 salary sie ticken uns unser~1/4 "
        "unternehmensprofil vorteil~1/7^2 wir worauf freuenyou~2/3 zusatzleistungen^2 "
        "zusätzliche perspective~2/6"
    ),
}

# The words of AS_PASSED that run together, and what was meant.
RUN_TOGETHER = {
    "dicheinsatz": "dich einsatz",
    "freuengeboten^1.5": "freuen geboten^1.5",
    "freuenyou~2/3": "freuen you~2/3",
    "fachgebietfachliche~1/8": "fachgebiet fachliche~1/8",
    "solltensolltest": "sollten solltest",
}

_ENTRY = re.compile(
    r"(?P<term>\w+)(?:~(?P<d>\d)(?:/(?P<p>\d+))?)?(?:\^(?P<w>-?[\d.]+))?", re.UNICODE
)


def entries(spelling: str = "as_passed") -> list[tuple[str, str, int, int, float]]:
    """``(intent, term, d, p, w)`` tuples; ``as_written`` splits the run-together words."""
    rows = []
    for intent, text in AS_PASSED.items():
        pieces = [
            word
            for item in text.split()
            for word in (RUN_TOGETHER.get(item, item) if spelling == "as_written" else item).split()
        ]
        open_at = 0
        for piece in pieces:
            if piece == "(":
                open_at = len(rows)
            elif piece.startswith(")"):
                factor = float(piece[2:])
                rows[open_at:] = [(*row[:4], row[4] * factor) for row in rows[open_at:]]
            else:
                m = _ENTRY.fullmatch(piece)
                rows.append(
                    (intent, m["term"], int(m["d"] or 0), int(m["p"] or 0), float(m["w"] or 1))
                )
    return rows


def intent_terms(
    spelling: str = "as_passed", rows: list[tuple[str, str, int, int, float]] | None = None
) -> DataFrame:
    """The vocabulary as a table; marked for broadcast, as its size is known here."""
    chosen = rows or entries(spelling)
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    # A literal table: what is read of it on the driver needs no job.
    values = ", ".join(f"({quoted(i)}, {quoted(t)}, {d}, {p}, {float(w)!r}D)" for i, t, d, p, w in chosen)
    table = SparkSession.active().sql(f"SELECT * FROM VALUES {values} AS t({', '.join(INTENT_TERMS.names)})")
    size = sum(64 + 4 * (len(row[0]) + len(row[1])) for row in chosen)
    return F.broadcast(table) if size <= BROADCAST_BYTES else table
