"""Random tokens without digits, and short ones, among prose."""

from __future__ import annotations

import random
import string

from claimloom.llm import secrets
from tests.llm.util import docs

PROSE = (
    "The committee considered the responsibilities of the international organisation and its representatives "
    "Die Verantwortlichkeiten der Geschwindigkeitsbegrenzung wurden ausdrücklich besprochen und aufgeschrieben "
    "los representantes consideraron detenidamente las responsabilidades internacionales de la organización "
    "telecommunications characteristics straightforward user-friendly thisIsAnOrdinaryIdentifier getElementById "
)


def test_tokens_without_digits_and_short_ones(spark):
    rng = random.Random(4)
    signs = {0: (string.ascii_lowercase, 16), 1: (string.ascii_letters, 24), 2: (string.ascii_letters + string.digits, 14)}
    made = []
    for k in range(60):
        alphabet, n = signs[k % 3]
        made.append("".join(rng.choice(alphabet) for _ in range(n)))
    made = [x if i % 3 < 2 else x[:-1] + "7" for i, x in enumerate(made)]
    words = PROSE.split()
    texts = [(i, f"{PROSE} see {t} here") for i, t in enumerate(made)]
    texts += [(100 + i, " ".join(rng.choice(words) for _ in range(200))) for i in range(60)]
    got = {r.doc_id: r for r in secrets.secrets(docs(spark, texts)).collect()}
    found = [sum(got[i].n_random for i in range(k, 60, 3)) for k in range(3)]
    assert found[0] >= 17 and found[1] >= 17 and found[2] >= 10, found
    assert all(got[i].n_random <= 1 for i in range(60)) and not any(got[100 + i].n_random for i in range(60))
