"""Secrets and disguised identifiers planted in texts of four languages: how many are found, and no others."""

import base64
import random
import string
import time

import pytest

from mixtura.llm import pii, secrets

WORDS = {
    "en": "the quick report about water management in northern towns shows that people often prefer simple answers when prices change".split(),
    "de": "der bericht über wasser in kleinen städten zeigt dass menschen oft einfache antworten vorziehen wenn preise steigen".split(),
    "fr": "le rapport sur la gestion des eaux dans les villes montre que les gens préfèrent souvent des réponses simples".split(),
    "es": "el informe sobre el agua en pueblos pequeños muestra que la gente prefiere respuestas sencillas cuando suben los precios".split(),
}
LETTERS = string.ascii_letters + string.digits


def prose(rng, n=60):
    words = WORDS[rng.choice(list(WORDS))]
    return [rng.choice(words) for _ in range(n)]


def test_planted_secrets(spark):
    rng = random.Random(1)
    rows, planted = [], {}
    for i in range(1500):
        words = prose(rng)
        words += rng.choices(["----------------", "AAAAAAAAAAAAAAAA", "getUserName()", "load_data_from_table", "2024-05-06", "|---|---|", "2001:0db8::1", "isEnabled"], k=2)
        if i % 10 == 0:
            words.append("password=" + "".join(rng.choices(LETTERS, k=20)))
        if i % 5 == 1:
            token = "".join(rng.choices(LETTERS, k=rng.choice([16, 20, 32, 40]))) if i % 2 else base64.b64encode(rng.randbytes(24)).decode()
            words.insert(rng.randrange(len(words)), token)
            planted[i] = token
        rows.append((i, " ".join(words)))
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id: [r.text[x.start : x.end] for x in r.secret_spans if x.kind == "random"] for r in got}
    hits = sum(planted[i] in found[i] for i in planted)
    alarms = sum(len([x for x in v if x != planted.get(i)]) for i, v in found.items())
    assert hits >= 0.95 * len(planted) and alarms <= 0.01 * hits


def disguise(rng):
    """(kind, text that stands for an identifier)."""
    name, host, top = rng.choice(["anna.berg", "jdoe", "luis99", "marie-claire"]), rng.choice(["example", "posteo", "my-mail"]), rng.choice(["com", "de", "org", "berlin"])
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    spell = dict(zip("0123456789", "zero one two three four five six seven eight nine".split(), strict=True))
    number = "49" + digits(9)
    return rng.choice(
        [
            ("email", f"{name} at {host} dot {top}"), ("email", f"{name} [at] {host} [dot] {top}"), ("email", f"{name}(at){host}.{top}"), ("email", f"{name}&#64;{host}.{top}"),
            ("email", f"{name} at {host}.{top}"), ("email", f"{name}@{host}.{top}".replace("a", "а").replace("e", "е")), ("email", f"{name.replace('.', '').replace('-', '')}_at_{host.replace('-', '')}_dot_{top}"),
            ("email", f"{name} at\n{host} dot {top}"), ("email", f"{name} arroba {host} punto {top}"), ("phone", "+" + " ".join(spell[c] for c in number)),
            ("phone", "plus " + " ".join(spell[c] for c in number)), ("phone", "+" + number.translate({48 + i: 0xFF10 + i for i in range(10)})), ("ip", " dot ".join(str(rng.randrange(256)) for _ in range(4))),
            ("ip", "10․1․" + str(rng.randrange(256)) + "․7"),
        ]
    )


def test_planted_disguises():
    rng = random.Random(2)
    hits = planted = alarms = 0
    for i in range(1500):
        words = prose(rng)
        want = None
        if i % 3 == 0:
            want = disguise(rng)
            words.insert(rng.randrange(5, 50), f"; {want[1]} ;")
        text = " ".join(words)
        base, added = pii.spans_of(text)
        found = [(k, text[s:e]) for k, s, e in base + added]
        planted += want is not None
        hits += any(k == want[0] and t == want[1] for k, t in found) if want else 0
        alarms += len([x for x in found if want is None])
    assert hits >= 0.97 * planted and alarms == 0


def test_a_wider_span_stands_beside_the_base_span_it_covers():
    assert pii.spans_of("ⓙohn@example.com") == ([("email", 1, 16)], [("email", 0, 16)])
    assert pii.mask("x ⓙohn@example.com y") == "x <email> y"


@pytest.mark.parametrize("text", ["one " * 100_000, "double " * 100_000, "twenty-" * 100_000, "&#64;" * 100_000, "a_at_b_dot_" * 30_000, " at\n" * 100_000, "plus " * 100_000, "1 ,;:-" * 60_000], ids=range(8))
def test_hostile_texts_in_linear_time(text):
    began = time.perf_counter()
    pii.spans_of(text)
    assert time.perf_counter() - began < 20
