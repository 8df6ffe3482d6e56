"""Steps are tried where they can change something, and all that trying each of them everywhere finds is found."""

from __future__ import annotations

import random

import numpy as np
import pytest
import regex

from loomcanvas.llm import answers as A
from loomcanvas.llm import encoding as E

SAMPLES = {
    "en": "The harbour café fills the gap despite the façade’s cracks. The lantern can’t help being odd — said the judge.",
    "de": "Die Prüferin prüft beide Entwürfe für längere Zeit. Der Bäcker am Hafen schließt die Lücke in der Nähe der Mühle.",
    "fr": "La dernière étape répète le mot manqué. L’élève relève l’écart après chaque déplacement.",
    "ru": "Курсор исправляет пропущенное слово. Последний паром открывается на рассвете.",
    "zh": "回放工具拒绝了非法步骤。港口的面包店关闭了空隙，没有改动提示。",
}


@pytest.fixture()
def solver():
    return E.Unscrambler(E.model({k: [t] * 8 for k, t in SAMPLES.items()}))


def parts() -> list[str]:
    """Sentences beyond ASCII: clean, garbled by each chain of one step, in capitals, at random."""
    rnd = random.Random(5)
    texts = [*SAMPLES.values(), "ÀÉÎ ÖÜ", "ПАРОМ № 5", "é", "ß\x00ü.", "𠀀 é 🙂", "� a�"]
    for text in SAMPLES.values():
        for true, read in [("utf-8", x) for x in (*E.READ_AS, *E.READ_AS_WIDE)] + list(E.SWAPPED) + [(x, "cp1252") for x in E.WIDE_AS_LATIN]:
            texts.append(text.encode(true, "replace").decode(read, "replace"))
    pool = "".join(c for name in ("cp1252", "mac_roman", "cp437", "koi8_r", "cp1251") for c in E.one_byte(name)) + "  aZ.\n�\ud800中한🙂Ã \x00¥"
    texts += ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 40))) for _ in range(400)]
    texts += [t.upper() for t in texts]
    return list(dict.fromkeys(p for t in texts for p in E.sentences(t) if not p.isascii()))


def test_arrays_make_what_each_step_makes(solver):
    each = parts()
    extra = solver.escapes(each)
    far = np.full(len(each), 1 << 40, np.int64)
    small = np.array([E.SMALL.search(p) is not None for p in each])
    found = [set(x) for x in solver.other_all(each)]
    for step, rows, made, costs in solver.swap_all(each, small, extra, far):
        for i, other in zip(rows.tolist(), made):
            found[i].add((step, other))
        assert (costs == solver.escapes(made)).all()
    assert found == [set(solver.candidates(p)) for p in each]
    assert sum(map(len, found)) > 2_000


def test_choices_are_those_of_every_step_everywhere(solver):
    each = parts()
    solver.choose(set(each))
    solver.weigh({(p, k) for p in each for k in range(len(solver.steps))})
    for p in each:
        quick = int(solver.lengths([p])[0])
        size = {k: int(solver.lengths([x])[0]) if x else 0 for k, x in solver.candidates(p)}
        assert set(solver.choices[p]) == {k for k, n in size.items() if n <= quick - solver.least[k]}, p
        assert {k: solver.weighed[p, k][1] for k in range(len(solver.steps)) if solver.weighed[p, k]} == {k: quick - n for k, n in size.items() if n <= quick + E.DOUBT}, p


def test_no_frame_is_shorter_than_its_bound(solver):
    rnd = random.Random(3)
    texts = ["é", "éa", "中", "a" * 500, "é" * 500, *SAMPLES.values(), *("".join(rnd.choice("éa中") for _ in range(rnd.randrange(1, 9))) for _ in range(300))]
    for t in texts:
        raw = t.encode()
        assert all(len(p.compress(raw)) >= E.FRAME + (1 if t.isascii() else min(len(raw), E.BLOCK)) for both in solver.packers for p in both)


def test_steps_run_only_where_they_may_change_something(solver):
    tried = 0

    def counted(undo):
        def run(text, chars):
            nonlocal tried
            tried += 1
            return undo(text, chars)

        return run

    solver.steps = [(name, counted(undo), cost) for name, undo, cost in solver.steps]
    texts = [SAMPLES[k].replace(".", f" {i}.") for k in ("de", "en", "fr", "ru") for i in range(50)]
    assert not any(affected for affected, _, _ in solver.solve_many(texts))
    assert tried < 1_000  # of 32 steps for each of some 350 sentences


def test_sentences_and_rules_are_those_of_their_patterns():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab.!? \n\t　\x1c\r é’") for _ in range(rnd.randrange(12))) for _ in range(5_000)]
    cut = regex.compile(r"(?<=[.!?]\s|\n)")
    assert [E.sentences(t) for t in texts] == [cut.split(t) for t in texts]
    assert A.squeeze("He said: “N°_5” (É)!") == "hesaidn5é" and A.squeeze("It's_OK, 5-5 \t^") == "itsok55"
    empty = ["n / a", "None.", "(blank)", "null [STOP]", "N<|of no use at all|>one", "undefined" + "." * 90, "tbd​", "Ｎｏｎｅ"]
    full = ["none of these", "null null null", "n" * 11, "undefinedness", "nothing <s>", "missing…………a"]
    assert all(map(A.is_empty, empty)) and not any(map(A.is_empty, full))
