from __future__ import annotations

import random

import pytest

from loomcanvas.llm import answers as A
from loomcanvas.llm import encoding as E
from loomcanvas.llm import sentences as S
from loomcanvas.llm import tokenizing as T
from loomcanvas.llm.packing import fullest, plan
from loomcanvas.llm.mixing import route

SAMPLES = {
    "en": ["The harbour café fills the gap despite the façade’s cracks. The lantern can’t help being odd — said the judge."] * 8,
    "de": ["Die Prüferin prüft beide Entwürfe für längere Zeit. Der Bäcker am Hafen schließt die Lücke in der Nähe der Mühle."] * 8,
    "fr": ["La dernière étape répète le mot manqué. L’élève relève l’écart après chaque déplacement."] * 8,
    "es": ["El cursor añade la palabra perdida según el último registro. ¿Dónde está la panadería?"] * 8,
    "ru": ["Курсор исправляет пропущенное слово. Последний паром открывается на рассвете."] * 8,
    "zh": ["回放工具拒绝了非法步骤。港口的面包店关闭了空隙，没有改动提示。"] * 8,
}


@pytest.fixture(scope="module")
def solver():
    return E.Unscrambler(E.model(SAMPLES))


def garbled(text: str, true: str, read: str) -> str:
    return "".join(chr(b) if true == "utf-8" and read == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode(read) for b in text.encode(true))


def test_round_trips_of_chains(solver):
    for text in [s for rows in SAMPLES.values() for s in rows[:1]]:
        for read in ("cp1252", "mac_roman", "cp437", "cp1250"):
            try:
                bad = garbled(text, "utf-8", read)
            except UnicodeDecodeError:
                continue
            assert solver.solve(bad)[:2] == (True, text), (read, bad)
    assert solver.solve(garbled(garbled(SAMPLES["de"][0], "utf-8", "cp1252"), "utf-8", "cp1252"))[:2] == (True, SAMPLES["de"][0])
    assert solver.solve(SAMPLES["ru"][0].encode("koi8_r").decode("cp1251"))[:2] == (True, SAMPLES["ru"][0])


def test_clean_lost_and_empty_texts(solver):
    for text in [None, "", "plain", *(rows[0] for rows in SAMPLES.values())]:
        assert solver.solve(text)[0] is False
    assert solver.solve("Die L�cke")[:2] == (True, None)
    half = SAMPLES["en"][0] + " " + garbled(SAMPLES["en"][0], "utf-8", "cp1252")
    assert solver.solve(half)[1] == SAMPLES["en"][0] + " " + SAMPLES["en"][0]


CODEC = T.codec(T.default_path())


def merges_one_by_one(piece: bytes) -> list[int]:
    """The plain rule: merge the adjacent pair of lowest rank until there is none."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        ranks = [(CODEC.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(ranks)
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [CODEC.ranks[p] for p in parts]


def test_encoder_equals_plain_merges():
    rnd = random.Random(5)
    for _ in range(3000):
        piece = "".join(rnd.choice("abcdeéstion中แ🙂 0’") for _ in range(rnd.randrange(1, 30)))
        assert list(CODEC.encode_piece(piece)) == merges_one_by_one(piece.encode())


def test_encoder_round_trip_and_edges():
    assert CODEC.encode(None) == [] and CODEC.encode("") == []
    for text in ["<|endoftext|> is text", "a" * 5000, "\x00\x1f  \r\n\t", "中" * 2000, "x̣́ 👩‍🔬"]:
        assert CODEC.decode(CODEC.encode(text)).decode() == text
    assert 50256 not in CODEC.encode("<|endoftext|>")


CASES = [
    ("Mr. Tarn left. He came back.", ["Mr. Tarn left.", "He came back."]),
    ("“Stop here. Then move on.” was all the note said. Next.", ["“Stop here. Then move on.” was all the note said.", "Next."]),
    ("It costs $1.5 m. per year. Loss 9.56. Even so.", ["It costs $1.5 m. per year.", "Loss 9.56.", "Even so."]),
    ("They left at 6 p.m. In practice it ended.", ["They left at 6 p.m.", "In practice it ended."]),
    ("It paused ... and went on. Really?! Yes.", ["It paused ... and went on.", "Really?!", "Yes."]),
    ("Am 3. Mai lief er, z. B. schnell. „Wo?“, fragte sie. Gut.", ["Am 3. Mai lief er, z. B. schnell.", "„Wo?“, fragte sie.", "Gut."]),
    ("「終わった？」と彼女は聞いた。驚いた！", ["「終わった？」と彼女は聞いた。", "驚いた！"]),
    ("评审说：「停下。再看一遍。」这条轨迹。", ["评审说：「停下。再看一遍。」", "这条轨迹。"]),
    ("เคอร์เซอร์อยู่ที่ไหน ผืนผ้าใบเก็บ 93 คำแรกไว้ จบ", ["เคอร์เซอร์อยู่ที่ไหน", "ผืนผ้าใบเก็บ 93 คำแรกไว้", "จบ"]),
    ("Heading\n\n* one. Two\n* three\nwrapped\n\nEnd", ["Heading", "* one.", "Two", "* three\nwrapped", "End"]),
    ("[step 1] loss=1.2 ok\n[step 2] DELETE x3; toks/s 2.0", ["[step 1] loss=1.2 ok", "[step 2] DELETE x3; toks/s 2.0"]),
    ("The long\nline goes on. (The log agrees.) So it ends.The next.", ["The long\nline goes on.", "(The log agrees.)", "So it ends.", "The next."]),
    ("«Τελείωσε;» ρώτησε. Πού είναι; Εδώ.", ["«Τελείωσε;» ρώτησε.", "Πού είναι;", "Εδώ."]),
    ("निर्णायक ने कहा, “रुको। फिर देखो।” नाव है।", ["निर्णायक ने कहा, “रुको। फिर देखो।”", "नाव है।"]),
]


@pytest.mark.parametrize(("text", "units"), CASES)
def test_sentence_units(text, units):
    ends, last, got = S.unit_ends(text), 0, []
    for e in ends:
        got.append(text[last:e].strip())
        last = e
    assert got == units


def test_scan_of_chunks_equals_the_walk():
    rnd = random.Random(2)
    for _ in range(60):
        text = " ".join(rnd.choice(CASES)[0] + rnd.choice(["", "\n\n", "“", "(", " »"]) for _ in range(30))
        want = S.unit_ends(text, 1 << 30)
        for chunk in (1, 3, 17):
            assert S.unit_ends(text, chunk) == want
    assert S.unit_ends(None) == S.unit_ends("") == S.unit_ends(" \n​\t") == []


def test_answer_rules():
    for text in (None, "", " \n​", "N/A", "“none”", "<|endoftext|>", "[END_OF_RESPONSE]", "()", "—"):
        assert A.is_empty(text), text
    for text in ("Yes", "3 %", "0", "No harbour"):
        assert not A.is_empty(text), text
    for text in ("I’m sorry, but I can't help with that request.", "Request declined. Try a safer topic.", "Dazu darf ich keine Auskunft geben.", "很抱歉，我不能帮助您完成这件事。"):
        assert A.is_refusal(text), text
    for text in ("I’m sorry for the yellow note; the ladder was late.", "I refuse to call that kettle dusty.", "Sorry to say, the bus rejects an illegal step.", "桐原先生拒绝了非法步骤。"):
        assert not A.is_refusal(text), text
    prompt = "It was late. Why does the judge prefer answer 96?"
    for text in (prompt, prompt.upper(), f"> {prompt}", f"Answer: {prompt}", f"{prompt} {prompt}", "Why does the judge prefer answer 96?"):
        assert A.is_copy(prompt, text), text
    assert not A.is_copy(prompt, prompt + " Because.") and not A.is_copy(None, "x") and not A.is_copy("", "x")


def test_endings():
    kinds = {"It ended.": "ended", "It ended”": "open", "rewrites the mid": "open", "(Look!)": "ended", "It ended. 🍞🍞": "ended", "It is\n```\nMOVE +4\nSTOP\n```": "open", "MOVE +4\nSTOP": "code", "": "empty"}
    for text, kind in kinds.items():
        assert A.Ending(text).kind == kind, text
    assert A.Ending("opens t…").core == "opens t" and A.Ending("It ends <end>").core == "It ends"


def test_bins_are_as_full_as_can_be():
    rnd = random.Random(4)
    for _ in range(200):
        counts = {rnd.randrange(1, 30): rnd.randrange(1, 4) for _ in range(6)}
        items = [k for k, n in counts.items() for _ in range(n)]
        sums = {0}
        first = max(items)
        items.remove(first)
        for x in items:
            sums |= {s + x for s in sums if s + x <= 40 - first}
        got = fullest(counts, 40)
        assert sum(k * n for k, n in got.items()) == first + max(sums) and all(n <= counts[k] for k, n in got.items())
    rows, containers = plan({5: 7, 3: 2, 10: 1}, 10)
    assert sum((to - start) for _, start, to, _, _ in rows) == 10 and containers >= 6
    assert plan({}, 10) == ([], 0)


def test_flow_serves_all_that_can_be_served():
    flow = route({("a",): 10, ("b",): 5, ("a", "b"): 10}, {"a": 20, "b": 12}, {"a": 1, "b": 1})
    assert sum(n for (_, s), n in flow.items() if s == "a") + sum(n for (_, s), n in flow.items() if s == "b") == 25
    again = route({("a",): 10}, {"a": 25}, {"a": 2})
    assert again == {(("a",), "a"): 20}


def test_a_letter_within_a_word_declines_nothing():
    assert not A.is_refusal("The kitchen can’t help being bright.") and not A.is_refusal("If I were asked, the whistle can’t help.")
