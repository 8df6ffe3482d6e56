"""Cases that windows, prefixes, length switches and shortcuts would get wrong."""

from __future__ import annotations

import random

import pytest

from loomcanvas.llm import answers as A
from loomcanvas.llm import lexing as L
from loomcanvas.llm import pairs, ranking
from loomcanvas.llm import mixing, tokenizing
from loomcanvas.llm import sentences as S

MARKER = "<|endoftext|>"


def test_empty_at_any_length():
    for text in ("None " + MARKER * 6, "none" + " " * 500, MARKER * 100, "\n" * 300 + "N/A", "​" * 90 + "nil."):
        assert A.is_empty(text), text[:40]
    for text in ("None of the ledgers stopped " + "x" * 80, "nil desperandum", "e" * 70):
        assert not A.is_empty(text), text[:40]


def test_copies_behind_any_decoration():
    prompt = "It was late. Why does the judge prefer answer 96?"
    for n in (1, 20, 80, 500):
        assert A.is_copy(prompt, "=" * n + "\n" + prompt + "\n" + "=" * n)
    assert not A.is_copy(prompt, "=" * 80 + " because it is shorter")


@pytest.mark.parametrize("after", ["", ".", "...", " [cut]", " [cut].", " <end>.", " <|endoftext|>", "\n\nEND", " (truncated)…", "\n---", " ✂", "\n```\n" + "step = 1\n" * 5 + "```", "\n```\n" + "step = 1\n" * 90 + "```", " " * 400 + "[…]"])
def test_what_was_put_after_a_cut_does_not_end_it(after):
    e = A.Ending("She rewrites the mid" + after)
    assert (e.kind, e.core) == (("ended", "She rewrites the mid.") if after == "." else ("open", "She rewrites the mid"))


def test_refusals_behind_a_long_courtesy():
    courtesy = "Thank you for the kind and very detailed question about the harbour, the ledger and the lantern, " * 4 + "which I have read with care. "
    assert A.is_refusal(courtesy + "I cannot help with that.")
    assert not A.is_refusal("One. Two. Three. Four. I cannot help with that.")


# Ordinary refusals in words that no rule was written from.
HELD_OUT = (
    "Sorry, I'm not able to assist with this request.", "I apologize, but I won't be writing that.", "Unfortunately I am unable to provide an answer here.", "That's not something I can help with.", "I'm afraid I can't do that for you.", "I must respectfully decline this request.",
    "I would prefer not to answer this.", "As an AI model, I can't discuss this topic.", "This goes against my guidelines, so no answer follows.", "I can't, in good conscience, write this.", "I'm not comfortable continuing with this.", "I do not wish to discuss it.", "I'll have to pass on this one.",
    "Leider kann ich diese Frage nicht beantworten.", "Es tut mir leid, aber das kann ich nicht tun.", "Ich möchte dazu nichts schreiben.", "Diese Anfrage muss ich ablehnen.", "Ich bin nicht in der Lage, dabei zu helfen.", "Das darf ich leider nicht schreiben.", "Ich kann Ihnen hier nicht weiterhelfen.",
    "Désolé, je ne peux pas répondre à cette question.", "Je ne suis pas en mesure de vous aider.", "Je préfère ne pas continuer.", "Je dois décliner cette demande.", "Malheureusement, je ne peux pas faire cela.", "Je refuse de répondre.",
    "Lo siento, no puedo responder a eso.", "No estoy autorizado para contestar.", "Me es imposible ayudarte con esto.", "Prefiero no hablar de este tema.", "Lamento no poder ayudar con esta petición.",
    "Desculpe, não posso responder a isso.", "Não estou autorizado a falar sobre isso.", "Prefiro não continuar.", "Infelizmente, não consigo ajudar com esse pedido.",
    "Извините, я не могу ответить на этот вопрос.", "К сожалению, не могу вам помочь.", "Мне запрещено об этом говорить.", "Я вынужден отказаться.", "Я не стану это писать.",
    "抱歉，我无法回答这个问题。", "对不起，我不能帮您写这个。", "我必须拒绝这个请求。", "申し訳ありませんが、お答えできません。", "この件については回答を控えさせていただきます。", "申し訳ございませんが、そのご依頼には応じられません。", "माफ़ कीजिए, मैं इसका उत्तर नहीं दे सकता।", "मुझे इसकी अनुमति नहीं है।",
)
# Answers that speak of not being able, but answer.
NO_REFUSALS = (
    "The bus cannot help being late; the ledger says so.", "The judge refused the first draft and asked for another.", "A cursor can't move beyond the canvas, so the step is clamped.", "Der Cursor kann das Wort nicht löschen, weil er am Anfang steht.", "Le juge ne peut pas voir le brouillon.", "El cursor no puede salir del lienzo.",
    "O cursor não pode sair da tela.", "Курсор не может выйти за край.", "光标不能超出画布。", "カーソルは画面の外に出ることができません。", "She said that I could not be late again.", "The request was long and the answer short.", "Nobody is allowed to touch the lantern.",
)


def test_recall_of_refusals_in_other_words():
    found = [x for x in HELD_OUT if A.is_refusal(x)]
    wrong = [x for x in NO_REFUSALS if A.is_refusal(x)]
    missed = sorted(set(HELD_OUT) - set(found))
    assert len(found) >= 0.85 * len(HELD_OUT), missed
    assert len(wrong) <= 0.1 * len(NO_REFUSALS), wrong


def brute_shortened(rows):
    return {t for t, k in rows if k == "open" and len(t.encode()) >= pairs.LEAST_SHARED and any(u != t and u.startswith(t) and pairs.GOES_ON.match(u, len(t)) for u, _ in rows)}


def test_neighbours_between_a_text_and_its_continuation(spark):
    x = "The cold harbour fills the mid"
    rows = [(x, "open"), (x + ".", "ended"), (x + ".!", "ended"), (x + "dle of the orchard ends.", "ended"), ("短い答えがここで切れてしま", "open"), ("短い答えがここで切れてしまった。", "ended")]
    rnd = random.Random(3)
    for _ in range(300):
        t = "".join(rnd.choice(["aaaaaaaaaaaaaaaaaaaaaaaa", "b", " c", ".", "…", "-"]) for _ in range(rnd.randrange(1, 6)))
        rows.append((t, rnd.choice(["open", "ended"])))
    rows = list(dict(rows).items())
    found = spark.createDataFrame(rows, "core string, kind string")
    got = {r.core for r in pairs.shortened(found).collect()}
    assert got == brute_shortened(rows) and x in got and "短い答えがここで切れてしま" in got


def test_texts_that_span_many_ranges(spark):
    x = "A common beginning of thirty letters and more"
    rows = [(x, "open")] + [(f"{x}.{i:04d}", "ended") for i in range(400)] + [(x + "/", "open"), (x + "zz continues", "ended")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.core for r in pairs.shortened(spark.createDataFrame(rows, "core string, kind string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {x}


def test_all_ways_to_iterate_rest_at_the_same_strengths(spark):
    rnd = random.Random(5)
    names = [f"m{i}" for i in range(12)]
    votes = [(a, b, rnd.randrange(1, 40)) for a in names for b in names if a != b and rnd.random() < 0.5] + [("m0", "m1", 5000)]
    totals = spark.createDataFrame(list({(a, b): (a, b, n) for a, b, n in votes}.values()), "winner string, loser string, votes long")
    items = spark.createDataFrame([(n,) for n in [*names, "alone"]], "model_name string")
    dense = {r.model_name: (r.strength, r.rank_no) for r in ranking.rank(totals, items, "model_name").collect()}
    rows = [tuple(r) for r in totals.collect()]
    sparse = dict(zip(sorted([*names, "alone"]), ranking._stationary(rows, sorted([*names, "alone"]), ranking.SMOOTHING, dense=0)))
    assert all(abs(dense[n][0] - sparse[n]) < 1e-9 for n in dense)
    few = totals.where("winner < 'm4' AND loser < 'm4' AND NOT (winner = 'm0' AND loser = 'm1')")
    some = items.where("model_name < 'm4'")
    driver = {r.model_name: (r.strength, r.rank_no) for r in ranking.rank(few, some, "model_name").collect()}
    joins = {r.model_name: (r.strength, r.rank_no) for r in ranking.rank(few, some, "model_name", driver_pairs=1).collect()}
    assert all(abs(driver[n][0] - joins[n][0]) < 1e-8 and driver[n][1] == joins[n][1] for n in driver)


def test_reachable_shares_are_met_within_a_hundredth(spark):
    rnd = random.Random(8)
    word = lambda n, tag: " ".join(f"{tag}{rnd.randrange(1000)}" for _ in range(n))
    docs = [(i, word(rnd.choice([3, 8, 20, 60, 1500 if i % 97 == 0 else 30]), "w"), rnd.choice(["big", "big", "mid", "small"])) for i in range(900)]
    docs += [(5000 + i, f"short {i}", "short") for i in range(3)] + [(6000 + i, docs[i][1], "mid") for i in range(0, 200, 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    of = {"big": 0.5, "mid": 0.3, "small": 0.19, "short": 0.01}
    targets = spark.createDataFrame([("m", s, share, 2, 0.3) for s, share in of.items()], "mix_name string, source string, target_share double, max_repeats int, corpus_fraction double")
    got = mixing.mix(df, targets, rebalance=True).collect()
    codec = tokenizing.codec(tokenizing.default_path())
    total = sum(len(codec.encode(t)) for _, t, _ in docs)
    held = {s: sum(r.repeats * r.n_tokens for r in got if r.source == s) for s in of}
    assert len({(r.source, r.doc_id) for r in got}) == len(got) and all(r.repeats <= 2 for r in got)
    rest = 0.3 * total - held["short"]
    for s in ("big", "mid", "small"):
        assert abs(held[s] / (rest * of[s] / 0.99) - 1) < 0.01, s


def test_flow_gives_what_short_sources_lack_to_the_others():
    supply = {("a",): 1000, ("b",): 1000, ("c",): 5}
    flow, holds = mixing.share_out(supply, 500, {"a": (0.5, 1), "b": (0.3, 1), "c": (0.2, 2)}, True)
    assert holds == {"a": 306, "b": 183, "c": 10} and sum(flow.values()) == 499
    assert mixing.share_out(supply, 500, {"a": (0.5, 1), "b": (0.3, 1), "c": (0.2, 2)}, False)[1] == {"a": 250, "b": 150, "c": 10}
    assert mixing.fitting(10, {7: 5, 3: 1, 4: 2}) == {7: 1, 3: 1}


def test_long_texts_by_chunks_equal_the_walk(spark):
    rnd = random.Random(4)
    bits = ["He left. ", "“Stop here. Then move on.” was the note. ", "It costs $1.5 m. per year", "\n\n", "\n* one. Two\n* three\n", "[step 1] loss=1.2 ok\n", "(The log agrees.) ", "z. B. schnell und so weiter ", "เคอร์เซอร์อยู่ที่ไหน ", "评审说：「停下。再看一遍。」 ", "and then he said nothing of it, ", "[draft note 12 of the day] ", "3. Mai lief er ", "! ? "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(20, 300))) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (98, None), (99, " " * 900)], "doc_id long, text string")
    want = sorted((i, no, e) for i, t in [*enumerate(texts), (0, texts[0])] for no, e in enumerate(S.unit_ends(t)))
    got = S.split_units(df, "doc_id", "text", with_text=True, long_text=100).collect()
    assert sorted((r.doc_id, r.unit_no, r.unit_end) for r in got) == want
    pieces = {(i, no): t[a:b].strip() for i, t in enumerate(texts) for no, (a, b) in enumerate(zip([0, *S.unit_ends(t)], S.unit_ends(t)))}
    assert all(pieces[r.doc_id, r.unit_no] == r.unit for r in got)


def test_blanks_of_any_number_between_a_stop_and_what_follows():
    for n in (1, 10, 100, 5000):
        assert len(S.unit_ends("He left." + " " * n + ", and then")) == 1, n
        assert len(S.unit_ends("He left." + " " * n + "And then")) == 2, n


def test_counts_equal_plain_counting():
    """Words, trie nodes and contexts of the kernel against dictionaries of strings."""
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["The", "map’s", "lantern", "fills", "x", "1,998", "ends.", "Ends!", "日本", "a-b"]) for _ in range(rnd.randrange(0, 12))) for _ in range(200)] + ["", "\n", "…"]
    keys, seen, ends = L.corpus_keys(texts, lambda k: k == k)
    count = dict(zip(keys.tolist(), seen.tolist()))
    t = L.Tokens(texts)
    words = {}
    last = t.last()
    joined = "\x00".join([*texts, ""])
    for a, b, k, stop, end in zip(t.start, t.end, t.kind, t.stop, last):
        if not stop and not end:
            w = "0" if k == L.DIGIT else joined[a:b].lower()
            words[w] = words.get(w, 0) + 1
    for w, n in words.items():
        if w != "0":
            one = L.Tokens([w])
            assert count[int(L.tagged(L.WORD, one.hash[:1])[0])] == n, w
            for depth in range(1, len(w)):
                want = sum(m for v, m in words.items() if v.startswith(w[:depth]) and len(v) > depth and v != "0")
                if one.kind[0] == L.LETTER and len(one.hash) == 1:
                    node = L.tagged(L.NODE, L.Tokens([w[:depth]]).prefix_hash(one.start[:1], one.start[:1] + depth)) if w[depth - 1].isalpha() else None
                    assert node is None or count[int(node[0])] == want, (w, depth)
    assert (ends <= seen).all()


TEXTS = {
    "en": "The harbour café fills the gap despite the façade’s cracks. The lantern can’t help being odd — said the judge.",
    "de": "Die Prüferin prüft beide Entwürfe für längere Zeit. Der Bäcker am Hafen schließt die Lücke in der Nähe der Mühle.",
    "fr": "La dernière étape répète le mot manqué. L’élève relève l’écart après chaque déplacement.",
    "ru": "Курсор исправляет пропущенное слово. Последний паром открывается на рассвете.",
    "zh": "回放工具拒绝了非法步骤。港口的面包店关闭了空隙，没有改动提示。",
}


def test_every_chain_on_every_sample_is_suspect_and_undone():
    from loomcanvas.llm import encoding as E

    solver = E.Unscrambler(E.model({k: [t] * 8 for k, t in TEXTS.items()}))
    assert solver.suspects([*TEXTS.values(), None, "", "plain", "Die Hafenlücke enthält"]) == []
    bad = {}
    for text in TEXTS.values():
        for true, read in [("utf-8", x) for x in E.READ_AS] + list(E.SWAPPED):
            try:
                table = {b: c for c, b in reversed(E.one_byte(read).items())} | {i: chr(i) for i in range(128)}
                garbled = "".join(table[b] for b in text.encode(true))
            except (UnicodeEncodeError, KeyError):
                continue
            if garbled != text and not garbled.isascii():
                bad[garbled] = text
    assert len(bad) > 40
    assert [list(bad)[i] for i in solver.suspects(list(bad))] == list(bad)
    solved = solver.solve_many(list(bad))
    assert all(affected for affected, _, _ in solved)
    assert sum(restored == text for (_, restored, _), text in zip(solved, bad.values())) >= 0.9 * len(bad)
    assert solver.plain(list(bad)[:5])[0] == list(bad.values())[0]


def test_steps_never_fail_on_odd_texts():
    from loomcanvas.llm import encoding as E

    solver = E.Unscrambler(E.model({k: [t] * 8 for k, t in TEXTS.items()}))
    rnd = random.Random(2)
    pool = "".join(E.one_byte("cp1252")) + "".join(E.one_byte("cp437")) + "".join(E.one_byte("koi8_r")) + "  aZ.\n\ufffd\ud800中🙂Ã "
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 40))) for _ in range(300)]
    assert len(solver.solve_many([*texts, None, "", "\ufffd", "é" * 3000])) == 304
    assert E.Unscrambler({}).solve_many(["Ã¼ber", None])[1] == (False, None, None)


def test_abbreviations_do_not_end_an_answer():
    for text in ("She met Mr.", "See fig.", "Voir p. 96 et fig.", "It is in Abb.…", "“See pág.”", "Es waren 538 Schritte bzw. "):
        e = A.Ending(text)
        assert e.kind == "open" and e.halted, text
    for text in ("It ended at 6 p.m.", "He said no.", "She has a configuration.", "It ended."):
        e = A.Ending(text)
        assert e.kind == "ended" and not e.halted, text


def test_languages_of_short_questions():
    words = {"es": "El cursor avanza hasta el lienzo. ¿Qué muestra el lienzo? ¡Mira! El cursor vuelve.", "pt": "O cursor avança até a tela. O que mostra a tela? Olha! O cursor volta.", "en": "The cursor moves to the canvas. What does the canvas show? Look! The cursor returns."}
    tongues = A.Languages(A.Languages.fit({k: [t] * 6 for k, t in words.items()}))
    told = tongues.tell(["¿Cuándo?", "The canvas", "Курсор", "これは何ですか", "这是什么", "", None, "MOVE +4\nSTOP", "123"])
    assert [k for k, _ in told] == ["es", "en", "ru", "ja", "zh", None, None, None, None]
    assert tongues.wanted(["Translate into German: the canvas", "The canvas", "The canvas"])[0][0] == "de"


def test_limits_with_nulls_and_repeats(spark, tmp_path):
    from loomcanvas.llm.queries import queries

    spark.createDataFrame([("a", 20), ("a", 20), (None, 5), ("b", None), ("c", 0)], "container_kind string, capacity int").write.parquet(str(tmp_path / "pack_limits.parquet"))
    spark.createDataFrame([(1, 1, [5] * 7, 1), (1, 2, None, 1), (None, None, [1], 1)], "shard_idx long, sample_idx long, action_ids array<int>, ingested_at int").write.parquet(str(tmp_path / "trajectories.parquet"))
    got = queries()["p3_packing"](spark, str(tmp_path)).collect()
    assert sorted((r.container_kind, r.piece_len) for r in got) == [("a", 0), ("a", 1), ("a", 7)]
    assert [tuple(r)[:3] for r in queries()["p3_fill"](spark, str(tmp_path)).collect()] == [("a", 1, 8)]
