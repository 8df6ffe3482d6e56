"""Models come from all documents and from whole texts."""

from __future__ import annotations

from loomcanvas.llm import encoding as E

FRENCH = "Le théâtre près du château était fermé à cause d’une fête. L’élève préfère le café très léger. "
PLAIN = "x = 1; y = 2; " * 200  # more than 2,000 characters that say nothing of the language


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def test_letters_count_in_all_documents(spark):
    n = 6_000
    rows = [("fr", f"note {i} {'é' if i < 12 else ''}{'ß' if i < 11 else ''}") for i in range(n)]  # 0.2 % is the limit
    models, _ = E.fitted(table(spark, rows + rows[:100]))
    assert "é" in models["fr"][1] and "ß" not in models["fr"][1]


def test_models_do_not_depend_on_partitions_and_merge_in_levels(spark, monkeypatch):
    monkeypatch.setattr(E, "GROUP_CHARS", 2_000)
    monkeypatch.setattr(E, "FAN", 2)
    df = table(spark, [("fr", f"{FRENCH} Nº {i}.") for i in range(150)] + [("de", f"Über die Brücke, Öl {i}.") for i in range(60)])
    models, _ = E.fitted(df)
    assert models == E.fitted(df.repartition(7))[0]
    assert set(models) == {"fr", "de"} and set("éàâ") <= set(models["fr"][1]) and set("üÜÖ") <= set(models["de"][1])
    assert 0 < len(models["fr"][0]) <= E.DICTIONARY_BYTES
    assert E.fitted(df.limit(0)) == ({}, None)


def test_p1_reads_whole_documents(spark, tmp_path):
    from loomcanvas.llm.queries import p1_restored

    table(spark, [("fr", PLAIN + FRENCH * 3 + str(i)) for i in range(20)]).write.parquet(str(tmp_path / "documents.parquet"))
    garbled = FRENCH.encode("cp1252").decode("mac_roman")
    spark.sql("SELECT 'a' AS id, 's' AS source, 'Ask.' AS prompt, '' AS response, timestamp'2024-01-01' AS ingested_at").selectExpr("id", "source", "prompt", f"'{garbled}' AS response", "ingested_at").write.parquet(str(tmp_path / "rollouts.parquet"))
    spark.sql("SELECT 1L AS pair_id, 'Ask.' AS prompt, timestamp'2024-01-01' AS ingested_at").write.parquet(str(tmp_path / "run_arena.parquet"))
    assert [(r.record_key, r.restored, r.chain) for r in p1_restored(spark, str(tmp_path)).collect()] == [("a", FRENCH, "cp1252<mac_roman")]


def test_p2_reads_whole_documents_and_restores_whole_answers(spark, tmp_path):
    from loomcanvas.llm import truncation
    from loomcanvas.llm.queries import p2_rates

    table(spark, [("fr", PLAIN + FRENCH * 3 + str(i)) for i in range(20)]).write.parquet(str(tmp_path / "documents.parquet"))
    garbled = FRENCH.encode("cp1252").decode("mac_roman")
    spark.createDataFrame([("a", "s", "Ask.", garbled, None, None)], "id string, source string, prompt string, response string, action_history array<int>, action_counts map<string,bigint>").selectExpr("*", "timestamp'2024-01-01' AS ingested_at").write.parquet(str(tmp_path / "rollouts.parquet"))
    spark.createDataFrame([("a", "s", None)], "id string, source string, action_history array<string>").selectExpr("*", "timestamp'2024-01-01' AS ingested_at").write.parquet(str(tmp_path / "rollouts_text_actions.parquet"))
    seen = []
    judge = truncation.judge
    try:
        truncation.judge = lambda found, *more: seen.extend(found.collect()) or judge(found, *more)
        assert p2_rates(spark, str(tmp_path)).count() == 1
    finally:
        truncation.judge = judge
    assert [(r.kind, r.core.strip()) for r in seen] == [("ended", FRENCH.strip())]


def test_texts_are_restored_though_the_corpus_has_their_words():
    good, bad = "A avaliação começa no cais e a opção não fica à vista na praça. ", "praÃ§a opÃ§Ã£o"
    solver = E.Unscrambler(E.model({"pt": [good + str(i) for i in range(40)] + [bad, bad + "."], "en": [f"The log of the quay {i}." for i in range(40)]}))
    assert not solver.suspects([bad])
    assert solver.plain([bad, None, good, good + bad + ". �"]) == ["praça opção", None, good, good + "praça opção. �"]


SAID = {
    "fr": FRENCH, "es": "¿Qué hora es? El gato negro duerme bajo la mesa verde. ", "en": "The quiet ledger stays near the bus. ", "de": "Das Heft liegt auf dem Tisch. ", "pt": "O caderno fica na praça do cais. ",
}


def test_languages_are_fitted_on_whole_documents(spark):
    from loomcanvas.llm.answers import LATIN, OWN_MARKS, Languages

    texts = {k: [PLAIN + said + str(i) for i in range(9)] for k, said in SAID.items()}
    _, counts = E.fitted(table(spark, [(k, t) for k, each in texts.items() for t in each]), LATIN, OWN_MARKS)
    tongues = Languages(Languages.of_counts(counts))
    asked = ["Le café est fermé", "El gato duerme", "¿Qué?", "nothing", None]
    assert [x for x, _ in tongues.tell(asked)] == ["fr", "es", "es", None, None]
    assert tongues.tell(asked) == Languages(Languages.fit(texts)).tell(asked)


def test_p5_reads_whole_documents(spark, tmp_path):
    from loomcanvas.llm.queries import p5_found

    table(spark, [(k, PLAIN + said + str(i)) for k, said in SAID.items() for i in range(9)]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", "s", "Le théâtre près du château était fermé ?", "El gato negro duerme bajo la mesa verde.")], "id string, source string, prompt string, response string").selectExpr("*", "timestamp'2024-01-01' AS ingested_at").write.parquet(str(tmp_path / "rollouts.parquet"))
    spark.createDataFrame([], "pair_id bigint, prompt string, response_a string, response_b string, model_a string, model_b string, ingested_at timestamp").write.parquet(str(tmp_path / "run_arena.parquet"))
    assert [(r.record_key, r.defect_type) for r in p5_found(spark, str(tmp_path)).collect()] == [("a", "other_language")]
