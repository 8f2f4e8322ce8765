import numpy as np
from pyspark.sql import functions as F

from texloom.llm import language
from texloom.llm.features import WordCodes, words_of
from texloom.llm.language import FieldTraining, LanguageField, _Packed, fit_language, label_language, train_field
from texloom.llm.queries import held_out


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    sizes = np.array([3, 1, 4, 2])
    scores = rng.normal(size=(10, 3))
    start, moves = rng.normal(size=3), rng.normal(size=(3, 3))
    gamma, _, total = _Packed(sizes).posteriors(scores, start, moves)
    begin, logs = 0, 0.0
    for n in sizes:
        weight = np.zeros((n, 3))
        z = 0.0
        for path in np.ndindex(*([3] * n)):
            s = start[path[0]] + sum(scores[begin + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            z += np.exp(s)
            for t, y in enumerate(path):
                weight[t, y] += np.exp(s)
        assert np.allclose(gamma[begin : begin + n], weight / z)
        logs += np.log(z)
        begin += n
    assert np.isclose(total, logs)


def test_grams_match_slices():
    words = ["abc", "z", "abcd", "é"]
    h, counts = WordCodes(words).grams(2, 5)
    assert counts.tolist() == [2, 0, 3, 0] and h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    assert len(set(WordCodes(["ab", "ba", "a", "aa", "ab"]).whole(1).tolist())) == 4


def test_code_switched_words_are_labelled(docs):
    rows = [(r["text"], r["lang"]) for r in docs.where("lang is not null and text is not null").orderBy("doc_id").limit(150).collect()]
    model = train_field([t for t, _ in rows], [y for _, y in rows], FieldTraining(rounds=4))
    by = {}
    for text, lang in rows:
        by.setdefault(lang, []).append(words_of(text)[:30])
    a, b = (max(by[x], key=len) for x in ("en", "fr"))
    label = [model.langs[i] for i in language._of_texts([a + b], model).argmax(axis=1)]
    assert label[: len(a)].count("en") > 0.85 * len(a) and label[len(a) :].count("fr") > 0.85 * len(b)


def test_held_out_accuracy(docs):
    model = fit_language(docs.where(~held_out(F.col("doc_id"))))
    rows = label_language(docs, model, spans=True).where(held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()
    assert rows and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.93 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        assert [s["start"] for s in r["lang_spans"]][:1] == [0] and r["n_changes"] == len(r["lang_spans"]) - 1


def test_odd_rows(odd, none, docs):
    model = fit_language(docs)
    rows = label_language(odd.withColumn("SCORE", F.lit(1)), model).collect()
    assert len(rows) == 10
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert found[2] == found[3] == found[4] == ("und", 0.0) and found[6][0] != "und" and found[7][0] == "fr"
    assert label_language(none, model).count() == 0
    assert {r["lang_pred"] for r in label_language(odd, LanguageField()).collect()} == {"und"}
    assert fit_language(none).langs == []
    kept = {r["doc_id"] for r in label_language(odd, model, least_score=0.4).collect()}
    assert kept.isdisjoint({2, 3, 4}) and 1 in kept


def test_letters_marks_and_numerals(spark, docs):
    assert words_of("Ⅷ ²½ 123 _ !") == [] and words_of("हिन्दी भाषा, l'ÉTÉ x9") == ["हिन्दी", "भाषा", "l", "été", "x"]
    rows = spark.createDataFrame([(1, "²½ 123"), (2, "Ⅷ"), (3, "\u0301\u0302")], "doc_id long, text string")
    assert {(r["lang_pred"], r["score"], r["certainty"]) for r in label_language(rows, fit_language(docs)).collect()} == {("und", 0.0, 0.0)}


def test_a_text_of_all_languages_is_certain(spark, docs):
    model = fit_language(docs)
    by = {r["lang"]: r["text"] for r in docs.where("lang is not null and length(text) between 600 and 1500").orderBy("doc_id").collect()}
    assert len(by) >= 3
    mixed = " ".join(" ".join(by[x].split()[:60]) for x in sorted(by))
    found = label_language(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model)
    row = found.first()
    assert row["score"] < 0.6 and row["certainty"] > 0.8
    assert label_language(found.select("doc_id", "text"), model, least_certainty=0.6).count() == 1


def test_training_keeps_to_its_bytes(docs):
    assert fit_language(docs, how=FieldTraining(sample_bytes=10)).langs == []
    assert len(fit_language(docs, how=FieldTraining(sample_bytes=200_000)).langs) > 1
