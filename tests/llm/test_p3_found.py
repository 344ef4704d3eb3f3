import random

import __spark_entry__ as e
import numpy as np
import pytest
from weftspark.llm.defects import LEAST_ODDS, REFUSAL_ODDS, Endings, copied, fit_languages, fit_refusals, plain, speech, wanted
from weftspark.llm.words import words

SF = "/root/testdata/sf0.01"
QUESTION = "Explain to a new reader how the lamp was lit before the storm came and why nobody kept it burning through the night"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = max(row[j], last[j] + 1 if x == y else last[j + 1])
    return row[-1]


def test_copied_is_four_fifths_of_the_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        q = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))]
        a = [w for w in q * rng.choice((1, 2)) if rng.random() > 0.15] + [rng.choice("xyz") for _ in range(rng.randrange(3))]
        again = q * (-(-len(a) // len(q)) + (len(a) > len(q))) if a else q
        assert copied(a, q) == (bool(a) and lcs(a, again) * 5 >= 4 * len(a))


def test_copied():
    q = words(QUESTION)
    assert copied(q, q) and copied(q + q, q) and copied(words('> "' + QUESTION.upper() + '"'), q) and copied(q[3:], q)
    assert not copied(q + words("It was lit with a match that stood by the door and it burnt well enough"), q)
    assert not copied(q[::-1], q) and not copied([], q) and not copied(q, [])


@pytest.mark.parametrize("question, language, yes", [("Answer in French, please. Why?", "fr", True), ("Réponds en anglais.", "en", True), ("用英语回答", "en", True), ("A Frenchman came", "fr", False), ("Why?", "de", False)])
def test_wanted(question, language, yes):
    assert wanted(question, language) == yes


def test_held_out_languages(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and lang is not null").orderBy("doc_id").collect()]
    model = fit_languages(rows)
    held = {"en": "They never said when it would be ready.", "de": "Wir haben lange nichts von der Antwort gehört.", "fr": "Nous avons vu la question avec le juge.", "es": "La respuesta no tiene que ver con el modelo."}
    scores, _ = model.scores([speech(t) for t in held.values()])
    assert [model.names[i] for i in scores.argmax(axis=1)] == list(held)


def test_refusals_and_endings_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/preference_pairs.parquet").where("pair_id % 4 = 3").selectExpr("chosen[size(chosen) - 1].content as a").collect()
    answers = [r.a for r in rows if r.a and r.a.strip()]
    documents = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()]
    model = fit_refusals(answers, documents)
    texts = ["Этот вопрос очень важен для нас, и ответ стоит у самой реки.", "这个问题对我们非常重要，而且新的回答每周都在增长。", "Sorry, but that is a thing I cannot help you with.", "Ich kann dabei leider nicht helfen.", "The lamp was lit before the storm and we kept it burning until the morning came."]
    scores, sizes = model.scores([plain(t) for t in texts])
    assert [bool(x) for x in (scores[:, 1] - scores[:, 0]) > np.maximum(REFUSAL_ODDS * sizes, LEAST_ODDS)] == [False, False, True, True, False]
    half = len(answers) // 2
    endings = Endings.fitted(answers[:half])
    sound = [a for a in answers[half:] if a.rstrip()[-1] in ".?!"]
    rng = random.Random(5)
    cut = [t for a in sound if len(a) > 80 and (t := a[: rng.randrange(40, len(a) - 2)].rstrip())[-1].isalnum()]
    assert sum(map(endings.cut, sound)) <= 0.01 * len(sound)
    assert sum(map(endings.cut, cut)) >= 0.95 * len(cut)


def turn(answer, question=QUESTION):
    return [{"role": "user", "content": question}] + ([{"role": "assistant", "content": answer}] if answer != "none" else [])


def test_found(spark, tmp_path):
    for t in ("documents", "preference_pairs", "alpaca_eval_outputs"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0 if t == "alpaca_eval_outputs" else 10**6).write.parquet(f"{tmp_path}/{t}.parquet")
    pairs = spark.read.parquet(f"{SF}/preference_pairs.parquet")
    kind = pairs.schema["chosen"].dataType.simpleString()
    sound = "The lamp was lit with a match, and the storm put it out again."
    rows = [
        (10**6, turn(None), turn("$ERROR$")),
        (10**6 + 1, turn("none"), turn("**\n<p></p>")),
        (10**6 + 2, turn("Sorry, I cannot assist with this request."), turn(QUESTION.lower())),
        (10**6 + 3, turn("Die Antwort steht in dem Bericht, und die Frage ist damit erledigt, weil es keine andere gibt."), turn(sound + " Then nobody cou")),
        (10**6 + 4, turn(sound), turn("Die Antwort steht in dem Bericht, und die Frage ist damit erledigt.", "Answer in German, please. " + QUESTION)),
        (10**6 + 5, [], None),
    ]
    own = spark.createDataFrame(rows * 2, f"pair_id bigint, chosen {kind}, rejected {kind}")
    pairs.select("pair_id", "chosen", "rejected").unionAll(own).write.mode("overwrite").parquet(f"{tmp_path}/preference_pairs.parquet")
    answers = [(1, [{"role": "user", "content": QUESTION}], a) for a in (None, [])] + [(2, [{"role": "user", "content": QUESTION}], [sound, None, "", sound]), (3, None, [sound, "I must decline this request, and I hope you understand."])]
    spark.createDataFrame(answers, f"gen_id bigint, prompt_messages {kind}, gen_answers array<string>").write.parquet(f"{tmp_path}/gen_preference_pairs.parquet")
    found = [tuple(r) for r in e.queries()["p3_found"](spark, str(tmp_path)).collect() if r.record_id >= 10**6 or r.answer_field == "gen_answers"]
    assert sorted(found) == sorted(
        [("chosen", 10**6, 0, "empty"), ("rejected", 10**6, 0, "empty"), ("chosen", 10**6 + 1, 0, "empty"), ("rejected", 10**6 + 1, 0, "empty"), ("chosen", 10**6 + 2, 0, "refusal"), ("rejected", 10**6 + 2, 0, "copy")]
        + [("chosen", 10**6 + 3, 0, "language"), ("rejected", 10**6 + 3, 0, "truncated"), ("chosen", 10**6 + 5, 0, "empty"), ("rejected", 10**6 + 5, 0, "empty"), ("gen_answers", 2, 1, "empty"), ("gen_answers", 2, 2, "empty"), ("gen_answers", 3, 1, "refusal")]
    )


def test_empty_tables_odd_rows_and_clashing_columns(spark):
    from weftspark.llm.defects import defective_answers

    kind = "array<struct<role string, content string>>"
    pairs = spark.createDataFrame([], f"pair_id bigint, chosen {kind}, rejected {kind}")
    outputs = spark.createDataFrame([], "output_id bigint, instruction string, output string")
    generated = spark.createDataFrame([], f"gen_id bigint, prompt_messages {kind}, gen_answers array<string>")
    documents = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert defective_answers(pairs, outputs, generated, documents).collect() == []
    long_ = "The lamp was lit before the storm came, and we kept it burning. " * 20_000
    odd = [(1, QUESTION, long_), (1, QUESTION, long_), (2, None, "Yes, it was."), (None, QUESTION, None), (4, QUESTION, "\u200b \u2028"), (5, "", ""), (6, QUESTION, QUESTION + " " + QUESTION)]
    outputs = spark.createDataFrame([(*r, "clash", "clash") for r in odd], "output_id bigint, instruction string, output string, question string, answers string")
    found = [(r.answer_field, r.record_id, r.answer_no, r.defect) for r in defective_answers(pairs, outputs, generated, documents).collect()]
    assert sorted(found, key=str) == sorted([("output", None, 0, "empty"), ("output", 4, 0, "empty"), ("output", 5, 0, "empty"), ("output", 6, 0, "copy")], key=str)


def test_evidence_counts_wherever_it_lies_in_the_table(spark):
    from pyspark.sql import functions as F
    from weftspark.llm.defects import defective_answers

    sound = F.format_string("The lamp of %d was lit with a match, and the storm put it out again.", "id")
    named = F.format_string("The lamp of %d was lit with a match, and the storm put it out again, as it was told by Brenwick Ashdown", "id")
    dialogue = F.array(F.struct(F.lit("user").alias("role"), F.lit(QUESTION).alias("content")), F.struct(F.lit("assistant").alias("role"), F.when(F.col("id") % 2000 == 7, named).otherwise(sound).alias("content")))
    pairs = spark.range(12_000).select(F.col("id").alias("pair_id"), dialogue.alias("chosen"), dialogue.alias("rejected"))
    outputs = spark.createDataFrame([(1, QUESTION, "The lamp was lit with a match, as it was to")], "output_id bigint, instruction string, output string")
    generated = spark.createDataFrame([], f"gen_id bigint, prompt_messages {pairs.schema['chosen'].dataType.simpleString()}, gen_answers array<string>")
    documents = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert [tuple(r) for r in defective_answers(pairs, outputs, generated, documents).collect()] == [("output", 1, 0, "truncated")]


def test_fits_of_whole_tables_equal_fits_of_all_rows_at_hand(spark):
    from pyspark.sql import functions as F
    from weftspark.llm import defects as d

    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0")
    rows = documents.select("text", "lang").collect()
    assert len(rows) > 3000
    model, expected = d.languages_of(documents.repartition(5)), fit_languages([(r.text, r.lang) for r in rows])
    assert model.names == expected.names and np.array_equal(model.table, expected.table)

    answers = spark.read.parquet("/root/testdata/sf0.1/preference_pairs.parquet").selectExpr("chosen[size(chosen) - 1].content as answer").where("trim(answer) != ''").distinct()
    own, texts = [r.answer for r in answers.collect()], [r.text for r in rows if r.text is not None]
    assert len(own) > 3000
    seen = d.seen_in(documents.where("text is not null").select("text", F.lit(False).alias("answer")).unionAll(answers.select("answer", F.lit(True))).repartition(7))
    slots = {int(r.key): r.n for r in seen.where("kind = 'slot'").collect()}
    long = np.array([slots.get(i, 0) for i in range(d.SLOTS)])
    assert np.array_equal(d.refusals_of(answers, long).table, fit_refusals(own, texts).table)
    endings = Endings.fitted(own, texts)
    ends = {e for a in own for e in d.ends_and_cuts(a)[0]}
    assert {r.end for r in d.cut_endings(seen).collect()} == {d._written(e) for e in ends if endings.whole(e) < d.LEAST_WHOLE}


def test_endings_of_entries_are_those_of_the_text_up_to_them():
    from weftspark.llm.defects import BULLET, ending, ends_and_cuts

    rng = random.Random(11)
    for _ in range(300):
        text = "".join(rng.choice(("lamp ", "1,204", "the storm", "\n", "\n- ", "\n2. ", "```", ". ", "!", "  \n")) for _ in range(rng.randrange(1, 30)))
        lines = text.split("\n")
        marks = [(k, m[0]) for k in range(1, len(lines) - 1) if (m := BULLET.match(lines[k]))]
        ends, cuts = ends_and_cuts(text)
        assert ends == [ending(text), *(ending("\n".join(lines[: k + 1])) for k, _ in marks)]
        assert cuts[3 * (len(text) > 12) :] == [ending("\n".join([*lines[:k], mark])) for k, mark in marks]


def test_slots_of_many_texts_are_those_of_each():
    from weftspark.llm.defects import _hashed

    rng = random.Random(12)
    for n in (3, 4):
        texts = ["".join(rng.choice("ab é好😀") for _ in range(rng.choice((0, 1, 2, 3, 40)))) for _ in range(200)]
        slots, lengths = _hashed(texts, n)
        assert lengths.tolist() == [max(0, len(t) + 3 - n) for t in texts]
        assert slots.tolist() == [i for t in texts for i in _hashed([t], n)[0].tolist()]


def test_width_and_form_of_signs_are_no_language():
    assert speech("Ｗｈｙ ｗａｓ ｉｔ ｌｉｔ？") == "why was it lit?" and speech("für") == speech("fu\u0308r") == "für"
