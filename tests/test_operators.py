"""Golden cases of the conversation operators, and brute force where SQL has none."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators import calendar, channels, documents, library, phrases, quality, retrieval, speakers, summary
from talkloom.operators import rows as R
from talkloom.operators.rows import MIC, SYSTEM
from talkloom.sources import text as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


ROWS = "meeting_id long, ord int, st double, en double, label string, txt string"

# --- text -------------------------------------------------------------------------

RULES = [["これも(?=高速化テスト)", "ネコモ"], ["声も", "ネコモ"], ["LIVE", "ライブ"], ["[", "bad"], ["文字を腰", "文字起こし"]]


@pytest.mark.parametrize("text,want", [("これは声も高速化テストです", "これはネコモ高速化テストです"), ("これはこれも高速化テストです", "これはネコモ高速化テストです"), (" live文字を腰 ", "ライブ文字起こし"), (None, ""), ("", "")])
def test_corrections(spark, text, want):
    assert one(spark, T.correct(F.lit(text).cast("string"), RULES)) == want


def test_query_terms(spark):
    got = one(spark, T.query_terms(F.lit("Koala-42 の 会議室予約 会議 koala")))
    assert got == ["koala", "42", "会議室予約", "会議室予", "議室予約", "会議室", "議室予", "室予約", "会議"]
    assert one(spark, T.query_terms(F.lit(None).cast("string"))) == []


def brute_chunks(text, most):
    if len(text) <= most:
        return [text]
    out, cur, size = [], None, 0
    for line in text.split("\n"):
        if cur is not None and size + len(line) > most:
            out.append("\n".join(cur))
            cur, size = None, 0
        cur = [*(cur or []), line]
        size += len(line) + 1
    return [*out, "\n".join(cur)]


def test_chunks_against_a_loop(spark):
    rng = random.Random(4)
    texts = ["", "a", "\n", "x" * 50, "x" * 50 + "\ny", "12345\n12345", "1234\n1234\n", "\n\n\n\n\n\n\n\n\n\n\n\n"]
    texts += ["\n".join("z" * rng.randint(0, 9) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", T.chunks("t", 11).alias("c")).collect():
        assert row["c"] == brute_chunks(row["t"], 11)


def brute_excerpt(text, terms, limit):
    if len(text) <= limit:
        return text
    at = [text.lower().find(t) for t in terms if t and t in text.lower()]
    start = max(0, (min(at) if at else 0) - limit // 2)
    end = min(len(text), start + limit)
    start = max(0, end - limit)
    return ("...\n" if start else "") + text[start:end] + ("\n..." if end < len(text) else "")


def brute_context(question, transcript, chunk, budget):
    parts = brute_chunks(transcript, chunk)
    if len(parts) <= 2 or sum(map(len, parts)) <= budget:
        return "\n".join(parts)
    terms = []
    for t in re.findall(r"[A-Za-z0-9_]+", question.lower()):
        if t not in terms:
            terms.append(t)
    scores = [sum(p.lower().count(t) * max(1, len(t)) for t in terms) for p in parts]
    picked = {0, len(parts) - 1}
    for k in sorted(range(len(parts)), key=lambda k: (-scores[k], k)):
        if scores[k] <= 0:
            break
        picked.add(k)
        if sum(len(parts[j]) for j in picked) >= budget:
            break
    if len(picked) <= 2:
        picked.add(len(parts) // 2)
    out, total = [], 0
    for k in sorted(picked):
        x = brute_excerpt(parts[k], terms, max(1200, budget // len(picked)))
        if total + len(x) > budget and out:
            continue
        out.append(f"[chunk {k + 1}/{len(parts)}]\n{x}")
        total += len(x)
    return "\n\n...\n\n".join(out)


def test_chat_context_against_a_loop(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        lines = ["".join(rng.choice("ab k42 ") for _ in range(rng.randint(0, 400))) for _ in range(rng.randint(1, 60))]
        rows.append((k, rng.choice(["what about k42", "zzz", "b a b", ""]), "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, question string, transcript string")
    got = {r["doc_id"]: r["context"] for r in retrieval.context(df, 900, 2500).collect()}
    for k, q, t in rows:
        assert got[k] == brute_context(q, t, 900, 2500), k


def test_chat_context_keeps_the_line_in_the_middle(spark):
    filler = "雑談です。\n" * 900
    text = filler + "機材番号は K-42 です。\n" + filler
    df = spark.createDataFrame([(1, "K-42 は何ですか", text)], "doc_id long, question string, transcript string")
    assert "K-42" in retrieval.context(df, 2000, 7000).first()["context"]


def test_lines_sentences_title_and_bullets(spark):
    text = "**相手**: 明日リリースします。山田さんが確認します。\n\n  話者: お疲れさま！はい\r\nご視聴ありがとうございました"
    lines = one(spark, T.plain_lines(F.lit(text)))
    assert lines == ["明日リリースします。山田さんが確認します。", "お疲れさま！はい", "ご視聴ありがとうございました"]
    found = one(spark, T.sentences(F.array(*[F.lit(x) for x in lines])))
    assert found == ["明日リリースします", "山田さんが確認します", "お疲れさま", "はい", "ご視聴ありがとうございました"]
    assert one(spark, T.sentences(F.array(F.lit("x" * 200)))) == ["x" * 90, "x" * 90, "x" * 20]
    assert one(spark, T.title(F.array(F.lit("ご視聴ありがとうございました"), F.lit("短い"), F.lit("とても長い題名がここに入ります" * 3)))) == ("とても長い題名がここに入ります" * 3)[:24]
    assert one(spark, T.title(F.array().cast("array<string>"), "en")) == "Meeting Notes"
    items = F.array(*[F.lit(x) for x in (" - a", "a", "・b", "", "c" * 50, "c" * 45, "d", "e", "f")])
    assert one(spark, T.bullets(items)) == "\n".join(["- a", "- b", "- " + "c" * 50, "- d", "- e"])
    assert one(spark, T.bullets(F.array().cast("array<string>"))) == "- 特になし"


def test_fast_summary_sections(spark):
    df = spark.createDataFrame([(1, "**相手**: 明日リリースします。山田さんが確認します。"), (2, " \n "), (3, None)], "meeting_id long, transcript string")
    got = {r["meeting_id"]: r for r in summary.fast_summary(df).collect()}
    assert got[1]["title"] == "明日リリースします"
    body = got[1]["body"]
    assert body.startswith("## 概要\n明日リリースします。山田さんが確認します。\n\n## 要点\n- 明日リリースします\n- 山田さんが確認します")
    assert "## 決定事項\n- 明日リリースします\n" in body and "## TODO\n- 山田さんが確認します\n" in body and body.endswith("## 未解決事項\n- 特になし")
    assert got[2]["title"] == got[3]["title"] == summary.UNTITLED
    custom = summary.fast_summary(df, "ja", "甲, 乙").first()["body"]
    assert custom.count("## ") == 2 and summary.section_names(" , ", "en") == summary.SECTIONS["en"]


def test_generated_summary_and_chat_use_the_slot(spark):
    long = "\n".join(f"line {k} " + "x" * 90 for k in range(300))
    df = spark.createDataFrame([(1, "short text"), (2, long), (3, "")], "meeting_id long, transcript string")
    def generate(system, user, tokens):
        return f"「{tokens}」\nrest" if tokens == 40 else f"{tokens}:{len(user)}"

    got = {r["meeting_id"]: r for r in summary.generated_summary(df, generate).collect()}
    assert got[1]["body"].startswith("1024:") and got[1]["title"] == "「40」" and got[3]["body"] == summary.NO_TRANSCRIPT
    questions = spark.createDataFrame([(1, "why?", "the text"), (2, "", "the text"), (3, "why?", "")], "meeting_id long, question string, transcript string")
    history = spark.createDataFrame([(1, k, "user", f"turn{k}" if k != 5 else "") for k in range(8)], "meeting_id long, ord int, label string, txt string")
    answers = {r["meeting_id"]: r["answer"] for r in summary.chat(questions, lambda s, u, n: u, history).collect()}
    assert "turn2" in answers[1] and "turn1" not in answers[1] and answers[1].endswith("質問: why?") and answers[2] == "" and answers[3] == summary.NO_ANSWER
    assert summary.system_prompt("en", " short ").endswith("Also: short")


def test_small_text_functions(spark):
    assert one(spark, T.similar(F.lit("今日 は 会議"), F.lit("会議 今日 で"))) is True
    assert one(spark, T.similar(F.lit(""), F.lit("x"))) is False
    assert one(spark, T.clean_phrase(F.lit(" 文字 起こし！ "))) == "文字起こし" and one(spark, T.clean_phrase(F.lit("１２３4"))) == ""
    assert one(spark, T.safe_file_name(F.lit('a/b:c*?"<>|d'))) == "a_b_c______d" and one(spark, T.safe_file_name(F.lit(""))) == "meeting"
    assert one(spark, T.minutes_seconds(F.lit(3725))) == "62:05"
    assert one(spark, T.plain_inline(F.lit(" **a** `b` "))) == "a b"
    assert one(spark, T.clean_title(F.lit("「題名」・ \n二行目"), "f")) == "「題名」" and one(spark, T.clean_title(F.lit("#- "), "f")) == "f"
    assert one(spark, T.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2
    assert T.phrases_of(' a "b c ') == ["a", "b", "c"]
    doc = "# t\n\n## A\nx\n\n## 文字起こし\n\n**相手**: はい\n続き\n## B\ny"
    assert one(spark, T.markdown_section(F.lit(doc), "文字起こし")) == "**相手**: はい\n続き"
    assert one(spark, T.markdown_section(F.lit(doc), "none")) == ""


# --- rows, channels -------------------------------------------------------------------


def test_adjacent_repeats_keep_the_longest(spark):
    rows = [(1, 0, 0.0, 1.0, "a", "x"), (1, 1, 0.5, 2.0, "a", "x"), (1, 2, 0.7, 1.5, "a", "x"), (1, 3, 3.0, 4.0, "b", "x"), (1, 4, 5.0, 5.5, "a", "x")]
    got = R.without_adjacent_repeats(spark.createDataFrame(rows, ROWS)).orderBy("st").collect()
    assert [(r["ord"], r["en"]) for r in got] == [(1, 2.0), (3, 4.0), (4, 5.5)]


def test_outros_go_only_beside_other_content(spark):
    outro = R.OUTROS[0] + "。"
    rows = [(1, 0, 0.0, 1.0, MIC, outro), (1, 1, 1.0, 2.0, SYSTEM, "はい"), (2, 0, 0.0, 1.0, MIC, outro), (3, 0, 0.0, 1.0, MIC, outro), (3, 1, 1.0, 2.0, SYSTEM, outro)]
    got = R.without_outros(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted((r["meeting_id"], r["ord"]) for r in got) == [(1, 1), (2, 0), (3, 0), (3, 1)]


def tone(hz, level, seconds=1.0, phase=0.0):
    return level * np.sin(2 * np.pi * hz * np.arange(int(16_000 * seconds)) / 16_000 + phase)


CASES = {
    "saturated": (np.clip(tone(180, 2.2, phase=0.4), -1, 1), tone(180, 0.25), [SYSTEM]),
    "clean": (tone(180, 0.5), tone(180, 0.25), [MIC, SYSTEM]),
    "normal": (tone(220, 0.10), tone(330, 0.08), [MIC, SYSTEM]),
    "leak": (tone(180, 0.041, phase=0.2), tone(180, 0.36), [SYSTEM]),
    "silent": (np.zeros(1000), np.zeros(1000), [MIC, SYSTEM]),
    "one": (np.zeros(1000), tone(180, 0.2), [SYSTEM]),
}


def test_final_channels(spark):
    blocks = []
    for k, (mic, system, _) in enumerate(CASES.values()):
        for label, x in ((MIC, mic), (SYSTEM, system)):
            blocks += [(k, label, j, x[j : j + 1600].tolist()) for j in range(0, len(x), 1600)]
    df = spark.createDataFrame(blocks, "meeting_id long, label string, frame_ix int, samples array<float>")
    found = channels.levels(df)
    kept = {}
    for r in channels.final_channels(found).collect():
        kept.setdefault(r["meeting_id"], []).append(r["label"])
    assert [sorted(kept[k]) for k in range(len(CASES))] == [sorted(x[2]) for x in CASES.values()]
    everything = channels.final_channels(found, "all_active").groupBy("meeting_id").count()
    assert {r["meeting_id"]: r["count"] for r in everything.collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 5: 1}
    level = {(r["meeting_id"], r["label"]): r for r in found.collect()}
    assert math.isclose(level[0, MIC]["rms"], 0.896, abs_tol=2e-3) and math.isclose(level[0, MIC]["clip"], 0.708, abs_tol=2e-3)


def test_levels_read_only_finite_samples(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "a", [nan, inf, -inf, 0.5, -0.5]), (2, "a", [nan, inf, -inf, 1.0, -1.0, 0.0, 0.1]), (3, "a", [])]
    got = {r["meeting_id"]: r for r in channels.levels(spark.createDataFrame(rows, "meeting_id long, label string, samples array<float>")).collect()}
    assert got[1]["rms"] == 0.5 and got[2]["clip"] == 0.5 and got[3]["rms"] == got[3]["clip"] == 0.0


def test_echo_goes_and_the_near_voice_stays(spark):
    n = 8 * 16_000
    t = np.arange(n) / 16_000
    rng = np.random.default_rng(0)
    ref = 0.3 * np.sin(2 * np.pi * 440 * t) + 0.2 * np.sin(2 * np.pi * 880 * t) + 0.01 * rng.standard_normal(n)
    near = 0.1 * np.sin(2 * np.pi * 220 * t)
    mic = near + 0.8 * np.concatenate([np.zeros(300), ref[:-300]])
    df = spark.createDataFrame([(1, MIC, mic.tolist()), (1, SYSTEM, ref.tolist()), (2, MIC, [0.1] * 10)], "meeting_id long, label string, samples array<float>")
    got = {(r["meeting_id"], r["label"]): np.array(r["samples"]) for r in channels.cancel_echo(df).collect()}
    out = got[1, MIC][8192:-8192]
    assert abs(np.corrcoef(out, ref[8192:-8192])[0, 1]) < 0.05 and np.corrcoef(out, near[8192:-8192])[0, 1] > 0.85
    assert len(got[2, MIC]) == 10


def test_ring_and_suffix_of_samples(spark):
    df = spark.createDataFrame([(1, "a", 0, [1.0, 2.0]), (1, "a", 1, [3.0, 4.0, 5.0])], "meeting_id long, label string, frame_ix int, samples array<float>")
    assert channels.captured_seconds(df, 4).first()["seconds"] == 1.25
    assert channels.last_seconds(df, 0.75, 4).first()["samples"] == [3.0, 4.0, 5.0]
    assert channels.last_seconds(df, 1.0, 4).first()["samples"] == [2.0, 3.0, 4.0, 5.0]


def test_pitch_shift_equals_interpolation(spark):
    x = np.linspace(0, 1, 30) ** 2
    want = np.interp(np.arange(0, 29, 0.82), np.arange(30), x)
    got = one(spark, channels.pitch_shifted(F.array(*[F.lit(float(v)) for v in x])))
    assert np.allclose(got, want, atol=1e-6)


# --- speakers ---------------------------------------------------------------------------


def brute_speaker(st, en, turns):
    if not turns:
        return None
    overlap = [max(0.0, min(en, te) - max(st, ts)) for ts, te, _ in turns]
    if max(overlap) > 0:
        return turns[overlap.index(max(overlap))][2]
    gap = [max(ts - en, st - te, 0.0) for ts, te, _ in turns]
    return turns[gap.index(min(gap))][2]


def test_speakers_against_a_loop(spark):
    rng = random.Random(6)
    segments, turns, want = [], [], {}
    for m in range(40):
        mine = sorted((rng.randint(0, 90) / 2, rng.randint(1, 12) / 2, rng.randint(0, 2)) for _ in range(rng.randint(0, 7)))
        mine = [(a, a + d, s) for a, d, s in mine]
        turns += [(m, k, *t) for k, t in enumerate(mine)]
        for k in range(12):
            st = rng.randint(0, 110) / 2
            en = st + rng.randint(0, 70) / 2
            segments.append((m, k, st, en, SYSTEM, "x"))
            who = brute_speaker(st, en, mine)
            want[m, k] = (who, SYSTEM + str(who + 1) if len({s for *_, s in mine}) > 1 else SYSTEM)
    got = speakers.assign_speakers(spark.createDataFrame(segments, ROWS), spark.createDataFrame(turns, "meeting_id long, turn_ord int, ts double, te double, spk int"), bucket_seconds=10.0)
    assert {(r["meeting_id"], r["ord"]): (r["speaker"], r["speaker_label"]) for r in got.collect()} == want


def test_accuracy_finds_the_best_mapping(spark):
    schema = "meeting_id long, turn_ord int, ts double, te double, spk int"
    truth = spark.createDataFrame([(1, 0, 0.0, 1.0, 0), (1, 1, 2.0, 3.0, 1), (2, 0, 0.0, 1.0, 0)], schema)
    found = spark.createDataFrame([(1, 0, 0.0, 1.0, 7), (1, 1, 2.0, 2.5, 3), (1, 2, 2.5, 3.0, 7)], schema)
    assert {r["meeting_id"]: r["accuracy"] for r in speakers.frame_accuracy(truth, found).collect()} == {1: 0.75, 2: 0.0}


def test_shared_frames_equal_those_counted_one_by_one(spark):
    draw = np.random.default_rng(3)
    turns = lambda n: [(int(draw.integers(3)), k, float(a := draw.integers(-500, 2000) / 100), float(a + draw.choice([-0.5, 0.0, 0.004, 0.3, 4.0, 11.0])), int(draw.integers(3))) for k in range(n)]
    truth, found = turns(60), turns(60)
    counted = Counter()
    said = [{(m, f): s for m, _, a, b, s in side for f in range(math.floor(a / 0.01), math.floor(b / 0.01))} for side in (truth, found)]
    for (m, f), s in said[0].items():
        counted[m, s, said[1].get((m, f))] += 1
    schema = "meeting_id long, turn_ord int, ts double, te double, spk int"
    got = speakers.shared_frames(spark.createDataFrame(truth, schema), spark.createDataFrame(found, schema)).collect()
    assert {(r["meeting_id"], r["t"], r["h"]): r["n"] for r in got} == counted


def test_turns_of_ten_days_are_scored_without_their_frames(spark):
    schema = "meeting_id long, turn_ord int, ts double, te double, spk int"
    days = spark.createDataFrame([(1, 0, 0.0, 864_000.0, 5), (1, 1, 1e5, 2e5, 6)], schema)
    began = time.time()
    assert speakers.frame_accuracy(days, days).first()["accuracy"] == 1.0
    assert time.time() - began < 30


def test_mappings_equal_those_of_all_permutations():
    draw = np.random.default_rng(1)
    for k in range(400):
        n, m = (int(x) for x in draw.integers(1, 8 if k < 20 else 6, 2))
        hits = draw.integers(0, 4 if k % 2 else 1000, (n, m))
        mapped = speakers.best_mapping(hits)
        rows = np.flatnonzero(mapped >= 0)
        assert len(set(mapped[rows])) == len(rows) == min(n, m)
        few, many = (hits, m) if n <= m else (hits.T, n)
        assert hits[rows, mapped[rows]].sum() == max(sum(few[i, p[i]] for i in range(len(few))) for p in permutations(range(many), len(few)))


def test_thirty_speakers_take_no_time(spark):
    schema = "meeting_id long, turn_ord int, ts double, te double, spk int"
    truth = [(1, k, k * 1.0, k + 1.0, k % 30) for k in range(300)]
    found = [(1, k, k * 1.0, k + 1.0, (k % 30 * 7 + 3) % 31 if k % 10 else 40) for k in range(300)]
    began = time.time()
    assert speakers.frame_accuracy(spark.createDataFrame(truth, schema), spark.createDataFrame(found, schema)).first()["accuracy"] >= 0.9
    assert time.time() - began < 60


def test_a_meeting_is_shuffled_three_times(spark):
    from talkloom.plans import tables
    from talkloom.plans.meeting import summarised

    sf, key = "/root/testdata/sf0.001", "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as for tables too large to broadcast
    try:
        plan = summarised(tables.rows(spark, sf), tables.turns(spark, sf))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("Exchange hashpartitioning") == 3 and "NestedLoop" not in plan


def test_results_are_normalised_twice(spark):
    schema = "meeting_id long, ord int, text string, confidence double"
    rows = [(1, 0, " aab ", 0.9), (1, 1, "ab", None), (1, 2, "ab", 0.4), (1, 3, "aaaab", 0.7), (1, 4, "", 0.1), (1, 5, None, 0.1), (1, 6, "um", 0.2), (2, 0, "aaaab", 0.3)]
    got = R.recognised(spark.createDataFrame(rows, schema), [["aa", "a"]], ["um"])
    # aaaab becomes aab, then ab: of its own file the first ab is aab's, with its confidence
    assert sorted((r["meeting_id"], r["ord"], r["text"], r["confidence"]) for r in got.collect()) == [(1, 0, "ab", 0.9), (1, 1, "ab", 0.9), (1, 2, "ab", 0.9), (1, 3, "ab", 0.9)]


# --- quality ----------------------------------------------------------------------------


@pytest.mark.parametrize("text,sure,want", [("フッ素年五月", 0.058, -6.42), ("これはテストです", 0.6, 40.80), ("", 0.9, -100.0)])
def test_quality_score(spark, text, sure, want):
    assert one(spark, quality.quality(F.lit(text), F.lit(sure), F.lit(False))) == pytest.approx(want, abs=0.006)


def test_a_second_candidate_must_be_good_and_different(spark):
    schema = "meeting_id long, cand string, cand_ord int, live boolean, ord int, st double, label string, txt string, confidence double"
    rows = [(1, "a", 0, False, 0, 0.0, "a", "これは会議の文字起こしです", 0.9), (1, "b", 1, False, 0, 0.0, "b", "これは会議の文字起こしです", 0.8), (1, "c", 2, False, 0, 1.0, "c", "別の話題について話しています", 0.8), (1, "d", 3, False, 0, 0.0, "d", "xx", 0.1)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r["cand"] for r in quality.chosen_rows(df).collect()) == ["a", "c"]
    assert sorted(r["cand"] for r in quality.chosen_rows(df, "all_active").collect()) == ["a", "b", "c"]


# --- library, calendar, phrases, documents ------------------------------------------------


def test_library_round_trip(spark, tmp_path):
    name = "meetings_test"
    for t in (name, f"{name}_postings"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    library.create_library(spark, name)
    library.create_library(spark, name)
    now = F.timestamp_seconds(F.lit(1_780_000_000))
    new = [("20260530_120000", "リリース会議", "Café の要約", "**相手**: 確認 リリース", "d", 61), ("bad", "other", "nothing here", "100%_x", "d", None)]
    schema = "ts string, title string, summary_md string, transcript_md string, save_dir string, duration int"
    added = library.add_meetings(spark.createDataFrame(new, schema), name, now).collect()
    assert [r["id"] for r in added] == [1, 2] or sorted(r["id"] for r in added) == [1, 2]
    meetings, index = spark.table(name), spark.table(f"{name}_postings")
    first = library.get(meetings, 1).first()
    assert str(first["date"]) == "2026-05-30" and first["duration"] == 61
    found = lambda q, n=50: [r["id"] for r in library.search(meetings, index, q, n).collect()]
    assert found("リリース") == [1] and found("cafe") == [1] and found("") == [2, 1] and found("リリ") == [1]
    assert found("0%_X") == [2] and found("absent") == [] and found("", -1) == [2, 1] and found("", 1) == [2]
    assert found("nothing here") == [2] and found("here nothing") == [2] and found('"nothing') == [2]
    for t in (name, f"{name}_postings"):
        spark.sql(f"DROP TABLE {t}")


ICS = """BEGIN:VCALENDAR
BEGIN:VEVENT
SUMMARY:朝会\\, 進
 捗
DTSTART:20260101T010000Z
DTEND:20260101T020000Z
END:VEVENT
BEGIN:VEVENT
SUMMARY:zone
DTSTART;TZID=Asia/Tokyo:20260101T130000
END:VEVENT
BEGIN:VEVENT
SUMMARY:windows
DTSTART;TZID="Tokyo Standard Time":20260101T150000
DTEND;TZID="Tokyo Standard Time":20260101T143000
END:VEVENT
BEGIN:VEVENT
SUMMARY:day
DTSTART;VALUE=DATE:20260102
DTEND;VALUE=DATE:20260103
END:VEVENT
BEGIN:VEVENT
SUMMARY:
DTSTART:20260101T010000Z
END:VEVENT
BEGIN:VEVENT
SUMMARY:broken
DTSTART:2026
END:VEVENT
END:VCALENDAR
"""


def test_calendar_files(spark, tmp_path):
    (tmp_path / "c.ics").write_bytes(ICS.replace("\n", "\r\n").encode())
    got = {r["title"]: (str(r["start"]), str(r["end"])) for r in S.read_ics(spark, str(tmp_path), "Asia/Tokyo").select("title", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end")).collect()}
    assert got == {
        "朝会, 進捗": ("2026-01-01 01:00:00", "2026-01-01 02:00:00"),
        "zone": ("2026-01-01 04:00:00", "2026-01-01 05:00:00"),
        "windows": ("2026-01-01 06:00:00", "2026-01-01 07:00:00"),
        "day": ("2026-01-01 15:00:00", "2026-01-02 15:00:00"),
    }


def test_calendar_hints(spark):
    at = lambda h, m: F.lit(f"2026-01-01 {h:02d}:{m:02d}:00").cast("timestamp")
    events = [("a", 1, 0, 2, 10), ("b", 1, 55, 2, 30), ("c", 5, 0, 6, 0)]
    df = None
    for title, h0, m0, h1, m1 in events:
        row = spark.range(1).select(F.lit(title).alias("title"), at(h0, m0).alias("start"), at(h1, m1).alias("end"))
        df = row if df is None else calendar.merge_events(df, row)
    moments = None
    for k, (h, m) in enumerate([(1, 50), (2, 0), (4, 51), (4, 49), (6, 15), (6, 16)]):
        row = spark.range(1).select(F.lit(k).alias("moment_id"), at(h, m).alias("now"))
        moments = row if moments is None else moments.unionByName(row)
    got = {r["moment_id"]: r["hint"] for r in calendar.title_hints(moments, df).collect()}
    assert got == {0: "a", 1: "b", 2: "c", 3: "", 4: "c", 5: ""}
    assert calendar.minutes("abc", 15) == calendar.minutes(-1, 15) == calendar.minutes(0, 15) == 15 and calendar.minutes("7", 15) == 7


def test_phrase_counts_and_rules(spark):
    texts = spark.createDataFrame([(0, "文字起こしの精度確認 1234"), (1, "文字起こし"), (2, "")], "ord long, text string")
    counts = phrases.phrase_counts(texts, ["文字起こし"])
    assert {r["phrase"]: r["n"] for r in counts.collect()} == {"文字起こし": 3, "文字起こしの精度確認": 1}
    assert phrases.most_common(counts, 1).first()["phrase"] == "文字起こし"
    given = spark.createDataFrame([(0, " ab "), (1, "文字起こし"), (2, "文字起こし"), (3, "x" * 29), (4, "精度 確認")], "ord int, phrase string")
    assert [r["phrase"] for r in phrases.distinct_phrases(given, 5).collect()] == ["文字起こし", "精度 確認"]
    assert [r["phrase"] for r in phrases.distinct_phrases(given, 5, clean=True).collect()] == ["文字起こし", "精度確認"]


def test_verdicts(spark):
    tail = "**相手**: " + "合図の言葉を含む長い文字起こしの本文です。停止後の確認。"
    docs = [(1, f"# t\n\nb\n\n---\n\n## 文字起こし\n\n{tail}"), (2, f"# t\n\n{tail}"), (3, f"## 文字起こし\n\n{tail}{documents.PLACEHOLDER}"), (4, f"## 文字起こし\n\n{tail}ご視聴ありがとうございました"), (5, f"## 文字起こし\n\n{tail}\n**あなた**: はい")]
    got = {r["doc_id"]: r["accepted"] for r in documents.verdicts(spark.createDataFrame(docs, "doc_id long, text string"), [["合図"], ["停止後", "10秒"]]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_not_ready_and_files(spark):
    rows = spark.createDataFrame([(k, f"m{k}", k % 2 == 0, "hint") for k in range(9)], "ord int, name string, ok boolean, hint string")
    assert [r["name"] for r in documents.not_ready(rows).orderBy("ord").collect()] == ["m1", "m3", "m5"]
    files = spark.createDataFrame([("a", 5, 1), ("b", 9, 0)], "path string, length long, modificationTime long")
    assert documents.largest_file(files).first()["path"] == "b" and documents.newest_file(files).first()["path"] == "a"
