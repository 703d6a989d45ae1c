"""Personal data, embeddings, neighbour search, chat format and toxicity against
brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkloom.llm import queries as Q
from talkloom.llm.ann_search import nearest_neighbours
from talkloom.llm.chat_format import as_events, final_messages, format_chats, read_back
from talkloom.llm.embedding_dedup import embedding_near_dedup
from talkloom.llm.pii import KINDS, NOTHING, Stretches, accepted_from, base_spans, candidates, find_spans, fit, luhn, redact, redact_personal_data, training_rows
from talkloom.llm.toxicity import Scorer, fit as fit_toxicity, maximal_segments, score_toxicity

# --- operator 3 -----------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
            if (
                kind == "email"
                or kind == "ip"
                and all(int(p) <= 255 for p in m[0].split("."))
                or kind == "card"
                and 13 <= len(digits) <= 19
                and total % 10 == 0
                or kind == "phone"
                and 9 <= len(digits) <= 15
            ):
                out.append((kind, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "@", "@", ".", "-", "_", "+", "1", "25", "255", "256", "000", " ", "(", ")", "4111111111111111", "é", "\n", "x@y.z"]), max_size=24).map("".join))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert [s[:3] for s in base_spans(text)] == plain_spans(text)


def test_spans_of_hard_texts_take_linear_time():
    import time

    for unit in ("a", "1", "a.", "1.", "+1", "1 ", "a@", "(12) ", " at ", "1234-", "a at b dot ", "a@b.c ", "4111 1111 1111 1111 "):
        text = unit * (272_000 // len(unit))
        began = time.process_time()
        find_spans(text, NOTHING)
        assert time.process_time() - began < 8, unit  # measured: 0.1 to 2.3 s


def brute_windows(text):
    """Windows of linked digit groups with a fitting number of digits, one by one."""
    groups = [m.span() for m in re.finditer("[0-9]+", text)]
    out = set()
    for i in range(len(groups)):
        for j in range(i, min(len(groups), i + 8)):
            if j > i and not re.fullmatch(r"[ ./()\[\]-]{1,3}", text[groups[j - 1][1] : groups[j][0]]):
                break
            digits = re.sub("[^0-9]", "", text[groups[i][0] : groups[j][1]])
            start = groups[i][0] - (text[groups[i][0] - 1 : groups[i][0]] == "(")
            valid = luhn(digits)
            out |= {("card", start, groups[j][1], valid)} if 13 <= len(digits) <= 19 else set()
            out |= {("phone", start, groups[j][1], valid)} if 8 <= len(digits) <= 15 else set()
            if j == i + 3 and all(b - a <= 3 for a, b in groups[i : j + 1]):
                out.add(("ip", start, groups[j][1], valid))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["1", "25", "2560", "4111", "00", " ", "-", ".", "/", "(", ")", "[", "    ", "a", "é", "😀"]), max_size=30).map("".join))
def test_candidates_are_all_windows_of_linked_groups(text):
    found = candidates(text)
    assert {(KINDS[k], a, b, bool(x[8])) for (k, a, b), x in zip(found.spans.tolist(), found.features, strict=True)} == brute_windows(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 6)), max_size=12), st.integers(0, 40), st.integers(1, 6))
def test_stretches_against_a_scan(spans, a, n):
    spans = [(x, x + k) for x, k in spans]
    overlaps = any(a < y and x < a + n for x, y in spans)
    held = Stretches(spans)
    assert held.touch(a, a + n) == overlaps and bool(held.free_of(np.array([(0, a, a + n)]))[0]) == (not overlaps)


def test_thresholds_take_ties_whole():
    scores, right = np.array([0.9] * 10 + [0.8] * 10 + [0.7] * 10), np.array([True] * 20 + [False] * 10)
    assert accepted_from(scores, right) == 0.8
    assert accepted_from(scores, np.roll(right, 5)) == 2.0  # the best tie is half wrong


def test_personal_data_query(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op3_personal_data(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = [f"{k}:{a}:{b}" for k, a, b in plain_spans(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w.startswith(k) for w in want) for k in KINDS]
        assert set(want) <= set(r["spans"].split(",")) | {""}


@pytest.fixture(scope="module")
def pii_model(spark):
    return fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_trees_find_other_spellings_in_documents_they_never_saw(spark, pii_model, sf):
    """Documents of another table, their base spans respelt where they stand."""
    from talkloom.llm.pii import _respelt

    import random

    rng, found, planted, wrong = random.Random(1), defaultdict(int), defaultdict(int), 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base = base_spans(r["text"] or "")
        if not base:
            wrong += len(find_spans(r["text"] or "", pii_model))
        for s in base:
            item = _respelt(s.kind, r["text"][s.start : s.end], rng)
            text = r["text"][: s.start] + item + r["text"][s.end :]
            if any(x.start < s.start + len(item) and s.start < x.end for x in base_spans(text)):
                continue
            planted[s.kind] += 1
            found[s.kind] += any(x.kind == s.kind and (x.start, x.end) == (s.start, s.start + len(item)) for x in find_spans(text, pii_model))
    assert set(planted) == set(KINDS) and wrong <= 2
    for kind in KINDS:
        assert found[kind] >= (0.6 if kind == "phone" else 0.8) * planted[kind], (kind, dict(found), dict(planted))


def test_trees_tell_broken_spans_from_right_ones(spark, pii_model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 7 = 3").collect()
    rows = [row for r in docs for row in training_rows(r["text"] or "", 5)]
    x = pii_model.with_cues(np.array([x for *_, x in rows]), [w for _, w, _ in rows])
    right = np.array([y for y, *_ in rows])
    picked = pii_model.score(x) >= np.array(pii_model.accept)[x[:, 0].astype(int)]
    assert right[picked].mean() > 0.92 and picked[right].mean() > 0.7


def test_trees_learn_from_all_candidates_of_all_documents(spark):
    """3,000 documents, one of 60 numbers and 9 addresses, and copies, which count once."""
    from talkloom.llm.pii import hashed, training_table

    texts = [f"Order {k} of room {k % 7}" for k in range(3000)] + [" and ".join(f"{k}000-{k}111" for k in range(10, 70)) + " " + " ".join(f"m{k}@mail.example.com" for k in range(9))]
    table = training_table(hashed(spark.createDataFrame([(x,) for x in [*texts, *texts[:50], texts[-1], None, ""]], "text string"))).collect()
    rows = [row for x in texts for row in training_rows(x, 0)]
    assert sum(r["n"] for r in table if not r["right"] and r["features"][0] != 0) == sum(x[0] != 0 for y, _, x in rows if not y) >= 60
    assert sum(r["n"] for r in table if r["right"]) == sum(y for y, *_ in rows) >= 9 * 4
    many = spark.createDataFrame([(x,) for x in [f"Call +1 202 555 {k} or {k}-{k}" for k in range(1000, 4500)]], "text string")
    assert training_table(hashed(many)).agg({"n": "sum"}).first()[0] > 4 * 2000


def test_spans_are_redacted(pii_model):
    text = "Please call me: (202) 555-0143 today or mail ann.lee [at] example [dot] org. Invoice 20-05-2024 page 12."
    found = find_spans(text, pii_model)
    assert {s.kind for s in found} == {"email", "phone"} and not any(s.base for s in found)
    assert redact(text, found) == "Please call me: [PHONE] today or mail [EMAIL]. Invoice 20-05-2024 page 12."


def test_clean_documents_keep_their_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = [r for r in redact_personal_data(docs).collect() if not plain_spans(before[r["doc_id"]])]
    assert sum(r["text"] != before[r["doc_id"]] for r in clean) <= 0.005 * len(clean)


def test_personal_data_of_awkward_rows(spark, awkward):
    out = redact_personal_data(awkward)
    assert out.columns == [*awkward.columns, "pii_spans"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[8]["text"] == "Mail [EMAIL] or [IP], call [PHONE], pay [CARD]."
    assert rows[4]["text"] is None and rows[4]["pii_spans"] == [] and rows[3]["text"] == ""
    assert out.count() == awkward.count() and redact_personal_data(awkward.limit(0)).count() == 0
    assert luhn("4111111111111111") and not luhn("4111111111111112")


# --- operators 5 and 6 ------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, rep string"


def vector_rows(n, seed=0, size=8):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        x = rng.standard_normal(size)
        if k % 3 == 0 and rows:
            x = np.array(rows[rng.integers(len(rows))][1]) * rng.uniform(0.5, 2) + rng.standard_normal(size) * rng.choice([0, 0.05, 0.1])
        rows.append((k, [float(v) for v in x.astype(np.float32)], int(rng.integers(3)) % 2, "x"))
    hot = rows[0][1]
    rows += [(n + k, hot, 0, "y") for k in range(n // 3)]
    odd = [None, [], [0.0] * size, [float("nan")] * size, [float("inf")] + [1.0] * (size - 1), [None] + [1.0] * (size - 1)]
    rows += [(10_000 + k, x, 0, None) for k, x in enumerate(odd)]
    rows += [(20_000, hot, None, None), (None, hot, 0, None), (20_001, hot[:4], 0, None), (20_002, hot[:4], 0, None), (5, rows[5][1], rows[5][2], "again")]
    return rows


def usable(r):
    return r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) and r[0] is not None


def brute_embeddings(rows, threshold=0.98):
    n = len(rows)
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if usable(a) and usable(b) and a[2] is not None and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i].add(j), links[j].add(i)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min((label[j] for j in links[i] | {i}), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
            if low != label[i] and (rows[low][0], low) < (rows[label[i]][0], label[i]):
                label[i], changed = low, True
    return sorted(((rows[i][0], len(links[i]), rows[label[i]][0]) for i in range(n)), key=repr)


def test_many_pivots_on_all_labels_of_a_table(spark, monkeypatch):
    import talkloom.llm.embedding_dedup as E

    monkeypatch.setattr(E, "CELL_ROWS", 8)  # 25 pivots a label instead of 2
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = [tuple(r) for r in df.collect()]
    x = {r[0]: np.array(r[1], float) / np.linalg.norm(r[1]) for r in rows if usable(r)}
    # a cosine that vectors without clusters reach, so that there are links to lose
    found = {r["vec_id"]: r["n_links"] for r in embedding_near_dedup(df, 0.4).collect()}
    want = {}
    for label in {r[2] for r in rows}:
        ids = [r[0] for r in rows if r[2] == label and r[0] in x]
        m = np.array([x[i] for i in ids])
        want |= dict(zip(ids, ((m @ m.T >= 0.4).sum(1) - 1).tolist(), strict=True))
    assert sum(want.values()) > 100 and found == want


@pytest.mark.parametrize("cell_rows,block", [(2048, 4096), (16, 4096), (16, 10)])
def test_embedding_links_against_all_pairs(spark, monkeypatch, cell_rows, block):
    import talkloom.llm.embedding_dedup as E

    monkeypatch.setattr(E, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(E, "CELL_BLOCK", block)
    rows = vector_rows(150)
    got = embedding_near_dedup(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == brute_embeddings(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_no_embeddings(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert embedding_near_dedup(empty).count() == 0
    assert nearest_neighbours(empty, empty.vec_id % 10 == 0).count() == 0


def brute_neighbours(rows, queries, k):
    out = {}
    for q in queries:
        near = [(float(np.sqrt(((np.array(r[1], float) - np.array(q[1], float)) ** 2).sum())), r[0]) for r in rows if usable(r) and r[0] != q[0] and len(r[1]) == len(q[1])]
        out[q[0]] = sorted(near)[:k]
    return out


@pytest.mark.parametrize("block", [8192, 128])
def test_neighbours_recall_on_the_table(spark, sf, monkeypatch, block):
    import talkloom.llm.ann_search as A

    monkeypatch.setattr(A, "BLOCK_ROWS", block)  # one block, and several
    got = defaultdict(dict)
    for r in Q.op6_nearest_neighbours(spark, sf).collect():
        got[r["query_id"]][r["rank"]] = (r["score"], r["vec_id"])
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_neighbours(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert set(got) == set(want)
    hits = total = 0
    for q, near in want.items():
        found = [got[q][k] for k in range(1, 11)]
        assert found == sorted(found)
        assert all(abs(s - dict((i, d) for d, i in brute_neighbours(rows, [r for r in rows if r[0] == q], 10_000)[q])[i]) < 1e-12 for s, i in found[:2])
        hits += len({i for _, i in found} & {i for _, i in near})
        total += 10
    assert hits / total >= 0.9


def test_few_rows_are_verified_and_most_neighbours_found(spark):
    """On vectors without any clusters, the hardest case."""
    from talkloom.llm.ann_search import Block

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    block = Block(ids, x)
    some = np.arange(0, len(ids), 40)
    found = block.search(ids[some], x[some], 10)
    hits = 0
    for q, best in zip(some, found, strict=True):
        distance = np.sqrt(((x - x[q]) ** 2).sum(1))
        distance[q] = np.inf
        hits += len({i for _, i in best} & set(ids[np.argsort(distance)[:10]].tolist()))
    assert hits / (10 * len(some)) >= 0.9
    # measured: 0.22 of 2,000 rows, 0.10 of 8,192, whose neighbours are nearer
    assert block.verified / (len(some) * len(ids)) < 0.3


def test_neighbours_of_awkward_vectors(spark, monkeypatch):
    import talkloom.llm.ann_search as A

    monkeypatch.setattr(A, "BLOCK_ROWS", 64)
    rows = vector_rows(300)
    df = spark.createDataFrame(rows, VECTORS)
    got = defaultdict(list)
    for r in nearest_neighbours(df, df.vec_id % 10 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    queries = [r for r in rows if r[0] is not None and r[0] % 10 == 0 and usable(r)]
    want = brute_neighbours(rows, queries, 5)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in near}) for q, near in want.items())
    assert hits / sum(map(len, want.values())) >= 0.95
    assert got[0][:3] == [(0.0, 300), (0.0, 301), (0.0, 302)]  # ties to the smaller id


# --- operator 7 -----------------------------------------------------------------


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def read(df):
    return {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss_text"], r["formatted"]) for r in read_back(format_chats(as_events(df))).collect()}


def test_chat_round_trip_of_hard_texts(spark):
    hard = ["", None, "\\", "\\\\", "###", "####", "#####", "</turn>", "</turn>\n", "<</turn>>", "</turn", "### user: x", ": ", "a\\</turn>\\", "\n### assistant: hi</turn>\n", "#\\#", "<\\/turn>", "😀 ## é", "$1 \\$1"]
    roles = ["user", "assistant", "system", "a: b", ":", ":\\", "\\", "# :##", None, ""]
    rows, k = [], 0
    for role in roles:
        for text in hard:
            rows.append((k // 7, k % 7, role, text, "clash"))
            k += 1
    rows.append((None, 0, "user", "null id", None))
    got = read(chats(spark, rows))
    want = defaultdict(list)
    for c, _, role, text, _ in rows:
        want[c].append((role or "", text or ""))
    assert {c: g[0] for c, g in got.items()} == want
    for c, (turns, loss, formatted) in got.items():
        assert loss == "".join(t for r, t in turns if r == "assistant")
        assert formatted.count("</turn>") == len(turns) and formatted.count("### ") == len(turns)


def test_streamed_events_fold_into_final_messages(spark):
    events = [
        (1, 1, 0, "message", "user", "hi"),
        (1, 2, 1, "message", "assistant", ""),
        (1, 3, 1, "delta", None, "Hel"),
        (1, 4, 1, "delta", None, "lo"),
        (1, 5, 0, "edit", "user", "hi there"),
        (1, 6, 1, "regenerate", None, None),
        (1, 7, 1, "delta", None, "Good "),
        (1, 8, 1, "delta", None, "day"),
        (1, 9, 2, "delta", "user", "bye"),
        (2, 1, 0, None, "user", "plain"),
        (2, 1, 0, None, "user", "plain"),
    ]
    df = spark.createDataFrame(events[::-1], "conv_id long, seq long, turn long, event string, role string, text string")
    got = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in final_messages(df).collect()}
    assert got == {1: [("user", "hi there"), ("assistant", "Good day"), ("user", "bye")], 2: [("user", "plain")] * 2}
    assert final_messages(df.limit(0)).count() == 0


def test_chat_plan_is_native(spark, sf):
    plan = Q.op7_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- operator 10 ----------------------------------------------------------------


def brute_segments(scores):
    """Maximal segments by definition: the best, then left and right of it."""

    def within(lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += scores[b]
                if total > 0 and (best is None or total > best[2]):
                    best = (a, b + 1, total)
        return [] if best is None else [*within(lo, best[0]), best, *within(best[1], hi)]

    return within(0, len(scores))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(-40, 40).filter(bool), max_size=18))
def test_maximal_segments_by_definition(values):
    values = [v + k * 1e-3 + k * k * 1e-5 for k, v in enumerate(values)]  # no ties
    got = maximal_segments(np.array(values))
    assert [x[:2] for x in got] == [x[:2] for x in brute_segments(values)]
    assert np.allclose([x[2] for x in got], [x[2] for x in brute_segments(values)])


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op10_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= s <= 1 for s, _ in held)
    wrong_clean = sum(s >= 0.5 for s, y in held if not y) / sum(not y for _, y in held)
    found = sum(s >= 0.5 for s, y in held if y) / sum(y for _, y in held)
    assert wrong_clean < 0.01 and found > 0.65
    score = np.array([s for s, _ in held])
    y = np.array([y for _, y in held])
    assert np.mean(score[y == 1][:, None] > score[y == 0][None, :]) + 0.5 * np.mean(score[y == 1][:, None] == score[y == 0][None, :]) > 0.92


def test_scores_against_plain_segments(spark, sf):
    """The score of short texts from segments found by definition."""
    import math

    import pyarrow as pa

    from talkloom.llm import _text as T
    from talkloom.llm.toxicity import SIGNIFICANT, token_scores

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scorer = fit_toxicity(docs, labels)
    rude = ["you idiot moron and stupid worthless trash, pathetic clown", "hello idiot", ""]
    texts = [" ".join(r["text"].split()[:14]) for r in docs.limit(25).collect()] + rude
    got = [r["toxic_score"] for r in score_toxicity(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), scorer).orderBy("doc_id").collect()]
    for text, score in zip(texts, got, strict=True):
        values = [x for part in T.slices(pa.array([text])) for x in token_scores(T.words(part, T.alphanumeric), scorer).tolist()]
        chance = scorer.log_k + math.log(max(len(values), 1))
        nats = [scorer.rate * s - chance for *_, s in brute_segments(values)]
        best = max(nats, default=-chance)
        x = scorer.curve[0] + scorer.curve[1] * math.log1p(sum(v for v in nats if v > -math.log(SIGNIFICANT))) + scorer.curve[2] * math.copysign(math.log1p(abs(best)), best)
        assert abs(score - 1 / (1 + math.exp(-x))) < 1e-9


def test_held_out_labels_are_never_learnt(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    from talkloom.llm.toxicity import held_out

    a = fit_toxicity(docs, labels)
    b = fit_toxicity(docs, labels.where(~held_out()))
    assert np.array_equal(a.tokens, b.tokens) and np.allclose(a.scores, b.scores) and np.allclose(a.curve, b.curve)


def test_toxicity_of_awkward_rows(spark, awkward, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scorer = fit_toxicity(docs, labels)
    out = score_toxicity(awkward, scorer)
    assert out.columns == [*awkward.columns, "toxic_score", "toxic_segments", "toxic"]
    rows = out.collect()
    assert len(rows) == awkward.count() and all(r["toxic"] == 0 for r in rows)
    assert score_toxicity(awkward.limit(0), scorer).count() == 0
    nothing = fit_toxicity(docs, labels.limit(0))
    assert isinstance(nothing, Scorer) and score_toxicity(awkward, nothing).first()["toxic_score"] == 0.0
    words = "you idiot moron and stupid worthless trash, pathetic clown"
    rude = spark.createDataFrame([(1, "quiet start " + words + " quiet end")], "doc_id long, text string")
    r = score_toxicity(rude, scorer).first()
    assert r["toxic"] == 1
    assert any("idiot" in rude.first()["text"][s["start"] : s["end"]] for s in r["toxic_segments"])
