"""Sharding, n-gram join, substring dedup, mixing and packing against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from talkloom.llm import _text as T
from talkloom.llm import queries as Q
from talkloom.llm._spark import components
from talkloom.llm.mixing import leaf_budgets, mix_sources
from talkloom.llm.ngram_join import least_matches, ngram_jaccard_join, one_of_each_class
from talkloom.llm.packing import encoder, first_fit_decreasing, pack_documents, sequences
from talkloom.llm.sharding import shard_rows, write_shards
from talkloom.llm.substring_dedup import RUN_WORDS, UNIT_WORDS, remove_repeats


def fold(text: str) -> str:
    return "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in text)


def blank_words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x00-\x20]+", fold(text or "")) if w]


def shingle_set(text: str | None) -> frozenset:
    w = blank_words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- words ----------------------------------------------------------------------


def test_words_are_those_of_a_plain_split():
    texts = ["", None, "  a  B c", "ÄÖ öx\nß", "x" * 5000 + " y", "\n", "last word"]
    (part,) = T.slices(pa.array(texts))
    w = T.words(part)
    got = [part.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    want = [(k, x) for k, t in enumerate(texts) for x in (t or "").split()]
    assert list(zip(w.text.tolist(), got, strict=True)) == want
    by_word = dict(zip([fold(g) for g in got], w.hash, strict=True))
    assert len(set(by_word.values())) == len(by_word)
    (other,) = T.slices(pa.array(["Y äö B"]))
    assert T.words(other).hash.tolist() == [by_word["y"], by_word["äö"], by_word["b"]]


def test_slices_and_shingles_do_not_depend_on_the_cut():
    texts = [" ".join(f"w{(k * j) % 50}" for j in range(k % 40)) for k in range(200)]
    whole = {}
    for limit in (64, 1 << 20):
        sets = []
        for part in T.slices(pa.array(texts), limit):
            values, offsets = T.shingles(T.words(part), part.hi - part.lo, 5)
            sets += [tuple(values[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
        whole[limit] = sets
        assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    assert whole[64] == whole[1 << 20]


# --- components -----------------------------------------------------------------


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)], [(5, 3), (3, 9), (9, 5), (20, 10), (10, 20), (7, 7)]])
def test_components(spark, edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in root}


# --- operator 1 -----------------------------------------------------------------


def check_shards(rows, shards):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    sizes = [len(by_shard.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_shards_are_even_gapless_and_whole(spark, sf):
    docs = documents(spark, sf)
    rows = shard_rows(docs, 16, bucket_bytes=200_000).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    assert {r["doc_id"]: r["text"] for r in rows} == {r["doc_id"]: r["text"] for r in docs.collect()}
    check_shards(rows, 16)
    place = lambda rs: {r["doc_id"]: (r["shard"], r["slot"]) for r in rs}
    assert place(shard_rows(docs.repartition(5), 16, bucket_bytes=200_000).collect()) == place(rows)
    other = place(shard_rows(docs, 16, seed=1, bucket_bytes=200_000).collect())
    assert sum(other[k] == v for k, v in place(rows).items()) < 30
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert abs(np.corrcoef([r["doc_id"] for r in order], range(len(order)))[0, 1]) < 0.15


def test_shards_of_awkward_rows(spark, awkward, tmp_path):
    out = shard_rows(awkward, 4)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "count", "shard", "slot"]
    rows = out.collect()
    key = lambda r: (r["doc_id"], r["text"])
    assert Counter(map(key, rows)) == Counter(map(key, awkward.collect()))
    check_shards(rows, 4)
    write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
    assert shard_rows(awkward.limit(0), 4).count() == 0


def test_a_key_of_a_third_of_the_rows_is_scattered(spark):
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "cast(id as string) as text")
    out = shard_rows(rows, 8, bucket_bytes=3000).collect()
    check_shards(out, 8)
    assert sorted(int(r["text"]) for r in out) == list(range(6000))
    hot = Counter(r["shard"] for r in out if r["doc_id"] == 7)
    assert len(hot) == 8 and max(hot.values()) < 500


# --- operator 2 -----------------------------------------------------------------


def brute_links(rows, threshold=0.8):
    sets = [shingle_set(r["text"]) if r["doc_id"] is not None else frozenset() for r in rows]
    index = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            index[x].append(k)
    links = defaultdict(set)
    for k, s in enumerate(sets):
        for j, shared in Counter(j for x in s for j in index[x] if j != k).items():
            if shared / (len(s) + len(sets[j]) - shared) >= threshold:
                links[k].add(j)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for k, others in links.items():
            low = min((label[j] for j in others | {k}), key=lambda x: rows[x]["doc_id"])
            if rows[low]["doc_id"] < rows[label[k]]["doc_id"]:
                label[k], changed = low, True
    return sorted((rows[k]["doc_id"] if rows[k]["doc_id"] is not None else -1, rows[label[k]]["doc_id"] if rows[k]["doc_id"] is not None else -1, len(links[k])) for k in range(len(rows)))


def joined(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["class_id"] is None else r["class_id"], r["n_links"]) for r in ngram_jaccard_join(df).collect())


def test_ngram_join_against_all_pairs(spark, sf):
    docs = documents(spark, sf)
    assert joined(docs) == brute_links(docs.collect())


def test_ngram_join_by_shuffle_where_nothing_is_broadcast(spark, sf, monkeypatch):
    import talkloom.llm.ngram_join as N

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 400")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    links, kept = rows(ngram_jaccard_join(docs)), rows(one_of_each_class(docs))
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    assert rows(ngram_jaccard_join(docs)) == links and rows(one_of_each_class(docs)) == kept
    assert len(kept) < 400


def test_ngram_join_of_awkward_rows(spark, awkward):
    assert joined(awkward) == brute_links(awkward.collect())
    assert joined(awkward.limit(0)) == []


def test_ngram_join_in_blocks(spark, monkeypatch):
    import talkloom.llm.ngram_join as N

    monkeypatch.setattr(N, "BUCKET_BLOCK", 20)
    monkeypatch.setattr(N, "CLUSTER_BLOCK", 4000)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 5), replace=False):
            words[at] = f"x{k}_{at}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df) == brute_links(df.collect())


def test_one_of_each_class_stays(spark, awkward):
    kept = one_of_each_class(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 3, 4, 5, 7, 8, 9]
    assert kept.where("doc_id is null").count() == 2


def test_texts_of_one_doc_id_are_documents_of_their_own(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b), (3, b), (1, ""), (1, ""), (1, None), (4, b + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df) == brute_links(rows_of(df))
    kept = sorted((r["doc_id"], r["text"] or "") for r in one_of_each_class(df).collect())
    assert kept == sorted([(1, ""), (1, ""), (1, a), (1, b)])  # a null text is not the empty one


def rows_of(df):
    return df.collect()


def test_pruning_rarely_drops_a_pair_at_the_threshold():
    rng = np.random.default_rng(0)
    least = least_matches(0.8, 1e-5)
    matches = rng.random((200_000, 64)) < 0.8
    steps = matches.cumsum(1)[:, 15::16]
    assert (steps < np.array(least)).any(1).mean() < 1e-4
    assert all(a < b for a, b in zip(least, least[1:], strict=False))


# --- operator 4 -----------------------------------------------------------------


def brute_removed(rows):
    units = []
    for r in rows:
        text, at = r["text"] or "", 0
        mine = []
        for line in text.split("\n"):
            tokens = [(m.start() + at, m.end() + at) for m in re.finditer(r"[^\x00-\x20]+", line)]
            at += len(line) + 1
            run = []
            for k, (a, b) in enumerate(tokens):
                run.append((a, b))
                if k == len(tokens) - 1 or text[b - 1] in ".!?":
                    if len(run) >= UNIT_WORDS:
                        mine.append((run[0][0], run[-1][1], len(run), tuple(fold(text[x:y]) for x, y in run)))
                    run = []
        units.append(mine)
    first = {}
    order = lambda k: (rows[k]["doc_id"] is not None, rows[k]["doc_id"] or 0)
    for k in sorted(range(len(rows)), key=order):
        for a, _, _, words in units[k]:
            first.setdefault(words, (rows[k]["doc_id"], rows[k]["text"], a))
    out = []
    for k, r in enumerate(rows):
        spans, open_ = [], None
        for a, b, n, words in units[k]:
            if first[words] != (r["doc_id"], r["text"], a):
                open_ = [a, b, n, first[words][0]] if open_ is None else [open_[0], b, open_[2] + n, open_[3]]
            elif open_:
                spans.append(open_)
                open_ = None
        spans = [s for s in [*spans, open_] if s and s[2] >= RUN_WORDS]
        text, done, kept = r["text"], 0, []
        for a, b, *_ in spans:
            kept.append(text[done:a])
            done = b
        out.append((r["doc_id"], text if text is None else "".join(kept) + text[done:], [tuple(s) for s in spans]))
    return sorted(out, key=repr)


def removed(df):
    return sorted(((r["doc_id"], r["text"], [(s["start"], s["end"], s["words"], s["first_doc_id"]) for s in r["removed_spans"]]) for r in remove_repeats(df).collect()), key=repr)


def test_repeats_against_brute_force(spark, sf):
    docs = documents(spark, sf)
    got = removed(docs)
    assert got == brute_removed(docs.collect())
    assert sum(bool(s) for *_, s in got) > 50


def test_a_passage_pasted_inside_a_line_goes_and_its_first_copy_stays(spark):
    passage = " ".join(" ".join(f"p{k}_{j}" for j in range(11)) + "." for k in range(6))
    rows = [(k, f"own{k} text{k} before {passage} after{k} it{k}\nAll rights reserved.") for k in range(4)]
    out = {d: (t, s) for d, t, s in removed(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert out[0][0] == rows[0][1] and not out[0][1]
    for k in (1, 2, 3):
        assert len(out[k][1]) == 1 and out[k][1][0][2] >= 50 and out[k][1][0][3] == 0
        assert "p3_4" not in out[k][0] and "reserved" in out[k][0] and f"after{k}" in out[k][0]


def test_a_passage_of_short_lines_goes_and_what_stands_once_stays(spark):
    short = "\n".join(f"s{k} t{k} u{k}" for k in range(20))
    header, footer = (" ".join(f"{x}{k}" for k in range(20)) + "." for x in "hf")
    rows = [(0, f"own zero\n{short}"), (1, f"{header}\nonly one\n{footer}"), (2, f"own two\n{short}"), (3, f"{header}\nonly three\n{footer}")]
    out = {d: (t, s) for d, t, s in removed(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert out[2] == ("own two\n", [(8, len(rows[2][1]), 60, 0)])
    # header and footer hold 20 words each: no run holds both, as a line between them stands once
    assert all(out[k] == (rows[k][1], []) for k in (0, 1, 3))


def test_a_passage_cut_inside_sentences_goes_with_its_edges(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [
        (0, f"{a}. {b}. {c}. end zero."),
        (1, f"x y z {' '.join(a.split()[-15:])}. {b.upper()}. {' '.join(c.split()[:15])} p q"),  # 15 + 20 + 15 words
        (2, f"v w a19. {b}. c0 u t"),  # 1 + 20 + 1 words: too few
        (3, f"{b}. m n. {b}. m o"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert remove_repeats(df).where("size(removed_spans) > 0").count() == 0
    out = {r["doc_id"]: (r["text"], [(s["words"], s["first_doc_id"]) for s in r["removed_spans"]]) for r in remove_repeats(df, edges=True).collect()}
    assert out == {0: (rows[0][1], []), 1: ("x y z  p q", [(50, 0)]), 2: (rows[2][1], []), 3: (rows[3][1], [])}


def test_repeats_with_edges_in_awkward_rows(spark, awkward, sf):
    assert remove_repeats(awkward, edges=True).count() == awkward.count()
    docs = documents(spark, sf)
    given = docs.selectExpr("doc_id", "text", "text AS given")
    plain, wide = ({(r["doc_id"], r["given"]): r["removed_spans"] for r in remove_repeats(given, edges=e).collect()} for e in (False, True))
    for key, spans in wide.items():
        assert all(x["end"] <= y["start"] for x, y in zip(spans, spans[1:], strict=False))
        assert all(any(w["start"] <= s["start"] and s["end"] <= w["end"] for w in spans) for s in plain[key])
        assert all(len(re.findall(r"[^\x00-\x20]+", key[1][s["start"] : s["end"]])) == s["words"] for s in spans)


def test_repeats_in_awkward_rows(spark, awkward):
    got = removed(awkward)
    assert [(d, t) for d, t, _ in got] == sorted(((r["doc_id"], r["text"]) for r in awkward.collect()), key=repr) or len(got) == awkward.count()
    assert removed(awkward.limit(0)) == []
    assert remove_repeats(awkward).columns == [*awkward.columns, "removed_spans"]


# --- operator 8 -----------------------------------------------------------------


def brute_budgets(leaves, weights, budget, epochs):
    """leaves: {(path): tokens}; fills siblings by repeated proportional shares."""
    given = {(): budget}
    depth = len(next(iter(leaves)))
    for d in range(depth):
        cap = Counter()
        for path, n in leaves.items():
            below = (weights(path[:k]) > 0 for k in range(d + 2, depth + 1))
            cap[path[: d + 1]] += n * epochs * all(below)
        families = defaultdict(list)
        for path in cap:
            families[path[:-1]].append(path)
        for parent, kids in families.items():
            rest, open_ = given[parent], [k for k in kids if weights(k) > 0]
            out = dict.fromkeys(kids, 0)
            while open_:
                total = sum(weights(k) for k in open_)
                full = [k for k in open_ if cap[k] * total <= rest * weights(k)]
                if not full:
                    for k in open_:
                        out[k] = rest * weights(k) // total
                    spare = rest - sum(out[k] for k in open_)
                    for k in sorted(open_, key=lambda k: (-(rest * weights(k) % total), k))[:spare]:
                        out[k] += 1
                    break
                k = min(full, key=lambda k: cap[k] / weights(k))
                out[k] = cap[k]
                rest -= cap[k]
                open_.remove(k)
            given |= out
    return {p: given[p] for p in leaves}


def test_budgets_flow_to_siblings_before_ancestors(spark):
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "1"): 50, ("b", "x", "1"): 5000, ("b", "x", "2"): 0, ("b", "z", "9"): 70}
    weights = {"l0": {"a": 70, "b": 30}, "l1": {"x": 3, "y": 1}, "l2": {"9": 0}}
    rows = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "l0 string, l1 string, l2 string, tokens long")
    from pyspark.sql import functions as F

    for budget in (0, 7, 400, 1500, 4000, 90_000):
        got = {(r["l0"], r["l1"], r["l2"]): r["given"] for r in leaf_budgets(rows, ["l0", "l1", "l2"], weights, F.lit(budget) + F.max("tokens") * 0).collect()}
        want = brute_budgets(leaves, lambda p: weights[f"l{len(p) - 1}"].get(p[-1], 1), budget, 2)
        assert got == want, budget


def test_no_budget_is_lost_below_a_child_without_weight(spark):
    from pyspark.sql import functions as F

    leaves = [("d0", "en", 1000), ("d0", "fr", 10), ("d1", "fr", 1000)]
    rows = spark.createDataFrame(leaves, "l0 string, l1 string, tokens long")
    for budget in (1206, 1207, 2020, 5000):
        got = {(r["l0"], r["l1"]): r["given"] for r in leaf_budgets(rows, ["l0", "l1"], {"l1": {"en": 0}}, F.lit(budget) + F.max("tokens") * 0).collect()}
        assert got == {("d0", "en"): 0, ("d0", "fr"): 20, ("d1", "fr"): min(2000, budget - 20)}
    rows = spark.createDataFrame([("a", k, 100) for k in "xyz"], "l0 string, l1 string, tokens long")
    assert sorted(r["given"] for r in leaf_budgets(rows, ["l0", "l1"], {}, F.lit(100) + F.max("tokens") * 0).collect()) == [33, 33, 34]


def test_rows_without_doc_id_have_places_of_their_own(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(None, f"w{k} a b c", "s") for k in range(400)], "doc_id long, text string, source string")
    assert mix_sources(rows, {}, {"source": F.col("source")}, budget_share=0.5).count() == 200


def test_mix_against_brute_force(spark, sf):
    import hashlib

    docs = documents(spark, sf)
    rows = docs.collect()
    got = sorted((r["doc_id"], r["epoch"], r["n_tokens"]) for r in Q.op8_mix_sources(spark, sf).collect())
    leaf = lambda r: (f"d{int(re.search('[0-9]+$', r['source'])[0]) % 4}", r["lang"], r["source"])
    tokens = {r["doc_id"]: len(re.findall(r"[^ \t\n\x0b\f\r]+", r["text"])) for r in rows}
    leaves = Counter()
    for r in rows:
        leaves[leaf(r)] += tokens[r["doc_id"]]
    levels = ("domain", "lang", "source")
    given = brute_budgets(leaves, lambda p: Q.WEIGHTS.get(levels[len(p) - 1], {}).get(p[-1], 1), sum(leaves.values()) * 6 // 10, 2)
    want = []
    for path, total in leaves.items():
        mine = [r["doc_id"] for r in rows if leaf(r) == path]
        epochs, rest = divmod(given[path], total)
        want += [(d, e, tokens[d]) for e in range(epochs) for d in mine]
        upto = 0
        for d in sorted(mine, key=lambda d: hashlib.md5(f"8:{epochs}:{d}".encode()).hexdigest()):
            upto += tokens[d]
            if upto > rest or not rest:
                break
            want.append((d, epochs, tokens[d]))
    assert got == sorted(want)


def test_mix_of_awkward_rows(spark, awkward):
    from pyspark.sql import functions as F

    levels = {"lang": F.col("lang"), "source": F.col("source")}
    out = mix_sources(awkward, {}, levels, budget_share=5.0)
    assert out.columns == [*awkward.columns, "mix_epoch", "mix_tokens"]
    some = awkward.where("length(trim(text)) > 4").count()
    assert out.where("mix_tokens > 0").count() == 2 * some
    assert mix_sources(awkward.limit(0), {}, levels).count() == 0


# --- operator 9 -----------------------------------------------------------------


def test_ids_are_the_tokenizers(spark, sf):
    ids = encoder()
    texts = [r["text"] for r in documents(spark, sf).collect()[:300]]
    texts += ["", "   ", "It's\tA\r\n b c d'll 12,5!? <|endoftext|> ok", "é ́x İI ΑΣ ΟΔΟΣ.", "日本語 テスト　x", "a\x1cb ​ c"]
    texts += ["It'S, OK. We'LL, x', y.", "«Ça», dit-il. Fin», x", "a., b .. c ,. d , , e. ", "ÀÉ, Öß. µ, ², ½. ª.", "<|ENDOFTEXT|>, a. b", "x\xa0, y\x85. z", ", . ,. a,b. c.d, "]
    for text in texts:
        want = ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids(text), "<u4").tolist() == want


def test_first_fit_decreasing_against_a_scan():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 257):
        sizes = rng.integers(1, 101, n)
        bins, offsets = first_fit_decreasing(sizes, 100)
        used = []
        for item in np.argsort(-sizes, kind="stable"):
            at = next((k for k, u in enumerate(used) if u + sizes[item] <= 100), len(used))
            if at == len(used):
                used.append(0)
            assert (bins[item], offsets[item]) == (at, used[at])
            used[at] += sizes[item]


def check_packed(rows, length, texts):
    ids = encoder()
    by_sequence, pieces = defaultdict(list), Counter()
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["start"], bytes(r["ids"])] += 1
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    want = Counter()
    for doc_id, text in texts:
        data = ids(text or "") + b"\2\0\0\0"
        for s in range(0, len(data) // 4, length):
            want[doc_id, s, data[4 * s : 4 * (s + length)]] += 1
    assert pieces == want
    return by_sequence


def test_packing_round_trip(spark, sf):
    docs = documents(spark, sf)
    packed = pack_documents(docs, group_chars=800_000)
    rows = packed.collect()
    by_sequence = check_packed(rows, 4096, [(r["doc_id"], r["text"]) for r in docs.collect()])
    used = sum(r["length"] for r in rows)
    assert used / (4096 * len(by_sequence)) > 0.97
    for r in sequences(pack_documents(docs.limit(200))).collect():
        n = len(r["ids"]) // 4
        assert n == (r["n_ids"] if bin(r["n_ids"]).count("1") == 1 else 4096)


def test_packing_of_awkward_rows(spark, awkward):
    rows = pack_documents(awkward, length=512).collect()
    check_packed(rows, 512, [(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert pack_documents(awkward.limit(0)).count() == 0


def test_op1_and_op9_digests(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, sf).collect()}
    for r in Q.op1_two_pass_shuffle(spark, sf).collect():
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    for r in Q.op9_pack_sequences(spark, sf).limit(100).collect():
        data = encoder()(texts[r["doc_id"]]) + b"\2\0\0\0"
        assert zlib.crc32(data[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
