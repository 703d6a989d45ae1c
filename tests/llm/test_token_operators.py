"""SentencePiece codec, prefix trie and token alignment against the libraries
themselves, plain loops and SQL."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from talkloom.llm import piece_codec, prefix_trie, queries, token_alignment
from talkloom.llm.piece_codec import PieceCodec, decode_pieces, encode_pieces
from talkloom.llm.token_alignment import align, align_tokenizers, tokenized

LETTERS = " \n\tabcABC 012.,'s▁éßöñ😀漢　\x00ﬁ\x1c\x85\xa0"


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def bytewise():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def odd_texts(n: int, seed: int = 3) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(40))) for _ in range(n)]


# -- codec


def test_ids_are_the_librarys(pieces):
    codec = PieceCodec()
    draw = random.Random(5)
    known = [pieces.id_to_piece(i).replace("▁", " ") for i in range(259, 32_000)]
    joined = ["".join(draw.choice(known) for _ in range(draw.randrange(1, 9))) for _ in range(2000)]
    blanks = [" " * draw.randrange(60) + "x" + " " * draw.randrange(60) for _ in range(100)]
    texts = ["", " ", "<s>", "<0x41>", "퟿", *odd_texts(3000), *joined, *blanks]
    for text, found in zip(texts, codec.encode(texts), strict=True):
        ids = pieces.encode(text)
        assert np.frombuffer(found, "<u4").tolist() == ids, text
        assert codec.decode(np.array(ids)) == pieces.decode(ids), text


def test_the_prefix_table_holds_the_last_piece_of_each_prefix(pieces):
    codec = PieceCodec()
    word = "▁internationalisationen"
    table = codec.prefix_table(word)
    for n in range(1, len(word) + 1):
        assert table[n - 1][0] == pieces.encode(word[1:n])[-1] if n > 1 else table[0] is not None


def test_a_long_word_and_forgetting(pieces):
    codec = PieceCodec(remembered=1000)
    text = "ab" * 50_000 + "éa" * 100
    for some in (["one two three", "four five"], [text], ["one two three", text[:5]]):
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(some)] == [pieces.encode(t) for t in some]
    assert text not in codec.known
    assert max(map(len, codec.known)) <= piece_codec.WORD_CHARS


def test_broken_bytes_give_a_mark_each(pieces):
    codec = PieceCodec()
    for ids in ([198, 3 + 0xE9], [3 + 0xE9, 3 + 0x41], [3 + 0x20, 258, 95], [1, 300, 2], [0, 300]):
        assert codec.decode(np.array(ids)).strip() == pieces.decode(ids).strip()


def test_query_equals_the_library(spark, sf, pieces):
    found = {r.doc_id: r for r in queries.QUERIES["op11_piece_codec"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for r in rows:
        ids = pieces.encode(r.text or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(found[r.doc_id]) == (r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(pieces.decode(ids)))


def test_codec_takes_awkward_rows(spark, awkward, pieces):
    both = decode_pieces(encode_pieces(awkward.withColumn("decoded", awkward.lang).withColumn("piece_ids", awkward.n_chars)))
    assert set(both.columns) == {*awkward.columns, "piece_ids", "decoded"}
    rows = both.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r.piece_ids == pieces.encode(r.text or "") and r.decoded == (r.text or "")
    assert decode_pieces(encode_pieces(awkward.limit(0))).count() == 0
    none = decode_pieces(spark.createDataFrame([(1, None), (2, [])], "doc_id long, piece_ids array<int>"))
    assert [r.decoded for r in none.collect()] == ["", ""]


# -- trie


def plain_trie(built: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    """Every prefix, counted in dictionaries. Keys of `built` are conversations."""
    nodes = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += p not in children
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(c for c in m if len(built[c]) == len(p))) for p, m in nodes.items())


def trie_rows(df) -> list[tuple]:
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def rebuilt(rows) -> dict[int, list[tuple[str, str]]]:
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def test_trie_query_equals_plain_loops_and_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = trie_rows(queries.QUERIES["op12_prefix_trie"](spark, sf))
    assert found == plain_trie(rebuilt(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    order = "conv_id, depth, coalesce(parent_conv_id, -1), n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    assert found == sorted(con.execute(f"SELECT {order} FROM ({queries.ORACLE_SQL['op12_prefix_trie']})").fetchall())


@pytest.mark.parametrize("waiting", [3, 20_000])
def test_parts_of_many_ranges_are_stitched(spark, monkeypatch, waiting):
    draw = random.Random(waiting)
    built = {c: [(draw.choice(["user", "a"]), draw.choice(["x", "é", "yy"])) for _ in range(draw.choice([0, 1, 2, 3, 9]))] for c in range(600)}
    built |= {c: [("user", "hot"), ("assistant", "conversation")] for c in range(1000, 1500)}
    built |= {c: [("user", "first"), ("assistant", str(c))] for c in range(2000, 2300)}
    rows = [(c, [{"role": a, "text": b} for a, b in t]) for c, t in built.items()]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<role:string,text:string>>").repartition(5)
    monkeypatch.setattr(prefix_trie, "WAITING", waiting)
    for setting, value in (("spark.sql.shuffle.partitions", "37"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        before = spark.conf.get(setting)
        spark.conf.set(setting, value)
        try:
            assert trie_rows(prefix_trie.prefix_trie(df)) == plain_trie(built)
        finally:
            spark.conf.set(setting, before)


def test_trie_takes_awkward_rows(spark):
    kind = "conv_id long, turn long, role string, text string, depth int, n_convs string"
    rows = [(0, None, "user", "b", 1, "x"), (0, 1, "user", None, 1, "x"), (0, 1, "user", None, 1, "x"), (0, 2, None, "a" * 100_000, 1, "x"), (3, 1, None, None, 1, "x"), (None, 1, "user", "lost", 1, "x"), (-7, 5, "user", "z", 1, "x"), (7, 1, "user", "", None, None), (11, 1, "user", "", None, None)]
    df = spark.createDataFrame(rows, kind)
    ours = rebuilt([r[:4] for r in rows if r[0] is not None])
    ours[-7] = [("user", "z")] if zlib.crc32(b"-7") % 9 < 1 else []  # its base is -5, which is absent
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.rebuilt_conversations(df))) == plain_trie(ours)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt_conversations(df.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, None, "y"), (2, [{"role": None, "text": None}], "z")], "conv_id long, turns array<struct<role:string,text:string>>, node string")
    assert [r[:4] for r in trie_rows(prefix_trie.prefix_trie(odd))] == [(1, 0, -1, 3), (2, 1, 1, 1)]


# -- alignment


def plain_alignment(a: list[bytes], b: list[bytes], a_ids: list[int], b_ids: list[int]):
    """Groups and links by walking both sequences side by side."""
    groups, links = [], []
    i = j = at = bt = start_a = start_b = 0
    while i < len(a):
        links.append((a_ids[i], b_ids[j]))
        end_a, end_b = at + len(a[i]), bt + len(b[j])
        if end_a == end_b:
            groups.append(",".join(map(str, a_ids[start_a : i + 1])) + "|" + ",".join(map(str, b_ids[start_b : j + 1])))
            start_a, start_b = i + 1, j + 1
        if end_a <= end_b:
            i, at = i + 1, end_a
        if end_b <= end_a:
            j, bt = j + 1, end_b
    return groups, links


def expected_alignment(rows, bytewise, pieces):
    letters = token_alignment._byte_letters()
    a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in bytewise.get_vocab().items()}
    b_bytes = [bytes([int(pieces.id_to_piece(i)[1:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(pieces.get_piece_size())]
    each, counts = [], collections.Counter()
    for doc_id, text in rows:
        a, b = ([], []) if not text else (bytewise.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text))
        if not (b"".join(a_bytes[i] for i in a) == b"".join(b_bytes[i] for i in b) == (" " + (text or "")).encode()):
            a, b = [], []
        groups, links = plain_alignment([a_bytes[i] for i in a], [b_bytes[i] for i in b], a, b)
        each.append((doc_id, len(a), len(b), groups, links))
        counts.update(set(links))
    most = collections.Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    sha = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return sorted((d is not None, d or 0, n_a, n_b, len(g), len(x), sum(counts[p] == most[p[0]] for p in x), sum(counts[p] for p in x), sha(g)) for d, n_a, n_b, g, x in each)


def alignment_rows(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_alignment_query_equals_plain_loops(spark, sf, bytewise, pieces):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert alignment_rows(queries.QUERIES["op13_token_alignment"](spark, sf)) == expected_alignment(rows, bytewise, pieces)


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_alignment_of_odd_texts(spark, bytewise, pieces, broadcast):
    texts = [None, "", " ", "  a", "a  b", "a ", "<|endoftext|> <s>", "\n", " \n x", "it's John's, it's", *odd_texts(500, 11)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = expected_alignment(rows, bytewise, pieces)
    assert alignment_rows(align_tokenizers(df, broadcast_pairs=broadcast)) == expected
    assert alignment_rows(align_tokenizers(df, ranks=None, broadcast_pairs=broadcast)) == expected


def test_alignment_takes_awkward_rows(spark, awkward, bytewise, pieces):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    df = awkward.withColumnRenamed("lang", "pair").withColumnRenamed("source", "row")
    assert alignment_rows(align_tokenizers(df)) == expected_alignment(rows, bytewise, pieces)
    assert align_tokenizers(df.limit(0)).count() == 0


def test_links_overlap_and_groups_hold_all_tokens(spark):
    df = spark.createDataFrame([(1, "Überraschung 😀!"), (2, "plain")], "doc_id long, text string")
    for r in align(tokenized(df)).collect():
        groups = [[side.split(",") for side in g.split("|")] for g in r.groups.split(";")]
        assert [int(i) for g in groups for i in g[0]] == r.a_ids
        assert [int(i) for g in groups for i in g[1]] == r.b_ids
        assert len(r.links) == len(r.a_ids) + len(r.b_ids) - r.n_groups


def test_tokens_of_half_a_megabyte_of_text_are_held_at_once():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "text": ["word " * 819] * 600})
    made = list(token_alignment._tokens(token_alignment.TOKENIZER, token_alignment.RANKS, token_alignment.MODEL)([batch]))
    assert sum(b.num_rows for b in made) == 600 and max(b.num_rows for b in made) <= 128


def test_other_words_are_encoded_in_batches(bytewise, pieces):
    both, calls = token_alignment.TokenPair(token_alignment.TOKENIZER, token_alignment.RANKS, token_alignment.MODEL), []
    both.b = type("Counted", (), {"encode": lambda self, *a, **k: calls.append(1) or pieces.encode(*a, **k)})()
    words = [f"слово{k}" for k in range(300)] + ["plain"]
    a, b = both.encode([f"a {w}" for w in words])
    assert len(calls) <= 2
    for word, x, y in zip(words, a, b, strict=True):
        assert x == np.array(bytewise.encode(f" a {word}", add_special_tokens=False).ids, "<u4").tobytes()
        assert y == np.array(pieces.encode(f"a {word}"), "<u4").tobytes()
