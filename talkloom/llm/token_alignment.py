"""Operator 13: alignment of the tokens of two tokenizers.

Python only tokenises: ids and the byte offsets at which tokens end. All else are
higher-order and array functions over these numbers. The ends of both, merged in order, cut a
text into segments; each segment lies in one token of either, so that segments are the
links; ends that both share close the groups.
"""

from __future__ import annotations

import base64
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import stored, tidy
from .piece_codec import BLANK, MODEL, WORD_CHARS, by_bytes, id_lists, model_path

#: Names of the byte-level tokenizer among the public ones: its file, and its ranks.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Bytes of words that a Python worker remembers, at most about.
REMEMBERED_BYTES = 96 << 20
#: Text bytes that Python tokenises together: about ten arrays of all their tokens.
TEXT_BYTES = 1 << 19
#: Id pairs whose counts are broadcast (under 40 bytes each); more are joined by shuffle.
BROADCAST_PAIRS = 1_000_000
#: An id pair as one number: the first id times this, and the second.
PAIR = 1 << 31
#: What tokenized() gives. Arrays without nulls are sorted as plain numbers.
TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType(), False)) for c in ("a_ends", "a", "a_places", "b_ends", "b", "b_places")]])

#: A blank between such characters begins a word for both tokenizers, whatever stands
#: around it; words of such characters alone are cut alike by both of A's libraries.
_SAFE = "!-~À-ÖØ-öø-ÿ"
_BETWEEN = re.compile(f" (?<=[{_SAFE}] )(?=[{_SAFE}])")
_PLAIN = re.compile(f"[{_SAFE}]+")


def _byte_letters() -> dict[str, int]:
    """What byte-level vocabularies write for each byte: itself where it is printable
    Latin-1, else the next character from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}


class TokenPair:
    """Ids of words by both tokenizers. A word is written with the blank before it."""

    def __init__(self, tokenizer: str, ranks: str | None, model: str, remembered: int = REMEMBERED_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(model_path(tokenizer))
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.fast = None
        if ranks:  # the same vocabulary, by a library that is several times faster
            import public_tokenizers
            import tiktoken

            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, open(model_path(ranks), "rb"))}
            self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path(model))
        size = self.b.get_piece_size()
        if any(BLANK in self.b.id_to_piece(i).lstrip(BLANK) for i in range(size)):
            raise ValueError(f"{model} has pieces that span words")
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(BLANK, " ").encode() for i in range(size)]
        self.a_lengths = np.array([len(x) for x in self.a_bytes], np.int32)
        self.b_lengths = np.array([len(x) for x in self.b_bytes], np.int32)
        self.most, self.held = remembered, 0
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    @staticmethod
    def _cut(ids: np.ndarray, lengths: np.ndarray, upto: np.ndarray) -> list[bytes]:
        """The ids of words that were encoded as one text; upto: where each ends."""
        ends = np.cumsum(lengths[ids])
        stop = np.searchsorted(ends, upto)
        if len(stop) and not np.array_equal(ends[np.minimum(stop, len(ends) - 1)], upto):
            raise ValueError("a token spans words")
        stop = (4 * (stop + 1)).tolist()
        data = ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *stop], stop, strict=False)]

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if self.fast and _PLAIN.fullmatch(w)]
        if plain:
            text = " " + " ".join(plain)
            upto = np.cumsum([len(w.encode()) + 1 for w in plain])
            a = self._cut(np.array(self.fast.encode_ordinary(text), np.int64), self.a_lengths, upto)
            b = self._cut(np.array(self.b.encode(text[1:]), np.int64), self.b_lengths, upto)
            self.known.update(zip(plain, zip(a, b, strict=True), strict=True))
        plain = set(plain)
        others = [w for w in words if w not in plain]
        if others:
            encoded = self.a.encode_batch_fast([" " + w for w in others], add_special_tokens=False)
            for word, a, b in zip(others, encoded, self.b.encode(others, num_threads=1), strict=True):
                a, whole = a.ids, (" " + word).encode()
                same = b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
                self.known[word] = (np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()) if same else None

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids of each text by both; none if a word's tokens are not its bytes."""
        if self.held > self.most:
            self.known.clear()
            self.held = 0
        split = [_BETWEEN.split(text) if text else [] for text in texts]
        new = list(set(chain.from_iterable(split)).difference(self.known))
        if new:
            self._learn(new)
        found, both = self.known.__getitem__, ([], [])
        for words in split:
            pairs = list(map(found, words))
            a, b = zip(*pairs, strict=True) if pairs and None not in pairs else ((), ())
            both[0].append(b"".join(a))
            both[1].append(b"".join(b))
        for word in new:
            if len(word) > WORD_CHARS:
                del self.known[word]
            else:
                self.held += 300 + 10 * len(word)
        return both


_pairs: dict[tuple, TokenPair] = {}


def _tokens(tokenizer: str, ranks: str | None, model: str):
    def run(batches):
        key = (tokenizer, ranks, model)
        if key not in _pairs:
            _pairs[key] = TokenPair(*key)
        both = _pairs[key]
        for whole in batches:
            for batch in by_bytes(whole, "text", TEXT_BYTES):
                columns = [batch.column("doc_id")]
                for side, encoded, lengths in zip((0, PAIR), both.encode([t or "" for t in batch.column("text").to_pylist()]), (both.a_lengths, both.b_lengths), strict=True):
                    ids = id_lists(encoded)
                    flat = np.cumsum(lengths[ids.values.to_numpy()], dtype=np.int64)
                    offsets = ids.offsets.to_numpy()
                    size = np.diff(offsets)
                    at = flat - np.repeat(np.concatenate([[0], flat])[offsets[:-1]], size)
                    ends = at << 32
                    place = np.arange(len(ends)) - np.repeat(offsets[:-1], size)
                    columns += [pa.ListArray.from_arrays(ids.offsets, pa.array(x)) for x in (at, ends + ids.values.to_numpy(), ends + side + place)]
                yield pa.RecordBatch.from_arrays(columns, TOKENS.names)

    return run


def tokenized(documents: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, model: str = MODEL) -> DataFrame:
    """doc_id and, of blank and text, the bytes at which tokens end by both tokenizers:
    a_ends and b_ends; and as numbers that sort by these (times 2 ** 32): a and b, with
    the id added, a_places and b_places, with the token's place among its own added, and
    with PAIR for b. A text that is null, empty or not the bytes of its tokens has none.
    `ranks`: A's vocabulary for the faster library, if there is."""
    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(tidy(_tokens(tokenizer, ranks, model)), TOKENS)


def align(tokens: DataFrame) -> DataFrame:
    """Groups and links of tokenized(): its doc_id, a_ids, b_ids, n_a, n_b, n_groups, `links`
    (array of long: first id times PAIR and second id, one for each pair of token
    occurrences that overlap, in order), `segments` (links, and a null for each end that
    makes none) and `groups` (string `a1,a2|b1;a3|b2,b3`). All steps take time in
    proportion to the tokens of a document, besides sorting them. Columns that nobody
    reads are not made. Arrays that lambdas run over are columns of their own, used twice:
    Spark then compiles what makes them."""
    low = F.lit(PAIR - 1).cast("long")
    end = lambda code: F.shiftright(code, 32)
    numbers = lambda codes: F.transform(codes, lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)))
    size = lambda c: F.size(c).cast("long")
    # ends of both in order, a's first; and the ends that both share, which close groups
    merged = tokens.withColumns({"merged": F.sort_array(F.concat("a_places", "b_places")), "shared": F.array_intersect("a_ends", "b_ends")})

    def link(code, place):
        """Of what stands before, as many as have no place in their own array are of the
        other. An end of b that a shares closes no segment of its own."""
        of_a, own = code.bitwiseAND(F.lit(PAIR)) == 0, code.bitwiseAND(low).cast("int")
        pair = lambda a, b: F.get("a", a).bitwiseAND(low) * F.lit(PAIR) + F.get("b", b).bitwiseAND(low)
        again = end(F.get("merged", place - 1)) == end(code)
        return F.when(of_a, pair(own, place - own)).when(again, F.lit(None).cast("long")).otherwise(pair(place - own, own))

    # a mark sorts behind the token that ends where it stands
    marked = merged.withColumn("marks", F.transform("shared", lambda x: F.shiftleft(x, 32) + F.lit(PAIR)))
    sorted_ = marked.withColumns({f"{side}_marked": F.sort_array(F.concat(side, "marks")) for side in "ab"})
    whole = lambda c: F.when(F.size(c) > 0, numbers(c))
    listed = sorted_.withColumns({f"{side}_listed": F.split(F.replace(F.concat(F.array_join(whole(f"{side}_marked").cast("array<string>"), ","), F.lit(",")), F.lit(f",{PAIR},"), F.lit(";")), ";") for side in "ab"})
    groups = F.when(F.size("a_listed") == F.size("b_listed"), F.array_join(F.zip_with("a_listed", "b_listed", lambda a, b: F.concat(a, F.lit("|"), b)), ";"))
    return listed.withColumn("joined", groups).select(
        "doc_id", numbers("a").alias("a_ids"), numbers("b").alias("b_ids"), size("a").alias("n_a"), size("b").alias("n_b"), size("shared").alias("n_groups"),
        F.transform("merged", link).alias("segments"), F.array_compact(F.transform("merged", link)).alias("links"),
        # behind the last mark stands nothing
        F.coalesce(F.substring("joined", F.lit(1), F.octet_length("joined") - 2), F.lit("")).alias("groups"),
    )


def align_tokenizers(documents: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, model: str = MODEL, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best
    (links whose count is their first id's highest, ties included), count_sum (counts
    of all links) and groups_sha256 ('' without tokens). The count of an id pair is the
    number of rows of documents that hold it linked.

    All rows stay, repeated ones too, which count each. Null and empty texts, and those
    that are not the bytes of their tokens, give zeros. A null doc_id stays null. Further
    columns are not read. An empty table gives an empty result. A document is one row
    of the links table, 8 bytes a link. The counts of pairs are broadcast up to
    `broadcast_pairs` of them, and joined by shuffle beyond."""
    aligned = align(tokenized(documents, tokenizer, ranks, model))
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256))
    rows = stored(
        aligned.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), digest.alias("groups_sha256"), "segments"),
        "token-links",
    )
    counts = stored(rows.select(F.explode(F.array_distinct("segments")).alias("pair")).where("pair IS NOT NULL").groupBy("pair").agg(F.count("*").alias("n")), "token-pairs")
    first = F.expr(f"pair div {PAIR}L")
    best = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    ranked = stored(counts.withColumn("a", first).join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "token-pairs-ranked")
    ranked = F.broadcast(ranked) if ranked.count() <= broadcast_pairs else ranked.hint("merge")
    scores = rows.select("row", F.explode("segments").alias("pair")).where("pair IS NOT NULL").join(ranked, "pair").groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.drop("segments").join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
