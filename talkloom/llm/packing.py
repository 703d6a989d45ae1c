"""Operator 9: packing token sequences by first-fit decreasing.

Documents are tokenised, cut at the sequence length, and dealt into random groups
that fit in memory. In each group the pieces, longest first, go to the first
sequence with room, which a tournament tree of remaining capacities finds in
logarithmic time.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import groups, scatter, tidy

#: Name of the tokenizer among the public ones.
TOKENIZER = "word_bpe_49k.json"
END_ID, LENGTH = 2, 4096
#: Text characters in a group, on average.
GROUP_CHARS = 8 << 20
#: Bytes of words and ids that a Python worker remembers within a task, at most about.
REMEMBERED_BYTES = 256 << 20
#: Documents encoded together.
ROWS_AT_ONCE = 256
#: Tasks that pack at most, each group after group: map tasks times these are the
#: blocks of the shuffle.
MAX_TASKS = 20_000
SEED = 9


#: Words made of Latin letters, digits and ASCII marks (no apostrophe) alone, and
#: the parts that the tokenizer's own pattern cuts them into.
_PLAIN = re.compile(r"[a-zA-ZÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
_PARTS = re.compile(r"[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


#: In Latin-1 text without marks in a row before a comma or full stop, both may
#: stand apart from the word: the tokenizer cuts there anyway.
_MARKS_IN_A_ROW = re.compile(r"[,.](?<=[^a-zA-Z0-9À-ÖØ-öø-ÿ ][,.]) ")


def _spread(text: str) -> str:
    """The text with the same ids, written so that fewer words differ: single-byte
    letters in lower case, commas and full stops before blanks apart."""
    text = text.replace("\n", " ")
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    if "<|" in text or _MARKS_IN_A_ROW.search(text):
        return text
    return text.lower().replace(", ", " , ").replace(". ", " . ")


class _Known(dict):
    """Ids of words; asking for a word that is missing gives None and notes it."""

    def __init__(self):
        self.missing: dict[str, None] = {}

    def __missing__(self, word: str) -> None:
        self.missing[word] = None


class _Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer never joins across blanks, so a text is encoded word by word
    (what single blanks and line breaks separate) and words are remembered. New
    plain words are cut into parts here; new parts are encoded many at once, past
    the normaliser that would leave them as they are. All other words take the
    tokenizer's full path."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = _Known()
        self.parts: dict[str, bytes] = {}
        self.held, self.most = 0, REMEMBERED_BYTES

    def forget(self) -> None:
        self.known.clear(), self.parts.clear()
        self.held = 0

    def _learn_parts(self, parts: list[str]) -> None:
        joined = [" ".join(parts[at : at + 200]) for at in range(0, len(parts), 200)]
        ids = np.array([i for e in self.bare.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], "<u4")
        # each part ends with the one token of it that ends a word
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(parts):
            raise ValueError("a word part without a final token")
        data = ids.tobytes()
        self.held += 200 * len(parts) + len(data)
        self.parts.update(zip(parts, [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))

    def _learn(self, words: list[str]) -> None:
        plain = {w: _PARTS.findall(w.lower()) for w in words if "<|" not in w and _PLAIN.fullmatch(w)}
        self._learn_parts(list({p for parts in plain.values() for p in parts}.difference(self.parts)))
        found = self.parts.__getitem__
        self.known.update((w, b"".join(map(found, parts))) for w, parts in plain.items())
        others = [w for w in words if w not in plain]
        self.held += 200 * len(words) + 4 * sum(map(len, words))  # about what a dict holds for each
        for word, encoding in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.known[word] = array("I", encoding.ids).tobytes()

    def __call__(self, text: str) -> bytes:
        return self.encode([text])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; new words of all texts are learnt together."""
        if self.held > self.most:
            self.forget()
        split = [_spread(text).split(" ") for text in texts]
        asked = self.known.__getitem__
        found = [list(map(asked, words)) for words in split]
        if new := list(self.known.missing):
            self.known.missing.clear()
            self._learn(new)
            for k, ids in enumerate(found):
                if None in ids:
                    found[k] = [asked(word) if x is None else x for word, x in zip(split[k], ids, strict=True)]
        return [b"".join(ids) for ids in found]


_encoders: dict[str, _Ids] = {}


def encoder(tokenizer: str = TOKENIZER) -> _Ids:
    """The process's encoder for a tokenizer file, or a public tokenizer's name."""
    if tokenizer not in _encoders:
        path = tokenizer
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        _encoders[tokenizer] = _Ids(path)
    return _encoders[tokenizer]


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, pack_group long"


def _cut(tokenizer: str, length: int, remembered: int):
    def pieces(batches):
        ids_of = encoder(tokenizer)
        ids_of.most = remembered
        encode = ids_of.encode
        end = array("I", [END_ID]).tobytes()
        for whole in batches:
            lo = 0
            while lo < whole.num_rows:
                # a few rows at a time: a batch may hold thousands of long texts
                batch = whole.slice(lo, ROWS_AT_ONCE)
                lo += ROWS_AT_ONCE
                ids, groups = batch.column("doc_id"), batch.column("pack_group")
                at, start, parts, total = [], [], [], []
                for k, data in enumerate(encode([text or "" for text in batch.column("text").to_pylist()])):
                    data += end
                    n = len(data) // 4
                    for s in range(0, n, length):
                        at.append(k), start.append(s), parts.append(data[4 * s : 4 * (s + length)]), total.append(n)
                rows, sizes = pa.array(at, pa.int32()), pa.array([len(p) // 4 for p in parts], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array(start, pa.int64()), sizes, pa.array(parts, pa.binary()), pa.array(total, pa.int64()), groups.take(rows)], ["doc_id", "start", "length", "ids", "doc_tokens", "pack_group"])
        ids_of.forget()

    return pieces


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length: longest first (ties by position), each to the
    lowest bin with room. Leaves of the tournament tree are bins, an inner node
    holds the most room below it."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, offsets
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    for item in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins, offsets


def _pack(length: int):
    def pack(batches):
        for table in groups(batches, "pack_group"):
            sizes = table["length"].to_numpy()
            bins, offset = first_fit_decreasing(sizes, length)
            sequence = (table["pack_group"].to_numpy() << 32) + bins
            packed = table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from packed.to_batches(max_chunksize=2048)

    return pack


def pack_documents(documents: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, group_chars: int = GROUP_CHARS, seed: int = SEED, remembered: int = REMEMBERED_BYTES) -> DataFrame:
    """Pieces of all documents, packed: doc_id, start (ids of its document before
    it), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and
    offset in the sequence. Sequences hold at most `length` ids and are gapless.

    A document's ids are the tokenizer's, then END_ID: a null or empty text gives
    one piece of END_ID alone. Repeated rows are packed as often as they stand; a
    doc_id that holds many rows is dealt to several groups.
    Further columns are not read. An empty table gives an empty result. A worker
    remembers the ids of about `remembered` bytes of words: fewer cost time, not rows."""
    text = F.col("text").cast("string")
    rows, chars = documents.agg(F.count("*"), F.sum(F.length(text).cast("long"))).first()
    n_groups = max(1, -(-(chars or 0) // group_chars))
    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    dealt = scatter(named, "doc_id", n_groups, rows, seed, "pack_group")
    pieces = dealt.mapInArrow(tidy(_cut(tokenizer, length, remembered)), PIECES)
    # a task packs its groups one after another, so that their number bounds nothing
    placed = pieces.repartitionById(min(n_groups, MAX_TASKS), (F.col("pack_group") % min(n_groups, MAX_TASKS)).cast("int")).sortWithinPartitions("pack_group", "doc_id", "start")
    return placed.mapInArrow(tidy(_pack(length)), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(packed: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """sequence_id, n_ids and ids (binary) of whole sequences. Each is padded to
    `length`, unless its own count is a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `length` parts
    joined = F.reduce(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    n = F.sum("length")
    grouped = packed.groupBy("sequence_id").agg(n.alias("n_ids"), joined.alias("ids"))
    power = F.bit_count("n_ids") == 1
    padding = F.unhex(F.repeat(F.lit(np.uint32(pad).tobytes().hex()), (F.lit(length) - F.col("n_ids")).cast("int")))
    return grouped.withColumn("ids", F.when(power, F.col("ids")).otherwise(F.concat("ids", padding)))
