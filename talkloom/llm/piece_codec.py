"""Operator 11: SentencePiece encoding and decoding by a merge-type prefix table.

The vocabulary is of the merge type: any two neighbouring symbols whose joined text
is a piece may merge, best score first, leftmost among equals. A sequence of pieces
is what these merges lead to exactly if each two neighbours are, so every prefix of
a text has one last piece. An automaton finds the pieces that end at each place; the
one that is compatible with the last piece of the prefix before it is stored, and the
ids are read back from the end.
"""

from __future__ import annotations

import codecs
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import tidy

#: Name of the model among the public ones.
MODEL = "piece_bpe_32k.model"
#: What stands for a blank inside pieces.
BLANK = "▁"
#: Bytes of words that a Python worker remembers, at most about, and pairs of pieces
#: whose test it remembers (100 bytes each).
REMEMBERED_BYTES, REMEMBERED_PAIRS = 96 << 20, 500_000
#: Longest word that is remembered, and text bytes encoded together.
WORD_CHARS, BATCH_BYTES = 48, 2 << 20
#: What no encoding may hold back: tells that a model normalises texts.
_PROBE = " ﬁ①  Ａ é"


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("talkloom.each_byte", _each_byte)


def model_path(model: str) -> str:
    """A model file, or the place of a public one of that name."""
    if os.path.exists(model):
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


class PieceCodec:
    """Encodes and decodes with the vocabulary of one model. Ids travel as
    little-endian unsigned 32-bit bytes."""

    def __init__(self, model: str = MODEL, remembered: int = REMEMBERED_BYTES):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path(model))
        size = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {text[i]: sp.get_score(i) for i in plain}
        self.piece = text
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(text[i], (i, len(text[i]), {}))
        self.automaton.make_automaton()
        self.letters = {c for i in plain for c in text[i]}
        self.spanned = {text[i][k : k + 2] for i in plain for k in range(len(text[i]) - 1)}
        self.byte_ids = {int(text[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.apart = next(c for c in "\n\t\r\x00\x01\x02" if c not in self.letters)
        # a word may end before every blank, and around a line break, that no piece spans
        if any(BLANK in text[i].lstrip(BLANK) for i in plain):
            self.words = re.compile(r"(?s).+")
        elif "\n" in self.letters:
            self.words = re.compile(r" *[^ ]+| +")
        else:
            self.words = re.compile(r"\n| *[^ \n]+| +")
        # what ids stand for: controls for nothing
        shown = [bytes([int(text[i][1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else text[i].replace(BLANK, " ").encode() for i in range(size)]
        self.lengths = np.array([len(s) for s in shown], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.most, self.held = remembered, 0
        self.known: dict[str, bytes] = {}
        self.tested = 0
        if np.frombuffer(self.encode([_PROBE])[0], "<u4").tolist() != sp.encode(_PROBE):
            raise ValueError(f"{model} is not of the merge type, or normalises texts")

    def merged(self, symbols: str) -> list[str]:
        """The merges themselves, one by one: best score first, leftmost among
        equals. Only for the few characters of two pieces."""
        score, symbols = self.score.get, list(symbols)
        scores = [score(a + b) for a, b in zip(symbols, symbols[1:], strict=False)]
        while True:
            best, at = None, 0
            for k, s in enumerate(scores):
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return symbols
            symbols[at : at + 2] = [joined := symbols[at] + symbols[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(symbols[at - 1] + joined)
            if at < len(scores):
                scores[at] = score(joined + symbols[at + 1])

    def compatible(self, left: tuple, right: tuple) -> bool:
        """Whether the merges of both pieces' characters end with these two pieces."""
        a, b = self.piece[left[0]], self.piece[right[0]]
        # no piece spans them, or else the merges decide
        ok = left[2][right[0]] = a[-1] + b[0] not in self.spanned or self.merged(a + b) == [a, b]
        self.tested += 1
        return ok

    def prefix_table(self, text: str) -> list[tuple | None]:
        """For each prefix of the text, at its length less one, its last piece: id,
        number of characters, tests of what may follow; None if that is a character
        without a piece. The last entry is the empty prefix. Blanks are BLANK."""
        table: list = [None] * (len(text) + 1)
        compatible = self.compatible
        for end, piece in self.automaton.iter(text):
            if table[end] is None:
                last = table[end - piece[1]]
                # None: the start, or a character that nothing merges with
                if last is None or (ok := last[2].get(piece[0])) or (ok is None and compatible(last, piece)):
                    table[end] = piece
        return table

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text whose blanks are BLANK, read back from its end, and where
        each ends (characters; all bytes of a character without a piece end with it)."""
        table, at, ids, ends = self.prefix_table(text), len(text), [], []
        while at:
            if (piece := table[at - 1]) is not None:
                ids.append(piece[0])
                ends.append(at)
                at -= piece[1]
            else:
                for byte in reversed(text[at - 1].encode()):
                    ids.append(self.byte_ids[byte])
                    ends.append(at)
                at -= 1
        return np.array(ids[::-1], "<u4"), np.array(ends[::-1], np.int64)

    def learn(self, words: list[str]) -> None:
        """Encodes new words, all in one text: what stands between them is a part of
        no piece, so that nothing merges across it."""
        ids, ends = self.ids(self.apart.join(words).replace(" ", BLANK))
        last = np.cumsum([len(w) + 1 for w in words])
        first, stop = np.searchsorted(ends, last - [len(w) + 1 for w in words], "right"), np.searchsorted(ends, last - 1, "right")
        data = ids.tobytes()
        self.known.update((w, data[4 * a : 4 * b]) for w, a, b in zip(words, first.tolist(), stop.tolist(), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Words are remembered; new words of all texts are
        learnt together."""
        if self.held > self.most:
            self.known.clear()
            self.held = 0
        if self.tested > REMEMBERED_PAIRS:
            for _, _, tests in self.automaton.values():
                tests.clear()
            self.tested = 0
        split = [self.words.findall(" " + text.replace(BLANK, " ")) if text else [] for text in texts]
        new = list(set(chain.from_iterable(split)).difference(self.known))
        if new:
            self.learn(new)
        found = self.known.__getitem__
        out = [b"".join(map(found, words)) for words in split]
        for word in new:
            if len(word) > WORD_CHARS:
                del self.known[word]
            else:
                self.held += 180 + 5 * len(word)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces one after another, the blank that encoding puts
        first left out; bytes that make no character give U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        length = self.lengths[ids]
        ends = np.cumsum(length)
        n = int(ends[-1]) if len(ends) else 0
        first = self.piece[ids[0]].startswith(BLANK) if n else False
        data = self.shown[np.repeat(self.starts[ids] - (ends - length), length) + np.arange(n)].tobytes()
        return data[first:].decode("utf-8", "talkloom.each_byte")


_codecs: dict[str, PieceCodec] = {}


def codec(model: str = MODEL) -> PieceCodec:
    """The process's codec of a model."""
    if model not in _codecs:
        _codecs[model] = PieceCodec(model)
    return _codecs[model]


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES):
    """Cuts a batch into runs of rows whose strings hold about `limit` bytes."""
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    lo = 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def id_lists(encoded: list[bytes]) -> pa.Array:
    """Ids of texts as an array<int> column."""
    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def _added(df: DataFrame, name: str, column: str, kind: str, make) -> DataFrame:
    """df with a column `name` made from `column`, a few megabytes at a time."""

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, column) if kind != "string" else [whole.slice(at, 256) for at in range(0, whole.num_rows, 256)]:
                made = make(batch.column(column))
                kept = [k for k in batch.schema.names if k != name]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], made], [*kept, name])

    df = df.drop(name) if name != column else df
    schema = df.drop(name).withColumn(name, F.lit(None).cast(kind)).schema
    return df.mapInArrow(tidy(run), schema)


def encode_pieces(documents: DataFrame, model: str = MODEL, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """documents with `piece_ids`, array<int>: the ids of the whole text, without
    begin and end ids.

    All rows stay, each on its own, repeated ones too; a null or empty text has no
    ids. A column named piece_ids is replaced, all others stay. A word without
    blanks may be of any length: time and memory are in proportion to it. An empty
    table gives an empty result."""
    made = lambda column: id_lists(codec(model).encode([t or "" for t in column.to_pylist()]))
    return _added(documents.withColumn(text, F.col(text).cast("string")), ids, text, "array<int>", made)


def decode_pieces(encoded: DataFrame, model: str = MODEL, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """`encoded` with `decoded`, the text of the column of ids; null or no ids give
    an empty text. A column named decoded is replaced."""

    def made(column):
        decode = codec(model).decode
        return pa.array([decode(np.asarray(x.values)) if x.is_valid and len(x.values) else "" for x in column], pa.string())

    return _added(encoded, text, ids, "string", made)
