"""Operator 4: substring dedup by hashing lines and the sentences inside them.

A unit is a sentence: it ends with a line or with one of . ! ? before a blank, so
that a passage is found wherever it was pasted. Units are normalised and hashed,
digests grouped over the whole corpus, the occurrence that ranks first is kept.
Of the others, runs of successive units that hold enough words are removed, with
their offsets in the original text. Every unit is hashed, however short, and a run
holds repeated units alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._spark import stored

#: Words from which a unit is hashed (all are), and words a removed run holds at least.
UNIT_WORDS, RUN_WORDS = 1, 25
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def _units(batches):
    for batch in batches:
        ids, same = batch.column("doc_id"), batch.column("same")
        for part in T.slices(batch.column("text")):
            w = T.words(part)
            n = len(w.hash)
            if not n:
                continue
            lines = np.zeros(len(part.data) + 1, np.int64)
            np.cumsum(part.data == 10, out=lines[1:])
            edge = np.searchsorted(w.text, np.arange(len(part.offsets)))
            last = np.ones(n, bool)
            last[:-1] = (w.text[1:] != w.text[:-1]) | (lines[w.start[1:]] > lines[w.end[:-1]]) | _ENDS[part.data[w.end[:-1] - 1]]
            end = np.flatnonzero(last) + 1
            begin = np.concatenate([[0], end[:-1]])
            text = w.text[begin]
            chars = T.char_offsets(part)
            origin = chars[part.offsets[text]]
            firsts = np.searchsorted(text, text, "left")
            size, same_text = end - begin, text[1:] == text[:-1]
            before, after = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
            before[1:], after[:-1] = size[:-1] * same_text, size[1:] * same_text
            rows = pa.array(text + part.lo)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(T.runs(w.hash, begin, end, 1).view(np.int64)),
                    pa.array(T.runs(w.hash, begin, end, 2).view(np.int64)),
                    ids.take(rows),
                    same.take(rows),
                    pa.array((np.arange(len(text)) - firsts).astype(np.int32)),
                    pa.array((chars[w.start[begin]] - origin).astype(np.int64)),
                    pa.array((chars[w.end[end - 1]] - origin).astype(np.int64)),
                    *(pa.array(x.astype(np.int32)) for x in (size, begin - edge[text], before, after)),
                ],
                ["digest_a", "digest_b", "doc_id", "same", "ord", "start", "end", "words", "at", "before", "after"],
            )


UNITS = "digest_a long, digest_b long, doc_id long, same long, ord int, start long, end long, words int, at int, before int, after int"


def _named(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), text.alias("text"))


_WORD = re.compile(r"[^\x00-\x20]+")
_FOLD = {c: c + 32 for c in (*range(65, 91), *range(0xC0, 0xDF)) if c != 0xD7}
_OF_RUN = {"start": "long", "end": "long", "from_at": "int", "to_at": "int", "first_doc_id": "long", "first_start": "long", "kept_doc_id": "long", "kept_same": "long", "kept_at": "int"}
_OF_RUN_SQL = f"struct<{', '.join(f'{c}: {t}' for c, t in _OF_RUN.items())}>"
CONTEXTS = f"run {_OF_RUN_SQL}, doc_id long, same long, at int, origin long, lead int, context string"


def _contexts(batches):
    """The words around each place asked for: `lead` words of `context` stand before
    word `at`; `origin` is the context's code point in the text. `run` is null where
    a kept occurrence is asked for."""
    for batch in batches:
        out = []
        for doc_id, same, text, needs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "same", "text", "needs")), strict=True):
            places = [m.span() for m in _WORD.finditer(text)]
            for need in needs:
                a, b = max(0, need["at"] - need["left"]), min(len(places), need["at"] + need["right"])
                origin = places[a][0]
                out.append((need["run"], doc_id, same, need["at"], origin, need["at"] - a, text[origin : places[b - 1][1]]))
        yield pa.RecordBatch.from_pylist([dict(zip(_CONTEXT_TYPE.names, r, strict=True)) for r in out], _CONTEXT_TYPE)


_CONTEXT_TYPE = pa.schema([("run", pa.struct([(c, pa.int64() if t == "long" else pa.int32()) for c, t in _OF_RUN.items()])), ("doc_id", pa.int64()), ("same", pa.int64()), ("at", pa.int32()), ("origin", pa.int64()), ("lead", pa.int32()), ("context", pa.string())])


def _longer(batches):
    """Extends runs over the words that their own context and the kept one share."""
    for batch in batches:
        table = batch.to_pydict()
        for k, (own, kept) in enumerate(zip(table["context"], table["kept_context"], strict=True)):
            places = [m.span() for m in _WORD.finditer(own)]
            x, y = (_WORD.findall(t.translate(_FOLD)) for t in (own, kept))
            i, j = table["lead"][k], table["kept_lead"][k]
            left, right = 0, 0
            while left < min(i, j) and x[i - 1 - left] == y[j - 1 - left]:
                left += 1
            while i + right < len(x) and j + right < len(y) and x[i + right] == y[j + right]:
                right += 1
            low, high = table["at"][k] - left, table["at"][k] + right
            if low < table["from_at"][k]:
                table["start"][k] = table["origin"][k] + places[i - left][0]
                table["from_at"][k] = low
            if high > table["to_at"][k]:
                table["end"][k] = table["origin"][k] + places[i + right - 1][1]
                table["to_at"][k] = high
        yield pa.RecordBatch.from_pydict({c: pa.array(table[c], batch.schema.field(c).type) for c in _RUN}, pa.schema([batch.schema.field(c) for c in _RUN]))


_RUN = ["doc_id", "same", "start", "end", "from_at", "to_at", "first_doc_id", "first_start"]
RUNS = "doc_id long, same long, start long, end long, from_at int, to_at int, first_doc_id long, first_start long"


def _with_edges(documents: DataFrame, runs: DataFrame, run_words: int) -> DataFrame:
    """Runs, each extended as far as the text around its longest unit and around that
    unit's kept occurrence agree, into the sentence before and the one after."""
    runs = stored(runs.where(F.col("to_at") - F.col("from_at") + F.col("left") + F.col("right") >= run_words), "repeated-units")
    open_ended = runs.where((F.col("left") > 0) | (F.col("right") > 0))
    reach = [(F.col("anchor") - F.col("from_at") + F.col("left")).alias("left"), (F.col("to_at") - F.col("anchor") + F.col("right")).alias("right")]
    kept = open_ended.select(F.col("kept.doc_id").alias("doc_id"), F.col("kept.same").alias("same"), F.col("kept.at").alias("at"), *reach)
    kept = kept.groupBy("doc_id", "same", "at").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    of_run = F.struct(*_RUN[2:], F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.same").alias("kept_same"), F.col("kept.at").alias("kept_at"))
    needs = (
        open_ended.select(of_run.alias("run"), "doc_id", "same", F.col("anchor").alias("at"), *reach)
        .unionByName(kept.withColumn("run", F.lit(None).cast(_OF_RUN_SQL)))
        .groupBy(F.col("doc_id").alias("__id"), F.col("same").alias("__same"))
        .agg(F.collect_list(F.struct("run", "at", "left", "right")).alias("needs"))
    )
    found = _named(documents).join(needs, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("same") == F.col("__same"))).select("doc_id", "same", "text", "needs")
    contexts = stored(found.mapInArrow(_contexts, CONTEXTS), "run-contexts")
    own = contexts.where("run is not null").select("doc_id", "same", "at", "origin", "lead", "context", "run.*")
    theirs = contexts.where("run is null").select(*(F.col(c).alias(f"__{c}") for c in ("doc_id", "same", "at")), F.col("lead").alias("kept_lead"), F.col("context").alias("kept_context"))
    # rows of one doc_id and text give the same contexts
    theirs = theirs.dropDuplicates(["__doc_id", "__same", "__at"])
    there = F.col("kept_doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("kept_same") == F.col("__same")) & (F.col("kept_at") == F.col("__at"))
    both = own.join(theirs, there).select(*_RUN, "at", "origin", "lead", "context", "kept_lead", "kept_context")
    longer = both.mapInArrow(_longer, RUNS).dropDuplicates(["doc_id", "same", "start"])
    whole = longer.unionByName(runs.where("left = 0 and right = 0").select(*_RUN)).where(F.col("to_at") - F.col("from_at") >= run_words)
    # two runs may both reach into the one sentence between them
    last = Window.partitionBy("doc_id", "same").orderBy("start")
    end, to_at = F.lag("end").over(last), F.lag("to_at").over(last)
    return whole.withColumns({"__end": end, "__to": to_at}).withColumns({"start": F.greatest("start", "__end"), "from_at": F.greatest("from_at", "__to")}).select(*_RUN)


def repeated_runs(documents: DataFrame, run_words: int = RUN_WORDS, edges: bool = False) -> DataFrame:
    """Runs of repeated units to remove: doc_id, same (hash of the text), start and
    end (code points, end exclusive), words, and the place of the run's first unit
    that is kept, first_doc_id and first_start. One row for equal rows. With
    `edges`, runs are extended before their words are counted; see remove_repeats."""
    units = _named(documents).mapInArrow(_units, UNITS)
    digest = ["digest_a", "digest_b"]
    # combined before the shuffle, so that a common line is one row from each task
    kept = units.groupBy(*digest).agg(F.min(F.struct("doc_id", "same", "start", "at")).alias("kept"), F.count("*").alias("n")).where("n > 1").select(*digest, "kept")
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("same") == F.col("kept.same")) & (F.col("start") == F.col("kept.start"))
    repeated = units.join(kept, digest).withColumn("again", ~stays).drop(*digest).repartition("doc_id", "same").dropDuplicates(["doc_id", "same", "ord"])
    in_order = Window.partitionBy("doc_id", "same").orderBy("ord")
    ends = {"__before": F.lag("ord").over(in_order), "__after": F.lead("ord").over(in_order), "__n": F.sum(F.col("again").cast("int")).over(in_order)}
    # only a sentence that stands once is open to an extension: no copy relies on it
    left = F.when(F.col("__before") == F.col("ord") - 1, 0).otherwise(F.col("before"))
    right = F.when(F.col("__after") == F.col("ord") + 1, 0).otherwise(F.col("after"))
    longest = F.max(F.struct("words", -F.col("ord"), "at", "kept"))
    runs = (
        repeated.withColumns(ends)
        .where("again")
        .withColumn("run", F.col("ord") - F.col("__n"))
        .groupBy("doc_id", "same", "run")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.min("at").alias("from_at"), F.max(F.col("at") + F.col("words")).alias("to_at"),
            F.sum(left).cast("int").alias("left"), F.sum(right).cast("int").alias("right"), F.min(F.struct("ord", "kept")).alias("first"), longest.alias("longest"),
        )
        .select("doc_id", "same", "start", "end", "from_at", "to_at", "left", "right", F.col("first.kept.doc_id").alias("first_doc_id"), F.col("first.kept.start").alias("first_start"), F.col("longest.at").alias("anchor"), F.col("longest.kept").alias("kept"))
    )
    runs = _with_edges(documents, runs, run_words) if edges else runs.where(F.col("to_at") - F.col("from_at") >= run_words)
    return runs.select("doc_id", "same", "start", "end", (F.col("to_at") - F.col("from_at")).cast("long").alias("words"), "first_doc_id", "first_start")


def remove_repeats(documents: DataFrame, run_words: int = RUN_WORDS, edges: bool = False) -> DataFrame:
    """Every row of `documents`, its text without repeated runs, and removed_spans:
    array of start, end, words, first_doc_id, first_start in the order of the given
    text, empty where nothing went.

    The occurrence of smallest (doc_id, text hash, offset) is kept; a null doc_id
    ranks first. Rows of one doc_id and text are one document: they keep and lose
    the same. Null, empty and short texts stay as they are. Words are separated by
    blanks and control characters, ASCII and Latin-1 letters fold case. A column
    named removed_spans is replaced, others pass. An empty table gives an empty
    result.

    With `edges`, a run reaches into the sentence before it and the one after, as
    far as the words there follow its longest unit's kept occurrence as well, and
    these words count: so a passage that was cut inside a sentence goes whole. A
    sentence that is kept for others is never cut into."""
    documents = documents.drop("removed_spans")
    spans = (
        repeated_runs(documents, run_words, edges)
        .groupBy(F.col("doc_id").alias("__id"), F.col("same").alias("__same"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "words", "first_doc_id", "first_start"))).alias("removed_spans"))
    )
    text = F.col("text").cast("string")
    joined = documents.withColumn("__text_hash", F.xxhash64(text)).join(
        stored(spans, "repeated-runs"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__same")), "left"
    )
    # kept stretches lie between one removed span's end and the next one's start
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("removed_spans", lambda s: s["end"]))
    ends = F.concat(F.transform("removed_spans", lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(text, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))), "")
    none = F.array().cast("array<struct<start:long,end:long,words:long,first_doc_id:long,first_start:long>>")
    others = [F.when(F.col("removed_spans").isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in documents.columns]
    return joined.select(*others, F.coalesce("removed_spans", none).alias("removed_spans"))
