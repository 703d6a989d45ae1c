"""Text functions as Column expressions: normalising, splitting, scoring, rendering."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters, patterns and texts that results depend on.
JAPANESE = "一-龯ぁ-んァ-ンー"
TERM_PATTERN = rf"[A-Za-z0-9_]+|[{JAPANESE}]{{2,}}"
SPLIT_TERM_PATTERN = rf"^[{JAPANESE}]{{5,}}$"
LINE_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
TERMINATORS = "。！？!?"
OUTRO_PHRASES = ("ご視聴ありがとうございました", "ありがとうございました", "thank you", "thanks for watching")
DECISIONS = "決定 合意 採用 確定 承認 締切 期限 リリース 方針".split()
ACTIONS = "TODO 対応 担当 確認します 確認する お願いします してください やります 進めます 作成 修正".split()
QUESTIONS = "未解決 確認が必要 質問 課題 懸念 要確認 どう なぜ いつ 誰".split()
FALLBACK_TITLES = {"ja": "会議メモ", "en": "Meeting Notes"}
TITLE_CHARS = {"ja": 24, "en": 60}
NO_BULLETS = "- 特になし"
SENTENCE_CHARS = 90


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Characters that Unicode counts as white space.
BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column | str) -> Column:
    """Without blanks (of any script) at both ends."""
    return F.btrim(col(c), F.lit(BLANKS))


def holds(c: Column, words: Sequence[str]) -> Column:
    """Whether any of the words stands in a text."""
    out = F.lit(False)
    for word in words:
        out = out | F.contains(c, F.lit(word))
    return out


def strip_of(c: Column | str, chars: str) -> Column:
    """Without the given characters at both ends."""
    return F.btrim(col(c), F.lit(chars))


def java_replacement(python_replacement: str) -> str:
    r"""Replacement text with \1 groups in Java's notation."""
    escaped = python_replacement.replace("$", r"\$")
    return re.sub(r"\\(\d)", r"$\1", escaped)


def correct(c: Column | str, rules: Iterable[Sequence[str]]) -> Column:
    """Ordered, case-insensitive substitutions; null: empty; patterns that do not
    compile and entries that are no pairs are skipped."""
    out = strip(F.coalesce(col(c), F.lit("")))
    for rule in rules:
        if isinstance(rule, (list, tuple)) and len(rule) == 2:
            try:
                re.compile(rule[0])
            except re.error:
                continue
            out = F.regexp_replace(out, f"(?iuU){rule[0]}", java_replacement(rule[1]))
    return strip(out)


def query_terms(c: Column | str) -> Column:
    """Lower-case search terms, each once in order; long Japanese runs also give all
    their 4-grams, then 3-grams."""
    grams = lambda t, n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda k: F.substring(t, k, F.lit(n)))
    terms = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TERM_PATTERN), 0)
    wide = F.transform(terms, lambda t: F.when(F.regexp_like(t, F.lit(SPLIT_TERM_PATTERN)), F.concat(F.array(t), grams(t, 4), grams(t, 3))).otherwise(F.array(t)))
    return F.array_distinct(F.flatten(wide))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text, without overlaps."""
    n = F.length(term)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def term_score(text: Column, terms: Column) -> Column:
    """Sum of occurrences times length over all terms."""
    low = F.lower(text)
    return F.aggregate(terms, F.lit(0).cast("long"), lambda s, t: s + occurrences(low, t) * F.greatest(F.lit(1), F.length(t)))


def plain_lines(c: Column | str) -> Column:
    """Lines without blank ones and without speaker labels."""
    lines = F.transform(F.split(F.coalesce(col(c), F.lit("")), LINE_BREAKS), strip)
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\*\*[^*]+\*\*:(?U)\s*", ""), r"^[^:：]{1,12}[:：](?U)\s*", "")
    return F.filter(F.transform(F.filter(lines, lambda x: x != ""), lambda x: strip_of(bare(x), " \u3000")), lambda x: x != "")


def sentences(lines: Column) -> Column:
    """Sentences of lines, ends stripped, cut into pieces of SENTENCE_CHARS."""
    text = strip(F.array_join(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.regexp_replace(x, "。+$", "")), "。"))
    parts = F.transform(F.split(text, rf"[{TERMINATORS}](?U)\s*|[\r\n]+"), lambda x: strip_of(x, " \u3000" + TERMINATORS))
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.length(x), F.lit(SENTENCE_CHARS)), lambda k: F.substring(x, k, F.lit(SENTENCE_CHARS)))
    return F.flatten(F.transform(F.filter(parts, lambda x: x != ""), cut))


def title(found: Column, language: str = "ja") -> Column:
    """The first usable sentence, shortened; else a fixed title. Sentences after it
    are not looked at."""
    bare = lambda s: strip_of(F.regexp_replace(s, f"[{TERMINATORS}].*$", ""), " \u3000-・")
    usable = lambda s: F.when(~holds(F.lower(s), OUTRO_PHRASES) & (F.length(bare(s)) >= 6), bare(s))
    first = F.aggregate(found, F.lit(None).cast("string"), lambda acc, s: F.when(acc.isNotNull(), acc).otherwise(usable(s)))
    key = language if language in TITLE_CHARS else "en"
    return F.coalesce(F.left(first, F.lit(TITLE_CHARS[key])), F.lit(FALLBACK_TITLES[key]))


def bullets(items: Column, limit: int = 5, words: Sequence[str] = ()) -> Column:
    """A Markdown list of the first items (of those that hold one of the words, if
    any are given) that differ in their first 40 characters."""
    none = F.array().cast("array<string>")
    bare = lambda x: strip_of(x, " \u3000-・")

    def keep(acc, x):
        wanted = holds(x, words) if words else F.lit(True)
        fresh = wanted & (bare(x) != "") & ~F.exists(acc, lambda y: F.left(y, F.lit(40)) == F.left(bare(x), F.lit(40)))
        return F.when(F.size(acc) >= limit, acc).when(fresh, F.array_append(acc, bare(x))).otherwise(acc)

    kept = F.aggregate(items, none, keep)
    return F.when(F.size(kept) == 0, F.lit(NO_BULLETS)).otherwise(F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), "\n"))


def chunks(c: Column | str, max_chars: int) -> Column:
    """Lines packed greedily into chunks: one closes when the next line would make
    its lines and breaks exceed max_chars; an oversize line stays whole; a text of
    up to max_chars is one chunk."""
    text = F.coalesce(col(c), F.lit(""))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("size"))

    def step(s, line):
        n = F.length(line)
        closes = (s["size"] + n > max_chars) & s["cur"].isNotNull()
        return F.struct(
            F.when(closes, F.array_append(s["out"], s["cur"])).otherwise(s["out"]).alias("out"),
            F.when(closes | s["cur"].isNull(), line).otherwise(F.concat(s["cur"], F.lit("\n"), line)).alias("cur"),
            (F.when(closes, 0).otherwise(s["size"]) + n + 1).alias("size"),
        )

    packed = F.aggregate(F.split(text, "\n"), start, step, lambda s: F.array_append(s["out"], s["cur"]))
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(packed)


def excerpt(text: Column, terms: Column, limit: Column) -> Column:
    """`limit` characters around the earliest occurrence of any term."""
    at = F.transform(F.filter(terms, lambda t: (t != "") & (F.instr(F.lower(text), t) > 0)), lambda t: F.instr(F.lower(text), t) - 1)
    centre = F.coalesce(F.array_min(at), F.lit(0))
    n = F.length(text)
    end = F.least(n, F.greatest(F.lit(0), centre - F.floor(limit / 2)) + limit)
    start = F.greatest(F.lit(0), end - limit)
    body = F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
    around = F.concat(F.when(start > 0, F.lit("...\n")).otherwise(F.lit("")), body, F.when(end < n, F.lit("\n...")).otherwise(F.lit("")))
    return F.when(n <= limit, text).otherwise(around)


def similar(a: Column, b: Column, least: float = 0.65) -> Column:
    """Whether the smaller set of word runs lies in the other by that share."""
    runs = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit("[ぁ-んァ-ン一-龯A-Za-z0-9]+"), 0))
    x, y = runs(a), runs(b)
    fewest = F.least(F.size(x), F.size(y))
    return F.when(fewest > 0, F.size(F.array_intersect(x, y)) / fewest >= least).otherwise(F.lit(False))


def clean_phrase(c: Column | str) -> Column:
    """A phrase of 3 to 28 word characters, not digits alone; else empty."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", ""), r"(?U)[^\w一-龯ぁ-んァ-ンー０-９0-9]+", "")
    good = F.length(bare).between(3, 28) & ~F.regexp_like(bare, F.lit("^[0-9０-９]+$"))
    return F.when(good, bare).otherwise(F.lit(""))


def markdown_section(text: Column, heading: str) -> Column:
    """What stands below `## heading`, up to the next second-level heading."""
    return F.trim(strip(F.regexp_extract(text, rf"(?ms)^##\s+{re.escape(heading)}[^\S\n]*$(.*?)(?=^##\s|\z)", 1)))


def plain_inline(c: Column | str) -> Column:
    """Without bold marks and backticks."""
    return strip(F.replace(F.replace(col(c), F.lit("**"), F.lit("")), F.lit("`"), F.lit("")))


def safe_file_name(c: Column | str, fallback: str | None = "meeting") -> Column:
    """Characters that file systems refuse become _, 60 characters at most; where
    nothing is left, the fallback, if there is one."""
    name = F.left(F.regexp_replace(col(c), r'[\\/:*?"<>|]', "_"), F.lit(60))
    return name if fallback is None else F.coalesce(F.nullif(name, F.lit("")), F.lit(fallback))


def escape_html(c: Column | str) -> Column:
    """& < > and both quotes as entities."""
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def minutes_seconds(seconds: Column) -> Column:
    """mm:ss of whole seconds, of any number of them; null stays null."""
    whole = seconds.cast("long")
    return F.when(whole.isNotNull(), F.format_string("%02d:%02d", F.call_function("div", whole, F.lit(60)), whole % 60))


def live_line(kind: Column, label: Column, text: Column) -> Column:
    """A caption by kind of event; null for empty texts."""
    line = F.when(kind == "status", text).when(kind == "provisional", F.concat(label, F.lit(": "), text, F.lit(" ..."))).otherwise(F.concat(label, F.lit(": "), text))
    return F.when(F.coalesce(text, F.lit("")) != "", line)


def phrases_of(query: str) -> list[str]:
    """A search text as phrases that must all be found: its words without double
    quotes."""
    return query.replace('"', "").split()


def clean_title(c: Column | str, fallback: str) -> Column:
    """First line of a generated title without quotes and bullets."""
    first = F.get(F.split(F.coalesce(col(c), F.lit("")), LINE_BREAKS), F.lit(0))
    return F.coalesce(F.nullif(strip_of(first, " \u3000\"'`#・-"), F.lit("")), F.lit(fallback))
