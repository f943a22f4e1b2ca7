"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text.

A line with a word fails one of three rules, asked in this order:

* navigation: menus; two or more separators and at least one for every six words, or a short line that
  holds a phrase of menus;
* boilerplate: a line of at most ``SHORT_WORDS`` words that holds a phrase of notices, or code braces alone;
* punctuation: symbols or doubled exclamation marks on more than every fifth word, or a line that neither ends
  a sentence nor holds the end of one (so a paragraph whose last sentence is cut stays, a bare label goes).

A document is rejected if its failed lines hold more than ``LOST`` of its word characters. Base measures
over the whole text come first: too few words, or too many words in repeated three-word windows, reject it
whatever its lines are.

Defined cases: a null or empty text, or one of white space, has no words and fails the base; very long
texts and lines are read whole, in pieces of a bounded size; repeated rows and ids are judged each on its
own; a null id is kept; an empty table gives an empty result; extra columns are ignored by ``judge``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 50, 50, 30
SHORT_WORDS, MENU_WORDS, PIECE = 40, 12, 1 << 20
SPACES, SEPARATORS, SYMBOLS, MARKS = " \t\n\x0b\x0c\r", "|»›•·>", "#*$%&|<>", ".!?…。！？"
MENU_PHRASES = ("skip to content", "skip to main", "back to top", "main menu", "site map", "next page", "previous page", "read more", "log in", "sign in")
NOTICE_PHRASES = (
    "all rights reserved", "privacy policy", "cookie policy", "use cookies", "uses cookies", "use of cookies", "terms of use", "terms of service", "enable javascript",
    "javascript is disabled", "lorem ipsum", "click here", "subscribe to our", "sign up for our", "share this", "follow us on", "powered by",
)
RULES = ("navigation", "boilerplate", "punctuation")

_GAP = re.compile(rb"[\x20\x09-\x0D]")
_ENDS = re.compile(r"""[.!?…。！？][)"'”’»\]]*(?:[\x20\x09-\x0D]|$)""")
_LOWER = {k: k + 32 for k in range(65, 91)}

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_lines long, n_navigation long, n_boilerplate long, n_punctuation long, lost_chars long, clean_text string"
)


def fault(line: str, n: int) -> str | None:
    """The first rule that a line of ``n`` words fails."""
    bars = sum(map(line.count, SEPARATORS))
    if bars >= 2 and bars * 6 >= n:
        return "navigation"
    if n <= SHORT_WORDS:
        low = line.translate(_LOWER)
        if n <= MENU_WORDS and any(p in low for p in MENU_PHRASES):
            return "navigation"
        if any(p in low for p in NOTICE_PHRASES) or not low.strip(SPACES + "{}"):
            return "boilerplate"
    if (sum(map(line.count, SYMBOLS)) + line.count("!!")) * 5 > n or not _ENDS.search(line):
        return "punctuation"
    return None


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` cut at white space into pieces of about ``PIECE`` bytes."""
    at = 0
    while len(data) - at > PIECE:
        gap = _GAP.search(data, at + PIECE)
        if gap is None:
            break
        yield data[at : gap.end()]
        at = gap.end()
    yield data[at:] if at else data


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more. ``ids``: a number for each word."""
    if len(ids) < 4:
        return 0
    pair = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
    _, at, count = np.unique(pair[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
    again = count[at] >= 2
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, SPACES))


def measure(text: str) -> dict:
    """The columns of ``SCHEMA`` but the id."""
    known: dict[bytes, int] = {}
    numbers = array("q")
    chars = word_chars(text)
    seen: set[str] = set()
    out = dict.fromkeys(RULES, 0)
    lines = dup = lost = 0
    clean = []
    for line in text.split("\n"):
        before = len(numbers)
        for piece in _pieces(line.encode("utf-8", "surrogatepass")):
            numbers.extend([known.setdefault(w, len(known)) for w in piece.split()])
        n = len(numbers) - before
        if not n:
            clean.append(line)
            continue
        lines += 1
        dup += line in seen
        seen.add(line)
        if (why := fault(line, n)) is None:
            clean.append(line)
        else:
            out[why] += 1
            lost += word_chars(line)
    ids = np.frombuffer(numbers, np.int64) if numbers else np.empty(0, np.int64)
    repeats = repeat_words(ids)
    base = len(ids) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(ids)
    return {
        "n_words": len(ids), "word_chars": chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": dup, "n_repeat_words": repeats, "base_failed": base,
        "kept": not base and 100 * lost <= MAX_LOST_PERCENT * chars, "n_lines": lines, **{f"n_{k}": v for k, v in out.items()}, "lost_chars": lost, "clean_text": "\n".join(clean),
    }


def judge(docs: DataFrame, texts: bool = True) -> DataFrame:
    """``SCHEMA`` for each row of ``docs``; ``texts``: with the text that is left, lines in their order."""
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    names = names if texts else names[:-1]
    schema = SCHEMA if texts else SCHEMA.rpartition(", ")[0]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [measure(t or "") for t in batch["text"].to_pylist()]
        types = {"base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.string()}
        return pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([x[c] for x in found], types.get(c, pa.int64())) for c in names[1:])], names=names)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their columns, the text without the lines that failed."""
    names = docs.columns
    types = docs.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [measure(t or "") for t in batch["text"].to_pylist()]
        at = names.index("text")
        batch = batch.set_column(at, pa.field("text", pa.string()), pa.array([x["clean_text"] for x in found], pa.string()))
        return batch.filter(pa.array([x["kept"] for x in found], pa.bool_()))

    return map_arrow(docs, run, types)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), texts=False)


def _any(column: str, phrases: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


_W = r"[^\x20\x09-\x0D]+"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLOSE = ")\"''”’»\\]"  # a quote doubled for SQL

ORACLE_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
w as (select r, unnest(regexp_extract_all(text, '{_W}')) as word, generate_subscripts(regexp_extract_all(text, '{_W}'), 1) as i from d),
win as (select r, i, (word, lead(word) over o, lead(word, 2) over o) as t, lead(word, 2) over o is not null as whole from w window o as (partition by r order by i)),
again as (select r, i from (select r, i, count(*) over (partition by r, t) as c from win where whole) x where c >= 2),
hit as (select r, count(distinct i + k) as n_repeat_words from again, (select unnest([0, 1, 2]) as k) ks group by r),
l as (select r, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as j from d),
m as (
  select r, line, j, len(regexp_extract_all(line, '{_W}')) as n, translate(line, '{_UPPER}', '{_SMALL}') as low,
    length(regexp_replace(line, '[^|»›•·>]', '', 'g')) as bars,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) + (length(line) - length(replace(line, '!!', ''))) // 2 as signs,
    length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as chars,
    regexp_matches(line, '[.!?…。！？][{_CLOSE}]*([\x20\x09-\x0D]|$)') as ends
  from l
),
f as (
  select r, line, j, chars, case
    when bars >= 2 and bars * 6 >= n then 'navigation'
    when n <= {MENU_WORDS} and {_any("low", MENU_PHRASES)} then 'navigation'
    when n <= {SHORT_WORDS} and ({_any("low", NOTICE_PHRASES)} or regexp_matches(line, '^[\x20\x09-\x0D{{}}]*$')) then 'boilerplate'
    when signs * 5 > n or not ends then 'punctuation' end as why,
    row_number() over (partition by r, line order by j) as nth
  from m where n > 0
),
s as (
  select r, count(*) as n_lines, count(*) filter (where nth > 1) as n_dup_lines, count(*) filter (where why = 'navigation') as n_navigation,
    count(*) filter (where why = 'boilerplate') as n_boilerplate, count(*) filter (where why = 'punctuation') as n_punctuation,
    coalesce(sum(chars) filter (where why is not null), 0) as lost_chars
  from f group by r
),
a as (
  select doc_id, cast(len(regexp_extract_all(text, '{_W}')) as bigint) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    coalesce(n_lines, 0) as n_lines, coalesce(n_navigation, 0) as n_navigation, coalesce(n_boilerplate, 0) as n_boilerplate,
    coalesce(n_punctuation, 0) as n_punctuation, cast(coalesce(lost_chars, 0) as bigint) as lost_chars
  from d left join s using (r) left join hit using (r)
),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars as kept, n_lines, n_navigation, n_boilerplate, n_punctuation, lost_chars
from b
"""
