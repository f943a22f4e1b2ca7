"""Conversation structure repair: the cheapest edits that bring each conversation into the grammar.

Roles' initials must read ``(s?(ua)+)?``. A row may be kept (K, 0), given the role user or assistant (R, 2) or
deleted (D, 3; required where it is blank or a repeat), and empty user or assistant turns may be inserted
(I, 2); a cut-off row that isn't deleted costs 1 more. The edits of least cost are found in Wu-Manber's manner:
one bitset for each cost holds, for all rows at once, the grammar states from which the rest can be brought
to acceptance within that cost; keeps spread inside a layer, other edits come from cheaper layers. The first
layer that holds the start gives the cost, and a walk through the bits the least audit, letter by letter.

A conversation may hold any share of the rows. Rows are put in order by a range sort and cut into segments of
at most ``SEGMENT``; layers over a segment give its costs from state to state, a conversation's 16 numbers a
segment are chained to the costs of what follows each, and segments are then walked on their own. Only the
digest of the repaired text, which is sequential, reads a conversation's rows in one stream, without holding
them; its audit holds a letter for each row, as it is one value.

Defined cases: a null role or text reads as one space; a null conv_id is a conversation of its own; null turns
stand first; equal turns stand by the digest of role and text; repeated rows are duplicates; roles go by their
first character, others than s, u and a fit nowhere; a conversation without rows has zeros, an empty audit and the
digest of the empty text; empty texts are blank; texts are read whole; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.shipping import ship

from .common import arrow_batches, map_arrow, staged, table
from .merkle import crc32_sql

#: Rows of a segment, a power of two.
SEGMENT = 2048
KEEP_CUT, REROLE, DELETE, INSERT = 1, 2, 3, 2
#: States: start, after a system turn, after a user turn, after an assistant turn. What follows each by role, and the next role of a turn made up.
STATES, STEPS = 4, {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
#: Cost of the inserts that end a conversation in each state.
ENDS = (0, 2 * INSERT, INSERT, 0)
NEVER = -1
#: A row's letter: its role's initial or x, a capital if the text is cut off, d if it must be deleted.
ROLES = {"u": "user", "a": "assistant"}
EMPTY = hashlib.sha256(b"").hexdigest()
_SPACE, _SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def _mask(codes: str, letters: str) -> int:
    """Four bits for each row whose letter is one of ``letters``."""
    return int("0" + "".join("f" if c in letters else "0" for c in reversed(codes)), 16)


def _made(x: int, ones: int) -> int:
    """States, in place, from which a made-up turn leads into ``x``."""
    return ((x >> 2) & ones) * 0b1011 | (x >> 1) & (ones << 2)


def layers(codes: str, after: tuple[int, ...], wanted: int) -> list[int]:
    """Bitsets by cost until row 0 has the ``wanted`` states; bits 4 i + p: state p before row i can be finished.

    ``after``: cost of finishing from each state behind the last row, ``NEVER`` where it can't be."""
    n = len(codes)
    rows = (1 << 4 * n) - 1
    ones = int("1" * (n + 1), 16)
    keep = {case: [_mask(codes, c.upper() if case else c) for c in "sua"] for case in (0, 1)}
    whole, cut = _mask(codes, "suax"), _mask(codes, "SUAX")

    def kept(x: int, masks: list[int]) -> int:
        y = x >> 4
        return (y >> 1) & ones & masks[0] | ((y >> 2) & ones) * 0b1011 & masks[1] | (y >> 1) & (ones << 2) & masks[2]

    out: list[int] = []
    back = lambda k: out[-k] if k <= len(out) else 0
    for cost in range(3 * n + 2 * INSERT + 1 + max(after)):
        x = back(1) | sum(1 << 4 * n + p for p, a in enumerate(after) if a == cost)
        x |= back(DELETE) >> 4 & rows | kept(back(KEEP_CUT), keep[1])
        x |= _made(back(REROLE) >> 4, ones) & whole | _made(back(REROLE + KEEP_CUT) >> 4, ones) & cut
        x |= _made(back(INSERT), ones) & rows
        while (more := x | kept(x, keep[0])) != x:
            x = more
        out.append(x)
        if x & wanted == wanted:
            break
    return out


def _least(found: list[int], bit: int) -> int:
    return next((c for c, x in enumerate(found) if x >> bit & 1), NEVER)


@lru_cache(1 << 15)
def costs(codes: str) -> tuple[int, ...]:
    """Least cost over a segment from each state to each, row by row."""
    # What can reach each state: the start only itself, the state after a system turn itself or, by such a turn, the start.
    wanted = (0b0001, 0b0011 if "s" in codes.lower() else 0b0010, 0b1111, 0b1111)
    found = [layers(codes, tuple(0 if p == q else NEVER for p in range(STATES)), wanted[q]) for q in range(STATES)]
    return tuple(_least(found[q], p) for p in range(STATES) for q in range(STATES))


@lru_cache(1 << 15)
def walks(codes: str, after: tuple[int, ...], first: bool, last: bool) -> tuple[tuple[str, int], ...]:
    """The least audit and the state behind it from each state before the segment (of the first, from the start)."""
    entries = range(1 if first else STATES)
    found = layers(codes, after, (1 << len(entries)) - 1)
    return tuple(_walk(codes, after, last, found, p) for p in entries)


def _walk(codes: str, after: tuple[int, ...], last: bool, found: list[int], state: int) -> tuple[str, int]:
    left = _least(found, state)
    if left == NEVER:
        return "", state
    n, i, audit = len(codes), 0, []
    reaches = lambda cost, row, p: cost >= 0 and found[cost] >> (4 * row + p) & 1
    while i < n:
        code = codes[i]
        made = 3 if state == 2 else 2
        more = KEEP_CUT if code.isupper() else 0
        own = STEPS[code.lower()].get(state) if code != "d" else None
        if reaches(left - DELETE, i + 1, state):
            letter, left, i = "D", left - DELETE, i + 1
        elif reaches(left - INSERT, i, made):
            letter, left, state = "I", left - INSERT, made
        elif own is not None and reaches(left - more, i + 1, own):
            letter, left, i, state = "K", left - more, i + 1, own
        else:
            letter, left, i, state = "R", left - REROLE - more, i + 1, made
        audit.append(letter)
    if last:
        audit.append("I" * (ENDS[state] // INSERT))
    return "".join(audit), state


def chained(segments: list[tuple[int, ...]]) -> tuple[int, list[tuple[int, ...]]]:
    """The cost of a conversation and, for each of its segments, that of finishing behind it (from 0)."""
    now, out, base = ENDS, [], 0
    for m in reversed(segments):
        low = min(x for x in now if x != NEVER)
        now = tuple(x - low if x != NEVER else NEVER for x in now)
        base += low
        out.append(now)
        sums = [[m[p * STATES + q] + now[q] for q in range(STATES) if m[p * STATES + q] != NEVER and now[q] != NEVER] for p in range(STATES)]
        now = tuple(min(s, default=NEVER) for s in sums)
    return base + now[0], out[::-1]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batched(rows: Iterable[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_LONG, _INTS, _TEXT = pa.int64(), pa.list_(pa.int32()), pa.string()


def _chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run() -> Iterator[dict]:
        for _, group in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            members = [(r["start"], tuple(r["costs"])) for r in group]
            cost, after = chained([m for _, m in members])
            for k, ((start, _), a) in enumerate(zip(members, after, strict=True)):
                yield {"start": start, "after": list(a), "first": k == 0, "last": k == len(members) - 1, "cost": cost}

    yield from _batched(run(), pa.schema([("start", _LONG), ("after", _INTS), ("first", pa.bool_()), ("last", pa.bool_()), ("cost", _LONG)]))


class _Telling:
    """One conversation's rows, in order, turned into its result and its repaired turns."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.cost, self.illegal, self.state, self.before = conv_id, 0, 0, 0, None
        self.audit: list[str] = []
        # The segment's letters, the next one's place, and the state there.
        self.letters, self.at, self.now = "", 0, 0
        self.digest, self.turns = hashlib.sha256(), 0

    def _turn(self, role: str, text: str, source: int | None) -> dict:
        line = f"{role}:{text}"
        self.digest.update((("\n" if self.turns else "") + line).encode("utf-8", "surrogatepass"))
        self.turns += 1
        return {"conv_id": self.conv_id, "position": self.turns - 1, "role": role, "text": text, "turn": source}

    def _make(self) -> str:
        role, self.now = ("a", 3) if self.now == 2 else ("u", 2)
        return ROLES[role]

    def segment(self, row: dict) -> Iterator[dict]:
        yield from self.inserts()
        self.cost, entry = row["cost"], self.state
        self.letters, self.at, self.now = row["audits"][entry], 0, entry
        self.state = row["exits"][entry]
        self.audit.append(self.letters)

    def inserts(self) -> Iterator[dict]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            yield self._turn(self._make(), "", None)

    def row(self, row: dict) -> Iterator[dict]:
        initial = row["role"][:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        yield from self.inserts()
        letter, self.at = self.letters[self.at], self.at + 1
        if letter == "K":
            self.now = STEPS[initial][self.now]
            yield self._turn(row["role"], row["text"], row["turn"])
        elif letter == "R":
            yield self._turn(self._make(), row["text"], row["turn"])

    def result(self) -> dict:
        return {"conv_id": self.conv_id, "cost": self.cost, "illegal": self.illegal, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _tell(batches: Iterable[pa.RecordBatch], turns: bool) -> Iterator[pa.RecordBatch]:
    def run() -> Iterator[dict]:
        for conv_id, group in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            told = _Telling(conv_id)
            for r in group:
                made = told.segment(r) if r["audits"] is not None else told.row(r)
                for turn in made:
                    if turns:
                        yield turn
            for turn in told.inserts():
                if turns:
                    yield turn
            if not turns:
                yield told.result()

    whole = pa.schema([("conv_id", _LONG), ("cost", _LONG), ("illegal", _LONG), ("audit", _TEXT), ("repaired_sha256", _TEXT)])
    single = pa.schema([("conv_id", _LONG), ("position", _LONG), ("role", _TEXT), ("text", _TEXT), ("turn", _LONG)])
    yield from _batched(run(), single if turns else whole)


def _ordered(df: DataFrame, fn, schema: str, *order: str) -> DataFrame:
    """``fn`` over the rows of each conversation, in order."""
    arrow_batches(df.sparkSession)
    ship(df.sparkSession)
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(fn, schema)


def numbered(rows: DataFrame) -> DataFrame:
    """Staged conv_id, turn, role, text, digest, pos (ascending by conversation and order) and code."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).withColumn("_tie", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "digest", "_tie"]
    return staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").withColumn("pos", F.monotonically_increasing_id()), "turns")


def faulted(rows: DataFrame) -> DataFrame:
    """conv_id, pos, turn, fault (blank, duplicate, truncated or null) and code of each numbered row."""
    again = rows.groupBy(F.col("conv_id").alias("_c"), F.col("digest").alias("_d")).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    joined = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d")), "left")
    fault = (
        F.when(~F.col("text").rlike(_SOLID), "blank")
        .when(F.col("pos") > F.col("_first"), "duplicate")
        .when(~F.col("text").rlike(rf"[.!?]{_SPACE}*\z"), "truncated")
    )
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return joined.select("conv_id", "pos", "turn", "role", fault.alias("fault")).select("conv_id", "pos", "turn", "fault", code.alias("code"))


def _walked(rows: DataFrame) -> DataFrame:
    """conv_id, start, cost, and by the state before it the audit of and the state behind each segment."""
    member = F.array_sort(F.collect_list(F.struct("pos", "code")))
    cut = F.shiftright("pos", SEGMENT.bit_length() - 1).alias("_cut")
    codes = F.concat_ws("", F.transform(member, lambda m: m["code"]))
    segments = staged(rows.groupBy("conv_id", cut).agg(F.min("pos").alias("start"), codes.alias("codes")).drop("_cut"), "segments")

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [list(costs(c)) for c in batch["codes"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["conv_id"], batch["start"], pa.array(found, _INTS)], names=["conv_id", "start", "costs"])

    def walked(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [walks(r["codes"], tuple(r["after"]), r["first"], r["last"]) for r in batch.select(["codes", "after", "first", "last"]).to_pylist()]
        audits, exits = [[w[0] for w in ws] for ws in found], [[w[1] for w in ws] for ws in found]
        return pa.RecordBatch.from_arrays([batch["conv_id"], batch["start"], batch["cost"], pa.array(audits, pa.list_(_TEXT)), pa.array(exits, _INTS)], names=["conv_id", "start", "cost", "audits", "exits"])

    single = map_arrow(segments, measured, "conv_id long, start long, costs array<int>")
    after = _ordered(single, _chain, "start long, after array<int>, first boolean, last boolean, cost long", "start")
    return map_arrow(segments.join(after, "start"), walked, "conv_id long, start long, cost long, audits array<string>, exits array<int>")


def _told(rows: DataFrame, marked: DataFrame, turns: bool) -> DataFrame:
    walked = _walked(marked).withColumnRenamed("start", "pos").withColumn("kind", F.lit(0))
    stream = walked.unionByName(rows.select("conv_id", "pos", "turn", "role", "text", F.lit(1).alias("kind")), allowMissingColumns=True)
    schema = "conv_id long, position long, role string, text string, turn long" if turns else "conv_id long, cost long, illegal long, audit string, repaired_sha256 string"
    return _ordered(stream, lambda batches: _tell(batches, turns), schema, "pos", "kind")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text and turn (null where inserted) of the repaired conversations."""
    rows = numbered(rows)
    return _told(rows, faulted(rows), turns=True)


def repair(rows: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """A row for each conversation of ``whole`` (of ``rows`` itself if not given): its faults, cost and edits."""
    ids = (rows if whole is None else whole).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = numbered(rows)
    marked = staged(faulted(rows), "faults")
    count = lambda what: F.count(F.when(F.col("fault") == what, 1)).alias(what)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    stats = marked.groupBy(F.col("conv_id").alias("_s")).agg(gaps, count("blank"), count("duplicate"), count("truncated"))
    told = _told(rows, marked, turns=False).withColumnRenamed("conv_id", "_t")
    joined = ids.join(stats, F.col("conv_id").eqNullSafe(F.col("_s")), "left").join(told, F.col("conv_id").eqNullSafe(F.col("_t")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations as the query's law harms them, by the CRC-32 of ``conv_id:turn``."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    law: Column = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(F.col("_law") == 1, "").when(F.col("_law") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text"))
    role = F.when(F.col("_law") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    rows = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit(" ")).alias("_text"), law.alias("_law")).where("_law != 0")
    copies = F.explode(F.when(F.col("_law") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("_copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair(damaged(rows), rows)


def _best(*options: str) -> str:
    return "list_min(list_filter([" + ", ".join(options) + "], lambda x: x.c is not null))"


def _then(cost: str, letter: str, line: str | None, rest: str, when: str = "true") -> str:
    """An option of the recursion: cost, audit and repaired text in front of ``rest``."""
    text = f"{rest}.t" if line is None else f"{line} || case when {rest}.t = '' then '' else chr(10) || {rest}.t end"
    return f"{{'c': case when {when} then {rest}.c + {cost} end, 'a': '{letter}' || {rest}.a, 't': {text}}}"


def _sql() -> str:
    """A recursion from the last row to the first; for each state the least (cost, audit), whose text goes along."""
    live, own = "not must", "role || ':' || text"
    made = {0: 2, 1: 2, 2: 3, 3: 2}
    consumed = []
    for p in range(STATES):
        name = "'assistant'" if p == 2 else "'user'"
        options = [_then("3", "D", None, f"s{p}"), _then("2 + cut", "R", f"{name} || ':' || text", f"s{made[p]}", live)]
        options += [_then("cut", "K", own, f"s{q}", f"{live} and initial = '{role}'") for role, step in STEPS.items() for at, q in step.items() if at == p]
        consumed.append(f"{_best(*options)} as w{p}")
    inserted = []
    for p in range(STATES):
        q, name, other = made[p], "assistant" if p == 2 else "user", "user" if p == 2 else "assistant"
        one = _then("2", "I", f"'{name}:'", f"w{q}")
        two = _then("4", "II", f"'{name}:' || chr(10) || '{other}:'", f"w{made[q]}")
        inserted.append(f"{_best(f'w{p}', one, two)} as s{p}")
    ends = {0: ("", ""), 1: ("II", "'user:' || chr(10) || 'assistant:'"), 2: ("I", "'assistant:'"), 3: ("", "")}
    last = ", ".join(f"{{'c': {ENDS[p]}, 'a': '{a}', 't': {t or chr(39) * 2}}} as s{p}" for p, (a, t) in ends.items())
    key = "coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')"
    return rf"""
with recursive raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql(key)} % 20 as law, dense_rank() over (order by conv_id nulls first) as g from conversations
),
harmed as (
  select conv_id, g, turn, case when law = 4 then 'user' else role end as role, case law when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from (select raw.*, unnest(case when law = 3 then [0, 1] else [0] end) as copy from raw where law <> 0) x
),
d as (select *, sha256(strlen(role) || ':' || role || text) as digest, left(role, 1) as initial from harmed),
o as (
  select *, row_number() over (partition by g, digest order by i) > 1 as again
  from (select *, row_number() over (partition by g order by turn nulls first, digest) as i, count(*) over (partition by g) as n from d) x
),
f as (
  select *, case when not regexp_matches(text, '{_SOLID}') then 'blank' when again then 'duplicate'
      when not regexp_matches(text, '[.!?]{_SPACE}*$') then 'truncated' end as fault,
    lag(initial) over (partition by g order by i) || initial not in ('su', 'ua', 'au') as bad
  from o
),
r as (select g, i, n, role, text, initial, coalesce(fault in ('blank', 'duplicate'), false) as must, case when fault = 'truncated' then 1 else 0 end as cut from f),
walk as (
  select g, n as i, {last} from (select distinct g, n from r) x
  union all
  select g, i - 1 as i, {", ".join(inserted)}
  from (select r.g, r.i, {", ".join(consumed)} from walk join r on walk.g = r.g and walk.i = r.i) y
),
stats as (
  select g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
    count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where bad) as illegal
  from f group by g
)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, cast(coalesce(s0.c, 0) as bigint) as cost, coalesce(s0.a, '') as audit, sha256(coalesce(s0.t, '')) as repaired_sha256
from (select distinct conv_id, g from raw) ids left join stats using (g) left join (select g, s0 from walk where i = 0) w using (g)
"""


ORACLE_SQL = _sql()
