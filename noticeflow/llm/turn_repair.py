"""Repair of conversations: which turns to keep, rerole, delete or insert at the least cost.

A repaired conversation's role initials are nothing, or one optional s and then ua one or more times.
The choice is a dynamic programme over the turns that stay (kept or reroled). Deletions between
two of them are priced by prefix sums, so that one running minimum per role of the last turn
that stayed is all that has to be remembered; the pair of roles says what is inserted
between them; of equal costs the ASCII-least audit (the edits' initials D, I, K, R) wins.

A run of turns is summed up by what it costs, and by its audit, to come from each state to
each other one. Such sums combine in any grouping, so a conversation of any length is
cut into runs of turns that are summed up in parallel, then run by run in a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm.common import Scratch, join_by_hot_key

#: Blanks of the contract, as characters.
BLANK_CHARS = " \t\n\x0b\x0c\r"

#: Characters that end a whole sentence.
ENDS = ".!?"

#: What edits cost; a turn that is cut off and stays costs TRUNCATED more.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5

#: Role of the last turn that stays; n before the first one.
STATES = "nsua"

#: Turns inserted between a turn of the first state and one of the second, or the end.
BETWEEN = {"ns": "", "nu": "", "na": "u", "su": "", "sa": "u", "ua": "", "uu": "a", "au": "", "aa": "u", "n$": "", "s$": "ua", "u$": "a", "a$": ""}

#: Turns of a run are 2 to this power; the rows of a run of text hashed together, likewise.
RUN_BITS, HASH_BITS = 10, 6

NAMES = {"u": "user", "a": "assistant"}

Sum = dict[str, tuple[int, str]]


def damage(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text after the damage that crc32 of `conv:turn` deals, modulo 20.

    0 drops the row, 1 empties its text, 2 takes full stops, exclamation and question marks
    away, 3 repeats it, 4 makes its role user. Nulls count as one space, but turn and
    conv stay null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = rows.select("conv", F.col("turn"), blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_d") == 0, 0).when(F.col("_d") == 3, 2).otherwise(1)
    out = dealt.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("_x"))
    return out.drop("_x")


def _key(conv: str) -> Column:
    """A key that is never null, for a conversation of any type."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def _in_order(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """rows in one order over all partitions, with key and pos (33 low bits within the partition).

    Ranges may cut a conversation anywhere, and short equal rows as well, so none is one task.
    """
    n = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.when(F.length("text") <= 64, F.monotonically_increasing_id()).otherwise(0)
    keyed = rows.withColumn("key", _key("conv")).withColumn("head", F.substring("text", 1, 64)).withColumn("tie", tie)
    dealt = keyed.repartitionByRange(n, "key", "turn", "role", "head", "tie").sortWithinPartitions("key", "turn", "role", "text")
    return scratch.cut(dealt.select("key", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")), "rows")


def _marked(rows: DataFrame) -> DataFrame:
    """key, turn, pos, initial (s, u, a or x), mark: b blank, d seen before, else the initial, in upper case where the text is cut off."""
    trimmed = F.rtrim("text", F.lit(BLANK_CHARS))
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    whole = F.unhex(F.sha2(F.concat_ws(":", F.length("key").cast("string"), "key", F.length("role").cast("string"), "role", "text"), 256))
    seen = rows.select("key", "turn", "pos", initial.alias("initial"), (trimmed == "").alias("blank"), F.instr(F.lit(ENDS), F.right(trimmed, F.lit(1))).alias("ends"), whole.alias("whole"))
    seen = seen.withColumn("whole", F.when(~F.col("blank"), F.col("whole")))
    again = seen.where("whole IS NOT NULL").groupBy("whole").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = join_by_hot_key(seen, again, ["whole"], "n", seen.count(), "left")
    mark = F.when(F.col("blank"), "b").when(F.col("pos") > F.col("first"), "d").when(F.col("ends") == 0, F.upper("initial")).otherwise(F.col("initial"))
    return joined.select("key", "turn", "pos", "initial", mark.alias("mark"))


def run_sum(marks: str, start: str) -> Sum:
    """The least cost and audit of coming through a run of marks from start to each state."""
    least = {start: (0, "", 0)}  # cost less the deletions before, audit, turns that it spans
    gone = 0
    for i, mark in enumerate(marks):
        found: dict[str, tuple[int, str, int]] = {}
        low = mark.lower()
        for to in "" if mark in "bd" else STATES[1:]:
            if to == "s" != low:
                continue
            edit, price = ("K", 0) if to == low else ("R", REROLE)
            price += TRUNCATED if mark != low else 0
            for state, (cost, audit, upto) in least.items():
                added = BETWEEN.get(state + to)
                if added is None:
                    continue
                c = cost + gone + price + INSERT * len(added)
                if to in found and c > found[to][0]:
                    continue
                made = (c, audit + "D" * (i - upto) + "I" * len(added) + edit, i + 1)
                if to not in found or made < found[to]:
                    found[to] = made
        gone += DELETE
        for to, (cost, audit, upto) in found.items():
            old = least.get(to)
            cost -= gone
            if old is None or cost < old[0] or (cost == old[0] and audit < old[1] + "D" * (i + 1 - old[2])):
                least[to] = (cost, audit, upto)
    return {to: (cost + gone, audit + "D" * (len(marks) - upto)) for to, (cost, audit, upto) in least.items()}


def sums(marks: str) -> dict[str, Sum]:
    """run_sum from every state."""
    return {s: run_sum(marks, s) for s in STATES}


def joined_sums(a: dict[str, Sum], b: dict[str, Sum]) -> dict[str, Sum]:
    """The sums of two runs, one after the other."""
    out: dict[str, Sum] = {}
    for start, first in a.items():
        made = out.setdefault(start, {})
        for mid, (c1, a1) in first.items():
            for to, (c2, a2) in b[mid].items():
                if to not in made or (c1 + c2, a1 + a2) < made[to]:
                    made[to] = (c1 + c2, a1 + a2)
    return out


def best(found: Sum) -> tuple[int, str]:
    """Least cost and audit from the start of a conversation to its end."""
    ended = [(s + "$", x) for s, x in found.items()]
    return min((c + INSERT * len(BETWEEN[p]), a + "I" * len(BETWEEN[p])) for p, (c, a) in ended)


def edits(audit: str, marks: str) -> Iterator[tuple[str, str, str]]:
    """For each turn: its edit, its new role (empty: as it was), and roles inserted before (or, after the last one, behind) it."""
    state, before, at = "n", "", -1
    rest = len(audit.rstrip("I"))
    for letter in audit[:rest]:
        if letter == "I":
            before += "I"
            continue
        at += 1
        if letter == "D":
            yield "D", "", ""
            continue
        low = marks[at].lower()
        to = low if letter == "K" else next(t for t in "ua" if t != low and len(BETWEEN.get(state + t, "??")) == len(before))
        added = BETWEEN[state + to]
        state, before = to, ""
        yield letter, NAMES[to] if letter == "R" else "", added
    if tail := BETWEEN[state + "$"]:
        yield "I", "", tail


_SUM = pa.list_(pa.struct([("way", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
_SUM_SQL = "array<struct<way:string,cost:long,audit:string>>"


def _packed(x: dict[str, Sum]) -> list[dict]:
    return [{"way": s + to, "cost": c, "audit": a} for s, found in x.items() for to, (c, a) in found.items()]


def _opened(ways: list[dict]) -> dict[str, Sum]:
    out: dict[str, Sum] = {}
    for w in ways:
        out.setdefault(w["way"][0], {})[w["way"][1]] = (w["cost"], w["audit"])
    return out


def _solve_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, cost, audit of conversations of one run."""
    for b in batches:
        done = [best(run_sum(m, "n")) for m in b.column("marks").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([c for c, _ in done], pa.int64()), pa.array([a for _, a in done], pa.string())], ["key", "cost", "audit"])


def _sum_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, at, marks in zip(b.column("key"), b.column("at"), b.column("marks").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.string()), pa.array([at.as_py()], pa.int64()), pa.array([_packed(sums(marks))], _SUM)], ["key", "at", "sums"])


def _join_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each row's runs, taken together two by two."""
    for b in batches:
        for key, at, runs in zip(b.column("key"), b.column("at"), b.column("runs")):
            left = [_opened(r["sums"].as_py()) for r in runs]
            while len(left) > 1:
                pairs = [joined_sums(left[i], left[i + 1]) for i in range(0, len(left) - 1, 2)]
                left = pairs + left[len(pairs) * 2 :]
            yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.string()), pa.array([at.as_py()], pa.int64()), pa.array([_packed(left[0])], _SUM)], ["key", "at", "sums"])


def _end_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, found in zip(b.column("key"), b.column("sums")):
            cost, audit = best(_opened(found.as_py())["n"])
            yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.string()), pa.array([cost], pa.int64()), pa.array([audit], pa.string())], ["key", "cost", "audit"])


def _solved(scratch: Scratch, runs: DataFrame) -> DataFrame:
    """key, cost, audit. Conversations of one run are solved where they lie; the others' runs meet in a tree over the places of partitions."""
    out = "key string, cost long, audit string"
    several = runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    told = join_by_hot_key(runs.select("key", "at", "marks"), several, ["key"], "n", runs.count(), "left")
    one = told.where("n IS NULL").select("key", "marks").mapInArrow(_solve_runs, out)
    level = told.where("n IS NOT NULL").select("key", "at", "marks").mapInArrow(_sum_runs, f"key string, at long, sums {_SUM_SQL}")
    for bits in (8, 33 - RUN_BITS - 8, 8, 54):
        up = level.withColumn("up", F.shiftright("at", bits))
        level = up.groupBy("key", "up").agg(F.array_sort(F.collect_list(F.struct("at", "sums"))).alias("runs")).select("key", F.col("up").alias("at"), "runs").mapInArrow(_join_runs, f"key string, at long, sums {_SUM_SQL}")
    return scratch.cut(one.unionByName(level.mapInArrow(_end_runs, out)), "solved")


def _edit_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, pos, edit, role, added, tail: one row a turn."""
    names = ["pos", "edit", "role", "added", "tail"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    lines = lambda roles: "\n".join(f"{NAMES[r]}:" for r in roles) or None
    for b in batches:
        rows: list[list] = []
        for audit, runs in zip(b.column("audit").to_pylist(), b.column("runs")):
            places = ((r["lo"].as_py() + i, m) for r in runs for i, m in enumerate(r["marks"].as_py()))
            marks = "".join(r["marks"].as_py() for r in runs)
            for edit, role, added in edits(audit, marks):
                if edit == "I":  # behind the last turn
                    rows[-1][4] = lines(added)
                    continue
                if len(rows) > 4096:  # the last one may still get a tail
                    yield batch(rows[:-1])
                    rows = rows[-1:]
                rows.append([next(places)[0], edit, role or None, lines(added), None])
        if rows:
            yield batch(rows)


def _hash_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, repaired_sha256 of rows sorted by key and place, a part at a time."""
    key, digest = None, None
    for b in batches:
        keys, hashes = [], []
        for k, part in zip(b.column("key").to_pylist(), b.column("part").to_pylist()):
            if k != key:
                if digest is not None:
                    keys.append(key)
                    hashes.append(digest.hexdigest())
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(part.encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], ["key", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["key", "repaired_sha256"])


class Repair:
    """The repair of conversations, given as conv (any type), turn (whole numbers), role and text; other columns are not read.

    Rows of one conversation follow each other by turn (nulls first), then role and text. A
    row's first fault counts: blank (no character but blanks), duplicate (role and text
    were there earlier), truncated (the last character that is no blank is none of ENDS).
    Blank and duplicate turns have to go. Null roles and texts count as one space; null
    conversations are one conversation. Tables may be empty, texts of any length.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame):
        self.scratch = Scratch(spark, "turn-repair")
        self.rows = _in_order(self.scratch, rows.select("conv", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))))
        self.marks = self.scratch.cut(_marked(self.rows), "marks")
        placed = F.array_sort(F.collect_list(F.struct("pos", "mark", "initial")))
        runs = self.marks.groupBy("key", F.shiftright("pos", RUN_BITS).alias("at")).agg(placed.alias("t"))
        text = lambda c: F.array_join(F.transform("t", lambda x: x[c]), "").alias(f"{c}s")
        self.runs = self.scratch.cut(runs.select("key", "at", F.element_at("t", 1)["pos"].alias("lo"), text("mark"), text("initial")), "runs")
        self.solved = _solved(self.scratch, self.runs)

    def faults(self) -> DataFrame:
        """key, gaps, blank, duplicate, truncated, illegal."""
        turns = self.marks.groupBy("key", "turn").agg(*(F.count_if(c).alias(n) for n, c in (("blank", F.col("mark") == "b"), ("duplicate", F.col("mark") == "d"), ("truncated", F.col("mark").isin("S", "U", "A", "X")))))
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
        counts = turns.groupBy("key").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
        pairs = F.sequence(F.lit(1), F.length("initials") - 1)
        bad = lambda c: ~c.isin("su", "ua", "au")
        within = F.when(F.length("initials") > 1, F.size(F.filter(F.transform(pairs, lambda i: F.substr("initials", i, F.lit(2))), bad))).otherwise(0)
        ends = self.runs.select("key", "at", within.alias("within"), F.left("initials", F.lit(1)).alias("head"), F.right("initials", F.lit(1)).alias("last"))
        # a run that goes on in the next one is met there: by its place, or over the edge of a partition
        before = self.runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        several = join_by_hot_key(ends, before, ["key"], "n", self.runs.count())
        across = self._edges(several)
        inside = ends.groupBy("key").agg(F.sum("within").alias("illegal"))
        total = inside.unionByName(across).groupBy("key").agg(F.sum("illegal").alias("illegal"))
        return counts.join(total, "key")

    def _edges(self, several: DataFrame) -> DataFrame:
        """key, illegal: pairs over the edges between a conversation's runs, which are strung together 256 at a time."""
        level = several.select("key", "at", F.concat("head", "last").alias("ends"), F.lit(0).cast("long").alias("illegal"))
        for bits in (8, 33 - RUN_BITS - 8, 8, 54):
            t = level.groupBy("key", F.shiftright("at", bits).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "ends", "illegal"))).alias("t"))
            n = F.size("t")
            pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.right(F.element_at("t", i)["ends"], F.lit(1)), F.left(F.element_at("t", i + 1)["ends"], F.lit(1))))).otherwise(F.array().cast("array<string>"))
            bad = F.size(F.filter(pairs, lambda c: ~c.isin("su", "ua", "au"))).cast("long")
            own = F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["illegal"])
            level = t.select("key", F.col("up").alias("at"), F.concat(F.left(F.element_at("t", 1)["ends"], F.lit(1)), F.right(F.element_at("t", -1)["ends"], F.lit(1))).alias("ends"), (own + bad).alias("illegal"))
        return level.select("key", "illegal")

    def turns(self) -> DataFrame:
        """The repaired turns: key, pos (order), line (`role:text`, with inserted turns before or behind it as lines of their own)."""
        runs = self.runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "lo", "marks"))).alias("runs"))
        steps = self.solved.join(runs, "key").select("audit", "runs").mapInArrow(_edit_rows, "pos long, edit string, role string, added string, tail string")
        told = self.rows.join(steps.withColumnRenamed("role", "new_role"), "pos")
        own = F.when(F.col("edit") != "D", F.concat(F.coalesce("new_role", "role"), F.lit(":"), F.col("text")))
        kept = told.where("edit <> 'D' OR tail IS NOT NULL")
        return kept.select("key", "pos", F.concat_ws("\n", "added", own, "tail").alias("line"))

    def digests(self) -> DataFrame:
        """key, repaired_sha256. Lines are hashed as they come in order, so a task holds HASH_BITS rows of them and no conversation."""
        parts = self.turns().groupBy("key", F.shiftright("pos", HASH_BITS).alias("at")).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("t"))
        parts = parts.select("key", "at", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("part"))
        return parts.repartition("key").sortWithinPartitions("key", "at").select("key", "part").mapInArrow(_hash_lines, "key string, repaired_sha256 string")


def repair_report(spark: SparkSession, conversations: DataFrame, damaged: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation in conversations.

    damaged: conv, turn, role, text, as Repair takes them. A conversation without rows there
    has zeros, an empty audit and the hash of nothing.
    """
    work = Repair(spark, damaged)
    known = conversations.select(F.col(conv_col).alias("conv")).groupBy("conv").agg(F.count("*").alias("_n")).select("conv", _key("conv").alias("key"))
    out = known.join(work.faults(), "key", "left").join(work.solved, "key", "left").join(work.digests(), "key", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias(conv_col), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def schema_of(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text of a table with other names."""
    kinds = dict(rows.dtypes)
    turn = F.col(turn_col) if kinds[turn_col] in ("tinyint", "smallint", "int", "bigint") else F.col(turn_col).cast(T.LongType())
    return rows.select(F.col(conv_col).alias("conv"), turn.alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
