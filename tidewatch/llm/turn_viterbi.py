"""Conversation structure repair: cheapest edits by a Viterbi recursion that runs in parallel chunks until their ranks converge.

Costs to go are kept for four states (nothing yet, after system, after user, after assistant). What matters of a cost vector
is its differences, and few vectors differ by more than a constant: VECTORS numbers them all, so a step is one lookup.
Conversations lie in range partitions ordered by turn. Where one runs on into the next partition, its chunk starts backwards
from a guess (as if the conversation ended there); passes then rerun such chunks from what the next chunk really found,
and each stops where its vector differs from the earlier one by a constant only, that is, has the same number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import pieces, stage

BLANKS = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = (USER, USER, ASSISTANT, USER)  # state after an inserted or renamed turn
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5  # costs
INITIALS = "sua"  # codes 0 to 3 by initial (3: another), 4 to 7 the same and truncated, 8 must go
GONE = 8
LEGAL = {"su", "ua", "au"}
END = (0, 2 * INSERT, INSERT, 0)


def _options(code: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row as (letter, cost, next state)."""
    out = [("D", DELETE, state)]
    if code != GONE:
        extra = TRUNCATED * (code >= 4)
        kept = KEEP.get((state, (*INITIALS, "")[code % 4]))
        if kept is not None:
            out.append(("K", extra, kept))
        out.append(("R", RENAME + extra, AFTER[state]))
    return out


def _step(vector: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Costs before a row from costs behind it."""
    plain = [min(cost + vector[to] for _, cost, to in _options(code, s)) for s in range(4)]
    return tuple(min(plain[s], INSERT + plain[AFTER[s]], 2 * INSERT + plain[AFTER[AFTER[s]]]) for s in range(4))


def _trace(vector: tuple[int, ...], code: int, state: int) -> tuple[str, int]:
    """Least letters of the cheapest edits from before a row to behind it, and the state then."""
    costs, letters = _step(vector, code), ""
    while True:
        best = costs[state]
        moves = {letter: to for letter, cost, to in _options(code, state) if cost + vector[to] == best}
        if "D" not in moves and INSERT + costs[AFTER[state]] == best:
            letters, state = letters + "I", AFTER[state]
            continue
        letter = min(moves)
        return letters + letter, moves[letter]


def _universe() -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """All vectors that the recursion can meet, the final one first, and the number of the next one by code."""
    vectors, number, steps = [END], {END: 0}, []
    for vector in vectors:
        row = []
        for code in range(9):
            out = _step(vector, code)
            out = tuple(x - min(out) for x in out)
            if out not in number:
                number[out] = len(vectors)
                vectors.append(out)
            row.append(number[out])
        steps.append(row)
    return vectors, steps


VECTORS, STEPS = _universe()
TRACES = [[[_trace(v, code, s) for s in range(4)] for code in range(9)] for v in VECTORS]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


BLOCK = ["part", "seq", "run", "alone", "conv", "turns", "roles", "texts", "keys"]


def _cut(most_rows: int, most_bytes: int):
    """Blocks of one conversation's rows in order. A block is alone if its conversation certainly lies in no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out, out_size, seq, number, nth, conv, kind = [], 0, 0, -1, 0, None, None
        rows, size = [], 0

        def block(alone: bool) -> tuple:
            turns, roles, texts, keys = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
            return part, seq, number, alone, conv, turns, roles, texts, b"".join(bytes.fromhex(k) for k in keys)

        def ready() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), kind, pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary()]
            return _batch(out, BLOCK, kinds)

        for b in pieces(batches, 10_000):
            kind = b.schema.field("conv").type
            for c, turn, role, text, key, absent in zip(*(b.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "key", "absent")), strict=True):
                fresh = number < 0 or c != conv
                if number >= 0 and (fresh or len(rows) >= most_rows or size >= most_bytes):
                    out.append(block(fresh and nth == 0 and number > 0))
                    seq, nth, out_size = seq + 1, nth + 1, out_size + size + 100
                    rows, size = [], 0
                    if out_size > 1 << 22:
                        yield ready()
                        out, out_size = [], 0
                if fresh:
                    conv, number, nth = c, number + 1, 0
                if not absent:
                    rows.append((turn, role, text, key))
                    size += len(text) + len(role)
        if number >= 0:
            out.append(block(False))
            yield ready()

    return run


def _codes(roles: list[str], texts: list[str], keys: bytes, first: set[bytes] | None) -> bytes:
    """A code a row; `first` has the keys that no earlier block of the conversation holds (None: all)."""
    seen, out = set(), bytearray()
    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        key, bare = keys[16 * i : 16 * i + 16], text.rstrip(BLANKS)
        again = key in seen or (first is not None and key not in first)
        seen.add(key)
        if not bare or again:
            out.append(GONE)
        else:
            at = INITIALS.find(role[:1]) if role else 3
            out.append((at if at >= 0 else 3) + 4 * (bare[-1] not in ".!?"))
    return bytes(out)


def _faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of blocks, given the keys first seen in each."""
    for b in pieces(batches, 256):
        out = [(r["part"], r["seq"], r["run"], _codes(r["roles"], r["texts"], r["keys"], {bytes(k) for k in r["first"] or ()})) for r in b.to_pylist()]
        yield _batch(out, ["part", "seq", "run", "codes"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()])


def _backwards(start: dict[int, int], last: dict[int, int]):
    """Vector numbers behind and before each block, blocks of a part from the last to the first.

    `start` is the number behind the last run of a part; other runs end with their conversation. Where an earlier
    result is given, the pass leaves a part as soon as it meets the same number again, and returns what has changed.
    """
    names, kinds = ["part", "seq", "behind", "before"], [pa.int32(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, v, met = None, None, 0, False
        for b in pieces(batches, 1000):
            out = []
            for r in b.to_pylist():
                if r["part"] != part:
                    part, number, met = r["part"], None, False
                if r["run"] != number:
                    number = r["run"]
                    v = start.get(part, 0) if number == last[part] else 0
                met = met or r["behind"] == v
                if met:
                    continue
                behind = v
                for code in reversed(r["codes"]):
                    v = STEPS[v][code]
                out.append((part, r["seq"], behind, v))
            if out:
                yield _batch(out, names, kinds)

    return run


def _settle(codes: DataFrame, runs: dict[int, tuple[int, int, bool]]) -> DataFrame:
    """Vector number behind every block: one pass from guesses, then passes over the chunks whose guess was wrong.

    `runs` has, by part, the number of its last run, its first block, and whether its last run goes on in the next part. It
    and the numbers at the borders, one a partition, are all that the driver holds.
    """
    shape = "part int, seq long, behind int, before int"
    last = {p: r[0] for p, r in runs.items()}
    parts = sorted(runs)
    following = dict(zip(parts, parts[1:], strict=False))
    spark = codes.sparkSession
    heads = spark.createDataFrame([(p, runs[p][1]) for p in parts], "part int, seq long")

    def ordered(df: DataFrame) -> DataFrame:
        return df.repartition("part").sortWithinPartitions("part", F.desc("seq"))

    used = {p: 0 for p in parts if runs[p][2]}
    blind = codes.withColumn("behind", F.lit(None).cast("int"))
    found = stage(ordered(blind).mapInArrow(_backwards(used, last), shape).withColumn("pass", F.lit(0)), "costs")
    before = {}
    changed, number = found, 0
    while used:
        before |= {r["part"]: r["before"] for r in changed.join(F.broadcast(heads), ["part", "seq"]).select("part", "before").collect()}
        wrong = {p: before[following[p]] for p in used if before[following[p]] != used[p]}
        if not wrong:
            break
        number += 1
        used |= wrong
        known = found.groupBy("part", "seq").agg(F.max_by("behind", "pass").alias("behind"))
        ends = spark.createDataFrame([(p, last[p]) for p in wrong], "part int, run long")
        again = codes.join(F.broadcast(ends), ["part", "run"])
        changed = stage(ordered(again.join(known, ["part", "seq"])).mapInArrow(_backwards(wrong, last), shape).withColumn("pass", F.lit(number)), "costs")
        found = stage(found.unionByName(changed), "costs")
    return found.groupBy("part", "seq").agg(F.max_by("behind", "pass").alias("behind"))


class _Talk:
    """One conversation while its blocks pass by."""

    def __init__(self, conv):
        self.conv, self.state, self.initial = conv, START, None
        self.low = self.high = self.turn = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.made = 0
        self.audit, self.hash = [], hashlib.sha256()

    def say(self, letter: str, role: str, text: str) -> tuple:
        self.hash.update((("\n" if self.made else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.made += 1
        return self.conv, self.made, letter, role, text

    def add(self, r: dict) -> Iterator[tuple]:
        first = None if r["alone"] else {bytes(k) for k in r["first"] or ()}
        codes = _codes(r["roles"], r["texts"], r["keys"], first)
        behind, v = [], r["behind"] or 0
        for code in reversed(codes):
            behind.append(v)
            v = STEPS[v][code]
        for code, v, turn, role, text in zip(codes, reversed(behind), r["turns"], r["roles"], r["texts"], strict=True):
            if turn is not None and turn != self.turn:
                self.low, self.high, self.turn, self.distinct = turn if self.low is None else self.low, turn, turn, self.distinct + 1
            self.illegal += self.initial is not None and self.initial + role[:1] not in LEGAL
            self.initial = role[:1]
            bare = text.rstrip(BLANKS)
            self.blank += not bare
            self.duplicate += bool(bare) and code == GONE
            self.truncated += 4 <= code < GONE
            letters, end = TRACES[v][code][self.state]
            self.audit.append(letters)
            for letter in letters:
                if letter == "D":
                    self.cost += DELETE
                    continue
                after = end if letter in "KR" else AFTER[self.state]
                self.cost += INSERT if letter == "I" else RENAME * (letter == "R") + TRUNCATED * (4 <= code < GONE)
                yield self.say(letter, role if letter == "K" else NAMES[after], "" if letter == "I" else text)
                self.state = after

    def close(self) -> Iterator[tuple]:
        while END[self.state]:
            self.state = AFTER[self.state]
            self.audit.append("I")
            self.cost += INSERT
            yield self.say("I", NAMES[self.state], "")

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


TALKS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TURNS = ["place", "edit", "role", "text"]


def _finish(turns: bool):
    """Trace the blocks of each conversation in order: its row, or with `turns` its repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk, out, size, kinds = None, [], 0, []
        names = ["conv", *(TURNS if turns else TALKS)]

        def ended() -> list[tuple]:
            rest = list(talk.close())
            return rest if turns else [talk.row()]

        for b in pieces(batches, 1000):
            kinds = [b.schema.field("conv").type, *([pa.int64(), *[pa.string()] * 3] if turns else [*[pa.int64()] * 6, pa.string(), pa.string()])]
            for r in b.to_pylist():
                if talk is None or r["conv"] != talk.conv:
                    out += ended() if talk else []
                    talk = _Talk(r["conv"])
                for said in talk.add(r):
                    if turns:
                        out.append(said)
                        size += len(said[4])
                size += 1000
                if size > 1 << 22 and out:
                    yield _batch(out, names, kinds)
                    out, size = [], 0
        if talk:
            out += ended()
        if out:
            yield _batch(out, names, kinds)

    return run


def repair_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: Column | None = None, repaired: bool = False, block_rows: int = 2048, block_bytes: int = 1 << 20) -> DataFrame:
    """Repair the turns of each conversation by the cheapest edits, so that roles read `(s?(ua)+)?` by their initials.

    Keeping a row costs 0, renaming it user or assistant 1, deleting it 2, inserting an empty user or assistant turn 5; a row that stays
    although it is truncated costs 5 more, blank and duplicate rows must go. Of equally cheap repairs the one whose letters
    (K, R, D, I in order) are least is taken. Returns a row per conversation: (conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256), the last over `role:text` lines; or with `repaired` the repaired turns (conv, place from 1, edit, role, text).

    Rows go by turn, nulls first; rows of one turn in the order of the md5 of role length, role and text, so equal ones stand together.
    Null role or text is one space, a null conversation one of its own. Rows where `absent` holds count for nothing, but
    their conversation comes back. Extra columns are ignored; an empty table gives no rows.

    A conversation of any length is cut into blocks of `block_rows` rows or `block_bytes`; costs are worked out partition by
    partition, duplicates by key, and only the final trace and digest read a conversation in order, as a stream.
    """
    spark = turns.sparkSession
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), r.alias("role"), t.alias("text"),
        F.coalesce(absent if absent is not None else F.lit(False), F.lit(False)).alias("absent"),
        F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary")).alias("key"), F.monotonically_increasing_id().alias("row"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "key", "row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["conv"].dataType.simpleString()
    shape = f"part int, seq long, run long, alone boolean, conv {kind}, turns array<long>, roles array<string>, texts array<string>, keys binary"
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = stage(placed.mapInArrow(_cut(block_rows, block_bytes), shape), "turn-blocks")

    chained = blocks.where("not alone")
    ends = chained.groupBy("part").agg(F.max("run").alias("last"), F.min("seq").alias("head"), F.min_by("conv", "seq").alias("first_conv"), F.max_by("conv", "seq").alias("last_conv")).orderBy("part").collect()
    goes_on = {a["part"]: a["last_conv"] == b["first_conv"] for a, b in zip(ends, ends[1:], strict=False)}
    runs = {e["part"]: (e["last"], e["head"], goes_on.get(e["part"], False)) for e in ends}

    each = chained.select("part", "seq", "conv", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("roles") - 1), lambda i: F.substring("keys", 1 + 16 * i, F.lit(16))))).alias("key")).where(F.length("key") > 0)
    earliest = each.groupBy("conv", "key").agg(F.min(F.struct("part", "seq")).alias("at"))
    first = stage(earliest.groupBy(F.col("at.part").alias("part"), F.col("at.seq").alias("seq")).agg(F.collect_list("key").alias("first")), "first-keys")
    chained = chained.join(first.hint("merge"), ["part", "seq"], "left")
    codes = stage(chained.select("part", "seq", "run", "roles", "texts", "keys", "first").mapInArrow(_faults, "part int, seq long, run long, codes binary"), "turn-codes")
    chained = chained.join(_settle(codes, runs).hint("merge"), ["part", "seq"], "left")

    shape = f"conv {kind}, " + ("place long, edit string, role string, text string" if repaired else "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    columns = [c for c in BLOCK if c != "run"]
    whole = blocks.where("alone").select(*columns, F.lit(None).cast("array<binary>").alias("first"), F.lit(0).alias("behind"))
    together = chained.select(*columns, "first", "behind").repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "seq")
    out = whole.mapInArrow(_finish(repaired), shape).unionByName(together.mapInArrow(_finish(repaired), shape))
    return out.withColumnRenamed("conv", conv)


def damage(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Damage conversations by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties it, 2 takes its `[.!?]`, 3 repeats it, 4 makes it the user's.

    Nulls are one space. Dropped rows come back with `dropped` set, so that their conversations stay known; the second value names them.
    """
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    out = turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return out.drop("copy"), F.col("dropped")
