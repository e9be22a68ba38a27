"""Repair of the structure of conversations: least edits that give role initials `(s?(ua)+)?`.

The rows of all conversations are sorted over the whole cluster by (conversation, turn), so one conversation may
lie in many partitions. What a partition holds of a conversation is a chunk; it is stored in pieces of bounded size. Costs
to go are vectors over four states, worked out backwards. Conversations within one partition are
solved where they are. Of the others, every chunk starts from a speculative vector, that of a conversation's end;
in fix-up passes the chunks whose right neighbour has another vector than they started from run again, until the new vectors
differ from the old ones only by a constant (rank convergence), where a chunk stops and keeps the rest. Passes end when no chunk changes. With
these stitched vectors each chunk is traced forwards from every state; the chunks' exits choose which trace holds.
The driver sees a few numbers a partition. What follows a conversation through one task is its hash, its counts and its audit: pieces
of finished text, one row each, in order, none of them held.

A null role or text is one space. A null conv_id is a conversation, a null turn comes first. Equal turns are ordered by role, then by a hash of
the text; equal rows are repetitions. A conversation whose rows are all gone has zeros, an empty audit and the hash of the empty
string. An empty table gives an empty result. Ties between cheapest edits go to the ASCII-least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import join_hot, small_batches, staged

#: Rows and bytes of text after which a piece ends; repeated texts that may be named in a broadcast.
PIECE_ROWS, PIECE_BYTES, BROADCAST = 512, 4 << 20, 1_000_000
SPACES = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
DELETE, REROLE, INSERT, UNFINISHED = 4, 3, 3, 3

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Initials: 0 s, 1 u, 2 a, 3 other.
_KEEP = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}
#: Where an added or renamed row leads: user, but assistant after user.
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
#: Costs to go after the last row: rows that have to be added.
END = (0, 6, 3, 0)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times: rows damaged by crc32 of `conv_id:turn` modulo 20.

    0 drops the row (times 0: it only names its conversation), 1 empties the text, 2 takes its `.!?` away, 3 repeats it, 4 makes it a user's.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(k <= 1, "").when(k == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    return rows.select(
        "conv_id", F.when(k != 0, F.col("turn")).alias("turn"), F.when(k == 0, "").when(k == 4, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("times"),
    )


# -- rows to pieces ------------------------------------------------------------------------------


def _marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times, h, g, salt, code: initial * 4 + first fault. h, g: hash of conversation, role and text."""
    end = F.rtrim("text", F.lit(SPACES))
    fault = F.when(end == "", BLANK).when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    blanks = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    own = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *blanks, F.col("times").cast("bigint").alias("times"), F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt"))
    own = own.withColumn("h", F.xxhash64("conv_id", "role", "text")).withColumn("g", F.xxhash64("text", F.lit(7), "role", "conv_id"))
    own = own.withColumn("code", initial * 4 + fault)
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = own.where((F.col("times") > 0) & (F.col("code") % 4 != BLANK)).groupBy("h", "g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    again = staged(again.where("first <> last").select("h", "g", "first", "n"), "said-again")
    if again.count() <= BROADCAST:
        met = own.join(F.broadcast(again), ["h", "g"], "left")
    else:
        one = F.struct("h", "g")
        named = again.select(one.alias("k"), "first", "n")
        keyed = own.withColumn("k", one)
        found = join_hot(keyed, named, "k", "n")
        met = found.unionByName(keyed.join(named.select("k"), "k", "left_anti"), allowMissingColumns=True)
    late = F.col("first").isNotNull() & (at > F.col("first")) & (F.col("code") % 4 != BLANK)
    return met.select("conv_id", "turn", "role", "text", "times", "h", "g", "salt", F.when(late, F.col("code") - F.col("code") % 4 + DUPLICATE).otherwise(F.col("code")).alias("code"))


def _piece_schema(conv_id: T.DataType) -> T.StructType:
    """A piece: chunk (pid, ordinal), part of it, whether another part follows; entries (code, times, role, text); turns; first and last row."""
    fields = T._parse_datatype_string(
        "pid bigint, ordinal bigint, part bigint, more boolean, codes binary, times binary, roles array<string>, texts array<string>, "
        "turns bigint, first_turn bigint, last_turn bigint, head array<bigint>, tail array<bigint>"
    ).fields
    return T.StructType([T.StructField("conv_id", conv_id), *fields])


def pieces(rows: DataFrame) -> DataFrame:
    """Sorts rows (conv_id, turn, role, text, times) over the cluster and lays them out in pieces, staged."""
    small_batches(rows.sparkSession)
    own = _marked(rows)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "h", "g", "salt"]
    own = own.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _piece_schema(rows.schema["conv_id"].dataType)
    names, arrow = ("conv_id", "turn", "role", "text", "times", "h", "g", "code"), to_arrow_schema(schema)

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        conv, ordinal, part, last, entries, size, ready = object(), -1, 0, None, [], 0, []

        def close(more: bool) -> dict:
            live = [e for e in entries if e[0]]
            turns = [e[4] for e in live if e[4] is not None]
            return {
                "conv_id": conv, "pid": pid, "ordinal": ordinal, "part": part, "more": more,
                "codes": bytes(e[1] for e in live), "times": np.array([e[0] for e in live], "<i8").tobytes(), "roles": [e[2] for e in live], "texts": [e[3] for e in live],
                "turns": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
                "head": entries[0][5] if entries[0][0] else None, "tail": entries[-1][5],
            }

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(ready, schema=arrow)

        for b in batches:
            for c, turn, role, text, times, h, g, code in zip(*(b[n].to_pylist() for n in names)):
                this = (turn, h, g)
                if ordinal >= 0 and c == conv and this == last:
                    entries[-1][0] += times
                    continue
                if ordinal < 0 or c != conv:
                    if entries:
                        ready.append(close(False))
                    conv, ordinal, part, entries, size = c, ordinal + 1, 0, [], 0
                elif len(entries) >= PIECE_ROWS or size >= PIECE_BYTES:
                    ready.append(close(True))
                    part, entries, size = part + 1, [], 0
                if len(ready) >= 50 or ready and size == 0 and len(ready[-1]["texts"]) > 50:
                    yield sent()
                    ready = []
                entries.append([times, code, role, text, turn, [h, g]])
                size += len(text)
                last = this
        if entries:
            ready.append(close(False))
        if ready:
            yield sent()

    return staged(own.mapInArrow(lay_out, schema), "pieces")


# -- costs ---------------------------------------------------------------------------------------


def closed(v: list[int]) -> tuple[int, int, int, int]:
    """Costs to go, with rows added first where that is cheaper."""
    u, a = min(v[2], v[3] + INSERT), min(v[3], v[2] + INSERT)
    return min(v[0], u + INSERT), min(v[1], u + INSERT), u, a


def before(code: int, times: int, after: tuple) -> tuple:
    """Costs to go before an entry: a row and its repetitions, which go whatever else happens."""
    initial, fault = divmod(code, 4)
    if fault in (BLANK, DUPLICATE):
        return tuple(x + DELETE * times for x in after)
    after = tuple(x + DELETE * (times - 1) for x in after)
    extra, keep = (UNFINISHED if fault == TRUNCATED else 0), _KEEP[initial]
    return closed([min(DELETE + after[q], REROLE + extra + after[_NEXT[q]], extra + after[keep[q]] if q in keep else 1 << 60) for q in range(4)])


def parallel(a: tuple, b: tuple) -> bool:
    return len({x - y for x, y in zip(a, b)}) == 1


def backwards(codes: bytes, times: np.ndarray, right: tuple) -> list[tuple]:
    """Costs to go before each entry and after the last."""
    out = [right]
    for code, n in zip(reversed(codes), times[::-1].tolist()):
        out.append(before(code, n, out[-1]))
    return out[::-1]


def fixed_up(codes: bytes, times: np.ndarray, old: tuple, new: tuple, old_left: tuple) -> tuple[tuple, int]:
    """(left vector for the right vector `new`, entries run), given that of `old`: stops where the two run parallel."""
    for k, (code, n) in enumerate(zip(reversed(codes), times[::-1].tolist())):
        if parallel(old, new):
            shift = new[0] - old[0]
            return tuple(x + shift for x in old_left), k
        old, new = before(code, n, old), before(code, n, new)
    return new, len(codes)


def trace(codes: bytes, times: np.ndarray, costs: list[tuple], state: int, last: bool, cuts: list[int]) -> tuple[int, list[tuple]]:
    """(state after the entries, for each cut the state there and the initials up to the next), the ASCII-least way.

    costs: from `backwards`. cuts: entries at which pieces begin; last: nothing follows.
    """
    parts, audit, begun = [], [], state
    for i, (code, n) in enumerate(zip(codes, times.tolist())):
        while len(parts) + 1 < len(cuts) and cuts[len(parts) + 1] == i:
            parts.append((begun, "".join(audit)))
            audit, begun = [], state
        initial, fault = divmod(code, 4)
        if fault in (BLANK, DUPLICATE):
            audit.append("D" * n)
            continue
        here, after = costs[i], tuple(x + DELETE * (n - 1) for x in costs[i + 1])
        extra = UNFINISHED if fault == TRUNCATED else 0
        while DELETE + after[state] != here[state] and INSERT + here[_NEXT[state]] == here[state]:
            audit.append("I")
            state = _NEXT[state]
        if DELETE + after[state] == here[state]:
            audit.append("D")
        elif state in _KEEP[initial] and extra + after[_KEEP[initial][state]] == here[state]:
            audit.append("K")
            state = _KEEP[initial][state]
        else:
            audit.append("R")
            state = _NEXT[state]
        audit.append("D" * (n - 1))
    while last and state in (1, 2):
        audit.append("I")
        state = _NEXT[state]
    parts.append((begun, "".join(audit)))
    return state, parts + [(state, "")] * (len(cuts) - len(parts))


# -- pieces to results ---------------------------------------------------------------------------

PART = (
    "cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial int, last_initial int, "
    "turns bigint, first_turn bigint, last_turn bigint, audit string, repaired binary"
)
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def finished(codes: bytes, times: np.ndarray, roles: list[str], texts: list[str], audit: str, state: int) -> dict:
    """Counts of a piece and its repaired text, from its audit and the state before it."""
    out = dict.fromkeys(_COUNTS, 0)
    steps, lines, before_it = iter(audit), [], None
    for code, n, role, text in zip(codes, times.tolist(), roles, texts):
        initial, fault = divmod(code, 4)
        out["illegal"] += n - 1 + (before_it is not None and (before_it, initial) not in _LEGAL)
        before_it = initial
        dead = fault in (BLANK, DUPLICATE)
        out["blank"] += n * (fault == BLANK)
        out["duplicate"] += n if fault == DUPLICATE else 0 if dead else n - 1
        out["truncated"] += fault == TRUNCATED
        for copy in range(n):
            while (step := next(steps)) == "I":
                lines.append(f"{_ROLE[state]}:")
                state, out["cost"] = _NEXT[state], out["cost"] + INSERT
            if step == "D":
                out["cost"] += DELETE
                continue
            lines.append(f"{role if step == 'K' else _ROLE[state]}:{text}")
            out["cost"] += (REROLE if step == "R" else 0) + (UNFINISHED if fault == TRUNCATED else 0)
            state = _KEEP[initial][state] if step == "K" else _NEXT[state]
    for _ in steps:
        lines.append(f"{_ROLE[state]}:")
        state, out["cost"] = _NEXT[state], out["cost"] + INSERT
    first, last = (codes[0] // 4, codes[-1] // 4) if codes else (None, None)
    return out | {"first_initial": first, "last_initial": last, "audit": audit, "repaired": "\n".join(lines).encode()}


_LEGAL = {(0, 1), (1, 2), (2, 1)}


class Merged:
    """The parts of a conversation, taken in order; texts go into the hash and are not kept."""

    def __init__(self):
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.sha, self.any, self.audit, self.initial = hashlib.sha256(), False, [], None
        self.turns, self.first, self.last = 0, None, None

    def add(self, p: dict) -> Merged:
        for c in _COUNTS:
            self.counts[c] += p[c]
        if p["first_initial"] is not None:
            self.counts["illegal"] += self.initial is not None and (self.initial, p["first_initial"]) not in _LEGAL
            self.initial = p["last_initial"]
        if p["first_turn"] is not None:
            self.turns += p["turns"] - (p["first_turn"] == self.last)
            self.first, self.last = p["first_turn"] if self.first is None else self.first, p["last_turn"]
        if p["repaired"]:
            self.sha.update(b"\n" * self.any + p["repaired"])
            self.any = True
        self.audit.append(p["audit"])
        return self

    def row(self, conv_id) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {"conv_id": conv_id, "gaps": gaps, **self.counts, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_SLIM = ["pid", "ordinal", "part", "codes", "times"]


def _times(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _chunk(t: pa.Table, continued: frozenset) -> tuple[bytes, np.ndarray, list[int]]:
    """Entries of a chunk, and where its pieces begin. continued: partitions whose first row repeats the one before it."""
    t = t.sort_by("part")
    codes = [_later(c, p, o, k, continued) for c, p, o, k in zip(*(t[n].to_pylist() for n in ("codes", "pid", "ordinal", "part")))]
    cuts = np.cumsum([0, *map(len, codes)]).tolist()[:-1]
    return b"".join(codes), np.concatenate([np.empty(0, np.int64), *map(_times, t["times"].to_pylist())]), cuts


def _later(codes: bytes, pid: int, ordinal: int, part: int, continued: frozenset) -> bytes:
    if pid in continued and ordinal == part == 0 and codes and codes[0] % 4 != BLANK:
        return bytes([codes[0] // 4 * 4 + DUPLICATE]) + codes[1:]
    return codes


def _pass(chunks: DataFrame, continued: frozenset, starts: dict) -> dict:
    """Left vectors of the chunks named in starts: (pid, ordinal) to (right vector before, its left vector, right vector now)."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        pid, ordinal = (k.as_py() for k in key)
        codes, times, _ = _chunk(t, continued)
        old, left, new = starts[pid, ordinal]
        left, n = (backwards(codes, times, new)[0], len(codes)) if left is None else fixed_up(codes, times, old, new, left)
        return pa.table({"pid": [pid], "ordinal": [ordinal], "vector": pa.array([[x - min(left) for x in left]], pa.list_(pa.int64())), "ran": [n]})

    named = F.broadcast(chunks.sparkSession.createDataFrame(list(starts), "pid bigint, ordinal bigint"))
    out = chunks.join(named, ["pid", "ordinal"], "left_semi").groupBy("pid", "ordinal").applyInArrow(run, "pid bigint, ordinal bigint, vector array<bigint>, ran bigint")
    return {(r["pid"], r["ordinal"]): tuple(r["vector"]) for r in out.collect()}


def stitched(chunks: DataFrame, continued: frozenset, following: dict) -> tuple[dict, int]:
    """(right vector of each chunk that another follows, passes). following: chunk to the chunk of the same conversation after it."""
    right = dict.fromkeys(following, END)
    left = _pass(chunks, continued, {k: (END, None, END) for k in {*following, *following.values()}}) if following else {}
    passes = bool(following)
    while stale := {k: (right[k], left[k], left[n]) for k, n in following.items() if not parallel(right[k], left[n])}:
        now = _pass(chunks, continued, stale)
        right |= {k: s[2] for k, s in stale.items()}
        left |= now
        passes += 1
    return right, passes


def _long(cut: DataFrame, long: DataFrame, edges: list, conv_id: T.DataType) -> DataFrame:
    """Results of the conversations that have several pieces, or may go on in another partition. edges: a row a partition, in order."""
    follows, continued = {}, set()
    for a, b in zip(edges, edges[1:]):
        if a["tail_of"] == b["head_of"]:
            follows[a["pid"], a["final"]] = (b["pid"], 0)
            if b["head"] and (a["tail"], a["last_turn"]) == (b["head"], b["first_turn"]):
                continued.add(b["pid"])
    continued, begun = frozenset(continued), set(follows.values())
    chunks = long.select(*_SLIM)
    right, _ = stitched(chunks, continued, follows)

    def walk(key: tuple, t: pa.Table) -> pa.Table:
        pid, ordinal = (k.as_py() for k in key)
        codes, times, cuts = _chunk(t, continued)
        costs = backwards(codes, times, right.get((pid, ordinal), END))
        rows = []
        for state in range(4) if (pid, ordinal) in begun else (0,):
            left, parts = trace(codes, times, costs, state, (pid, ordinal) not in follows, cuts)
            rows += [(pid, ordinal, k, state, left, at, audit) for k, (at, audit) in enumerate(parts)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], names=[f.name for f in arrow])

    walked = "pid bigint, ordinal bigint, part bigint, entry int, leaves int, state int, audit string"
    arrow = to_arrow_schema(T._parse_datatype_string(walked))
    walks = staged(chunks.groupBy("pid", "ordinal").applyInArrow(walk, walked), "walks")
    # Which trace of a chunk holds: the one from where the chunk before it ends.
    entry = {}
    if follows:
        spark = cut.sparkSession
        known = F.broadcast(spark.createDataFrame([*follows], "pid bigint, ordinal bigint"))
        leaves = {(r["pid"], r["ordinal"], r["entry"]): r["leaves"] for r in walks.where("part = 0").join(known, ["pid", "ordinal"], "left_semi").collect()}
        for k in sorted(follows):
            entry[follows[k]] = leaves[(*k, entry.get(k, 0))]
        named = F.broadcast(spark.createDataFrame([(*k, s) for k, s in entry.items()], "pid bigint, ordinal bigint, chosen int"))
        walks = walks.join(named, ["pid", "ordinal"], "left").where("entry = coalesce(chosen, 0)")
    both = long.join(walks.select("pid", "ordinal", "part", "state", "audit"), ["pid", "ordinal", "part"])

    part = T.StructType([T.StructField("conv_id", conv_id), *T._parse_datatype_string("pid bigint, part bigint, " + PART).fields])
    part_arrow = to_arrow_schema(part)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.to_pylist():
                codes = _later(p["codes"], p["pid"], p["ordinal"], p["part"], continued)
                p |= finished(codes, _times(p["times"]), p["roles"], p["texts"], p["audit"], p["state"])
                yield pa.RecordBatch.from_pylist([{n: p[n] for n in part.names}], schema=part_arrow)

    result = T.StructType([T.StructField("conv_id", conv_id), *T._parse_datatype_string(RESULT).fields])
    result_arrow = to_arrow_schema(result)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, merged = None, None
        for b in batches:
            for p in b.to_pylist():
                if merged is None or p["conv_id"] != conv:
                    if merged:
                        yield pa.RecordBatch.from_pylist([merged.row(conv)], schema=result_arrow)
                    conv, merged = p["conv_id"], Merged()
                merged.add(p)
        if merged:
            yield pa.RecordBatch.from_pylist([merged.row(conv)], schema=result_arrow)

    return both.mapInArrow(finish, part).repartition("conv_id").sortWithinPartitions("conv_id", "pid", "part").mapInArrow(merge, result)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row a conversation.

    rows: conv_id, turn, role, text, times (repetitions; 0 only names the conversation, with a null turn and empty role and text).
    """
    kind = rows.schema["conv_id"].dataType
    cut = pieces(rows)
    per = cut.groupBy("pid").agg(
        F.max("ordinal").alias("final"),
        *(F.min_by(c, F.struct("ordinal", "part")).alias(a) for c, a in (("conv_id", "head_of"), ("head", "head"), ("first_turn", "first_turn"))),
        *(F.max_by(c, F.struct("ordinal", "part")).alias(a) for c, a in (("conv_id", "tail_of"), ("tail", "tail"), ("last_turn", "last_turn"))),
    )
    edges = sorted(per.collect(), key=lambda r: r["pid"])
    ends = F.broadcast(rows.sparkSession.createDataFrame([(r["pid"], r["final"]) for r in edges], "pid bigint, final bigint"))
    known = cut.join(ends, "pid")
    whole = (F.col("part") == 0) & ~F.col("more") & (F.col("ordinal") > 0) & (F.col("ordinal") < F.col("final"))
    result = T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(RESULT).fields])
    arrow = to_arrow_schema(result)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.to_pylist():
                codes, times = p["codes"], _times(p["times"])
                _, parts = trace(codes, times, backwards(codes, times, END), 0, True, [0])
                out.append(Merged().add(p | finished(codes, times, p["roles"], p["texts"], parts[0][1], 0)).row(p["conv_id"]))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    whole_ones = known.where(whole).drop("final").mapInArrow(solve, result)
    return whole_ones.unionByName(_long(cut, known.where(~whole).drop("final"), edges, kind))
