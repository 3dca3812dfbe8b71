"""Repair of a conversation's structure by the cheapest edits.

Roles have to read `(s?(ua)+)?` by their initials. Turns are dealt by ranges of conversation and
turn, numbered in order, and cut into chunks of bounded length; a conversation may have any number
of them. A dynamic programme over the four states of that grammar gives each chunk's costs to go;
chunks of one conversation pass on 4 x 4 cost matrices, not turns. The edits that keep to the least
cost are arcs between (turn, state) nodes. Prefix doubling ranks these arcs by their next 1, 2, 4, ...
letters of the audit; at each node the arc of least rank is taken, and the path is read through
pointers that doubled along.

A turn that is blank, or repeats role and text of an earlier one, has to be deleted. It costs the
same wherever letters of insertions stand, so it takes no part in the programme; D being the least
letter, its deletion comes before insertions at that place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import col, shuffle_partitions, small_batches, stored

#: Turns of a chunk: two to the power of it.
CHUNK_BITS = 12
#: Characters of a text that take part in the order of one turn's rows.
ORDERED = 256
WHITE = " \t\n\x0b\x0c\r"
# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# States: nothing yet, after s, after u, after a. Where an inserted or changed role leads, and its name.
START, SYSTEM, USER, ASSISTANT = range(4)
GIVEN = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Costs to go when no turn is left.
FINAL = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
#: Arcs that are ranked at a time.
ARCS = 1 << 19


def _kept(kind: int, state: int) -> int:
    """The state after a turn whose role stays, or -1; kinds: s, u, a, any other."""
    if kind == 0:
        return SYSTEM if state == START else -1
    if kind == 1:
        return USER if state != USER else -1
    return ASSISTANT if kind == 2 and state == USER else -1


def _edits(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of what can be done with a turn; code: 2 x kind + truncated."""
    late = TRUNCATED * (code & 1)
    yield "D", DELETE, state
    if (to := _kept(code >> 1, state)) >= 0:
        yield "K", late, to
    yield "R", REROLE + late, GIVEN[state]


def cost_matrix(codes: list[int]) -> list[int]:
    """Least costs from each state before the turns to each state after them, row by row."""
    out = []
    for s in range(4):
        cost = [FAR] * 4
        cost[s] = 0
        for code in codes:
            cost[USER] = min(cost[USER], *[cost[x] + INSERT for x in (START, SYSTEM, ASSISTANT)])
            cost[ASSISTANT] = min(cost[ASSISTANT], cost[USER] + INSERT)
            after = [FAR] * 4
            for state in range(4):
                for _, c, to in _edits(code, state):
                    after[to] = min(after[to], cost[state] + c)
            cost = after
        out.extend(cost)
    return out


def costs_after(matrices: list[list[int]]) -> list[list[int]]:
    """For each chunk of a conversation, the costs to go from each state after it."""
    out = [list(FINAL)]
    for m in reversed(matrices[1:]):
        out.append([min(m[4 * s + t] + out[-1][t] for t in range(4)) for s in range(4)])
    return out[::-1]


def optimal_arcs(codes: list[int], after: list[int], last: bool) -> list[tuple[int, str, int]]:
    """(node, letter, node) of all edits that keep to the least cost; node: 4 x turn + state."""
    arcs = []
    go = list(after)
    if last:
        arcs += [(4 * len(codes) + s, "I", 4 * len(codes) + GIVEN[s]) for s in (SYSTEM, USER)]
    for i in range(len(codes) - 1, -1, -1):
        own = [[(e, c + go[to], 4 * (i + 1) + to) for e, c, to in _edits(codes[i], s)] for s in range(4)]
        least = [min(c for _, c, _ in own[s]) for s in range(4)]
        user = min(least[USER], least[ASSISTANT] + INSERT)
        go = [min(least[START], user + INSERT), min(least[SYSTEM], user + INSERT), user, min(least[ASSISTANT], least[USER] + INSERT)]
        for s in range(4):
            arcs += [(4 * i + s, e, to) for e, c, to in own[s] if c == go[s]]
            if go[s] == go[GIVEN[s]] + INSERT:
                arcs.append((4 * i + s, "I", 4 * i + GIVEN[s]))
    return arcs


def least_audits(programmes: list[tuple[list[int], list[int], bool]]) -> list[list[tuple[str, int]]]:
    """For (codes, costs after, last) of some chunks: from each of the four states before, the least
    optimal audit and the state that it leads to."""
    begin, of, letter, to = [], [], [], []
    nodes = 0
    for codes, after, last in programmes:
        begin.append(nodes)
        for a, e, b in optimal_arcs(codes, after, last):
            of.append(nodes + a)
            letter.append(ord(e))
            to.append(nodes + b)
        nodes += 4 * len(codes) + 4
    of, letter, to = np.array(of, np.int64), np.array(letter, np.int64), np.array(to, np.int64)
    ends = np.setdiff1d(np.arange(nodes), of)  # a node without an arc has one to itself, of no letter
    of, letter, to = np.concatenate([of, ends]), np.concatenate([letter, np.zeros(len(ends), np.int64)]), np.concatenate([to, ends])
    rank = letter

    def least() -> np.ndarray:
        """For each node, its arc of least rank."""
        order = np.lexsort((rank, of))
        return order[np.searchsorted(of[order], np.arange(nodes))]

    jumps = [least()[to]]
    longest = max((3 * len(codes) + 3 for codes, _, _ in programmes), default=1)
    while 1 << len(jumps) <= longest:
        rank = np.unique(rank * len(rank) * 128 + rank[jumps[-1]], return_inverse=True)[1]
        jumps.append(jumps[-1][jumps[-1]])
    entry = least()
    out = []
    for a, (codes, _, _) in zip(begin, programmes):
        steps = np.arange(3 * len(codes) + 3)
        arc = np.repeat(entry[a : a + 4, None], len(steps), 1)
        for j in range(len(steps).bit_length()):
            arc = np.where(steps >> j & 1, jumps[j][arc], arc)
        final = to[arc[:, -1]] - a - 4 * len(codes)
        out.append([(bytes(x[x > 0].astype(np.uint8)).decode(), int(s)) for x, s in zip(letter[arc], final)])
    return out


def _turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """pos, conv, turn, role, text, kind, blank, truncated: written in order, numbered upwards."""
    or_space = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    rows = df.select(col(conv).alias("conv"), col(turn).alias("turn"), or_space(role).alias("role"), or_space(text).alias("text"), F.monotonically_increasing_id().alias("tie"))
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = rows.select("*", F.substring("text", 1, ORDERED).alias("head"), F.sha2("text", 256).alias("hash"))
    order = ["conv", "turn", "role", "head", "hash", "tie"]
    rows = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return rows.select(
        F.monotonically_increasing_id().alias("pos"), "conv", "turn", "role", "text", "hash", kind.alias("kind"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated")
    )


def _mapped(rows: DataFrame, columns: list[str], f: Callable[[list[tuple]], Iterator[tuple]], more: str) -> DataFrame:
    """conv and what f makes of each batch of rows: tuples of a row's number and more columns."""
    rows = rows.select("conv", *columns)
    names = [x.split()[0] for x in more.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(f(list(zip(*[batch.column(c).to_pylist() for c in columns]))))
            if out:
                at, *values = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column("conv").take(pa.array(at)), *[pa.array(v) for v in values]], names=["conv", *names])

    return rows.mapInArrow(run, f"conv {rows.schema['conv'].dataType.simpleString()}, {more}")


def _audited(rows: list[tuple]) -> Iterator[tuple]:
    """chunk, live, after, last -> chunk, positions, audits and states by the state before."""
    a = 0
    while a < len(rows):
        z, size = a, 0
        while z < len(rows) and (z == a or size < ARCS):
            size += 12 * len(rows[z][1])
            z += 1
        found = least_audits([([x["code"] for x in live], after, last) for _, live, after, last in rows[a:z]])
        for i, ways in zip(range(a, z), found):
            yield i, rows[i][0], [x["pos"] for x in rows[i][1]], [w[0] for w in ways], [w[1] for w in ways]
        a = z


def _suffixes(rows: list[tuple]) -> Iterator[tuple]:
    for i, (chunks,) in enumerate(rows):
        for x, after in zip(chunks, costs_after([x["matrix"] for x in chunks])):
            yield i, x["chunk"], after


def _entries(rows: list[tuple]) -> Iterator[tuple]:
    for i, (chunks,) in enumerate(rows):
        state = START
        for x in chunks:
            yield i, x["chunk"], state
            state = x["states"][state]


def _scripts(turns: DataFrame, bits: int) -> DataFrame:
    """conv, chunk, positions of the turns that need not go, letters of their edits."""
    first = turns.filter(~F.col("blank")).groupBy("conv", "role", "hash").agg(F.min(F.struct("pos", (2 * F.col("kind") + F.col("truncated").cast("int")).alias("code"))).alias("t"))
    chunk = F.shiftright("t.pos", bits).alias("chunk")
    live = first.select("conv", chunk, "t").groupBy("conv", "chunk").agg(F.array_sort(F.collect_list("t")).alias("live"))
    own = Window.partitionBy("conv")
    live = stored(live.select("*", F.count(F.lit(1)).over(own).alias("chunks"), (F.max("chunk").over(own) == F.col("chunk")).alias("last")), "repair-chunks")
    ways = "chunk bigint, positions array<bigint>, audits array<string>, states array<bigint>"
    final = F.array(*[F.lit(x).cast("long") for x in FINAL]).alias("after")
    whole = _mapped(live.filter("chunks = 1").select("conv", "chunk", "live", final, "last"), ["chunk", "live", "after", "last"], _audited, ways)
    whole = whole.select("conv", "chunk", "positions", F.col("audits")[START].alias("letters"))

    many = live.filter("chunks > 1")
    listed = lambda df, *c: df.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("chunk", *c))).alias("chunks"))
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"]) & (a["chunk"] == b["chunk"])
    matrices = _mapped(many, ["chunk", "live"], lambda rows: ((i, c, cost_matrix([x["code"] for x in t])) for i, (c, t) in enumerate(rows)), "chunk bigint, matrix array<bigint>")
    # A row for each chunk: what a conversation brings together is a few numbers for thousands of turns.
    after = _mapped(listed(matrices, "matrix"), ["chunks"], _suffixes, "chunk bigint, after array<bigint>")
    cut = many.join(after, same(many, after)).select(many["conv"], many["chunk"], "live", "after", "last")
    found = stored(_mapped(cut, ["chunk", "live", "after", "last"], _audited, ways), "repair-ways")
    entry = _mapped(listed(found, "states"), ["chunks"], _entries, "chunk bigint, entry bigint")
    part = found.join(entry, same(found, entry)).select(found["conv"], found["chunk"], "positions", F.get("audits", F.col("entry").cast("int")).alias("letters"))
    return whole.unionByName(part)


class Reader:
    """Follows one conversation's turns in order and says what becomes of each."""

    def __init__(self):
        self.state, self.letters, self.at, self.positions, self.next = START, "", 0, [], 0

    def script(self, positions: list[int], letters: str) -> None:
        self.positions, self.letters, self.at, self.next = positions, letters, 0, 0

    def insertions(self) -> Iterator[str]:
        """Roles inserted here."""
        while self.letters[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = GIVEN[self.state]
            yield NAMES[self.state]

    def live(self, pos: int) -> bool:
        found = self.next < len(self.positions) and self.positions[self.next] == pos
        self.next += found
        return found

    def edit(self, role: str, kind: int) -> tuple[str, str]:
        """Letter of a turn's edit and its role after that."""
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = _kept(kind, self.state)
        elif letter == "R":
            self.state = GIVEN[self.state]
            role = NAMES[self.state]
        return letter, role


class Report:
    """Counts and digests of one conversation, turn by turn; nothing grows but the audit."""

    COLUMNS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"

    def __init__(self):
        self.low = self.high = self.before = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.lines, self.hash = 0, hashlib.sha256()

    def turn(self, turn: int | None, role: str) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]

    def edit(self, letter: str, role: str, text: str, late: bool) -> None:
        self.audit.append(letter)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[letter] + (TRUNCATED if late and letter != "D" else 0)
        if letter != "D":
            self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _read(df: DataFrame, conv: str, turn: str, role: str, text: str, every: DataFrame | None, bits: int, report: bool) -> DataFrame:
    """Turns and scripts of a conversation side by side in order, followed by one pass."""
    spark = df.sparkSession
    small_batches(spark)
    turns = stored(_turns(df, conv, turn, role, text), "repair-turns")
    scripts = stored(_scripts(turns, bits), "repair-scripts")
    kind = turns.schema["conv"].dataType.simpleString()
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    rest = [none("bigint", "turn"), none("string", "role"), none("string", "text"), none("int", "kind"), none("boolean", "blank"), none("boolean", "truncated")]
    ids = turns.select("conv") if every is None else turns.select("conv").union(every.select(col(conv).cast(kind)))
    lines = [
        ids.distinct().select("conv", F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("what"), none("bigint", "pos"), none("array<bigint>", "positions"), none("string", "letters"), *rest),
        scripts.select("conv", "chunk", F.lit(1).alias("what"), none("bigint", "pos"), "positions", "letters", *rest),
        turns.select("conv", F.shiftright("pos", bits).alias("chunk"), F.lit(2).alias("what"), "pos", none("array<bigint>", "positions"), none("string", "letters"), F.col("turn").cast("bigint").alias("turn"), "role", "text", "kind", "blank", "truncated"),
    ]
    order = ["conv", "chunk", "what", "pos"]
    rows = lines[0].unionByName(lines[1]).unionByName(lines[2]).repartition("conv").sortWithinPartitions(*order)
    names = rows.columns
    edits = "nth bigint, edit string, turn bigint, role string, text string"
    more = Report.COLUMNS if report else edits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        reader, told, key, nth = None, None, None, 0
        conv_type = None

        def close() -> None:
            nonlocal nth
            if reader is not None:
                for name in reader.insertions():
                    if report:
                        told.edit("I", name, "", False)
                    else:
                        out.append((key, nth, "I", None, name, ""))
                        nth += 1
                if report:
                    out.append((key, *told.row()))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            fields = [x.split()[0] for x in more.split(", ")]
            kinds = [pa.int64() if x.endswith("bigint") else pa.string() for x in more.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], conv_type), *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], names=["conv", *fields])

        for batch in batches:
            conv_type = batch.column("conv").type
            for key_, _, what, pos, positions, letters, turn, role, text, kind, blank, late in zip(*[batch.column(c).to_pylist() for c in names]):
                if what == 0:
                    close()
                    reader, told, key, nth = Reader(), Report(), key_, 0
                elif what == 1:
                    reader.script(positions, letters)
                else:
                    made = []
                    if live := reader.live(pos):
                        made = [("I", None, name, "", False) for name in reader.insertions()]
                        letter, role_ = reader.edit(role, kind)
                        made.append((letter, turn, role_, text, late))
                    else:
                        made = [("D", turn, role, text, False)]
                    if report:
                        told.turn(turn, role)
                        told.blank += blank
                        told.duplicate += not live and not blank
                        told.truncated += live and late
                        for letter, _, r, t, x in made:
                            told.edit(letter, r, t, x)
                    else:
                        for letter, n, r, t, _ in made:
                            out.append((key, nth, letter, n, r, t))
                            nth += 1
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return rows.mapInArrow(run, f"conv {kind}, {more}").withColumnRenamed("conv", conv)


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One row for each edit: conversation, nth (from 0), edit, turn, role, text, as they are after it.

    Edits are Keep (cost 0), Rerole to user or assistant (2), Delete (3; blank turns and such whose
    role and text occurred earlier have to go) and Insert of an empty user or assistant turn (2); a
    turn that stays costs 1 more if its last character other than white space is none of `.!?`. The
    cheapest edits that make the roles' initials read `(s?(ua)+)?` are taken, of equal ones those
    whose letters come first in ASCII. Deleted turns are listed as they were.

    Turns go by number, null first, those of one number by role and text (its first 256 characters,
    then its SHA-256). A null role or text counts as one space, a null conversation as one of its
    own. Repeated rows are repeated turns. An empty table gives an empty result. Other columns are
    ignored, whatever their names. Programme and choice are spread over tasks by chunks of
    2 ** chunk_bits turns; the last pass follows each conversation turn by turn, one after another,
    and holds no more of it than one chunk's script.
    """
    return _read(df, conv_col, turn_col, role_col, text_col, None, chunk_bits, False)


def repair_report(df: DataFrame, every: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One row for each conversation of df (of every, if given; also one without turns): gaps in the
    turns' numbers, turns by first fault (blank, duplicate, truncated), illegal neighbours, cost,
    audit (letters of repair()), repaired_sha256 (of `role:text` of the turns after it, by line).

    As repair(). A digest and an audit are of a whole conversation, and so made one turn after another.
    """
    return _read(df, conv_col, turn_col, role_col, text_col, every, chunk_bits, True)
