"""Cheapest repair of conversations to the form ``(s?(ua)+)?`` of role initials, with an audit of the edits.

Rows are told apart by nine symbols: initial (s, u, a, other) with or without a cut-off text, or a row that must go. A symbol is a
4 x 4 min-plus matrix over the states nothing, after s, after u, after a: the least cost to pass one such row, insertions before
it included. Equal consecutive symbols are collapsed to runs, and a run of r rows is passed by the cached powers M, M^2,
M^4, ... of its matrix. From the back, that gives the cost still to come at every border; from the front, the least
edit letter that keeps to the least cost is chosen row by row.

Rows are sorted by range, so a long conversation is spread over tasks, and packed into chunks of some hundred rows with their
symbols as runs. The choices of a conversation are made from its chunks' symbols alone, without any text; the texts then
pass once more, chunk by chunk in order, since the hash of a repaired conversation is a chain. A task holds one
chunk's texts, and of one conversation the runs of symbols and the audit, which is a value of the result anyway.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqframe.functions.scratch import materialize

#: Costs: rerole, delete, insert, and a cut-off text that stays.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3

#: Rows and bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_ROWS, CHUNK_BYTES = 256, 1 << 20

#: More copies of a row are spread over several chunks.
_MOST_COPIES = 1 << 30

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

START, AFTER_S, AFTER_U, AFTER_A = range(4)
_FAR = 1 << 40
_NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}  # what an inserted or reroled row leads to
_KEEP = {"s": {START: AFTER_S}, "u": {s: AFTER_U for s in (START, AFTER_S, AFTER_A)}, "a": {AFTER_U: AFTER_A}, "o": {}}
#: Cost still to come behind the last row: insertions up to an assistant's turn.
END = (0, 2 * INSERT, INSERT, 0)

#: A symbol is a letter: s, u, a, o; in upper case with a cut-off text; d must be deleted.
SYMBOLS = "suaoSUAOd"
_powers: dict[str, list[tuple]] = {}


def _moves(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """Ways to pass a row: letter, cost, state after it. In ASCII order of the letters."""
    found = [("D", DELETE, state)]
    if symbol != "d":
        cut = CUT if symbol.isupper() else 0
        if state in _KEEP[symbol.lower()]:
            found.append(("K", cut, _KEEP[symbol.lower()][state]))
        found.append(("R", REROLE + cut, _NEXT[state]))
    return found


def _matrix(symbol: str) -> tuple:
    rows = []
    for state in range(4):
        cost, at, row = 0, state, [_FAR] * 4
        for _ in range(4):  # insertions lead through at most three further states
            for _, c, to in _moves(symbol, at):
                row[to] = min(row[to], cost + c)
            cost, at = cost + INSERT, _NEXT[at]
        rows.append(tuple(row))
    return tuple(rows)


def _times(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(4)) for row in a)


def _apply(m: tuple, v: tuple) -> tuple:
    a, b, c, d = v
    return tuple([min(r[0] + a, r[1] + b, r[2] + c, r[3] + d) for r in m])


def _power(symbol: str, k: int) -> tuple:
    """The matrix of 2^k rows of a symbol, from the cache of this process."""
    have = _powers.setdefault(symbol, [])
    while len(have) <= k:
        have.append(_times(have[-1], have[-1]) if have else _matrix(symbol))
    return have[k]


def before(symbol: str, rows: int, to_come: tuple) -> tuple:
    """The cost still to come, by state, before ``rows`` rows of one symbol, from that behind them."""
    k = 0
    while rows:
        if rows & 1:
            to_come = _apply(_power(symbol, k), to_come)
        rows, k = rows >> 1, k + 1
    return to_come


#: Rows whose costs to come are held at once while choices are unrolled.
_UNROLL = 64


def unroll(symbol: str, rows: int, to_come: tuple, state: int) -> tuple[str, int]:
    """The edit letters for a run of rows entered in ``state``, and the state behind it."""
    letters = []
    while rows:
        part = min(rows, _UNROLL)
        costs = [before(symbol, rows - part, to_come)]
        for _ in range(part):
            costs.append(_apply(_power(symbol, 0), costs[-1]))
        for i in range(part, 0, -1):
            now, later = costs[i], costs[i - 1]
            while True:
                best = [(x, to) for x, c, to in _moves(symbol, state) if c + later[to] == now[state]]
                if best and best[0][0] == "D":
                    break
                if INSERT + now[_NEXT[state]] == now[state]:  # I stands between D and K
                    letters.append("I")
                    state = _NEXT[state]
                else:
                    break
            letters.append(best[0][0])
            state = best[0][1]
        rows -= part
    return "".join(letters), state


def close(state: int) -> tuple[str, int]:
    """The insertions behind the last row."""
    letters = ""
    while END[state]:
        letters, state = letters + "I", _NEXT[state]
    return letters, state


def choose(chunks: list[list[tuple[str, int]]]) -> tuple[int, list[str], list[int]]:
    """Cost of a conversation, the edit letters of each of its chunks and the state each begins in. A chunk is a list of runs."""
    behind = [END]
    for runs in reversed(chunks):
        v = behind[-1]
        for symbol, n in reversed(runs):
            v = before(symbol, n, v)
        behind.append(v)
    state, letters, states = START, [], []
    for k, runs in enumerate(chunks):
        v = [behind[len(chunks) - 1 - k]]
        for symbol, n in reversed(runs):
            v.append(before(symbol, n, v[-1]))
        states.append(state)
        text = ""
        for j, (symbol, n) in enumerate(runs):
            part, state = unroll(symbol, n, v[len(runs) - 1 - j], state)
            text += part
        letters.append(text)
    last, _ = close(state)
    if letters:
        letters[-1] += last
    return behind[-1][START], letters, states


def repaired(letters: str, state: int, roles: list[str], texts: list[str]) -> Iterator[str]:
    """The lines ``role:text`` that a chunk's edits leave."""
    at = 0
    for x in letters:
        if x == "D":
            at += 1
            continue
        if x == "K":
            initial = roles[at][:1]
            state = _KEEP[initial][state]
            yield f"{roles[at]}:{texts[at]}"
        else:
            state = _NEXT[state]
            yield ("user:" if state == AFTER_U else "assistant:") + (texts[at] if x == "R" else "")
        at += x != "I"


_CHUNK = "conv {conv}, part int, seq int, runs string, first string, last string, illegal long, roles array<string>, texts array<string>, copies array<int>"
_PLAN = "conv {conv}, part int, seq int, letters string, state int, cost long, illegal long"
_DONE = "conv {conv}, cost long, illegal long, audit string, repaired_sha256 string"


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _mapped(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``df`` with each partition's rows passed through ``rows``, a generator of tuples."""
    kind = df.schema["conv"].dataType.simpleString()
    names = [x.split()[0] for x in schema.split(", ")]
    shape = to_arrow_schema(T.DataType.fromDDL(schema.format(conv=kind)))

    def batches(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), shape, strict=True)], names=names)

        for row in rows(_rows(found)):
            held.append(row)
            size += sum(map(len, row[8])) if len(row) > 8 else 64
            if size > CHUNK_BYTES:
                yield done()
                held, size = [], 0
        if held:
            yield done()

    return df.mapInArrow(batches, schema.format(conv=kind))


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _chunk(rows: list[tuple]) -> tuple:
    """Symbols as runs, initials at both ends, illegal neighbours, and columns of a chunk's rows."""
    symbols, illegal, last = [], 0, None
    for _, role, _, copies, symbol in rows:
        initial = role[:1]
        illegal += (last is not None and not _legal(last, initial)) + copies - 1
        last = initial
        symbols += [(symbol, 1), ("d", copies - 1)] if copies > 1 else [(symbol, 1)]
    runs = "".join(f"{s}{sum(n for _, n in group)}," for s, group in groupby(symbols, key=lambda x: x[0]))
    return runs, rows[0][1][:1], last, illegal, [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]


def _pack(found: Iterator[tuple]) -> Iterator[tuple]:
    """Rows in order to chunks. ``copies`` rows that are alike lie in one; all but the first are duplicates, if they aren't blank."""
    part, seq, rows, size = TaskContext.get().partitionId(), 0, [], 0
    for row in found:
        while row is not None:
            piece, row = row, None
            if piece[3] > _MOST_COPIES:
                piece, row = (*piece[:3], _MOST_COPIES, piece[4]), (*piece[:3], piece[3] - _MOST_COPIES, "d")
            if rows and (piece[0] != rows[0][0] or len(rows) >= CHUNK_ROWS or size + len(piece[2]) > CHUNK_BYTES):
                yield rows[0][0], part, seq, *_chunk(rows)
                seq, rows, size = seq + 1, [], 0
            rows.append(piece)
            size += len(piece[2])
    if rows:
        yield rows[0][0], part, seq, *_chunk(rows)


def _decide(found: Iterator[tuple]) -> Iterator[tuple]:
    """Edits of every chunk from the runs of all chunks of its conversation, which arrive in order."""
    for conv, group in groupby(found, key=lambda r: r[0]):
        chunks = list(group)
        cost, letters, states = choose([[(x[0], int(x[1:])) for x in c[3].split(",")[:-1]] for c in chunks])
        illegal = sum(c[6] for c in chunks) + sum(not _legal(a[5], b[4]) for a, b in pairwise(chunks))
        for c, x, state in zip(chunks, letters, states, strict=True):
            yield conv, c[1], c[2], x, state, cost, illegal


def _edit(found: Iterator[tuple]) -> Iterator[tuple]:
    """Per conversation cost, illegal pairs, audit and the digest of its repaired lines. A chunk's edits arrive before its texts."""
    for conv, group in groupby(found, key=lambda r: r[0]):
        audit, digest, lines, edits, cost, illegal = [], hashlib.sha256(), 0, None, 0, 0
        for _, letters, state, much, pairs, roles, texts, copies in group:
            if letters is not None:
                edits, cost, illegal = (letters, state), much, pairs
                audit.append(letters)
                continue
            if max(copies) > 1:
                edits = (_without_copies(edits[0], copies), edits[1])
            for line in repaired(*edits, roles, texts):
                digest.update((("\n" if lines else "") + line).encode())
                lines += 1
        yield conv, cost, illegal, "".join(audit), digest.hexdigest()


def _without_copies(letters: str, copies: list[int]) -> str:
    """The edits without the deletions of the second and later of rows alike."""
    out, row, left = [], 0, copies[0]
    for x in letters:
        if x == "I":
            out.append(x)
            continue
        if left == copies[row]:
            out.append(x)
        left -= 1
        if not left and row + 1 < len(copies):
            row += 1
            left = copies[row]
    return "".join(out)


def faults(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows alike counted once, with the fault of the first of them: conv, turn, role, text, copies, fault (NULL if none).

    NULL roles and texts count as one space, and numbers of NULL turns come first.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    plain = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    alike = plain.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    alike = materialize(alike.withColumn("said", F.unhex(F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text").cast("binary"), 256))))
    first = alike.groupBy("conv", "said").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn")).alias("first")).where("n > 1")
    again = first.select(F.col("conv").alias("_conv"), F.col("said").alias("_said"), "first")
    both = alike.join(again, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    twice = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(twice, DUPLICATE).when(cut, TRUNCATED)
    return both.select("conv", "turn", "role", "text", "copies", fault.alias("fault"))


def repair(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation of ``rows``: ``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Rows of a conversation are taken by turn (NULL first), then role and text, so that rows alike stand together. A NULL
    conversation id is a conversation of its own. Of the faults blank, duplicate (role and text as in an earlier row) and
    truncated the first that applies counts. Other columns, whatever their names, are not read.
    """
    marked = materialize(faults(rows, conv=conv, turn=turn, role=role, text=text))
    n = lambda c, x=F.col("copies"): F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("long")
    fault, rest = F.col("fault"), F.col("copies") - 1
    counts = marked.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        n(fault == BLANK).alias("blank"),
        (n(fault == DUPLICATE) + n(fault.isNull() | (fault == TRUNCATED), rest)).alias("duplicate"),
        n(fault == TRUNCATED, F.lit(1)).alias("truncated"),
    )
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(fault.isin(BLANK, DUPLICATE), "d").when(fault == TRUNCATED, F.upper(letter)).otherwise(letter)
    place = ["conv", "turn", "role", F.substring("text", 1, 64)]
    ordered = marked.repartitionByRange(*place).sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text", "copies", symbol.alias("symbol"))
    chunks = materialize(_mapped(ordered, _pack, _CHUNK))

    plan = chunks.select("conv", "part", "seq", "runs", "first", "last", "illegal").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    plan = materialize(_mapped(plan, _decide, _PLAN))
    passed = plan.unionByName(chunks.select("conv", "part", "seq", "roles", "texts", "copies"), allowMissingColumns=True)
    passed = passed.repartition("conv").sortWithinPartitions("conv", "part", "seq", F.col("letters").isNull())
    passed = passed.select("conv", "letters", "state", "cost", "illegal", "roles", "texts", "copies")
    done = _mapped(passed, _edit, _DONE).withColumnRenamed("conv", "_conv")
    return counts.join(done, F.col("conv").eqNullSafe(F.col("_conv"))).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows: DataFrame) -> DataFrame:
    """The damage of the registered query: conv_id, turn, role and text after it. NULLs count as one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    what = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    new = F.when(what == 1, "").when(what == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    out = rows.withColumn("_what", what).where("_what <> 0").select("conv_id", "turn", F.when(what == 4, "user").otherwise(role).alias("role"), new.alias("text"), "_what")
    return out.withColumn("_", F.explode(F.sequence(F.lit(1), F.when(F.col("_what") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def report(rows: DataFrame, repaired_: DataFrame) -> DataFrame:
    """Every original conversation; those of which no row is left have zeros and an empty audit."""
    ids = rows.select("conv_id").distinct()
    out = ids.join(repaired_, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in longs], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")
    )
