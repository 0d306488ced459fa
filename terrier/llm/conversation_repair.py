"""Repair of role order and faulty turns by an automaton shared from the end.

The rows of a conversation become a signature, one letter a row (its role initial, in
capitals if the text is cut off; ``x`` if the row must go). Edits bring the role initials
to ``(s?(ua)+)?``. From any place of a signature on, the cheapest edits depend on the rest
of it and on the state of that grammar alone, so signatures are merged from the end:

* Signatures are cut in blocks of at most ``BLOCK`` letters, equal ones become one row,
  and these are dealt out and sorted by their reversed letters. Neighbours then share
  their ends, and each shared end is one node of the automaton, worked out once.
* The costs to go of the four grammar states, less their minimum, take few values (31
  here; ``VALUES``). So a first pass gives for each block the value before it for each
  value after it; a scan of blocks, last to first, finds the value after each block.
* A second pass over distinct (block, value after it) gives the best edits of each state,
  node by node; a scan of blocks, first to last, picks those of the state reached.

Ties are settled by the first edit alone, since the choices of a state have four
different initials and each leads to one state.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.llm.common import few_keys, text_of
from terrier.session import staged

#: Letters of a block of a signature.
BLOCK = 1024
#: White space of the contract, and the ends of a finished text.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Grammar states: at the start, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: State after a turn of the role that is missing in each state.
WANTED = (USER, USER, ASSISTANT, USER)
#: State after a kept turn, by state and initial.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Letters of signatures: must go; kept roles; the same cut off. ``o`` is any other role.
LETTERS = "xsuaoSUAO"
LEGAL = ("su", "ua", "au")
#: Order of rows in a conversation; rows of one turn go by role, then text.
ORDER = ("turn", "role", "head", "digest")

Choice = tuple[int, str, int, bool]  # cost to go, initial of the edit, state after it, whether a row is used


def _inserted(choices: list[Choice]) -> list[Choice]:
    """The choices at a node when a turn may be put in first."""
    best = list(choices)
    for _ in range(len(best)):
        for q, after in enumerate(WANTED):
            best[q] = min(best[q], (best[after][0] + INSERT, "I", after, False))
    return best


def choices(letter: str, costs: tuple[int, ...]) -> list[Choice]:
    """The best first edit of each state before a row, with the costs to go after it."""
    out = []
    for q, wanted in enumerate(WANTED):
        found = [(costs[q] + DELETE, "D", q, True)]
        if letter != "x":
            more = CUT_OFF if letter.isupper() else 0
            kept = KEPT.get((q, letter.lower()))
            if kept is not None:
                found.append((costs[kept] + KEEP + more, "K", kept, True))
            found.append((costs[wanted] + REROLE + more, "R", wanted, True))
        out.append(min(found))
    return _inserted(out)


def _at_end() -> list[Choice]:
    none = 1 << 20
    return _inserted([(0 if q in (START, ASSISTANT) else none, "", q, True) for q in range(4)])


def _values() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All costs to go less their minimum; the value before each letter, and what was taken off.

    Value 0 is the end of a conversation, whatever else has the same costs.
    """
    values = [tuple(c[0] for c in _at_end())]
    index: dict[tuple[int, ...], int] = {}
    before, taken = [], []
    for value in values:  # grows as values are met
        row, off = [], []
        for letter in LETTERS:
            costs = [c[0] for c in choices(letter, value)]
            least = min(costs)
            found = tuple(c - least for c in costs)
            if found not in index:
                index[found] = len(values)
                values.append(found)
            row.append(index[found])
            off.append(least)
        before.append(row)
        taken.append(off)
    return values, np.array(before).T, np.array(taken, np.int64).T


VALUES, BEFORE, TAKEN = _values()


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows, damaged by the crc32 of ``conv_id:turn``.

    Nulls count as one space (in role, text and the key; conv_id and turn themselves stay
    null). Remainders by 20: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out of
    it, 3 repeats the row, 4 makes the role ``user``.
    """
    def said(column: str | Column) -> Column:
        return F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column, F.lit(" "))

    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ENDS, "")).otherwise(said("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(1), times)).alias("once")).drop("once")


def _ordered(turns: DataFrame) -> DataFrame:
    """The rows with the columns of their order; the text's MD5 stands for its later characters."""
    base = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                        text_of().alias("text"))
    return base.withColumns({"head": F.substring("text", 1, 64), "digest": F.unhex(F.md5(F.col("text").cast("binary")))})


def _faults(turns: DataFrame) -> DataFrame:
    """One row for each different row of a conversation: its order, copies, and what is wrong with it."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = turns.select("conv_id", *ORDER, (end == "").alias("blank"),
                        (~F.substring(end, -1, 1).isin(*ENDS)).alias("cut"))
    light = staged(rows.groupBy("conv_id", *ORDER).agg(
        F.count(F.lit(1)).alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut")))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = light.groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    said = few_keys(staged(said.filter("n > 1").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")))
    joined = light.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                        & (F.col("digest") == F.col("d")), "left")
    repeats = F.coalesce(F.col("first") != at, F.lit(False))
    return joined.select("conv_id", *ORDER, "copies", "blank", "cut", repeats.alias("repeats"))


def _blocks(conv_type: str):
    """Signature blocks of sorted rows; a conversation may begin or end in another task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters, first, last, illegal = None, [], "", "", 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal held, letters, illegal
            if held is not None:
                out.append((*held, "".join(letters), first, last, illegal))
            held, letters, illegal = None, [], 0

        for batch in batches:
            for conv, turn, role, head, digest, copies, blank, cut, repeats in zip(*(c.to_pylist() for c in batch.columns)):
                initial = role[:1]
                kept = initial if initial in ("s", "u", "a") else "o"
                gone = blank or repeats
                for copy in range(copies):
                    if held is None or held[0] != conv or len(letters) == BLOCK:
                        close()
                        held, first = (conv, turn, role, head, digest, copy), initial
                    elif last + initial not in LEGAL:
                        illegal += 1
                    letters.append("x" if gone or copy else kept.upper() if cut else kept)
                    last = initial
                    if len(out) == 4096:
                        yield rows(out)
                        out = []
        close()
        if out:
            yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        names = ["conv_id", *ORDER, "copy", "letters", "first", "last", "illegal"]
        types = [pa_type, pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(),
                 pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    pa_type = arrow_type(conv_type)
    return run


def arrow_type(spark_type: str) -> pa.DataType:
    """The Arrow type of an identifier column."""
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[spark_type]


def _shared(signatures: Iterable[str], node, end) -> Iterator[object]:
    """What ``node`` makes of each signature; ``signatures`` come sorted by their reversed letters.

    ``node(letter, rest)`` is called once for each different end of the run; what it made
    of the ends of the last signature is kept, which is one branch of the automaton.
    """
    branch, before = [end], ""
    for signature in signatures:
        back = signature[::-1]
        same = 0
        for x, y in zip(back, before):
            if x != y:
                break
            same += 1
        del branch[same + 1:]
        for letter in back[same:]:
            branch.append(node(letter, branch[-1]))
        before = back
        yield branch[-1]


def _value_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the value before it and the cost taken off, by the value after it."""
    def node(letter: str, rest: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        value, cost = rest
        at = LETTERS.index(letter)
        return BEFORE[at][value], cost + TAKEN[at][value]

    def signatures() -> Iterator[str]:
        for batch in batches:
            yield from batch.column(0).to_pylist()

    end = (np.arange(len(VALUES)), np.zeros(len(VALUES), np.int64))
    yield from _batched(((s, value.tolist(), cost.tolist()) for s, (value, cost) in _with(signatures(), node, end)),
                        ["letters", "before", "taken"], [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())])


def _with(signatures: Iterable[str], node, end) -> Iterator[tuple[str, object]]:
    """Each signature with what ``_shared`` gives for it."""
    seen: deque[str] = deque()

    def noted() -> Iterator[str]:
        for s in signatures:
            seen.append(s)
            yield s

    for made in _shared(noted(), node, end):
        yield seen.popleft(), made


def _batched(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _best_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and value after it: the best edits of each state, and the state they lead to.

    A node is the costs, edits and last states of one end of a signature.
    """
    def spelt(found: list[Choice], edits: list[str], last: list[int]) -> tuple:
        """Edits by state: a choice that uses a row goes on with those after the row."""
        out: list[str | None] = [None] * 4
        to = [0] * 4
        for q in sorted(range(4), key=lambda q: found[q][0]):  # what an insertion leads to costs less
            _, initial, after, used = found[q]
            out[q] = initial + (edits[after] if used else out[after])
            to[q] = last[after] if used else to[after]
        return [c[0] for c in found], out, to

    def node(letter: str, rest: tuple) -> tuple:
        costs, edits, last = rest
        return spelt(choices(letter, costs), edits, last)

    def rows() -> Iterator[tuple]:
        value_now, run = None, []

        def of(value: int, signatures: list[str]) -> Iterator[tuple]:
            end = spelt(_at_end(), [""] * 4, list(range(4))) if value == 0 else (VALUES[value], [""] * 4, list(range(4)))
            for s, (_, edits, last) in _with(signatures, node, end):
                yield s, value, edits, last

        for batch in batches:
            for s, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if run and (value != value_now or len(run) == 4096):  # a longer run begins its automaton again
                    yield from of(value_now, run)
                    run = []
                value_now = value
                run.append(s)
        if run:
            yield from of(value_now, run)

    yield from _batched(rows(), ["letters", "value", "edits", "states"],
                        [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())])


def _values_after(conv_type: str):
    """Blocks of a conversation from the last to the first: the value after each, and its cost."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, value, later = object(), 0, None
        for batch in batches:
            values, costs, extra = [], [], []
            columns = (batch.column(n).to_pylist() for n in ("conv_id", "first", "last", "before", "taken"))
            for c, first, last, before, taken in zip(*columns):
                if c != conv:
                    conv, value, later = c, 0, None
                extra.append(int(later is not None and last + later not in LEGAL))
                values.append(value)
                costs.append(taken[value])
                value, later = before[value], first
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("conv_id", *ORDER, "copy", "letters")),
                 pa.array(np.array(extra, np.int64) + batch.column("illegal").to_numpy()),
                 pa.array(values, pa.int64()), pa.array(costs, pa.int64())],
                ["conv_id", *ORDER, "copy", "letters", "illegal", "value", "cost"])
    return run


def _edits_taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from the first to the last: the edits of the state reached."""
    conv, state, number = object(), START, 0
    for batch in batches:
        pieces, numbers, costs = [], [], []
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "edits", "states", "cost", "value", "letters"))
        for c, edits, states, cost, value, letters in zip(*columns):
            if c != conv:
                conv, state, number = c, START, 0
                for letter in reversed(letters):  # what is above the minimum before the first block
                    value = BEFORE[LETTERS.index(letter)][value]
                cost += VALUES[value][START]
            pieces.append(edits[state])
            numbers.append(number)
            costs.append(cost)
            state, number = states[state], number + 1
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("conv_id", *ORDER, "copy", "illegal")),
             pa.array(costs, pa.int64()), pa.array(numbers, pa.int64()), pa.array(pieces, pa.string())],
            ["conv_id", *ORDER, "copy", "illegal", "cost", "number", "edits"])


def audits(faults: DataFrame) -> DataFrame:
    """The best edits of each block: conv_id, its place, illegal, cost, number, edits."""
    kind = dict(faults.dtypes)["conv_id"]
    place = f"conv_id {kind}, turn long, role string, head string, digest binary, copy long"
    sort = ["conv_id", *ORDER]
    blocks = staged(faults.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(
        _blocks(kind), f"{place}, letters string, first string, last string, illegal long"))

    def by_ends(signatures: DataFrame, *first: str) -> DataFrame:
        keys = [*first, F.reverse("letters")]
        return signatures.distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)

    maps = staged(by_ends(blocks.select("letters")).mapInArrow(
        _value_maps, "letters string, before array<long>, taken array<long>"))
    down = [F.col(c).desc_nulls_last() for c in (*ORDER, "copy")]
    valued = staged(blocks.join(maps, "letters").repartition("conv_id").sortWithinPartitions("conv_id", *down).mapInArrow(
        _values_after(kind), f"{place}, letters string, illegal long, value long, cost long"))
    best = staged(by_ends(valued.select("letters", "value"), "value").mapInArrow(
        _best_edits, "letters string, value long, edits array<string>, states array<long>"))
    return valued.join(best, ["letters", "value"]).repartition("conv_id").sortWithinPartitions(
        "conv_id", *ORDER, "copy").mapInArrow(
        _edits_taken, f"{place}, illegal long, cost long, number long, edits string")


def _repaired(batch_rows: Iterator[tuple]) -> Iterator[tuple]:
    """Conversation, edit, role and text of the repaired turns; a piece of edits comes before its rows."""
    conv, queue, state = object(), deque(), START

    def inserted() -> Iterator[tuple]:
        nonlocal state
        while queue and queue[0] == "I":
            queue.popleft()
            state = WANTED[state]
            yield conv, "I", ROLE[state], ""

    for c, is_row, role, text in batch_rows:
        if c != conv:
            yield from inserted()
            conv, state = c, START
            queue.clear()
        if not is_row:
            queue.extend(text)
            continue
        yield from inserted()
        edit = queue.popleft()
        if edit == "K":
            state = KEPT[state, role[:1]]
            yield c, "K", role, text
        elif edit == "R":
            state = WANTED[state]
            yield c, "R", ROLE[state], text
        else:
            yield c, "D", None, None
    yield from inserted()


def _turns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", "is_row", "role", "text")))


def _rows_repaired(conv_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv, place = object(), 0
            for c, edit, role, text in _repaired(_turns_of(batches)):
                conv, place = c, place if c == conv else 0
                if edit != "D":
                    yield c, place, edit, role, text
                    place += 1
        yield from _batched(rows(), ["conv_id", "place", "edit", "role", "text"],
                            [arrow_type(conv_type), pa.int64(), pa.string(), pa.string(), pa.string()])
    return run


def _digests(conv_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv, now, some = object(), None, False
            for c, edit, role, text in _repaired(_turns_of(batches)):
                if c != conv:
                    if now is not None:
                        yield conv, now.hexdigest()
                    conv, now, some = c, hashlib.sha256(), False
                if edit != "D":
                    now.update(f"{chr(10) if some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    some = True
            if now is not None:
                yield conv, now.hexdigest()
        yield from _batched(rows(), ["conv_id", "repaired_sha256"], [arrow_type(conv_type), pa.string()])
    return run


def _with_edits(ordered: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows in order, each block's edits before its first row."""
    rows = ordered.select("conv_id", *ORDER, F.lit(True).alias("is_row"), F.lit(0).cast("long").alias("copy"), "text")
    edits = pieces.select("conv_id", *ORDER, F.lit(False).alias("is_row"), "copy", F.col("edits").alias("text"))
    return rows.unionByName(edits).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER, "is_row", "copy")


def repair(turns: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), edit (K, R or I), role, text.

    ``turns`` has conv_id (bigint, int or string), turn, role and text; other columns are
    ignored. Null roles and texts count as empty, a null conv_id is a conversation of its
    own, null turns come first. Rows of one turn go by role, then by the first 64 characters
    of the text, then by its MD5; repeated rows are duplicates. An empty table gives no rows,
    as does a conversation of which nothing is left. A conversation is read by one task as a
    stream, since its turns follow from one another; none of its texts is held.
    """
    ordered = _ordered(turns)
    kind = dict(turns.dtypes)["conv_id"]
    return _with_edits(ordered, staged(audits(_faults(ordered)))).mapInArrow(
        _rows_repaired(kind), f"conv_id {kind}, place long, edit string, role string, text string")


def repair_report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: faults of its ``turns``, cheapest edits, digest.

    gaps (turn numbers missing between the least and the greatest), blank, duplicate and
    truncated rows, illegal neighbours, cost, audit (initials of the edits), repaired_sha256
    (of ``role:text`` lines). A conversation without turns has zeros, no edits and the digest
    of nothing. Odd input is treated as in ``repair``.
    """
    ordered = _ordered(turns)
    kind = dict(conversations.dtypes)["conv_id"]
    faults = staged(_faults(ordered))
    pieces = staged(audits(faults))
    hashes = _with_edits(ordered, pieces).mapInArrow(_digests(kind), f"conv_id {kind}, repaired_sha256 string")

    again = F.col("copies") - F.when(F.col("repeats"), 0).otherwise(1)
    counted = faults.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), again).otherwise(0)).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & ~F.col("repeats") & F.col("cut"), 1).otherwise(0)).alias("truncated"))
    edited = pieces.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "edits"))), lambda x: x["edits"]),
                     "").alias("audit"))
    parts = conversations.select("conv_id").distinct().unionByName(counted, allowMissingColumns=True).unionByName(
        edited, allowMissingColumns=True).unionByName(hashes, allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return parts.groupBy("conv_id").agg(
        *(F.coalesce(F.max(n), F.lit(0)).cast("long").alias(n) for n in numbers),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
