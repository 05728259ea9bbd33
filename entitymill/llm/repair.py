"""Cheapest repair of conversations over a suffix-shared automaton of their signatures.

A conversation's signature has one letter per row: its role's initial (capital
where the text is cut off) or a letter for rows that have to go. Signatures are
sorted by their ends, so those with equal ends follow each other and every
different end, a node of the automaton, is met once over all conversations: for
each node and grammar state the cost to the end and the best first edit are
computed there and then. A very long conversation is several pieces; costs are
carried from its last piece to its first, states from its first to its last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

#: Rows and characters of text a piece of a conversation holds at most (one row at least).
PIECE_ROWS, PIECE_CHARS = 4096, 1 << 20

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a. What an inserted or renamed turn is in each state, and where it leads.
WANTED = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
#: Where a kept row's initial leads.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NEVER = 1 << 40
#: Cost to end in each state, and the turns that are then added.
END = (0, 6, 3, 0)
CLOSING = ("", "II", "I", "")


def _row(letter: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Cost to the end from before a row in each state, and the best first edit with the state it leads to.

    Edits that cost the same are told apart by their letter: no two of a node
    and state share one, so the smaller letter has the smaller audit.
    """
    gone, cut = letter in "bd", letter.isupper()
    costs, edits = [], []
    for state in range(4):
        ways = [(DELETE + after[state], "D", state)]
        if not gone:
            ways.append((REROLE + TRUNCATED * cut + after[NEXT[state]], "R", NEXT[state]))
            kept = KEPT.get((state, letter.lower()))
            if kept is not None:
                ways.append((KEEP + TRUNCATED * cut + after[kept], "K", kept))
        best = min(ways)
        costs.append(best[0])
        edits.append(best[1:])
    # a turn inserted before the row: states 2 and 3 lead to each other, 0 and 1 to 2
    plain = tuple(costs)
    two, three = min(plain[2], INSERT + plain[3]), min(plain[3], INSERT + plain[2])
    reached = (INSERT + two, INSERT + two, INSERT + three, INSERT + two)
    for state in range(4):
        if reached[state] < costs[state] or reached[state] == costs[state] and "I" < edits[state][0]:
            costs[state], edits[state] = reached[state], ("I", NEXT[state])
    return tuple(min(c, NEVER) for c in costs), tuple(edits)


def automaton(signatures: DataFrame, audits: bool = True) -> DataFrame:
    """(signature, after, costs, audits, states) of every row of ``signatures``, which are distinct.

    ``signature``: a letter per row; ``after``: cost to the end behind it by
    state. For each state before it: the cost to the end, the letters of the
    cheapest edits (of equal ones the smallest) and the state they end in.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, known, nodes = None, "", []
        for batch in batches:
            out = {"signature": [], "after": [], "costs": [], "audits": [], "states": []}
            for back, after in zip(batch.column("back").to_pylist(), batch.column("after").to_pylist()):
                if after != end:
                    end, known, nodes = after, "", [(tuple(after), None)]
                shared = 0
                for a, b in zip(back, known):
                    if a != b:
                        break
                    shared += 1
                del nodes[shared + 1:]
                for letter in back[shared:]:
                    nodes.append(_row(letter, nodes[-1][0]))
                known = back
                said, states = [], []
                for state in range(4):
                    letters, at, node = [], state, len(nodes) - 1
                    while audits and node and nodes[-1][0][state] < NEVER:
                        letter, at = nodes[node][1][at]
                        letters.append(letter)
                        node -= letter != "I"
                    said.append("".join(letters))
                    states.append(at)
                out["signature"].append(back[::-1])
                out["after"].append(after)
                out["costs"].append(nodes[-1][0])
                out["audits"].append(said)
                out["states"].append(states)
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    n = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_end = signatures.select(F.reverse("signature").alias("back"), "after").repartitionByRange(n, "after", "back").sortWithinPartitions("after", "back")
    return by_end.mapInArrow(run, "signature string, after array<long>, costs array<long>, audits array<string>, states array<int>")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns)):
            yield dict(zip(names, values))


def marked(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n, early): different rows of a conversation, how often they occur, and whether role and text were not seen before.

    ``rows``: conv, turn, role, text; equal rows are summed before their shuffle.
    """
    once = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    once = cut_lineage(once.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    # nulls come first, so a null turn is the smallest
    again = once.groupBy("conv", "digest").agg(F.count("*").alias("turns"), F.max(F.col("turn").isNull()).alias("no_turn"), F.min("turn").alias("first"))
    again = cut_lineage(again.filter("turns > 1").select("conv", "digest", "no_turn", "first"))
    early = F.when(F.col("no_turn"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first"))
    return once.join(again, ["conv", "digest"], "left").select("conv", "turn", "role", "text", "n", F.coalesce(early, F.lit(True)).alias("early"))


def pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Conversations cut into pieces, in order: conv, part, piece, signature, turns, blank, duplicate, truncated.

    Rows are range-sorted by conversation and turn over all tasks, so one of any
    length is spread; ``part`` and ``piece`` number its pieces in order.
    """
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    letter = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit("b")).when(~F.col("early"), F.lit("d")).when(~bare.rlike(r"[.!?]\z"), F.upper(known)).otherwise(known)
    # further copies of a row that stays are duplicates of it
    copies = F.when(letter == "b", F.lit("b")).otherwise(F.lit("d"))
    signed = rows.select("conv", "turn", "role", "text", F.concat(letter, F.repeat(copies, (F.col("n") - 1).cast("int"))).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now, held, chars = TaskContext.get().partitionId(), 0, None, [], 0

        def ready() -> pa.RecordBatch:
            values = [[now], [part], [number], ["".join(h[2] for h in held)], [[{"role": h[0], "text": h[1], "n": len(h[2])} for h in held]]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["conv", "part", "piece", "signature", "turns"])

        turn = pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int32())])
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field("conv").type, pa.int32(), pa.int32(), pa.string(), pa.list_(turn)]
            for conv, role, text, letters in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text", "letters"))):
                if held and (conv != now or len(held) >= piece_rows or chars + len(text) > piece_chars):
                    yield ready()
                    number, held, chars = number + 1, [], 0
                now = conv
                held.append((role, text, letters))
                chars += len(text)
        if held:
            yield ready()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    kind = rows.schema["conv"].dataType.simpleString()
    return signed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        run, f"conv {kind}, part int, piece int, signature string, turns array<struct<role: string, text: string, n: int>>")


def _carried(steps: DataFrame) -> DataFrame:
    """(conv, part, piece, after): cost to the end behind each piece, carried from the last piece of its conversation to the first.

    ``steps``: conv, part, piece and ``through``, the costs from each state to
    each. One small row per piece passes one task in order, nothing is held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, after = None, None
        for batch in batches:
            afters = []
            for conv, through in zip(batch.column("conv").to_pylist(), batch.column("through").to_pylist()):
                if after is None or conv != now:
                    now, after = conv, np.array(END)
                afters.append((after - after.min()).tolist())
                after = (np.array(through).reshape(4, 4) + after).min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("conv", "part", "piece")] + [pa.array(afters, pa.list_(pa.int64()))], names=["conv", "part", "piece", "after"])

    kind = steps.schema["conv"].dataType.simpleString()
    ordered = steps.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("piece"))
    return ordered.mapInArrow(run, f"conv {kind}, part int, piece int, after array<long>")


def _through(signatures: DataFrame) -> DataFrame:
    """(signature, through): least cost from every state before a signature to every state behind it, row by row."""
    ends = [[0 if i == j else NEVER for i in range(4)] for j in range(4)]
    asked = signatures.select("signature", F.explode(F.array(*[F.array(*[F.lit(x).cast("long") for x in e]) for e in ends])).alias("after"))
    solved = automaton(asked, audits=False).select("signature", F.array_position("after", F.lit(0).cast("long")).alias("end"), "costs")
    whole = solved.groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("end", "costs"))).alias("c"))  # four each
    return whole.select("signature", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.col("c"), lambda e: e["costs"][i]))).alias("through"))


def _finished(asked: DataFrame, told: DataFrame) -> DataFrame:
    """One row per conversation: the edits of its pieces in order, its counts, and the digest of what is left.

    Rows of pieces pass in order; states, counts and the digest's state are all
    that is held, however long the conversation.
    """
    names = ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind, out, solved = None, None, [], None
        state = counts = audit = digest = last = None

        def add(role: str, text: str) -> None:
            digest.update(("\n" if counts["turns"] else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            counts["turns"] += 1

        def insert() -> int:
            add(WANTED[state], "")
            counts["cost"] += INSERT
            return NEXT[state]

        def done() -> None:
            nonlocal state
            audit.append(CLOSING[state])
            for _ in CLOSING[state]:
                state = insert()
            out.append((now, *(counts[k] for k in names[1:6]), "".join(audit), digest.hexdigest()))

        def ready() -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 5, pa.string(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return made

        for batch in batches:
            kind = batch.schema.field("conv").type
            for row in _groups([batch]):
                if counts is None or row["conv"] != now:
                    if counts is not None:
                        done()
                    now, state, audit, digest, last = row["conv"], 0, [], hashlib.sha256(), None
                    counts = dict.fromkeys(["turns", *names[1:6]], 0)
                if row["audits"] is not None:
                    solved = row["audits"]
                    continue
                letters = iter(solved[state])
                audit.append(solved[state])
                marks = iter(row["signature"])
                for turn in row["turns"]:
                    for _ in range(turn["n"]):
                        mark, first = next(marks), turn["role"][:1]
                        counts["blank"] += mark == "b"
                        counts["duplicate"] += mark == "d"
                        counts["truncated"] += mark.isupper()
                        counts["illegal"] += last is not None and last + first not in ("su", "ua", "au")
                        last = first
                        while (edit := next(letters)) == "I":
                            state = insert()
                        if edit == "D":
                            counts["cost"] += DELETE
                            continue
                        counts["cost"] += TRUNCATED * mark.isupper() + REROLE * (edit == "R")
                        add(WANTED[state] if edit == "R" else turn["role"], turn["text"])
                        state = NEXT[state] if edit == "R" else KEPT[state, mark.lower()]
                # what is inserted behind a piece belongs to the next one
            if out:
                yield ready()
        if counts is not None:
            done()
            yield ready()

    none = {"audits": "array<string>", "signature": "string", "turns": "array<struct<role: string, text: string, n: int>>"}
    sides = [df.select("conv", "part", "piece", *[F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in none.items()]) for df in (asked, told)]
    both = sides[0].unionByName(sides[1]).repartition("conv").sortWithinPartitions("conv", "part", "piece", F.col("audits").isNull())
    return both.mapInArrow(run, f"conv {told.schema['conv'].dataType.simpleString()}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation in ``messages``.

    Rows are read by turn, nulls first, equal turns by role and text. A row's
    first fault counts: blank, duplicate (role and text seen earlier, compared
    by SHA-256) or truncated (the last character that is not blank is none of
    .!?). Edits are Keep, Rerole, Delete, Insert; the roles left begin with
    (s?(ua)+)? and the audit is the smallest of the cheapest. ``illegal`` counts
    neighbours whose roles do not begin with su, ua or au. The digest is of
    role:text of what is left, joined by newlines.

    A null conversation is one conversation, null roles and texts count as one
    space, repeated rows are duplicates; an empty table has no conversation and
    other columns are not read. A conversation of any length is spread over
    pieces; only its digest is made in order, piece by piece.
    """
    own = messages.select(
        F.struct(F.col(conv).alias("conv")).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    kind = own.schema["conv"].dataType["conv"].dataType
    # conversations by a name that sorts and joins where the id is null
    named = own.withColumn("conv", F.when(F.col("conv.conv").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("conv.conv").cast("string"))))
    told = cut_lineage(pieces(marked(named), piece_rows, piece_chars))
    narrow = told.select("conv", "part", "piece", "signature")
    several = narrow.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select("conv")
    parted = cut_lineage(narrow.join(several, "conv"))
    steps = parted.join(_through(parted.select("signature").distinct()), "signature")
    after = _carried(steps).select("conv", "part", "piece", F.col("after").alias("carried"))
    end = F.array(*[F.lit(x).cast("long") for x in END])
    spots = cut_lineage(narrow.join(after, ["conv", "part", "piece"], "left").withColumn("after", F.coalesce("carried", end)).drop("carried"))
    solved = cut_lineage(automaton(spots.select("signature", "after").distinct()).select("signature", "after", "audits"))
    found = _finished(spots.join(solved, ["signature", "after"]), told)
    return found.select(
        F.when(F.col("conv") != "-", F.substr("conv", F.lit(2))).cast(kind).alias("conv_id"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after damage that a checksum of conversation and turn deals out, nulls as one space.

    Of 20 rests 0 drops the row, 1 empties its text, 2 removes its .!?, 3
    repeats it, 4 makes the user its speaker.
    """
    def spaced(c: str) -> F.Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rest = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    own = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), rest.alias("rest"))
    body = F.when(F.col("rest") == 1, F.lit("")).when(F.col("rest") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    who = F.when(F.col("rest") == 4, F.lit("user")).otherwise(F.col("role"))
    return own.filter("rest <> 0").select("conv_id", "turn", who.alias("role"), body.alias("text"), F.explode(F.expr("sequence(1, if(rest = 3, 2, 1))")).alias("copy")).drop("copy")


def turn_gaps(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps): whole numbers between the smallest and largest turn of a conversation that no row has; nulls aside.

    Null where the number passes 64 bits.
    """
    once = rows.filter("turn is not null").select("conv_id", "turn").distinct()
    wide = [f(F.col("turn").cast("decimal(20)")) for f in (F.max, F.min)]
    found = once.groupBy("conv_id").agg((wide[0] - wide[1] + 1 - F.count("*")).alias("gaps"))
    return found.select("conv_id", F.col("gaps").try_cast("long").alias("gaps"))
