"""Conversation structure repair over a suffix-shared DAWG.

A conversation is reduced to a signature, one letter per row: what its role's initial is and what is wrong with it. All
distinct signatures form one automaton that is minimised from the end: a node is a suffix, and every signature that ends
in it shares it. Each node holds, for each state of the grammar, the cheapest cost of what is left and the edit that begins
the least audit among the cheapest; both follow from the node behind it in constant time, because the edits that can come
first all have different letters. They are computed once per node for all conversations, and audits are read off by walking.

Signatures are sorted by their reversals and dealt in ranges, so a task meets signatures that share a suffix one after the other
and holds only the nodes of the current one. The grammar is ``(s?(ua)+)?`` over role initials.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import bounded_batches, landed, new_folder, read_table

# The edits' costs, and the grammar. States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MADE = (2, 2, 3, 2)
ENDS = (0, 3)
NEVER = 1 << 60
SPACE = r"\x20\x09-\x0D"


class Node(NamedTuple):
    """Cost and first edit ("" at the end) of what is left, per state of the grammar."""

    cost: tuple[int, int, int, int]
    edit: tuple[str, str, str, str]


def _with_inserts(first: list[tuple[int, str]]) -> Node:
    """``first`` without inserts, per state, completed by those that begin with one. Two inserts lead from u or a back to it, so one
    is the most that helps there, and the other states insert into u."""
    best = list(first)
    for s, behind in ((2, first[3]), (3, first[2])):
        best[s] = min(first[s], (INSERT + behind[0], "I"))
    for s in (0, 1):
        best[s] = min(first[s], (INSERT + best[2][0], "I"))
    return Node(tuple(c for c, _ in best), tuple(e for _, e in best))


END = _with_inserts([(0 if s in ENDS else NEVER, "") for s in range(4)])


def before(letter: str, behind: Node) -> Node:
    """The node of ``letter`` and the suffix ``behind``."""
    first = []
    for s in range(4):
        ways = [(DELETE + behind.cost[s], "D")]
        if letter != "x":
            fault = TRUNCATED if letter.isupper() else 0
            ways.append((fault + REROLE + behind.cost[MADE[s]], "R"))
            if (to := KEEPS[s].get(letter.lower())) is not None:
                ways.append((fault + behind.cost[to], "K"))
        first.append(min(ways))
    return _with_inserts(first)


def solve(signatures: Iterable[str]) -> Iterator[tuple[str, int, str]]:
    """``signature, cost, audit`` of signatures that are sorted by their reversals; only the nodes of the current one are held."""
    last, nodes = "", [END]
    for word in signatures:
        turned = word[::-1]
        shared = 0
        while shared < min(len(last), len(turned)) and last[shared] == turned[shared]:
            shared += 1
        del nodes[shared + 1 :]
        for letter in turned[shared:]:
            nodes.append(before(letter, nodes[-1]))
        last = turned
        audit, state, left = [], 0, len(word)
        while edit := nodes[left].edit[state]:
            audit.append(edit)
            if edit == "K":
                state = KEEPS[state][word[len(word) - left].lower()]
            elif edit != "D":
                state = MADE[state]
            left -= edit != "I"
        yield word, nodes[-1].cost[0], "".join(audit)


def replay(audit: str, turns: Iterable[dict]) -> list[dict]:
    """The repaired rows (``role, text``) of an audit and the rows it is about."""
    rest, state, out = iter(turns), 0, []
    for edit in audit:
        row = None if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit == "K":
            state = KEEPS[state][row["role"][:1]]
            out.append({"role": row["role"], "text": row["text"]})
        else:
            state = MADE[state]
            out.append({"role": "user" if state == 2 else "assistant", "text": row["text"] if row else ""})
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def words() -> Iterator[str]:
        for batch in batches:
            yield from (w.as_py() for w in batch.column("signature"))

    schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
    held, size = [], 0
    for row in solve(words()):
        held.append(row)
        size += len(row[0])
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        repaired = [replay(a.as_py(), t.as_py()) for a, t in zip(batch.column("audit"), batch.column("turns"), strict=True)]
        kept = [c for c in batch.schema.names if c != "turns"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(repaired, TURNS)], names=[*kept, "repaired"])


def audits(signatures: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of the distinct values of column ``signature``."""
    distinct = signatures.select("signature").distinct().withColumn("turned", F.reverse("signature"))
    return distinct.repartitionByRange("turned").sortWithinPartitions("turned").mapInArrow(_solve, "signature string, cost long, audit string")


def _letter(role: Column, gone: Column, truncated: Column) -> Column:
    initial = F.substring(role, 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(gone, "x").when(truncated, F.upper(known)).otherwise(known)


def signatures(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation its rows in order, its faults and its signature. One exchange, by conversation."""
    clean = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))])
    by_text, by_turn = Window.partitionBy("conv").orderBy("role", "text", "turn"), Window.partitionBy("conv").orderBy("turn", "role", "text")
    same = F.lag("role").over(by_text).eqNullSafe(F.col("role")) & F.lag("text").over(by_text).eqNullSafe(F.col("text"))
    told = clean.select("*", same.alias("again"), (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"))
    end = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    told = told.select("*", (F.col("again") & ~F.col("blank")).alias("duplicate"), (~F.col("again") & ~F.col("blank") & ~end.isin(".", "!", "?")).alias("truncated"))
    pair = F.concat(F.lag(F.substring("role", 1, 1)).over(by_turn), F.substring("role", 1, 1))
    placed = told.select("*", F.row_number().over(by_turn).alias("at"), (pair.isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"), _letter(F.col("role"), F.col("blank") | F.col("duplicate"), F.col("truncated")).alias("letter"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0))
    held = placed.groupBy("conv").agg(gaps.alias("gaps"), *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.sort_array(F.collect_list(F.struct("at", "letter", "role", "text"))).alias("ts"))
    turns = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return held.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", F.array_join(F.transform("ts", lambda t: t["letter"]), "").alias("signature"), turns.alias("turns"))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired`` per conversation.

    ``repaired`` is the list of ``role, text`` that the cheapest edits leave, ``audit`` their initials in order. A null role or
    text is one space; a null turn comes first and counts in no gap; rows of a null conversation id form one conversation;
    rows of one turn go by role, then text; of rows that repeat, the later are duplicates. A role is known by its first
    character, an empty role has none. Other columns are ignored, an empty table gives no rows. A conversation is one row
    here, as its repaired text is one value: its length is bounded by that, not by a cap.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    held = landed(signatures(rows, conv_col, turn_col, role_col, text_col), new_folder(spark, "conversations"))
    solved = landed(audits(held), new_folder(spark, "audits"))
    # Few signatures are in very many conversations: what is joined is a row per signature, broadcast by its written size or skew-split.
    met = held.join(solved, "signature").drop("signature")
    schema = met.drop("turns").withColumn("repaired", F.lit(None).cast("array<struct<role:string,text:string>>")).schema
    return met.mapInArrow(_replay, schema).withColumnRenamed("conv", conv_col)


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with known faults, chosen by a hash of conversation and turn: dropped, emptied, without sentence
    ends, doubled, or said by the user. A null is one space, but a null turn or id stays one outside the hash."""
    clean = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    kind = clean.withColumn("kind", F.crc32(F.encode(key, "UTF-8")) % 20).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = kind.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired; those of which no row is left too."""
    rows = read_table(spark, sf_dir, "conversations")
    done = repair(damage(rows))
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    told = done.select(F.col("conv_id").alias("conv"), *counts, "audit", said.alias("said"))
    all_ids = rows.select("conv_id").distinct()
    every = all_ids.join(told, all_ids["conv_id"].eqNullSafe(told["conv"]), "left")
    return every.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.encode(F.coalesce("said", F.lit("")), "UTF-8"), 256).alias("repaired_sha256"))
