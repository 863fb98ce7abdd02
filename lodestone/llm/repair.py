r"""Conversations whose turns are missing, doubled, empty, cut off or of the wrong role, found and repaired at the least cost.

A conversation's rows become a signature, one letter each: the initial of its role (``s``, ``u``, ``a``, any other ``x``), as a
capital where the row is cut off;
``-`` for a row that has to go (blank or a duplicate). Many conversations share a signature, so each different one is solved once,
by recursion over its
suffixes, memoised: the cheapest edits of ``signature[i:]`` from each of four states. The audits are joined back to the
conversations, and each replays its own over its turns with array functions.

Edits: Keep (0), Rerole to user or assistant (1), Delete (2; the only one for ``-``) and Insert of an empty turn of user or
assistant (5). A cut-off row that stays costs 5 more.
The role initials that remain must read ``(s?(ua)+)?``. Of equally cheap edits the least by ASCII of their initials wins. An audit
says all: which role a Rerole or an Insert gives follows from the turn before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import modest, parallelism

#: States of the role grammar: nothing yet; a system turn; a user turn last; an assistant turn last. The first and the last may end
#: a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may come next in a state: role initial to state.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
BLANK = r"^[\x20\x09-\x0D]*$"
ENDED = r"[.!?][\x20\x09-\x0D]*$"

Plan = tuple[int, str]


def inserted(plans: list[Plan | None]) -> list[Plan | None]:
    """The best plan from each state once inserts may come first. A third insert in a row comes back to a state that the first left."""
    for _ in range(3):
        plans = [
            min((p for p in (plans[state], *((plans[to][0] + INSERT, "I" + plans[to][1]) for role, to in NEXT[state].items() if role != "s" and plans[to])) if p), default=None)
            for state in range(4)
        ]
    return plans


def before(letter: str, after: list[Plan | None]) -> list[Plan | None]:
    """The best plan from each state for a row and what follows, given the plans for what follows."""
    more = CUT_OFF if letter.isupper() else 0
    plans: list[Plan | None] = []
    for state in range(4):
        found = [(after[state][0] + DELETE, "D" + after[state][1])] if after[state] else []
        if letter != "-":
            for role, to in NEXT[state].items():
                if after[to] and role == letter.lower():
                    found.append((after[to][0] + more, "K" + after[to][1]))
                elif after[to] and role != "s":
                    found.append((after[to][0] + REROLE + more, "R" + after[to][1]))
        plans.append(min(found, default=None))
    return inserted(plans)


def solver():
    """signature -> (cost, audit). Remembers the suffixes of what it solved, if they have at most 32 letters, as those recur;
    100,000 of them at most."""
    memo: dict[str, list[Plan | None]] = {"": inserted([(0, ""), None, None, (0, "")])}

    def solve(signature: str) -> Plan:
        at = max(0, len(signature) - 32)
        while signature[at:] not in memo:
            at += 1
        plans = memo[signature[at:]]
        for k in range(at - 1, -1, -1):
            plans = before(signature[k], plans)
            if len(signature) - k <= 32 and len(memo) < 100_000:
                memo[signature[k:]] = plans
        return plans[START]

    return solve


def replayed(signature: str, audit: str) -> tuple[list[int], list[str | None]]:
    """For each turn of the repaired conversation the row that it comes from (-1: none), and the role that it gets (None: the row's)."""
    at, state, rows, roles = 0, START, [], []
    for edit in audit:
        if edit in "KRI":
            initial = signature[at].lower() if edit == "K" else "a" if state == USER else "u"
            state = NEXT[state][initial]
            rows.append(-1 if edit == "I" else at)
            roles.append(None if edit == "K" else {"u": "user", "a": "assistant"}[initial])
        at += edit != "I"
    return rows, roles


SOLVED = "signature string, cost long, audit string, rows array<int>, roles array<string>"


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    solve = solver()
    for batch in modest(batches):
        signatures = batch.column(0).to_pylist()
        plans = [solve(s) for s in signatures]
        rows, roles = zip(*(replayed(s, audit) for s, (_, audit) in zip(signatures, plans, strict=True)), strict=True)
        columns = [batch.column(0), pa.array([p[0] for p in plans], pa.int64()), pa.array([p[1] for p in plans], pa.string()), pa.array(rows, pa.list_(pa.int32())), pa.array(roles, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["signature", "cost", "audit", "rows", "roles"])


def damaged(turns: DataFrame, every: int = 20) -> DataFrame:
    """conv_id, turn, role, text and ``lost`` of the rows after damage, by crc32(``conv_id:turn``) modulo ``every``: 0 loses the
    row, 1 its text, 2 the marks that end
    sentences, 3 repeats it, 4 makes it a user's. Null roles and texts, and nulls in the key, are one space; the columns conv_id and
    turn keep theirs. A lost row stays as an empty one, marked, so that its conversation isn't forgotten."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % every
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("lost"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def repaired(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lost: Column | None = None) -> DataFrame:
    """For each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, and ``turns``, its repaired
    turns as an array of (role, text).

    Rows go by turn, nulls first, then role, then text. Null roles and texts are one space. A row's first fault counts: blank,
    duplicate (role and text
    stand earlier), truncated (its last letter is none of ``.!?``). gaps: numbers missing between the least and the largest turn.
    illegal: neighbouring rows whose roles don't follow one
    another. A role that starts with none of s, u and a can be reroled or deleted, not kept. A null conversation is one of its own.
    Rows for which ``lost`` holds are no rows, but
    their conversations stay: one without rows has zeros, no edits and no turns. Other columns are not read. No row: no row.

    Texts are shuffled once, by conversation; a conversation becomes one row of the result, so it must fit one. Signatures are
    solved and joined back without texts, those that many conversations
    share by parts, so no signature is one task's.
    """
    own = F.col(conv)
    there = ~F.coalesce(lost, F.lit(False)) if lost is not None else F.lit(True)
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), own.cast("string")), F.lit("null")).alias("key"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        there.alias("there"),
    )
    parts = parallelism(rows)
    same = Window.partitionBy("key", "there", "role", "text").orderBy("turn")
    rows = rows.repartition(parts, "key").withColumn("again", F.row_number().over(same) > 1)
    one = F.when(F.col("there"), F.struct("turn", "role", "text", "again"))
    whole = rows.groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("turns"))

    initial = lambda t: F.substring(t["role"], 1, 1)
    fault = lambda t: F.when(t["text"].rlike(BLANK), "blank").when(t["again"], "duplicate").when(~t["text"].rlike(ENDED), "truncated").otherwise("")
    whole = whole.withColumn("faults", F.transform("turns", fault)).withColumn("initials", F.transform("turns", initial))

    def letter(i: Column, k: Column) -> Column:
        known = F.when(i.isin("s", "u", "a"), i).otherwise("x")
        this = F.get("faults", k)
        return F.when(this.isin("blank", "duplicate"), "-").when(this == "truncated", F.upper(known)).otherwise(known)

    whole = whole.withColumn("signature", F.array_join(F.transform("initials", letter), ""))

    # a signature's conversations get its plan by parts
    shares = whole.select("key", "signature", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"))
    pairs = shares.select("signature", "part").distinct()
    plans = pairs.select("signature").distinct().mapInArrow(solved, SOLVED)
    audits = shares.join(pairs.join(plans, "signature"), ["signature", "part"]).select("key", "cost", "audit", "rows", "roles")

    numbers = F.filter(F.transform("turns", lambda t: t["turn"].cast("long")), lambda n: n.isNotNull())
    gaps = F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers))
    pair = lambda k: F.concat(F.get("initials", k - 1), F.get("initials", k))
    illegal = F.size(F.filter(F.transform("initials", lambda i, k: (k > 0) & ~pair(k).isin("su", "ua", "au")), lambda bad: bad))
    of_row = lambda k, name: F.get("turns", k)[name]
    turns = F.zip_with(
        "rows",
        "roles",
        lambda k, r: F.struct(F.coalesce(r, of_row(k, "role")).alias("role"), F.when(k < 0, "").otherwise(of_row(F.greatest(k, F.lit(0)), "text")).alias("text")),
    )
    count = lambda kind: F.size(F.filter("faults", lambda f: f == kind)).cast("long").alias(kind)
    kind = conversations.select(own).schema[0].dataType
    return whole.join(audits, "key").select(
        F.when(F.col("key") != "null", F.substring("key", 2, 1 << 30).cast(kind)).alias("conv_id"),
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        count("blank"),
        count("duplicate"),
        count("truncated"),
        illegal.cast("long").alias("illegal"),
        "cost",
        "audit",
        turns.alias("turns"),
    )
