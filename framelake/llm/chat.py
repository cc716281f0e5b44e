"""Chat formatting with a minimum-cost repair of roles.

A legal conversation has at most one system turn, at its start, then user and assistant turns in alternation, beginning with the
user and ending with the assistant. A dynamic program over the automaton of legal prefixes reads the turns in order and chooses
for each: keep its role, give it another one, or merge it with the turn before; empty turns may be inserted before it or at
the end. The sequence of least total cost is rendered; among equal ones, the one with the lowest states at the ends of chunks, and within
a chunk the choices that come first in the fixed order of states and actions (so the chunk's size may choose among equal ones).

States: nothing yet, after system, after user, after assistant. A turn is a matrix of the costs from state to state, and
costs of turns one after another are their product with (min, +). So a long conversation is cut into chunks of turns: each
chunk's matrix is computed by itself, the chunks' matrices are multiplied along each conversation, and then each chunk is
traced back on its own from the states at its two ends. No task holds more than a chunk's turns or a conversation's matrices. A
chunk is a range of turn numbers; where many turns share a few numbers, it is cut by number and by a hash of role and text.

Rendering is by turn: a header and the text, or for a merged turn its text alone; so the rendered conversation is its turns' pieces
in order, and no task gathers a whole one.

Defined results: a null or unknown role has no preferred role and becomes the cheapest legal one; a null text counts as empty; turns of
one number stand in the order of a hash of role and text, then of these, and repeated rows are turns of their own; a null turn comes first; rows of a null conversation form one.
An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import materialize, table

ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "ai": "assistant", "model": "assistant", "instruction": "system", "developer": "system"}
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Costs: of a merge, of giving a turn another role (from an unknown one: less), of an empty turn inserted.
MERGE, RELABEL, UNKNOWN, INSERT = 1.0, 3.0, 0.5, 2.0
#: Turn numbers that form a chunk.
CHUNK = 512
INF = 1e18
#: From state to state, the empty turns to insert before a turn of a role (0 system, 1 user, 2 assistant): none if the step is legal.
BEFORE = {
    (NOTHING, 0): (), (NOTHING, 1): (), (SYSTEM, 1): (), (ASSISTANT, 1): (), (USER, 2): (),
    (NOTHING, 2): (1,), (SYSTEM, 2): (1,), (ASSISTANT, 2): (1,), (USER, 1): (2,),
}
KEEP, RENAME, JOIN = "keep", "relabel", "merge"
Step = tuple[float, int, str, tuple[int, ...]]  # cost, next state, action, inserted roles


def steps(state: int, role: int, before: int) -> list[Step]:
    """What may be done with a turn of a role (-1: unknown) in a state, in order of preference. before: 1 if the conversation has had a turn, which a turn can be merged with."""
    out: list[Step] = []
    for new in (role, *(r for r in range(3) if r != role)) if role >= 0 else range(3):
        inserted = BEFORE.get((state, new))
        if inserted is not None:
            cost = (0.0 if new == role else UNKNOWN if role < 0 else RELABEL) + INSERT * len(inserted)
            out.append((cost, new + 1, KEEP if new == role else RENAME, inserted))
    if state != NOTHING and before:
        out.append((MERGE + (0.0 if role == state - 1 else UNKNOWN if role < 0 else RELABEL), state, JOIN, ()))
    return out


def end_cost(state: int) -> tuple[float, tuple[int, ...]]:
    """Cost of ending in a state, and the empty turns that are added for it."""
    return {NOTHING: (0.0, ()), SYSTEM: (2 * INSERT, (1, 2)), USER: (INSERT, (2,)), ASSISTANT: (0.0, ())}[state]


STEPS = {(s, r): steps(s, r, 1) for s in range(4) for r in range(-1, 3)}
MATRICES = {r: np.array([[min([c for c, t, _, _ in STEPS[s, r] if t == to], default=INF) for to in range(4)] for s in range(4)]) for r in range(-1, 3)}


def chunk_matrix(roles: list[int]) -> np.ndarray:
    """Least costs from state to state over turns one after another."""
    m = np.where(np.eye(4, dtype=bool), 0.0, INF)
    for r in roles:
        m = np.minimum((m[:, :, None] + MATRICES[r][None]).min(axis=1), INF)
    return m


def trace(roles: list[int], start: int, end: int) -> list[Step]:
    """The steps of a least-cost way from start to end over the turns."""
    costs = [[INF] * 4 for _ in range(len(roles) + 1)]  # from each place on to the end
    costs[-1][end] = 0.0
    for k in range(len(roles) - 1, -1, -1):
        after = costs[k + 1]
        for s in range(4):
            costs[k][s] = min((c + after[t] for c, t, _, _ in STEPS[s, roles[k]]), default=INF)
    out, s = [], start
    for k, r in enumerate(roles):
        step = min(STEPS[s, r], key=lambda x: x[0] + costs[k + 1][x[1]])
        out.append(step)
        s = step[1]
    return out


def way(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """For each chunk of a conversation, the states at its two ends on a least-cost way."""
    after = np.array([end_cost(s)[0] for s in range(4)])
    rest = [after]
    for m in reversed(matrices):
        after = (m + after[None]).min(axis=1)
        rest.append(after)
    rest.reverse()
    out, s = [], NOTHING
    for m, after in zip(matrices, rest[1:]):
        t = int(np.argmin(m[s] + after))
        out.append((s, t))
        s = t
    return out


def header(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


def rendered(step: Step, text: str, first: bool, last_end: tuple[int, ...] | None) -> str:
    """A turn's piece: what ends the turn before (but for the first), inserted turns, header and text; at the conversation's end, what ends it."""
    _, state, action, inserted = step
    if action == JOIN:
        piece = "\n\n" + text
    else:
        piece = ("" if first else "\n") + "".join(header(r) + "\n" for r in inserted) + header(state - 1) + text
    if last_end is not None:
        piece += "\n" + "".join(header(r) + "\n" for r in last_end)
    return piece


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else -1


def by_chunk(rows: DataFrame, columns: list[str], settle, schema: str) -> DataFrame:
    """settle(list of rows) for each (conv_id, chunk); rows of columns, the first two of which are conv_id and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:2] != row[:2]:
                    out += settle(held)
                    held = []
                held.append(row)
            if out:
                yield as_batch(out)
        if held:
            yield as_batch(settle(held))

    types = [pa.int64() if "long" in x else pa.int32() if "int" in x else pa.list_(pa.float64()) if "array" in x else pa.string() for x in schema.split(", ")]
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "tie", "role", "text").select(*columns).mapInArrow(run, schema)


def chunked(rows: DataFrame, chunk: int) -> DataFrame:
    """rows (conv_id, turn, role, text) with tie and chunk, whose order is that of turns: (range of numbers, number, part of the ties) in one string.

    Only ranges that hold more than twice chunk rows are cut further; what tells them is a row for each of these.
    """
    tie = F.xxhash64("role", "text")
    rows = rows.withColumn("tie", tie).withColumn("range", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(2**53))).cast("long"))
    crowded = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n")).where(F.col("n") > 2 * chunk)
    crowded = crowded.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.least(F.lit(48), F.ceil(F.log2(F.col("n") / chunk))).cast("int").alias("bits"))
    told = rows.join(materialize(crowded, "crowded"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")), "left")
    ordered = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(2**63)))), 16, "0")  # noqa: E731  as text, in the order of the numbers
    part = F.concat(ordered(F.coalesce("turn", F.lit(-(2**63)))), ordered(F.expr("shiftright(tie, 64 - bits)")))
    return told.withColumn("chunk", F.concat(ordered(F.col("range")), F.when(F.col("bits").isNull(), "").otherwise(part))).drop("c", "r", "bits", "range")


def repair(turns: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, turn, place, role, new_role, action, inserted, piece) of each row of turns; a conversation's text is its pieces by place."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = chunked(rows, chunk)

    def matrix(held: list[tuple]) -> list[tuple]:
        return [(*held[0][:2], len(held), chunk_matrix([role_number(x[2]) for x in held]).ravel().tolist())]

    matrices = materialize(by_chunk(rows, ["conv_id", "chunk", "role"], matrix, "conv_id long, chunk string, n long, m array<double>"), "chat")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle() -> list[tuple]:
            found = way([np.array(x[3]).reshape(4, 4) for x in held])
            first = np.cumsum([0, *(x[2] for x in held)]).tolist()
            return [(x[0], x[1], first[k], s, t, int(k == len(held) - 1)) for k, (x, (s, t)) in enumerate(zip(held, found))]

        def as_batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), *[pa.int32()] * 3))], ["conv_id", "chunk", "first", "s", "t", "last"])

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    out += settle()
                    held.clear()
                held.append(row)
            if out:
                yield as_batch(out)
        if held:
            yield as_batch(settle())

    states = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(ends, "conv_id long, chunk string, first long, s int, t int, last int")
    states = states.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "first", "s", "t", "last")
    told = rows.join(states, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))

    def traced(held: list[tuple]) -> list[tuple]:
        first, start, end, last = held[0][2:6]
        out = []
        for k, (row, step) in enumerate(zip(held, trace([role_number(x[7]) for x in held], start, end))):
            closing = end_cost(step[1])[1] if last and k == len(held) - 1 else None
            inserted = ",".join(ROLES[r] for r in step[3]) + ("|" + ",".join(ROLES[r] for r in closing) if closing else "")
            out.append((row[0], row[6], first + k, row[7], ROLES[step[1] - 1], step[2], inserted, rendered(step, row[8], first + k == 0, closing)))
        return out

    return by_chunk(told, ["conv_id", "chunk", "first", "s", "t", "last", "turn", "role", "text"], traced, "conv_id long, turn long, place long, role string, new_role string, action string, inserted string, piece string")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


#: By a recursion over the turns: of each state the cheapest way, and of equal ones the one whose choices come first.
OP7_SQL = r"""
WITH RECURSIVE turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n,
  CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE -1 END AS r FROM conversations),
states AS (SELECT unnest(range(0, 4)) AS s), roles AS (SELECT unnest(range(-1, 3)) AS r), names AS (SELECT unnest(range(0, 3)) AS new),
legal AS (SELECT s, r, new, CASE WHEN s = 0 AND new < 2 OR s = 1 AND new = 1 OR s = 2 AND new = 2 OR s = 3 AND new = 1 THEN []::VARCHAR[] WHEN new = 2 THEN ['user'] WHEN s = 2 AND new = 1 THEN ['assistant'] END AS added FROM states, roles, names),
steps AS (SELECT s, r, CASE WHEN new = r THEN 0 ELSE 1 + new END AS nth, (CASE WHEN new = r THEN 0 WHEN r < 0 THEN 0.5 ELSE 3 END + 2 * len(added))::DOUBLE AS cost, new + 1 AS after, CASE WHEN new = r THEN 'keep' ELSE 'relabel' END AS action, added FROM legal WHERE added IS NOT NULL
  UNION ALL SELECT s, r, 9, (1 + CASE WHEN r = s - 1 THEN 0 WHEN r < 0 THEN 0.5 ELSE 3 END)::DOUBLE, s, 'merge', []::VARCHAR[] FROM states, roles WHERE s > 0),
best AS (SELECT DISTINCT conv_id, 0::BIGINT AS place, 0::BIGINT AS state, 0.0::DOUBLE AS cost, []::INTEGER[] AS nths, []::STRUCT(after BIGINT, action VARCHAR, added VARCHAR[])[] AS way FROM turns
  UNION ALL SELECT b.conv_id, b.place + 1, p.after, b.cost + p.cost, list_append(b.nths, p.nth::INTEGER), list_append(b.way, {'after': p.after, 'action': p.action, 'added': p.added})
  FROM best b JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.place = b.place JOIN steps p ON p.s = b.state AND p.r = t.r
  QUALIFY row_number() OVER (PARTITION BY b.conv_id, p.after ORDER BY b.cost + p.cost, list_append(b.nths, p.nth::INTEGER)) = 1),
chosen AS (SELECT b.conv_id, b.way, CASE state WHEN 1 THEN ['user', 'assistant'] WHEN 2 THEN ['assistant'] ELSE []::VARCHAR[] END AS closing
  FROM best b JOIN (SELECT DISTINCT conv_id, n FROM turns) c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.place
  QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, state) = 1),
told AS (SELECT t.*, c.way[place + 1] AS w, CASE WHEN place = n - 1 THEN closing END AS closing FROM turns t JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM t.conv_id)
SELECT conv_id, turn, place, role, ['system', 'user', 'assistant'][w.after] AS new_role, w.action AS action, array_to_string(w.added, ',') || CASE WHEN len(closing) > 0 THEN '|' || array_to_string(closing, ',') ELSE '' END AS inserted,
  CASE WHEN w.action = 'merge' THEN chr(10) || chr(10) || text ELSE CASE WHEN place = 0 THEN '' ELSE chr(10) END || array_to_string(list_transform(w.added, lambda x: '<|' || x || '|>' || chr(10) || chr(10)), '') || '<|' || ['system', 'user', 'assistant'][w.after] || '|>' || chr(10) || text END
  || CASE WHEN closing IS NULL THEN '' ELSE chr(10) || array_to_string(list_transform(closing, lambda x: '<|' || x || '|>' || chr(10) || chr(10)), '') END AS piece
FROM told
"""
