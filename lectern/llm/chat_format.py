"""Chat transcripts made legal at the least cost, by dynamic programming over an automaton of legal turns, and rendered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import checkpointed

ROLES = ("system", "user", "assistant")
START = 0
#: State 0 is before any message; state r + 1 is after a message of role r.
LEGAL = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}
STATES = tuple(LEGAL)

#: Other names that are in use for the three roles.
ALIASES = {
    "system": 0, "developer": 0, "instruction": 0,
    "user": 1, "human": 1, "prompter": 1, "customer": 1,
    "assistant": 2, "gpt": 2, "bot": 2, "model": 2, "ai": 2, "chatbot": 2,
}


@dataclass(frozen=True)
class ChatConfig:
    """Costs of the repairs. relabel[given][taken]; the last row is for a role that is unknown or null.

    ends: roles with which a conversation may end.
    """

    merge: int = 10
    insert: int = 15
    relabel: tuple[tuple[int, int, int], ...] = field(default=((0, 12, 22), (32, 0, 24), (34, 26, 0), (14, 4, 6)))
    ends: tuple[str, ...] = ("user", "assistant")


def _path(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty messages after which role is legal in state; None if no number of them makes it so."""
    if role in LEGAL[state]:
        return ()
    for r in LEGAL[state]:
        if r > 0 and role in LEGAL[r + 1]:
            return (r,)
    return None


def _moves(cfg: ChatConfig) -> list[list[tuple[int, int, int, int, tuple[int, ...]]]]:
    """For each given role: (state, next state, cost, merged, roles inserted before) of every repair."""
    out = []
    for given in range(4):
        found = []
        for state in STATES:
            for role in range(3):
                cost = cfg.relabel[given][role]
                if state == role + 1:
                    found.append((state, role + 1, cost + cfg.merge, 1, ()))
                if (path := _path(state, role)) is not None:
                    found.append((state, role + 1, cost + cfg.insert * len(path), 0, path))
        out.append(found)
    return out


def _role(name: str | None) -> int:
    return ALIASES.get((name or "").strip().lower(), 3)


def _forward(values: dict[int, tuple[int, int]], moves: list, tie: bytes) -> tuple[dict, dict]:
    """One turn on: least (cost, tie value) of each state reached, and the move that led there.

    The tie value is a sum of hashes of turn and move, so that of two equally cheap repairs the same one is
    taken wherever a long conversation is cut.
    """
    best: dict[int, tuple[int, int]] = {}
    by: dict[int, tuple] = {}
    for k, move in enumerate(moves):
        if move[0] in values:
            cost, spread = values[move[0]]
            new = (cost + move[2], spread + (xxhash.xxh3_64_intdigest(tie, k) >> 24 if move[2] else 0))
            if move[1] not in best or new < best[move[1]]:
                best[move[1]], by[move[1]] = new, move
    return best, by


def _tie(turn: int | None, role: str | None) -> bytes:
    return f"{turn}:{role}".encode()


def repairs(turns: list[tuple[int | None, str | None]], cfg: ChatConfig, entry: int = START, leave: int | None = None) -> list[tuple]:
    """The moves of the cheapest legal reading of turns (turn, role), from state entry to state leave or any that may end."""
    moves, values, trail = _moves(cfg), {entry: (0, 0)}, []
    for turn, role in turns:
        values, by = _forward(values, moves[_role(role)], _tie(turn, role))
        trail.append(by)
    ends = [leave] if leave is not None else [s for s in values if s == START or ROLES[s - 1] in cfg.ends]
    state = min(ends, key=lambda s: (values[s], s))
    out = []
    for by in reversed(trail):
        move = by[state]
        out.append(move)
        state = move[0]
    return out[::-1]


def _escaped(text: str) -> str:
    return text.replace("<|", "< |")


def _opened(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


_CLOSED = "<|im_end|>\n"
_OUT = "conv_id long, turn long, role string, new_role string, action string, starts_message boolean, cost long, rendered string"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()]


def _rendered(conv: int | None, rows: list[tuple], found: list[tuple], last: bool) -> Iterator[tuple]:
    for k, ((turn, role, text), (state, after, cost, merged, inserted)) in enumerate(zip(rows, found)):
        done = [name for name, on in (("relabel", _role(role) != after - 1), ("merge", merged), ("insert", inserted)) if on]
        piece = "\n\n" if merged else ("" if state == START else _CLOSED) + "".join(_opened(r) + _CLOSED for r in inserted) + _opened(after - 1)
        piece += _escaped(text or "")
        if last and k == len(rows) - 1:
            piece += _CLOSED
        yield conv, turn, role, ROLES[after - 1], "+".join(done) or "keep", not merged, cost, piece


def format_chats(turns: DataFrame, cfg: ChatConfig = ChatConfig()) -> DataFrame:
    """turns (conv_id, turn, role, text) with new_role, action, cost and the rendered piece, in which the pieces of a
    conversation in the order of turns are its whole transcript.

    Turns are dealt by range of (conv_id, turn), so a conversation of any length spreads over tasks. Only a task's
    first and last conversation can go on in another; for these, a first pass sums a table of least costs from each
    state to each state. The driver joins those tables, two for each task at most, and so finds in which state each
    part begins and ends. The second pass repairs and renders every part by itself; a task holds one part at a time.

    Defined cases: a null or unknown role is relabelled at a cost of its own; null text is empty; turns are ordered
    by turn (null first), role and a hash of the text, repeated rows included; of equally cheap repairs a hash of turn and
    role decides; a row with null conv_id is a conversation of its own;
    other columns are ignored; an empty table gives no rows.
    """
    spark = turns.sparkSession
    cols = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    keys = ["conv_id", "turn", "role", "h"]
    ordered = cols.withColumn("h", F.xxhash64("text")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = checkpointed(ordered.withColumn("part", F.spark_partition_id()).select("part", "conv_id", "turn", "role", "text"))
    moves = _moves(cfg)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = now = None
        for batch in batches:
            for part, conv, turn, role in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if now is None or conv is None or conv != now[1]:
                    first = first or now
                    now = [part, conv, {s: {s: (0, 0)} for s in STATES}]
                now[2] = {s: _forward(v, moves[_role(role)], _tie(turn, role))[0] for s, v in now[2].items()}
        rows = [(p, c, a, b, v[0], str(v[1]), k) for k, x in enumerate([first, now]) if x for p, c, t in [x] for a, to in t.items() for b, v in to.items()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32()))]
        if rows:
            yield pa.RecordBatch.from_arrays(columns, ["part", "conv_id", "a", "b", "cost", "spread", "k"])

    chains: dict[int, dict[tuple[int, int], dict]] = {}
    found = ordered.select("part", "conv_id", "turn", "role").mapInArrow(borders, "part int, conv_id long, a int, b int, cost long, spread string, k int")
    for r in found.where("conv_id is not null").collect():  # at most two conversations for each partition, sixteen rows each
        chains.setdefault(r.conv_id, {}).setdefault((r.part, r.k), {})[r.a, r.b] = (r.cost, int(r.spread))
    fixed = {key: ends for conv, parts in chains.items() if len(parts) > 1 for key, ends in _joined(conv, parts, cfg).items()}
    held = spark.sparkContext.broadcast(fixed)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def flush() -> list[tuple]:
            entry, leave, last = held.value.get(now, (START, None, True)) if now[1] is not None else (START, None, True)
            return list(_rendered(now[1], rows, repairs([r[:2] for r in rows], cfg, entry, leave), last))

        for batch in batches:
            for part, conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and (conv is None or now != (part, conv)):
                    out += flush()
                    rows = []
                now = (part, conv)
                rows.append((turn, role, text))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], [x.split()[0] for x in _OUT.split(", ")])
                out = []
        if now is not None:
            out += flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], [x.split()[0] for x in _OUT.split(", ")])

    return ordered.mapInArrow(render, _OUT)


def _joined(conv: int, parts: dict, cfg: ChatConfig) -> dict:
    """(part, conv) -> (state at its begin, state at its end, whether it is the conversation's last)."""
    values, trail = {START: (0, 0)}, []
    for key in sorted(parts):
        step: dict[int, tuple] = {}
        for (a, b), (cost, spread) in parts[key].items():
            if a in values:
                new = (values[a][0] + cost, values[a][1] + spread)
                if b not in step or (new, a) < step[b]:
                    step[b] = (new, a)
        values = {b: v for b, (v, _) in step.items()}
        trail.append((key, {b: a for b, (_, a) in step.items()}))
    ends = [s for s in values if s == START or ROLES[s - 1] in cfg.ends]
    state, out = min(ends, key=lambda s: (values[s], s)), {}
    for n, (key, back) in enumerate(reversed(trail)):
        out[key[0], conv] = (back[state], state, n == 0)
        state = back[state]
    return out
