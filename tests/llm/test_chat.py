import itertools
import random

from lectern.llm.queries import QUERIES
from lectern.llm.chat_format import LEGAL, ROLES, START, ChatConfig, _path, _role, format_chats, repairs

CFG = ChatConfig()
SCHEMA = "conv_id long, turn long, role string, text string, cost string"


def cheapest(roles):
    """Least cost over every choice of a role for each turn, merged or not."""
    best = None
    for choice in itertools.product(range(3), repeat=len(roles)):
        for merged in itertools.product((0, 1), repeat=len(roles)):
            state, cost = START, 0
            for given, role, m in zip(roles, choice, merged):
                cost += CFG.relabel[_role(given)][role]
                if m:
                    if state != role + 1:
                        break
                    cost += CFG.merge
                else:
                    path = _path(state, role)
                    if path is None:
                        break
                    cost += CFG.insert * len(path)
                state = role + 1
            else:
                if (state == START or ROLES[state - 1] in CFG.ends) and (best is None or cost < best):
                    best = cost
    return best


def messages(rows):
    """Roles of the messages of rendered rows."""
    text = "".join(r.rendered for r in rows)
    return [p.split("\n", 1)[0] for p in text.split("<|im_start|>")[1:]], text


def legal(roles):
    state = START
    for r in roles:
        if ROLES.index(r) not in LEGAL[state]:
            return False
        state = ROLES.index(r) + 1
    return True


def test_against_all_repairs():
    names = ["system", "user", "assistant", "tool", None, "Human"]
    rng = random.Random(4)
    for n in range(1, 5):
        for roles in ([rng.choice(names) for _ in range(n)] for _ in range(40)):
            assert sum(m[2] for m in repairs([(k, r) for k, r in enumerate(roles)], CFG)) == cheapest(roles), roles


def test_conversations_that_span_partitions(spark):
    rng = random.Random(6)
    names = ["system", "user", "assistant", "assistant", "tool", None]
    rows = [(1, k, rng.choice(names), f"t{k}", "") for k in range(600)]
    rows += [(c, k, rng.choice(names), None if k == 2 else f"c{c} <|im_start|>", "") for c in range(2, 40) for k in range(rng.randrange(1, 8))]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.conv_id, []).append(r)
    for conv, group in by.items():
        group.sort(key=lambda r: r.turn)
        alone = repairs([(r.turn, r.role) for r in group], CFG)
        assert [ROLES[m[1] - 1] for m in alone] == [r.new_role for r in group], conv
        roles, text = messages(group)
        assert legal(roles) and text.endswith("<|im_end|>\n") and text.count("<|im_end|>") == len(roles)


def test_odd_rows(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, 1, "user", "a", ""), (None, 2, "assistant", "b", ""), (5, None, "user", "x" * 200_000, ""), (5, 1, "assistant", "y", ""), (5, 1, "assistant", "y", "")]
    found = format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    alone = [r for r in found if r.conv_id is None]
    assert len(found) == 5 and all(legal(messages([r])[0]) for r in alone)
    assert sorted(r.action for r in found if r.conv_id == 5) == ["keep", "keep", "merge"]


def least(roles):
    """As cheapest, but turn by turn, for conversations of any length."""
    best = {START: 0}
    for given in roles:
        step = {}
        for state, cost in best.items():
            for role in range(3):
                ways = [CFG.merge] if state == role + 1 else []
                ways += [CFG.insert * len(path)] if (path := _path(state, role)) is not None else []
                for way in ways:
                    step[role + 1] = min(step.get(role + 1, 1 << 60), cost + way + CFG.relabel[_role(given)][role])
        best = step
    return min(cost for state, cost in best.items() if state == START or ROLES[state - 1] in CFG.ends)


def test_query_against_brute_force(spark):
    given, found = {}, {}
    for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect():
        given.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    for r in QUERIES["op4_chat_format"](spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r.conv_id, []).append(r)
    assert set(given) == set(found)
    for conv, turns in given.items():
        rows, roles = sorted(found[conv], key=lambda r: (r.turn, r.role or "")), [r for _, r, _ in sorted(turns, key=lambda t: (t[0], t[1] or ""))]
        assert sorted((r.turn, r.role or "") for r in rows) == sorted((t, r or "") for t, r, _ in turns)
        assert sum(r.cost for r in rows) == least(roles)
        if len(roles) < 5:
            assert least(roles) == cheapest(roles)
        names, text = messages(rows)
        assert legal(names) and names[-1] in CFG.ends
        at = 0
        for _, _, body in sorted(turns, key=lambda t: (t[0], t[1] or "")):
            at = text.index((body or "").replace("<|", "< |"), at)


def test_long_conversation_costs_the_least(spark):
    rng = random.Random(8)
    rows = [(1, k, rng.choice(["system", "user", "assistant", "assistant", "tool", None]), f"t{k}", "") for k in range(500)]
    found = format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.cost for r in found) == least([r[2] for r in rows])
