import itertools
import random
import re

import pytest

from tidewatch.llm import chat

ROLES = ("system", "user", "assistant")


def missing(roles):
    """Least empty turns that make a written sequence legal, or None."""
    body = roles[1:] if roles[0] == "system" else roles
    if "system" in body:
        return None
    count, wanted = 0, "user"
    for role in body:
        count += role != wanted
        wanted = "user" if role == "assistant" else "assistant"
    return count + (2 if not body else wanted == "assistant")


def least_cost(roles):
    """Cheapest repair, by trying every role and every merge for each turn."""
    best = None
    for new in itertools.product(ROLES, repeat=len(roles)):
        named = sum(0 if a == b else chat.RELABEL if a in ROLES else chat.NAME for a, b in zip(roles, new, strict=True))
        for merges in itertools.product((False, True), repeat=len(roles) - 1):
            if any(m and new[i] != new[i + 1] for i, m in enumerate(merges)):
                continue
            left = [new[0], *(new[i + 1] for i, m in enumerate(merges) if not m)]
            if (gap := missing(left)) is not None:
                cost = named + chat.MERGE * sum(merges) + chat.INSERT * gap
                best = cost if best is None else min(best, cost)
    return best


def spent(rows):
    cost = 0
    for r in rows:
        role = (r.role or "").strip().lower()
        cost += chat.MERGE * ("merge" in r.action) + chat.INSERT * len(r.inserted)
        cost += (chat.RELABEL if role in ROLES else chat.NAME) * ("relabel" in r.action)
    return cost


def by_conversation(out):
    found = {}
    for r in sorted(out, key=lambda r: r.place):
        found.setdefault(r.conv, []).append(r)
    return found


def written(rows):
    return [x for x in re.findall(r"<\|(\w+)\|>\n", "".join(r.piece for r in rows)) if x in ROLES]


def test_cost_is_least_and_result_legal(spark):
    rng = random.Random(3)
    turns, roles = [], {}
    for c in range(120):
        roles[c] = [rng.choice([*ROLES, "tool", None, " USER "]) for _ in range(rng.randrange(1, 6))]
        turns += [(c, t, r, f"text {c} {t}", "x") for t, r in enumerate(roles[c])]
    rng.shuffle(turns)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, place string").repartition(5)
    found = by_conversation(chat.repair(df).collect())
    assert found.keys() == roles.keys()
    for c, rows in found.items():
        plain = [r.strip().lower() if r else None for r in roles[c]]
        assert spent(rows) == least_cost(plain), plain
        assert missing(written(rows)) == 0
        text = "".join(r.piece for r in rows)
        assert [m for m in re.findall(r"text \d+ \d+", text)] == [f"text {c} {t}" for t in range(len(plain))]
        assert text.endswith("<|end|>\n")


def test_a_long_conversation_does_not_depend_on_partitions(spark):
    rng = random.Random(8)
    turns = [(1, t, rng.choice([*ROLES, None]), f"t{t}", 0) for t in range(3000)] + [(0, 0, "user", "a", 0), (2, 0, "assistant", "b", 0)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, x int")
    several = chat.repair(df).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = chat.repair(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    a, b = by_conversation(several), by_conversation(one)
    assert [(r.turn, r.new_role, r.action, r.inserted, r.piece) for r in a[1]] == [(r.turn, r.new_role, r.action, r.inserted, r.piece) for r in b[1]]
    assert all(missing(written(rows)) == 0 for rows in a.values())


@pytest.mark.parametrize("rows", [[], [(None, None, None, None), (None, 1, "user", ""), (5, 1, "user", "same"), (5, 1, "user", "same"), (6, 0, "system", "z" * 100_000)]])
def test_nulls_repeats_and_nothing(spark, rows):
    found = by_conversation(chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert sum(map(len, found.values())) == len(rows)
    assert all(missing(written(r)) == 0 for r in found.values())
