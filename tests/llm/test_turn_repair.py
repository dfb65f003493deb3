import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from vellumspark.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, kind string, dropped int"
SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """The contract turn by turn, by recursion."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept.extend([(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1))
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in kept:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))

        @lru_cache(None)
        def best(i, state, inserts=0):
            found = []
            if i == len(kept) and state in "-a":
                found.append((0, "", ()))
            new = "a" if state == "u" else "u"
            if inserts < 3:
                c, a, lines = best(i, new, inserts + 1)
                found.append((c + 5, "I" + a, (("user" if new == "u" else "assistant") + ":",) + lines))
            if i < len(kept):
                c, a, lines = best(i + 1, state)
                found.append((c + 2, "D" + a, lines))
                if faults[i] not in ("blank", "duplicate"):
                    pay, (_, role, text) = 5 * (faults[i] == "truncated"), kept[i]
                    c, a, lines = best(i + 1, new)
                    found.append((c + 1 + pay, "R" + a, (("user" if new == "u" else "assistant") + ":" + text,) + lines))
                    if role[:1] == new or (state == "-" and role[:1] == "s"):
                        c, a, lines = best(i + 1, role[0])
                        found.append((c + pay, "K" + a, (role + ":" + text,) + lines))
            return min(found, default=(10**9, "", ()))

        cost, audit, lines = best(0, "-")
        turns = [t for t, _, _ in kept if t is not None]
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def invented(seed, convs, longest):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.integers(1, longest)):
            role = rng.choice(["user", "assistant", "system", "tool", "User", "usher", "", None], p=[0.35, 0.35, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])
            text = rng.choice(["Yes.", "no", "Why? \n", "", " \x0b", "é!", "a ", None, "so\tit is", "."])
            rows.append((None if c == 3 else c, None if rng.random() < 0.05 else int(t + (rng.random() < 0.1) * 3), role, text))
    return rows


def run(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = turn_repair.repair(docs, **how)
    assert ", ".join(f"{c} {t}" for c, t in out.dtypes) == turn_repair.SCHEMA.replace(" long", " bigint")
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_recursion(spark, seed):
    rows = invented(seed, 400, 12)
    assert run(spark, rows) == plain(rows)


def test_long_conversations_in_pieces(spark):
    rows = invented(7, 12, 60)
    assert run(spark, rows, long=8) == plain(rows)


def test_long_and_dropped(spark):
    dropped = [c for c in range(3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = [(c, 0, "user", "Hm.") for c in dropped] + [(77, t, "user" if t % 2 == 0 else "assistant", "Said %d." % t) for t in range(120)]
    assert run(spark, rows, long=16) == plain(rows) and run(spark, rows) == plain(rows)
    empty = next(r for r in plain(rows) if r[0] == dropped[0])
    assert empty[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_empty_table_and_very_long_text(spark):
    assert run(spark, []) == []
    rows = [(1, 0, "user", "long " * 400_000 + "?"), (1, 1, "assistant", " " * 1_000_000 + "end")]
    assert run(spark, rows) == plain(rows)


def test_whole_query(spark):
    import duckdb

    from vellumspark.llm import queries

    rows = duckdb.sql("SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.001/conversations.parquet'").fetchall()
    out = queries.queries()["op11_conversation_repair"](spark, "/root/testdata/sf0.001")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain(rows)
