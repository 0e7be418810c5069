import functools
import hashlib
import random
import re
import zlib

import pytest

from geoloom.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, cost string, copies string"
SHAPE = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        yield from [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def fault_list(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(rows, faults):
    """(cost, edits, turns): the least over all edit strings whose roles have the right shape, by plain search."""

    @functools.cache
    def go(i, made):
        found = []
        if i == len(rows) and SHAPE.fullmatch(made):
            found.append((0, "", ()))
        usable = lambda m: any(SHAPE.fullmatch(m + more) for more in ("", "a", "ua"))
        tail = lambda m: m if len(m) < 4 else m[:1].replace("a", "").replace("u", "") + "uaua"[:2] + m[-1:].replace("a", "") if m[0] == "s" else "uau"[: 2 + (m[-1] == "u")]  # noqa: E731  as good as the whole

        def way(cost, edit, j, more, turn):
            m = made + more
            if usable(m) and (rest := go_bounded(j, tail(m))) is not None:
                found.append((cost + rest[0], edit + rest[1], turn + rest[2]))

        if i < len(rows):
            _, _, role, text = rows[i]
            way(3, "D", i + 1, "", ())
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if role[:1] in ("s", "u", "a"):
                    way(extra, "K", i + 1, role[:1], ((role, text),))
                for r in ("user", "assistant"):
                    way(2 + extra, "R", i + 1, r[0], ((r, text),))
        for r in ("user", "assistant"):
            if inserts.get(i, 0) < 3:
                inserts[i] = inserts.get(i, 0) + 1
                way(2, "I", i, r[0], ((r, ""),))
                inserts[i] -= 1
        return min(found, default=None)

    inserts: dict[int, int] = {}

    def go_bounded(i, made):
        return go.__wrapped__(i, made) if inserts.get(i, 0) else go(i, made)

    return go(0, "")


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(damaged([r for r in rows if r[0] == conv]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:16], hashlib.sha256(r[3].encode()).digest()))
        faults = fault_list(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, edits, left = best(tuple(own), tuple(faults))
        text = "\n".join(f"{r}:{t}" for r, t in left)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest())
    return out


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {r[0]: tuple(r)[1:] for r in conversations.repair_summaries(conversations.damage_turns(df)).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_same_as_search(spark, seed):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "u", "tool", "", None, "User", "aide"]
    texts = ["Well.", "No", "", None, " \t", "Why? \n", "What!", "ok ok", "é…", "Well. ", "long " * 50 + "."]
    rows = []
    for conv in [*range(40), None]:
        ordered = rnd.random() < 0.5
        for k in range(rnd.randrange(1, 6)):
            role = ["user", "assistant"][k % 2] if ordered and rnd.random() < 0.8 else rnd.choice(roles)
            rows.append((conv, rnd.choice([k, k, k, k + 3, None, -k]), role, rnd.choice(texts)))
    rnd.shuffle(rows)
    assert result(spark, rows) == expected(rows)


def test_everything_dropped_and_empty(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert result(spark, [(7, dropped, "user", "Hi.")]) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert result(spark, []) == {}


def test_turns_have_the_shape_and_the_digest(spark):
    df = queries.table(spark, "/root/testdata/sf0.01", "conversations")
    hurt = conversations.damage_turns(df)
    found = {}
    for r in conversations.repair_turns(hurt).collect():
        found.setdefault(r.conv_id, []).append(r)
    for r in conversations.repair_summaries(hurt).collect():
        own = sorted(found.get(r.conv_id, []), key=lambda x: x.position)
        assert [x.position for x in own] == list(range(len(own)))
        assert SHAPE.fullmatch("".join(x.role[0] for x in own))
        assert r.audit.replace("D", "") == "".join(x.edit for x in own)
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest() == r.repaired_sha256


def test_very_long_conversation_and_text(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], f"Turn {k}." if k != 7 else "word " * 400_000 + ".") for k in range(20_000)]
    got = result(spark, turns)[1]
    costs = conversations.Costs()
    own = list(damaged(turns))
    faults = fault_list(own)
    assert got[1:4] == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    assert len(costs.vectors) < 100 and len(got[6].replace("I", "")) == len(own)
    assert got[5] == sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] for e in got[6]) + sum(e != "D" and f == "truncated" for e, f in zip(got[6].replace("I", ""), faults))
