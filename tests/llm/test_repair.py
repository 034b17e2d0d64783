import hashlib
import random
import zlib
from functools import cache

import numpy as np
import pytest

BLANKS = " \t\n\x0b\x0c\r"
ADD = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def least(rows):
    """(cost, audit, lines) over all edits of (initial, role, text, must go, truncated)."""

    @cache
    def best(i, state):
        out = []
        if i == len(rows) and state in ("", "a"):
            return 0, "", ()
        if i < len(rows):
            initial, role, text, must, cut = rows[i]
            c, a, said = best(i + 1, state)
            out.append((c + 3, "D" + a, said))
            if not must:
                if (initial == "s" and state == "") or (initial == "u" and state != "u") or (initial == "a" and state == "u"):
                    c, a, said = best(i + 1, initial)
                    out.append((c + cut, "K" + a, (f"{role}:{text}", *said)))
                c, a, said = best(i + 1, ADD[state])
                out.append((c + cut + 2, "R" + a, (f"{NAME[ADD[state]]}:{text}", *said)))
        if not (state == "a" and i == len(rows)):
            out += [added(i, state, 2)] if i == len(rows) else [added(i, state, k) for k in (1, 2)]
        return min(o for o in out if o is not None)

    def added(i, state, most):
        """One or more added turns, then anything but another."""
        said, audit = [], ""
        found = []
        for _ in range(most):
            state = ADD[state]
            said, audit = [*said, NAME[state] + ":"], audit + "I"
            if i == len(rows):
                if state == "a":
                    found.append((2 * len(audit), audit, tuple(said)))
            else:
                initial, role, text, must, cut = rows[i]
                c, a, s = best(i + 1, state)
                found.append((2 * len(audit) + c + 3, audit + "D" + a, (*said, *s)))
                if not must:
                    if (initial == "u" and state != "u") or (initial == "a" and state == "u"):
                        c, a, s = best(i + 1, initial)
                        found.append((2 * len(audit) + c + cut, audit + "K" + a, (*said, f"{role}:{text}", *s)))
                    c, a, s = best(i + 1, ADD[state])
                    found.append((2 * len(audit) + c + cut + 2, audit + "R" + a, (*said, f"{NAME[ADD[state]]}:{text}", *s)))
        return min(found, default=None)

    return best(0, "")


def expected(table):
    """Rows of (conv_id, turn, role, text), with the contract written out."""
    import xxhash

    tie = lambda t: (h := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (1 << 64) * (h >> 63)
    out = {i: [] for i, *_ in table}
    for i, turn, role, text in table:
        kind = zlib.crc32(f"{' ' if i is None else i}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = text.translate(dict.fromkeys(map(ord, ".!?")))
        elif kind == 4:
            role = "user"
        out[i] += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    for i, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], tie(r[2])))
        seen, coded, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            fault = "blank" if not text.strip(BLANKS) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(BLANKS)[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            coded.append((role[:1], role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:], strict=False))
        turns = [t for t, *_ in rows if t is not None]
        cost, audit, said = least(coded)
        yield i, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def made(n, conversations, seed=0):
    rng = random.Random(seed)
    say = ["Hello there.", "hello there", "", " \n", "What is this?", "No", "Yes!", "it goes on ", "ünï.", None]
    rows = []
    for _ in range(n):
        rows.append((rng.choice(conversations), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle"]), rng.choice(say) if rng.random() < 0.6 else f"line {rng.random()}."))
    return rows


def sort_key(r):
    return (r[0] is not None, r[0] or 0)


def test_lanes_equal_brute_force():
    from vireo.llm import viterbi

    rng = random.Random(3)
    sizes = [0, 1, 2, 15, 16, 17, 33, 70, 0, 5]
    codes = [[rng.choice([0, 1, 2, 3, 2, 3, 2 | 4, 3 | 8, 2 | 8]) for _ in range(n)] for n in sizes]
    lanes = viterbi.Lanes(np.array(sum(codes, []), np.uint8), np.array(sizes))
    after, first, total, passes = viterbi.backward(lanes, np.tile(viterbi.END, (len(sizes), 1)))
    added, op, states, last = viterbi.trace(lanes, after, np.zeros(len(sizes), np.int64))
    got = viterbi.audits(added, op, np.array(sizes))
    assert 2 <= passes <= 4  # ranks converge
    for k, c in enumerate(codes):
        cost, audit, _ = least([(" sua"[x & 3], "", "", bool(x & 4), x >> 3 & 1) for x in c])
        assert (int(total[k] + first[k, 0]), got[k] + "I" * len(viterbi.missing(int(last[k])))) == (cost, audit)


@pytest.mark.parametrize("piece", [None, 5])
def test_repair(spark, monkeypatch, piece):
    """Null ids, turns, roles and texts, ties, repeats, one conversation with most rows; pieces small enough to be many."""
    from vireo.llm import repair

    if piece:
        monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    rows = made(160, [1, 2, 3, None, 5]) + made(150, [7], 1) + [(8, 0, "user", "x")] * 3 + [(9, t, "user", "same text") for t in range(40)]
    rows += [(40, 9, "user", "gone")]  # crc32("40:9") % 20 == 0 is checked below
    df = spark.createDataFrame([(*r, "z", "en") for r in rows], "conv_id long, turn long, role string, text string, c string, gone string").repartition(3)
    got = [tuple(r) for r in repair.repaired(repair.damaged(df)).collect()]
    assert sorted(got, key=sort_key) == sorted(expected(rows), key=sort_key)
    assert repair.repaired(repair.damaged(df.limit(0))).count() == 0


def test_conversation_without_rows(spark):
    from vireo.llm import repair

    gone = next((c, t) for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*gone, "user", "x")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.repaired(repair.damaged(df)).collect()] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_whole_table(spark, sf, same):
    from vireo.llm import repair

    same(repair.op11_rank_convergence, repair.OP11_SQL)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in repair.op11_rank_convergence(spark, sf).collect()]
    assert sorted(got, key=sort_key) == sorted(expected(rows), key=sort_key)
