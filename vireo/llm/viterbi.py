"""Cheapest edits that make a conversation's roles read ``(s?(ua)+)?``, by Viterbi over chunks in parallel.

States are what the roles so far allow: nothing yet, after ``s``, after ``u``, after ``a``. Costs go backward: a vector
holds, for each state at a place, the least cost of all that follows. Sequences are cut into chunks of ``LANE`` rows that
run side by side in numpy. A chunk starts from a speculative vector; then it reruns from the vector that the chunk after
it found, until vectors differ only by constants (their ranks have converged), and the constants add up to the cost. A
step maps a vector to minima of sums, so a constant goes through and the fixed point is exact.

Among edits of the least cost, the trace takes the ASCII-least initial at each step (D, I, K, R). In a state, an initial
leads to one state only, so chunks are traced from all states at once and their maps are composed.
"""

from __future__ import annotations

import numpy as np

LANE = 16
START, SYSTEM, USER, ASSISTANT, NONE = range(5)
#: Codes of a row: what its role's initial is, and its faults.
S, U, A, MUST_GO, CUT = 1, 2, 3, 4, 8
DELETE, REROLE, INSERT = 3, 2, 2
#: Costs at the end of a conversation: nothing, two or one missing turns.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int32)
#: Where an added user or assistant leads.
ADDED = np.array([USER, USER, ASSISTANT, USER])
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: By the low three bits of a code and the state: the state after keeping the row, and after giving it another role.
KEPT, REROLED = np.full((8, 4), NONE), np.full((8, 4), NONE)
KEPT[S, START] = SYSTEM
KEPT[U, [START, SYSTEM, ASSISTANT]] = USER
KEPT[A, USER] = ASSISTANT
REROLED[:4] = ADDED
BIG = np.int32(1 << 28)
IDENTITY = np.arange(4)


class Lanes:
    """Rows of several sequences, cut into chunks of at most ``LANE`` rows."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        self.codes, self.n = codes, np.asarray(sizes, np.int64)
        each = -(-self.n // LANE)
        self.sequence = np.repeat(np.arange(len(self.n)), each)
        self.ordinal = np.arange(len(self.sequence)) - np.repeat(np.cumsum(each) - each, each)
        begin = np.cumsum(self.n) - self.n
        self.start = begin[self.sequence] + LANE * self.ordinal
        self.size = np.minimum(LANE, self.n[self.sequence] - LANE * self.ordinal)
        self.last = self.ordinal == each[self.sequence] - 1
        self.each = each

    def at(self, t: int, lanes: np.ndarray) -> np.ndarray:
        return lanes[self.size[lanes] > t]


def _moves(codes: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[rows, 4]: least cost when the row is deleted, kept or given another role, from the costs after it."""
    padded = np.concatenate([after, np.full((len(after), 1), BIG)], axis=1)
    cut = ((codes >> 3) & 1)[:, None].astype(np.int32)
    low = codes & 7
    keep, other = (np.take_along_axis(padded, to[low], 1) for to in (KEPT, REROLED))
    return after + DELETE, keep + cut, other + cut + REROLE


def _before(best: np.ndarray) -> np.ndarray:
    """Costs when turns may be added before the row: at most two, since a third would repeat the first."""
    out = best.copy()
    out[:, USER] = np.minimum(best[:, USER], best[:, ASSISTANT] + INSERT)
    out[:, ASSISTANT] = np.minimum(best[:, ASSISTANT], best[:, USER] + INSERT)
    for state in (START, SYSTEM):
        out[:, state] = np.minimum(best[:, state], out[:, USER] + INSERT)
    return out


def _run(lanes: Lanes, which: np.ndarray, given: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs chunks backward from ``given``; fills ``after`` and returns the vectors at their starts and the constants taken out."""
    now = given[which].copy()
    for t in range(LANE - 1, -1, -1):
        here = np.flatnonzero(lanes.size[which] > t)
        rows = lanes.start[which[here]] + t
        after[rows] = now[here]
        now[here] = _before(np.minimum.reduce(_moves(lanes.codes[rows], now[here])))
    shift = now.min(axis=1) if len(now) else np.zeros(0, np.int32)
    return now - shift[:, None], shift


def backward(lanes: Lanes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Costs after each row (up to a chunk's constant), each sequence's vector at its start, the constant, and the passes.

    ``ends``: for each sequence the vector at its end, its least entry 0.
    """
    n, every = len(lanes.sequence), np.arange(len(lanes.sequence))
    after = np.zeros((len(lanes.codes), 4), np.int32)
    given = np.zeros((n, 4), np.int32)  # speculative, but for the last chunks
    given[lanes.last] = ends[lanes.sequence[lanes.last]]
    found, shift = np.zeros((n, 4), np.int32), np.zeros(n, np.int32)
    rerun, passes = every, 0
    while len(rerun):
        found[rerun], shift[rerun] = _run(lanes, rerun, given, after)
        passes += 1
        inner = every[~lanes.last]
        rerun = inner[(found[inner + 1] != given[inner]).any(axis=1)]
        given[rerun] = found[rerun + 1]
    total = np.bincount(lanes.sequence, weights=shift, minlength=len(lanes.n)).astype(np.int64)
    first = np.array(ends, np.int32)
    first[lanes.sequence[lanes.ordinal == 0]] = found[lanes.ordinal == 0]
    return after, first, total, passes


def choices(codes: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[rows, 4]: turns added before the row, what becomes of it (a byte of D, K, R) and the state after it."""
    gone, keep, other = _moves(codes, after)
    total = _before(np.minimum(np.minimum(gone, keep), other))
    adds = (total != gone) & (total == total[:, ADDED] + INSERT)
    op = np.where(total == gone, ord("D"), np.where(total == keep, ord("K"), ord("R"))).astype(np.uint8)
    low = codes & 7
    then = np.where(op == ord("D"), IDENTITY, np.where(op == ord("K"), KEPT[low], REROLED[low]))
    state, added = np.broadcast_to(IDENTITY, op.shape).copy(), np.zeros(op.shape, np.uint8)
    for _ in range(2):
        more = np.take_along_axis(adds, state, 1)
        added += more
        state = np.where(more, ADDED[state], state)
    return added, np.take_along_axis(op, state, 1), np.take_along_axis(then, state, 1)


def maps(lanes: Lanes, then: np.ndarray) -> np.ndarray:
    """[chunks, 4]: the state at a chunk's end for each state at its start."""
    out, every = np.tile(IDENTITY, (len(lanes.sequence), 1)), np.arange(len(lanes.sequence))
    for t in range(LANE):
        here = lanes.at(t, every)
        out[here] = np.take_along_axis(then[lanes.start[here] + t], out[here], 1)
    return out


def composed(lanes: Lanes, by_chunk: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state at each chunk's start and at each sequence's end; ``entry``: [sequences] states at their starts."""
    at, state = np.zeros(len(by_chunk), np.int64), np.array(entry, np.int64)
    order = np.argsort(lanes.ordinal, kind="stable")
    for chunk in np.split(order, np.flatnonzero(np.diff(lanes.ordinal[order])) + 1) if len(order) else []:
        at[chunk] = state[lanes.sequence[chunk]]
        state[lanes.sequence[chunk]] = by_chunk[chunk, at[chunk]]
    return at, state


def sequence_maps(lanes: Lanes, by_chunk: np.ndarray) -> np.ndarray:
    """[sequences, 4]: the state at a sequence's end for each state at its start."""
    return np.column_stack([composed(lanes, by_chunk, np.full(len(lanes.n), q))[1] for q in IDENTITY])


def trace(lanes: Lanes, after: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row: turns added before it, what becomes of it, the state before both; and each sequence's last state."""
    added, op, then = choices(lanes.codes, after)
    now, out = composed(lanes, maps(lanes, then), entry)
    states, every = np.zeros(len(lanes.codes), np.int64), np.arange(len(lanes.sequence))
    for t in range(LANE):
        here = lanes.at(t, every)
        rows = lanes.start[here] + t
        states[rows] = now[here]
        now[here] = then[rows, now[here]]
    rows = np.arange(len(lanes.codes))
    return added[rows, states], op[rows, states], states, out


def audits(added: np.ndarray, op: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The initials of each sequence's edits."""
    ends = np.cumsum(added.astype(np.int64) + 1)
    text = np.full(int(ends[-1]) if len(ends) else 0, ord("I"), np.uint8)
    text[ends - 1] = op
    whole, cut = text.tobytes().decode(), np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [whole[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def lines(roles: list[str], texts: list[str], added: list[int], op: list[int], states: list[int]) -> list[str]:
    """``role:text`` of the rows that stay and of the turns that are added."""
    out, ahead = [], ADDED.tolist()
    for role, text, more, what, state in zip(roles, texts, added, op, states, strict=True):
        for _ in range(more):
            state = ahead[state]
            out.append(ROLE_OF[state] + ":")
        if what == 75:  # K
            out.append(f"{role}:{text}")
        elif what == 82:  # R
            out.append(f"{ROLE_OF[ahead[state]]}:{text}")
    return out


def missing(state: int) -> list[str]:
    """Turns to add at the end."""
    return {SYSTEM: ["user:", "assistant:"], USER: ["assistant:"]}.get(state, [])
