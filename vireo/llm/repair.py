"""Conversation structure repair: faults, the cheapest edits and the repaired text of every conversation.

Rows are dealt by ranges of (conversation, turn), so a conversation of any size is spread over tasks. What lies whole
inside a task is finished there; a conversation that may go on in another task, or that exceeds ``PIECE``, leaves pieces
of bounded size. Pieces are chunks of the same Viterbi as in ``viterbi``: each starts from a speculative cost vector,
fix-up passes rerun those whose successor found another one, and the trace composes maps of states. Only slim rows of
pieces meet by conversation; the digest of the repaired text reads the pieces in order, as a digest must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import viterbi
from .common import BLANKS, forget, settled, table

#: Rows and bytes of text of a piece; conversations that are solved together.
PIECE_ROWS, PIECE = 1 << 16, 4 << 20
BATCH_ROWS = 1 << 15
INITIALS = {"s": viterbi.S, "u": viterbi.U, "a": viterbi.A}
GOOD_PAIRS = {"su", "ua", "au"}
BLANK, DUPLICATE = 16, 32
RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_WHOLE = "c string, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = "part int, seq int, roles array<string>, texts array<string>, codes binary, keys array<binary>, turns array<long>, different long, illegal_in long"


def damaged(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and ``gone``, after the damage that crc32 of ``conv_id:turn`` modulo 20 decides.

    0 drops the row (it stays as ``gone``, so that its conversation is known), 1 empties its text, 2 removes its end
    marks, 3 repeats it, 4 makes its role user. Nulls count as one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = df.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    d = d.withColumn("kind", kind)
    hurt = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 3, 1).otherwise(0)))
    return d.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


class _Run:
    """Rows of one conversation in a task, in order: faults by row, and what must be known across pieces."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.seen, self.open, self.seq = conv_id, set(), False, 0
        self.clear()

    def clear(self) -> None:
        self.roles, self.texts, self.codes, self.keys, self.turns = [], [], bytearray(), [], []
        self.different, self.bytes, self.illegal = 0, 0, 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        code, key = INITIALS.get(role[:1], 0), None
        shown = text.rstrip(BLANKS)
        if not shown:
            code |= BLANK | viterbi.MUST_GO
        else:
            key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            if key in self.seen:
                code, key = code | DUPLICATE | viterbi.MUST_GO, None
            else:
                self.seen.add(key)
                if shown[-1] not in ".!?":
                    code |= viterbi.CUT
        if self.roles and self.roles[-1][:1] + role[:1] not in GOOD_PAIRS:
            self.illegal += 1
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.different += 1
            self.turns = [self.turns[0] if self.turns else turn, turn]
        self.roles.append(role)
        self.texts.append(text)
        self.codes.append(code)
        self.keys.append(key)
        self.bytes += len(role) + len(text) + 64

    def counts(self) -> dict[str, int]:
        codes = np.frombuffer(bytes(self.codes), np.uint8)
        gaps = self.turns[1] - self.turns[0] + 1 - self.different if self.turns else 0
        return _faults(codes) | {"gaps": gaps, "illegal": self.illegal}

    def piece(self, part: int) -> dict:
        out = {
            "conv_id": self.conv_id, "part": part, "seq": self.seq, "roles": self.roles, "texts": self.texts, "codes": bytes(self.codes), "keys": self.keys, "turns": self.turns,
            "different": self.different, "illegal_in": self.illegal,
        }
        self.seq += 1
        self.clear()
        return out


def _faults(codes: np.ndarray) -> dict[str, int]:
    return {name: int(np.count_nonzero(codes & bit)) for name, bit in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", viterbi.CUT))}


def _key(conv_id: int | None) -> str:
    """A conversation's name in joins, where null ids must meet."""
    return "" if conv_id is None else str(conv_id)


def _solved(runs: list[_Run]) -> list[dict]:
    """Results of whole conversations, all at once."""
    sizes = np.array([len(r.codes) for r in runs], np.int64)
    lanes = viterbi.Lanes(np.frombuffer(b"".join(bytes(r.codes) for r in runs), np.uint8), sizes)
    after, first, total, _ = viterbi.backward(lanes, np.tile(viterbi.END, (len(runs), 1)))
    added, op, states, last = viterbi.trace(lanes, after, np.zeros(len(runs), np.int64))
    words, out, at = viterbi.audits(added, op, sizes), [], 0
    added, op, states = added.tolist(), op.tolist(), states.tolist()
    for k, r in enumerate(runs):
        end = at + len(r.codes)
        rest = viterbi.missing(int(last[k]))
        lines = viterbi.lines(r.roles, r.texts, added[at:end], op[at:end], states[at:end]) + rest
        out.append({
            "conv_id": r.conv_id, **r.counts(), "cost": int(total[k] + first[k, viterbi.START]), "audit": words[k] + "I" * len(rest),
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        })
        at = end
    return out


def _first_pass(ordered: DataFrame) -> DataFrame:
    """Whole conversations with their results, and pieces of the others (``audit`` is null)."""
    schema = f"{_WHOLE}, {_PIECE}"
    names = [c.strip().split(" ")[0] for c in schema.replace("array<", "array ").split(", ")]

    def rows(found: list[dict]) -> pa.RecordBatch:
        kinds = {"c": pa.string(), "conv_id": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string(), "part": pa.int32(), "seq": pa.int32(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())}
        kinds |= {"codes": pa.binary(), "keys": pa.list_(pa.binary()), "turns": pa.list_(pa.int64())}
        fields = [pa.field(n, kinds.get(n, pa.int64())) for n in names]
        return pa.RecordBatch.from_pylist([{"c": _key(r["conv_id"]), **r} for r in found], pa.schema(fields))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, first, done, held = TaskContext.get().partitionId(), None, True, [], 0
        for batch in batches:
            for conv_id, turn, role, text, gone in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")), strict=True):
                if run is None or conv_id != run.conv_id:
                    if run is not None:
                        if first or run.open:
                            yield rows([run.piece(part)])
                        else:
                            done.append(run)
                            held += len(run.codes) + 1
                        first = False
                    if held >= BATCH_ROWS:
                        yield rows(_solved(done))
                        done, held = [], 0
                    run = _Run(conv_id)
                if not gone:
                    run.add(turn, role, text)
                    if len(run.codes) >= PIECE_ROWS or run.bytes >= PIECE:
                        run.open = True
                        yield rows([run.piece(part)])
        if run is not None:
            yield rows([run.piece(part)])
        if done:
            yield rows(_solved(done))

    return ordered.mapInArrow(read, schema)


PLACE = ["c", "part", "seq"]


def _faulted(pieces: DataFrame) -> DataFrame:
    """Pieces with codes that know of rows seen in earlier tasks."""
    keys = pieces.select(*PLACE, F.posexplode("keys").alias("row", "key")).where("key IS NOT NULL")
    first = F.min(F.struct("part", "seq")).over(Window.partitionBy("c", "key"))
    again = keys.withColumn("first", first).where(F.struct("part", "seq") > F.col("first")).groupBy(*PLACE).agg(F.collect_list("row").alias("again"))  # of one piece
    joined = pieces.select(*PLACE, "codes").join(again, PLACE, "left")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, again in zip(batch.column("codes").to_pylist(), batch.column("again").to_pylist(), strict=True):
                now = np.frombuffer(codes, np.uint8).copy()
                now[again or []] = now[again or []] & ~np.uint8(viterbi.CUT) | np.uint8(DUPLICATE | viterbi.MUST_GO)
                out.append(now.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PLACE), pa.array(out, pa.binary())], names=[*PLACE, "codes"])

    return settled(joined.mapInArrow(mark, "c string, part int, seq int, codes binary"), "repair-codes")


def _lanes_of(codes: list[bytes]) -> viterbi.Lanes:
    return viterbi.Lanes(np.frombuffer(b"".join(codes), np.uint8), np.array([len(c) for c in codes], np.int64))


def _vectors(run_on: DataFrame) -> DataFrame:
    """Runs pieces backward from ``given``: the vector at their start and the constant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = np.array(batch.column("given").to_pylist(), np.int32).reshape(-1, 4)
            _, start, shift, _ = viterbi.backward(_lanes_of(batch.column("codes").to_pylist()), given)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*PLACE, "given")), pa.array(start.tolist(), pa.list_(pa.int32())), pa.array(shift)], names=[*PLACE, "given", "start", "shift"])

    return run_on.select(*PLACE, "given", "codes").mapInArrow(run, "c string, part int, seq int, given array<int>, start array<int>, shift long")


def _array(values) -> Column:
    return F.array(*(F.lit(int(v)) for v in values))


def fixed_up(codes: DataFrame) -> tuple[DataFrame, int]:
    """Every piece's vector at its end (``given``) and start, and the constant; and how many passes it took.

    A pass reruns the pieces whose successor found a vector that differs by more than a constant from the one they
    were run from.
    """
    in_order = Window.partitionBy("c").orderBy("part", "seq")
    guess = F.when(F.lead("seq").over(in_order).isNull(), _array(viterbi.END)).otherwise(_array([0] * 4))
    state, passes = settled(_vectors(codes.withColumn("given", guess)), "repair-vectors"), 1
    while True:
        wanted = state.withColumn("want", F.coalesce(F.lead("start").over(in_order), _array(viterbi.END)))
        due = wanted.where("want != given").select(*PLACE, F.col("want").alias("given"))
        if due.isEmpty():
            return state, passes
        again = _vectors(codes.join(due, PLACE))
        now = settled(state.join(due.select(*PLACE), PLACE, "left_anti").unionByName(again), "repair-vectors")
        forget(state)
        state, passes = now, passes + 1


def _entered(solved: DataFrame) -> DataFrame:
    """The state at each piece's start: maps of states are composed along the conversation, slim rows in order."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = _lanes_of(batch.column("codes").to_pylist())
            after, *_ = viterbi.backward(lanes, np.array(batch.column("given").to_pylist(), np.int32).reshape(-1, 4))
            found = viterbi.sequence_maps(lanes, viterbi.maps(lanes, viterbi.choices(lanes.codes, after)[2]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PLACE), pa.array(found.tolist(), pa.list_(pa.int32()))], names=[*PLACE, "map"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, viterbi.START
        for batch in batches:
            entry = []
            for c, to in zip(batch.column("c").to_pylist(), batch.column("map").to_pylist(), strict=True):
                state = viterbi.START if c != name else state
                name = c
                entry.append(state)
                state = to[state]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PLACE), pa.array(entry, pa.int32())], names=[*PLACE, "entry"])

    slim = solved.select(*PLACE, "codes", "given").mapInArrow(maps, "c string, part int, seq int, map array<int>")
    return slim.repartition("c").sortWithinPartitions(*PLACE).mapInArrow(walk, "c string, part int, seq int, entry int")


def _traced(pieces: DataFrame, solved: DataFrame, entries: DataFrame) -> DataFrame:
    """Each piece's edits and repaired lines, and the state after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lanes = _lanes_of([r["codes"]])
                after, *_ = viterbi.backward(lanes, np.array([r["given"]], np.int32))
                added, op, states, last = viterbi.trace(lanes, after, np.array([r["entry"]]))
                lines = viterbi.lines(r["roles"], r["texts"], added.tolist(), op.tolist(), states.tolist())
                out = {"c": r["c"], "part": r["part"], "seq": r["seq"], "edits": viterbi.audits(added, op, lanes.n)[0], "lines": len(lines), "repaired": "\n".join(lines), "last": int(last[0])}
                yield pa.RecordBatch.from_pylist([out | _faults(lanes.codes)], kinds)

    kinds = pa.schema([(n, pa.string() if n in ("c", "edits", "repaired") else pa.int32() if n in ("part", "seq") else pa.int64()) for n in (*PLACE, "edits", "lines", "repaired", "last", "blank", "duplicate", "truncated")])
    schema = "c string, part int, seq int, edits string, lines long, repaired string, last long, blank long, duplicate long, truncated long"
    return pieces.select(*PLACE, "roles", "texts").join(solved.select(*PLACE, "codes", "given"), PLACE).join(entries, PLACE).mapInArrow(run, schema)


def _joined(traced: DataFrame) -> DataFrame:
    """Conversations from their pieces in order: sums, the edits and the digest of the repaired text."""
    names = ["c", "conv_id", *RESULT, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def closed() -> pa.RecordBatch:
            rest = viterbi.missing(now["last"])
            for line in rest:
                now["digest"].update((("\n" if now["any"] else "") + line).encode())
                now["any"] = True
            turns = now["turns"]
            row = {k: now[k] for k in ("c", "conv_id", *RESULT)} | {"gaps": turns[1] - turns[0] + 1 - now["different"] if turns else 0}
            row |= {"cost": now["cost"] + now["start"], "audit": "".join(now["edits"]) + "I" * len(rest), "repaired_sha256": now["digest"].hexdigest()}
            return pa.RecordBatch.from_pylist([{k: row[k] for k in names}], pa.schema([(k, pa.string() if k in ("c", "audit", "repaired_sha256") else pa.int64()) for k in names]))

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["c"] != r["c"]:
                    if now is not None:
                        yield closed()
                    now = {"c": r["c"], "conv_id": r["conv_id"], "digest": hashlib.sha256(), "any": False, "edits": [], "turns": [], "role": None, "start": r["start"][0]} | dict.fromkeys((*RESULT, "different"), 0)
                for k, v in (("blank", r["blank"]), ("duplicate", r["duplicate"]), ("truncated", r["truncated"]), ("illegal", r["illegal_in"]), ("cost", r["shift"]), ("different", r["different"])):
                    now[k] += v
                if r["turns"]:
                    now["different"] -= bool(now["turns"]) and now["turns"][1] == r["turns"][0]
                    now["turns"] = [now["turns"][0] if now["turns"] else r["turns"][0], r["turns"][1]]
                if r["ends"]:
                    now["illegal"] += now["role"] is not None and now["role"] + r["ends"][0] not in GOOD_PAIRS
                    now["role"] = r["ends"][1]
                if r["lines"]:
                    now["digest"].update((("\n" if now["any"] else "") + r["repaired"]).encode())
                    now["any"] = True
                now["edits"].append(r["edits"])
                now["last"] = r["last"]
        if now is not None:
            yield closed()

    return traced.repartition("c").sortWithinPartitions(*PLACE).mapInArrow(run, _WHOLE)


def repaired(df: DataFrame) -> DataFrame:
    """Per conversation of ``df`` (conv_id, turn, role, text; rows with ``gone`` only tell that it exists): its faults, the least cost, the edits and the repaired text's digest.

    Rows go by turn, null turns first, then by role and a digest of the text, so ties have an order; rows that repeat all
    of these are duplicates of one another. Rows with a null id are one conversation. A role that is empty has no initial and
    so is given another or deleted. Null roles and texts count as one space. A conversation without rows has zeros, no edits
    and the digest of nothing; an empty table has no rows. Columns of other names are not read.
    """
    d = df.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.col("gone") if "gone" in df.columns else F.lit(False).alias("gone"))
    d = d.withColumns({"__h": F.xxhash64("text"), "__tie": F.monotonically_increasing_id()})
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "__h", "__tie"]
    ordered = d.repartitionByRange(*order).sortWithinPartitions(*order)
    found = settled(_first_pass(ordered), "repair")
    whole = found.where("audit IS NOT NULL").select("conv_id", *RESULT, "audit", "repaired_sha256")
    pieces = found.where("audit IS NULL")
    codes = _faulted(pieces)
    state, _ = fixed_up(codes)
    solved = codes.join(state, PLACE)
    traced = _traced(pieces, solved, _entered(solved))
    ends = F.when(F.size("roles") > 0, F.array(F.substring(F.get("roles", F.lit(0)), 1, 1), F.substring(F.element_at("roles", -1), 1, 1)))
    slim = pieces.select(*PLACE, "conv_id", "turns", "different", "illegal_in", ends.alias("ends"))
    joined = _joined(traced.join(slim, PLACE).join(state.select(*PLACE, "start", "shift"), PLACE))
    return whole.unionByName(joined.select(whole.columns))


def op11_rank_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations after the damage of the contract; see ``damaged`` and ``repaired`` for nulls, ties and empty tables."""
    return repaired(damaged(table(spark, sf_dir, "conversations")))


#: The same steps a row at a time: backward costs of every conversation, then the trace.
OP11_SQL = """
WITH RECURSIVE powers AS (
  SELECT list(c ORDER BY k) AS t FROM (SELECT range AS k, list_reduce(list_prepend(range, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256))),
given AS (
  SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..') AS b FROM conversations),
kinds AS (
  SELECT * EXCLUDE (b), xor(list_reduce(list_prepend(4294967295, list_transform(b, lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM given, powers),
hurt AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, lag(role[1]) OVER w || role[1] AS pair,
    rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS shown FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faulty AS (
  SELECT *, shown = '' AS blank, shown <> '' AND again AS duplicate, shown <> '' AND NOT again AND shown[-1] NOT IN ('.', '!', '?') AS truncated, role[1] AS cls FROM placed),
coded AS (SELECT *, blank OR duplicate AS must, truncated::INTEGER AS cut FROM faulty),
sizes AS (SELECT conv_id, count(*) AS n FROM coded GROUP BY conv_id),
back(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, n, 0, 4, 2, 0 FROM sizes
  UNION ALL
  SELECT conv_id, i - 1, least(w0, 2 + w2, 4 + w3), least(w1, 2 + w2, 4 + w3), least(w2, 2 + w3), least(w3, 2 + w2) FROM (
    SELECT b.conv_id, b.i,
      least(3 + v0, CASE WHEN NOT must THEN v2 + cut + 2 END, CASE WHEN NOT must AND cls = 's' THEN v1 + cut WHEN NOT must AND cls = 'u' THEN v2 + cut END) AS w0,
      least(3 + v1, CASE WHEN NOT must THEN v2 + cut + 2 END, CASE WHEN NOT must AND cls = 'u' THEN v2 + cut END) AS w1,
      least(3 + v2, CASE WHEN NOT must THEN v3 + cut + 2 END, CASE WHEN NOT must AND cls = 'a' THEN v3 + cut END) AS w2,
      least(3 + v3, CASE WHEN NOT must THEN v2 + cut + 2 END, CASE WHEN NOT must AND cls = 'u' THEN v2 + cut END) AS w3
    FROM back b JOIN coded c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.i = b.i)),
steps AS (
  SELECT c.conv_id, c.i, c.role, c.text, c.cls, c.must, c.cut, [a.v0, a.v1, a.v2, a.v3] AS before, [b.v0, b.v1, b.v2, b.v3] AS after
  FROM coded c JOIN back b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.i JOIN back a ON a.conv_id IS NOT DISTINCT FROM c.conv_id AND a.i = c.i - 1),
walk(conv_id, i, q, audit, said) AS (
  SELECT conv_id, 1::BIGINT, 1, '', []::VARCHAR[] FROM sizes
  UNION ALL
  SELECT conv_id, CASE edit WHEN 'I' THEN i ELSE i + 1 END,
    CASE edit WHEN 'D' THEN q WHEN 'K' THEN kept ELSE ahead END, audit || edit,
    CASE edit WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) WHEN 'R' THEN list_append(said, CASE ahead WHEN 3 THEN 'user:' ELSE 'assistant:' END || text)
      ELSE list_append(said, CASE ahead WHEN 3 THEN 'user:' ELSE 'assistant:' END) END
  FROM (
    SELECT *, CASE WHEN 3 + after[q] = before[q] THEN 'D' WHEN 2 + before[ahead] = before[q] THEN 'I' WHEN kept IS NOT NULL AND NOT must AND after[kept] + cut = before[q] THEN 'K' ELSE 'R' END AS edit FROM (
      SELECT w.conv_id, w.i, w.q, w.audit, w.said, s.role, s.text, s.must, s.cut, s.before, s.after, CASE w.q WHEN 3 THEN 4 ELSE 3 END AS ahead,
        CASE WHEN s.cls = 's' AND w.q = 1 THEN 2 WHEN s.cls = 'u' AND w.q <> 3 THEN 3 WHEN s.cls = 'a' AND w.q = 3 THEN 4 END AS kept
      FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i))),
ended AS (
  SELECT w.conv_id, CASE q WHEN 3 THEN audit || 'I' WHEN 2 THEN audit || 'II' ELSE audit END AS audit,
    CASE q WHEN 3 THEN list_append(said, 'assistant:') WHEN 2 THEN list_concat(said, ['user:', 'assistant:']) ELSE said END AS said
  FROM walk w JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = s.n + 1),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(b.v0, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 0
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
