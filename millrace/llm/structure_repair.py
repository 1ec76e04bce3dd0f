"""Repair of conversations to ``(s?(ua)+)?`` by the cheapest edits.

Rows of a conversation are read in order. Every partial repair is one integer: its high digits are the
cost so far, its low digits the audit letters written so far, each in a slot of three bits, counted from
the left, with zeros in the slots that are not yet used. So the least integer is the cheapest repair,
and among the cheapest the one whose audit is least in ASCII order, a shorter one before its
continuations. Nodes of the search are (rows read, state of the pattern); an edge adds its cost and its
letter in the next free slot, and each node keeps the least integer that reaches it. The audit is read
off the digits of the least integer at the end; nothing else is remembered.

Letters that all four integers begin with are decided: they are taken off, together with the rows they
speak of, whenever a window of rows is full. So a conversation of any length is gone through once with
integers of bounded width, and only undecided rows are held.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Audit letters by the digit that stands for them; 0 is an unused slot.
LETTERS = ".DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
#: States of the pattern: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: By state: the state that a kept row's initial leads to; and role and state of an inserted or renamed row.
FOLLOWS = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
EXPECTED = (("user", AFTER_U), ("user", AFTER_U), ("assistant", AFTER_A), ("user", AFTER_U))
LEGAL = {"su", "ua", "au"}
SLOT, WINDOW = 3, 64
GAP = " \t\n\x0b\x0c\r"


class Repair:
    """One conversation, row by row; ``emit`` receives (role, text, letter) of the turns that come out."""

    def __init__(self, emit: Callable[[str, str, str], None]):
        self.emit = emit
        self.seen: set[bytes] = set()
        self.turns: set[int] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None
        # search: per state the least integer and its letters' number; the cost's place is above the slots
        self.slots = 3 * WINDOW + 2
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self.pending: deque[tuple[str, str]] = deque()
        self.unread, self.state, self.audit = 0, START, []

    def _with(self, weight: int, used: int, letter: int, cost: int) -> tuple[int, int]:
        return weight + (cost << SLOT * self.slots) + (letter << SLOT * (self.slots - 1 - used)), used + 1

    def _inserted(self) -> list[tuple[int, int] | None]:
        """The best integers with up to two turns inserted; more would come back to the same state."""
        best = list(self.best)
        for _ in range(2):
            for state, known in enumerate(list(best)):
                if known is not None:
                    _lower(best, EXPECTED[state][1], self._with(*known, INSERT, INSERT_COST))
        return best

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns.add(turn)
        bare = text.strip(GAP)
        key = blake2b(f"{len(role)}:{role}{text}".encode(errors="surrogatepass"), digest_size=16).digest()
        must_go = cut = False
        if not bare:
            self.blank += 1
            must_go = True
        elif key in self.seen:
            self.duplicate += 1
            must_go = True
        elif bare[-1] not in ".!?":
            self.truncated += 1
            cut = True
        self.seen.add(key)
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        self.pending.append((role, text))
        self._step(initial, must_go, TRUNCATED_COST if cut else 0)

    def _step(self, initial: str, must_go: bool, extra: int) -> None:
        after: list[tuple[int, int] | None] = [None] * 4
        for state, known in enumerate(self._inserted()):
            if known is None:
                continue
            _lower(after, state, self._with(*known, DELETE, DELETE_COST))
            if not must_go:
                _lower(after, EXPECTED[state][1], self._with(*known, REROLE, REROLE_COST + extra))
                kept = FOLLOWS[state].get(initial)
                if kept is not None:
                    _lower(after, kept, self._with(*known, KEEP, KEEP_COST + extra))
        self.best = after
        self.unread += 1
        if self.unread == WINDOW:
            self._settle()

    def _letters(self, weight: int, used: int) -> str:
        return "".join(LETTERS[weight >> SLOT * (self.slots - 1 - i) & 7] for i in range(used))

    def _settle(self) -> None:
        """Takes off what all integers begin with, and makes room for another window."""
        costs = [None if b is None else b[0] >> SLOT * self.slots for b in self.best]
        letters = [None if b is None else self._letters(*b) for b in self.best]
        told = [x for x in letters if x is not None]
        low, high, n = min(told), max(told), 0
        while n < len(low) and low[n] == high[n]:
            n += 1
        self._apply(low[:n])
        rest = [None if x is None else x[n:] for x in letters]
        self.slots = max(len(x) for x in rest if x is not None) + 3 * WINDOW + 2
        for state, text in enumerate(rest):
            if text is not None:
                weight, used = costs[state] << SLOT * self.slots, 0
                for letter in text:
                    weight, used = self._with(weight, used, LETTERS.index(letter), 0)
                self.best[state] = weight, used
        self.unread = 0

    def _apply(self, letters: str) -> None:
        """Carries out decided edits."""
        self.audit.append(letters)
        for letter in letters:
            role, text = ("", "") if letter == "I" else self.pending.popleft()
            if letter == "D":
                continue
            if letter == "K":
                self.state = FOLLOWS[self.state][role[:1]]
            else:
                role, self.state = EXPECTED[self.state]
            self.emit(role, text, letter)

    def finish(self) -> tuple[int, int, int, int, int, int, str]:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        best = self._inserted()
        weight, used = min(b for b in (best[START], best[AFTER_A]) if b is not None)
        cost = weight >> SLOT * self.slots
        self._apply(self._letters(weight, used))
        gaps = max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit)


def _lower(best: list, state: int, candidate: tuple[int, int]) -> None:
    if best[state] is None or candidate < best[state]:
        best[state] = candidate


REPORT = pa.schema(
    [
        ("conv_id", pa.int64()),
        *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        ("audit", pa.string()),
        ("repaired_sha256", pa.string()),
    ]
)
TURNS = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
)
REPORT_TYPE = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint,"
    " audit string, repaired_sha256 string"
)
TURN_TYPE = "conv_id bigint, place bigint, role string, text string, edit string"
#: Bytes of repaired turns that are handed on together.
OUT_BYTES = 4 << 20


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _repaired(with_turns: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = TURNS if with_turns else REPORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = place = 0
        conv = repair = digest = None

        def emit(role: str, text: str, letter: str) -> None:
            nonlocal place, held
            if with_turns:
                out.append((conv, place, role, text, letter))
                held += len(text) + 64
            else:
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            place += 1

        def close() -> None:
            report = repair.finish()
            if not with_turns:
                out.append((conv, *report, digest.hexdigest()))

        for batch in batches:
            for c, present, turn, role, text in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                if c != conv or repair is None:
                    if repair is not None:
                        close()
                    conv, repair, digest, place = c, Repair(emit), sha256(), 0
                if present:
                    repair.row(turn, role, text)
                if held >= OUT_BYTES:
                    yield _columns(out, schema)
                    out, held = [], 0
            yield _columns(out, schema)
            out, held = [], 0
        if repair is not None:
            close()
        yield _columns(out, schema)

    return run


def _in_order(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None) -> DataFrame:
    blank = F.lit(" ")
    picked = rows.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), blank).alias("role"),
        F.coalesce(F.col(text_col), blank).alias("text"),
    )
    return picked.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def repair_reports(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """One row per conversation: ``gaps`` (missing turn numbers), ``blank``, ``duplicate``, ``truncated`` (rows by
    their first fault), ``illegal`` (neighbours that may not follow one another), ``cost`` and ``audit`` of the
    cheapest repair, and ``repaired_sha256`` of its turns (``role:text``, one per line).

    Rows are taken in order of turn, null first, then role and text; repeated rows are rows of their own.
    A null role or text is one space. Rows without a conversation id belong to none and are left out.
    A row for which ``present`` is not true only names its conversation; one without any other row has
    zeros, an empty audit and the digest of nothing. Other columns are not used. An empty table gives an
    empty result. A conversation is one sorted run of a task, of which the undecided rows are held and
    a digest of each row for finding duplicates; how long it is makes no difference to the rest.
    """
    ordered = _in_order(rows, conv_col, turn_col, role_col, text_col, present)
    return ordered.mapInArrow(_repaired(with_turns=False), REPORT_TYPE)


def repaired_turns(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """The repaired conversations themselves, a row per turn: ``conv_id``, ``place`` (from 0), ``role``,
    ``text`` and ``edit`` (K, R or I), under the rules of :func:`repair_reports`."""
    ordered = _in_order(rows, conv_col, turn_col, role_col, text_col, present)
    return ordered.mapInArrow(_repaired(with_turns=True), TURN_TYPE)
