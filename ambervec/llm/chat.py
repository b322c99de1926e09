"""Operator 3: chat formatting in budgeted windows of whole turns."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tokens import piece_counts

# Control strings of this template and of common others; each gets a backslash
# behind its first character inside texts, and backslashes are doubled.
_CONTROL = re.compile(r"<\||\|>|</?s>|\[/?INST\]|<</?SYS>>|\\")
_TURN = re.compile(r"<\|turn:((?:[^\\|<]|\\.)*)\|>(.*?)<\|end\|>\n", re.S)

_PREPARED = "conv_id long, turn long, role string, body string, n_tokens long"
WINDOWS = (
    "conv_id long, window int, first_turn long, n_turns int, n_repeated int, text string, "
    "loss array<struct<start:long,end:long>>, n_tokens long, over_budget boolean"
)
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:] if len(m[0]) > 1 else "\\\\", text)


def _escape_role(role: str) -> str:
    return re.sub(r"[\\|<]", lambda m: "\\" + m[0], role)


def unescape(text: str) -> str:
    """Reverse of `escape`: a doubled backslash is one, a single one goes."""
    return re.sub(r"\\(\\?)", lambda m: m[1], text)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted window: role and body unescaped, and the body's limits."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(text)]


def _prepared(turns: DataFrame, model: str) -> DataFrame:
    """Escaped turns with their token counts; the costly work, before any shuffle."""

    def run(batches):
        counter = piece_counts(model)
        for b in batches:
            roles = [_escape_role(r or "") for r in b.column("role").to_pylist()]
            bodies = [escape(t or "") for t in b.column("text").to_pylist()]
            n = counter.count([f"<|turn:{r}|>{t}<|end|>\n" for r, t in zip(roles, bodies)])
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id").cast(pa.int64()), b.column("turn").cast(pa.int64()), pa.array(roles, pa.string()), pa.array(bodies, pa.string()), pa.array(n, pa.int64())],
                [c.split()[0] for c in _PREPARED.split(", ")],
            )

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, _PREPARED)


class _Conversation:
    """One conversation in the making; holds no more than a window's turns and history.

    ``turns`` are the held turns, ``sums`` the prefix sums of their tokens: sums[i]
    counts all turns of the conversation before held turn i. ``lo`` and ``start`` are
    the first repeated and the first new turn of the open window.
    """

    def __init__(self, conv_id, budget: int, history: int, history_turns: int):
        self.conv_id, self.budget, self.history, self.history_turns = conv_id, budget, history, history_turns
        self.turns, self.sums, self.lo, self.start, self.system, self.window, self.at = [], [0], 0, 0, None, 0, 0

    def _always(self) -> int:
        """Tokens of the system turn that the open window repeats."""
        return self.system[2] if self.system and self.window else 0

    def add(self, turn: tuple[str, str, int]):
        if self.at == 0 and not self.turns and turn[0] == "system":
            self.system = turn
        if len(self.turns) > self.start and self._always() + self.sums[-1] + turn[2] - self.sums[self.lo] > self.budget:
            yield self.close()
        if len(self.turns) == self.start:
            # history goes before the budget breaks
            room = max(0, min(self.history, self.budget - self._always() - turn[2]))
            oldest = max(self.start - self.history_turns, int(self.system is not None and self.at == self.start), 0)
            self.lo = min(self.start, max(oldest, bisect_left(self.sums, self.sums[self.start] - room)))
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn[2])

    def close(self) -> tuple:
        again = ([self.system] if self.system and self.window else []) + self.turns[self.lo : self.start]
        new = self.turns[self.start :]
        parts, loss, at = [], [], 0
        for k, (role, body, _) in enumerate([*again, *new]):
            head = f"<|turn:{role}|>"
            if k >= len(again) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts.append(f"{head}{body}<|end|>\n")
            at += len(parts[-1])
        n = self._always() + self.sums[-1] - self.sums[self.lo]
        row = (self.conv_id, self.window, self.at, len(new), len(again), "".join(parts), loss, n, n > self.budget)
        self.at += len(new)
        past = max(0, len(self.turns) - self.history_turns)
        self.turns, self.sums = self.turns[past:], self.sums[past:]
        self.start, self.window = len(self.turns), self.window + 1
        return row


def chat_windows(turns: DataFrame, model: str, budget: int = 2048, history: int = 512, history_turns: int = 2) -> DataFrame:
    """Format conversations (conv_id, turn, role, text) in windows of whole turns.

    Spans of turns are chosen by prefix sums of the turns' tokens: a window holds as
    many turns as fit ``budget`` tokens, one at least. Later windows begin with the
    system turn, always, and up to ``history_turns`` earlier turns of at most
    ``history`` tokens; history is left out, oldest turns first, where the window's
    first new turn would not fit beside it. A window passes the budget, and is marked
    over_budget, only if the system turn and one new turn alone do. The
    ``n_repeated`` turns bear no loss, so each assistant text is under the loss mask
    once. Control strings inside texts and roles are escaped reversibly.

    Turns are escaped and counted where they lie; then each conversation is read
    once, in order of (turn, role, text), as a stream that holds one window. A
    conversation's order ties it to one task; its rows are never all in memory.

    Null texts and roles are empty, a null turn comes first, null conv_ids are
    one conversation. Repeated rows are turns of their own. Empty table: no
    rows. Other columns are left out.
    """

    def run(batches):
        conv, out = None, []

        def table():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds)], kinds.names)

        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "body", "n_tokens")))
            for conv_id, role, body, n in rows:
                if conv is None or conv.conv_id != conv_id:
                    if conv is not None:
                        out.append(conv.close())
                    conv = _Conversation(conv_id, budget, history, history_turns)
                out.extend(conv.add((role, body, n)))
                if len(out) >= 256:
                    yield table()
                    out = []
        if conv is not None:
            out.append(conv.close())
            yield table()

    kinds = _kinds(WINDOWS)
    ready = _prepared(turns, model)
    return ready.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "body").mapInArrow(run, WINDOWS)


def _kinds(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def read_back(windows: DataFrame, in_order: bool = False) -> DataFrame:
    """What a reader of the windows gets: digests of each conversation's turns
    and of the text under the loss mask. ``in_order``: the rows already lie by
    conversation and window, as `chat_windows` leaves them."""

    def run(batches):
        conv, state, out = object(), None, []

        def done():
            n, turns, chars, loss, total = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), total)

        for b in batches:
            for conv_id, again, text, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "n_repeated", "text", "loss"))):
                if state is None or conv_id != conv:
                    if state is not None:
                        out.append(done())
                    conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body, _, _ in parse(text)[again:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    seen = unescape(text[span["start"] : span["end"]])
                    state[2] += len(seen)
                    state[3].update(seen.encode())
                state[4] += len(text)
        if state is not None:
            out.append(done())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], kinds.names)

    kinds = _kinds(READ_BACK)
    rows = windows if in_order else windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInArrow(run, READ_BACK)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return read_back(chat_windows(turns.unionByName(extra), public_tokenizers.path("piece_bpe_32k.model")), in_order=True)
