"""Operator 1: chat formatting.

A template names the control strings, the roles with their loss flags and the
allowed turn order as a finite-state machine.  Turns of a conversation are
read in order and streamed out as text segments with a loss flag; memory holds
one Arrow batch, so a conversation of any length passes.  A digest of a whole
conversation is sequential by nature: rows are dealt by conversation and
sorted there (Spark's sort spills), then read one after another.

Defined cases: a null text or role is an empty one; rows are ordered by turn,
then role, then text (repeated rows are all kept); a turn that the machine
doesn't allow is still formatted, and the conversation is marked invalid with
the first offending turn; an empty table gives no rows; a null conv_id is a
conversation of its own.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    first: str = "start"
    #: state -> role -> next state
    machine: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "asked", "user": "user"},
        "asked": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user", "tool": "user"},
    })
    final: tuple[str, ...] = ("assistant",)


_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left: every ``<``, backslashes, ``|`` gets one more backslash."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turn_no, text, loss, state): the formatted conversations, in order within partitions.

    ``state`` is the machine's state after the turn, or null from the first
    turn on that it doesn't allow.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    empty = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        now, at, state = object(), 0, None
        for batch in batches:
            take, number, text, loss, states = [], [], [], [], []
            ids = batch.column(0).to_pylist()
            for row, (conv, role, said) in enumerate(zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if conv != now:
                    now, at, state = conv, 0, template.first
                state = None if state is None else template.machine.get(state, {}).get(role)
                for piece, flag in ((f"{template.start}{_role_out(role)}\n", False), (escape(said), role in template.loss_roles), (f"{template.end}\n", False)):
                    take.append(row)
                    number.append(at)
                    text.append(piece)
                    loss.append(flag)
                    states.append(state)
                at += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(number, pa.int64()), pa.array(text, pa.string()), pa.array(loss, pa.bool_()), pa.array(states, pa.string())],
                names=["conv_id", "turn_no", "text", "loss", "state"],
            )

    return rows.mapInArrow(run, f"conv_id {kind}, turn_no long, text string, loss boolean, state string")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Parse the output of ``segments`` again: one digest row per conversation.

    Only the concatenated text and its loss mask are used; turns are found by
    the control strings.
    """
    kind = formatted.schema["conv_id"].dataType
    turn = re.compile(re.escape(template.start) + r"([^\n]*)\n(.*?)" + re.escape(template.end) + "\n", re.S)
    allowed = template.final

    def run(batches):
        keys: list = []
        rows: list[tuple] = []
        now, state, held = object(), None, []

        def fresh():
            return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "n_chars": 0, "state": None, "bad": None}

        def close():
            if state is not None:
                keys.append(now)
                valid = state["bad"] is None and state["state"] in allowed
                rows.append((state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(), state["n_chars"], valid, state["bad"]))

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64())))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "first_bad_turn"],
            )
            keys.clear()
            rows.clear()
            return out

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for conv, number, text, loss, at in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if conv != now:
                    close()
                    now, state, held = conv, fresh(), []
                held.append(text)
                state["n_chars"] += len(text)
                if loss:
                    plain = unescape(text)
                    state["loss"].update(plain.encode())
                    state["loss_n"] += len(plain)
                if at is None and state["bad"] is None:
                    state["bad"] = number
                state["state"] = at
                if text.endswith(template.end + "\n"):
                    for role, said in turn.findall("".join(held)):
                        state["n"] += 1
                        state["turns"].update(f"{_role_in(role)}\n{unescape(said)}\n".encode())
                    held = []
            if len(rows) > 5000:
                yield flush()
        if key_type is not None:
            close()
            yield flush()

    return formatted.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_bad_turn long")
