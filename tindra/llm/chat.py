"""Chat formatting by a grammar round trip.

    output := "<s>" turn*
    turn   := "[INST]" text "[/INST]"            a user's
            | "[ANS]" text "</s>"                an assistant's
            | "[ROLE]" role "[:]" text "[/ROLE]"  any other role's

A text may hold any character but a control string; a backslash makes the next character ordinary. Each turn is rendered as
it is, parsed again, and compared with its source; on a difference it is escaped (backslashes and control strings first,
then every character) until both are identical. Turns are rendered and checked one by one in parallel; then the rendered
turns are dealt by conversation, sorted by turn, and read back by the same parser as a stream that holds one batch and the
running digests, so a conversation of any length needs no more memory than a short one. A SHA-256 over a whole conversation
is sequential by definition: that stream is the one step that can't be divided.

Defined results: null text or role: empty; ties in turn go by rendered text; a null turn comes first; null conv_id is a
conversation of its own; repeated rows are turns of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

START = "<s>"
# The template's control strings.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[:]", "[/ROLE]"]
_CONTROL = "|".join(map(re.escape, CONTROLS))
_LEX = re.compile(rf"\\(.)|({_CONTROL})", re.DOTALL)
_SPECIAL = re.compile(rf"\\|{_CONTROL}")
_ANY = re.compile(r"(?=.)", re.DOTALL)
_ENDS = {"[INST]": "[/INST]", "[ANS]": "</s>", "[ROLE]": "[/ROLE]"}


class Malformed(ValueError):
    pass


def render(role: str, text: str, level: int = 0) -> str:
    """One turn; level 0 doesn't escape, 1 escapes backslashes and control strings, 2 every character."""
    esc = (lambda x: x) if level == 0 else (lambda x: (_SPECIAL if level == 1 else _ANY).sub(lambda m: "\\" + m[0], x))
    if role == "user":
        return f"[INST]{esc(text)}[/INST]"
    if role == "assistant":
        return f"[ANS]{esc(text)}</s>"
    return f"[ROLE]{esc(role)}[:]{esc(text)}[/ROLE]"


def parse(chunk: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end: where the text, still escaped, stands in the chunk."""
    out, at, mark, role, buf, begin = [], 0, None, "", [], 0
    for m in _LEX.finditer(chunk):
        if mark is None and m.start() != at:
            raise Malformed("text outside a turn")
        buf.append(chunk[at : m.start()])
        at = m.end()
        if m[1] is not None:
            if mark is None:
                raise Malformed("an escape outside a turn")
            buf.append(m[1])
        elif mark is None:
            if m[2] not in _ENDS:
                raise Malformed(f"{m[2]} begins no turn")
            mark, buf, begin = m[2], [], at
            role = {"[INST]": "user", "[ANS]": "assistant"}.get(mark)
        elif m[2] == "[:]" and mark == "[ROLE]" and role is None:
            role, buf, begin = "".join(buf), [], at
        elif m[2] == _ENDS[mark] and role is not None:
            out.append((role, "".join(buf), begin, m.start()))
            mark, buf = None, []
        else:
            raise Malformed(f"{m[2]} inside a text")
    if mark is not None or at != len(chunk):
        raise Malformed("the last turn doesn't end")
    return out


def rendered(role: str | None, text: str | None) -> str:
    """A turn in the least escaped form that parses back to exactly its source."""
    role, text = role or "", text or ""
    for level in (0, 1, 2):
        chunk = render(role, text, level)
        try:
            if [x[:2] for x in parse(chunk)] == [(role, text)]:
                return chunk
        except Malformed:
            pass
    raise AssertionError("a fully escaped turn must parse back")


def format_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, chunk, loss_start, loss_end): rendered turns, and where in the chunk the loss counts (else null).

    A conversation's output is START and its chunks in the order of turn.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def run(batches):
        for b in batches:
            chunks = [rendered(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            spans = [next(((s, e) for r, _, s, e in parse(c) if r == "assistant"), (None, None)) for c in chunks]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(chunks, pa.string()), pa.array([s for s, _ in spans], pa.int64()), pa.array([e for _, e in spans], pa.int64())], ["conv_id", "turn", "chunk", "loss_start", "loss_end"])

    return small_batches(df).select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, chunk string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted output alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        cur, state, done = None, None, []

        def close():
            n, turns, chars, loss, size = state
            done.append((cur[0], n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for b in batches:
            for conv, chunk, start, end in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if cur is None or cur[0] != conv:
                    if cur is not None:
                        close()
                    cur, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), len(START)]
                for role, text, s, e in parse(chunk):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if (s, e) == (start, end):
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(chunk)
            if len(done) > 20_000:
                cols, done = list(zip(*done, strict=True)), []
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *map(pa.array, cols[1:], types)], names)
        if cur is not None:
            close()
            cols = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *map(pa.array, cols[1:], types)], names)

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "chunk").select("conv_id", "chunk", "loss_start", "loss_end")
    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def probe(df: DataFrame) -> DataFrame:
    """The conversation -7, whose texts are control strings of a common template."""
    text = "</s>[INST] ok [/INST]"
    rows = df.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return df.select("conv_id", "turn", "role", "text").unionByName(rows)


def oracle() -> str:
    controls = "|".join(re.escape(c) for c in CONTROLS)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
f AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\\\|{controls}')) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 16 + length(role) + len(regexp_extract_all(role, '\\\\|{controls}')) END AS size FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(size))::BIGINT AS formatted_chars FROM f GROUP BY conv_id"""
