"""Chat formatting with a grammar round trip (operator 12).

The template, as a grammar::

    conversation := turn*
    turn         := "### " role ":" NL text NL "</turn>" NL
    control      := "###" | "</turn>"

A control string that stands behind no backslash is a mark of the template; in
a role or text it stands behind one backslash more than in the source.
``render`` first writes every turn as it is; ``parse``, a deterministic parser
of the grammar, reads the result back, and turns that do not come back as they
were are written again with their conflicting content escaped, until what is
read is identical to the source.

``write`` formats conversations into a parquet dataset and ``read`` returns its
rows::

    conv_id, part bigint      parts of a conversation ascend
    whole boolean             the part is sure to be the whole conversation
    formatted string
    loss array<struct<start:bigint,end:bigint>>   code points that count for the loss

Turns are range-partitioned by conversation and turn, so a conversation that
holds most rows is formatted by many tasks, in parts of at most ``PART_CHARS``
characters (or one turn).

Defined cases: a NULL role or text is empty; turns are in order of ``turn``
(NULLs first), those of the same turn by role and text; equal rows are all
kept; rows of NULL ``conv_id`` are one conversation; an empty table gives an
empty dataset; other columns are ignored. A text of any length is one turn.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.session import ensure_checkpoint_dir

from .common import map_arrow, shared_table
from .ordering import sha256_of_parts, shuffle_partitions

HEAD, END = "### ", "</turn>"
#: Characters of one row of the dataset, unless one turn is longer.
PART_CHARS = 1 << 16

Turn = tuple[str, str]
# a run of backslashes is looked at from its start only: long runs stay linear
_CONTROL = re.compile(r"(?<!\\)(\\*)(###|</turn>)")
_ESCAPED = re.compile(r"(?<!\\)\\(\\*)(###|</turn>)")
#: What ends or breaks a role in the template's first line, and the backslash itself.
_ROLE = re.compile(r"[\\:\n]|###|</turn>")
_ROLE_ESCAPED = re.compile(r"\\(n|[\\:]|###|</turn>)")
_ROLE_LINE = re.compile(r"((?:\\(?:[n\\:]|###|</turn>)|(?!###|</turn>)[^\\:\n])*+):\n")


def escape_text(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape_text(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return _ROLE.sub(lambda m: r"\n" if m[0] == "\n" else "\\" + m[0], role)


def unescape_role(role: str) -> str:
    return _ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


class Ungrammatical(ValueError):
    """The text is not of the grammar at ``turn`` (counted from 0)."""

    def __init__(self, turn: int):
        super().__init__(f"no turn of the grammar at turn {turn}")
        self.turn = turn


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text, and the code points (start, end)
    of the escaped text. Raises :class:`Ungrammatical` after the turns before it."""
    at, turn = 0, 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise Ungrammatical(turn)
        role = _ROLE_LINE.match(formatted, at + len(HEAD))
        if role is None:
            raise Ungrammatical(turn)
        start = role.end()
        mark = next((m for m in _CONTROL.finditer(formatted, start) if not m[1]), None)
        if mark is None or mark[2] != END or mark.start() == start or formatted[mark.start() - 1] != "\n" or not formatted.startswith("\n", mark.end()):
            raise Ungrammatical(turn)
        end = mark.start() - 1
        if end < start:
            raise Ungrammatical(turn)
        yield unescape_role(role[1]), unescape_text(formatted[start:end]), start, end
        at, turn = mark.end() + 1, turn + 1


def render(turns: list[Turn]) -> tuple[str, list[tuple[str, str, int, int]]]:
    """The formatted text of ``turns`` and what the parser recovers from it, equal to them."""
    escaped = [False] * len(turns)
    while True:
        pieces = [f"{HEAD}{escape_role(r)}:\n{escape_text(t)}\n{END}\n" if e else f"{HEAD}{r}:\n{t}\n{END}\n"
                  for (r, t), e in zip(turns, escaped, strict=True)]
        formatted, found = "".join(pieces), []
        try:
            found.extend(parse(formatted))
        except Ungrammatical:
            pass
        if [f[:2] for f in found] == turns:
            return formatted, found
        # a turn that does not come back alone conflicts with the grammar, whatever stands around it
        before = list(escaped)
        for i, (piece, turn) in enumerate(zip(pieces, turns, strict=True)):
            if not escaped[i]:
                try:
                    escaped[i] = [f[:2] for f in parse(piece)] != [turn]
                except Ungrammatical:
                    escaped[i] = True
        if escaped == before:
            raise Ungrammatical(len(found))


_SCHEMA = "conv_id bigint, part bigint, whole boolean, formatted string, loss array<struct<start:bigint,end:bigint>>"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _parts(rows: Iterable[tuple], pid: int, learn: frozenset[str]) -> Iterator[tuple]:
    """Rows of the dataset from turns (conv_id, role, text) in order."""
    conv, turns, size, split, n, first = object(), [], 0, False, 0, True

    def put(whole):
        nonlocal n, turns, size
        formatted, found = render(turns)
        spans = [{"start": s, "end": e} for role, _, s, e in found if role in learn]
        out = (conv, (pid << 32) + n, whole, formatted, spans)
        n, turns, size = n + 1, [], 0
        return out

    for c, role, text in rows:
        if c != conv:
            if turns:
                yield put(not (split or first))
                first = False
            conv, split = c, False
        elif size + len(text) > PART_CHARS and turns:
            yield put(False)
            split = True
        turns.append((role, text))
        size += len(role) + len(text)
    if turns:
        yield put(False)  # the next partition may go on with it


def write(conversations: DataFrame, path: str, learn: Iterable[str] = ("assistant",)) -> None:
    """Format ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``) into the
    dataset described above; texts of the roles ``learn`` are under the loss mask."""
    learn = frozenset(learn)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))

    def run(batches):
        def turns():
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    piece = b.slice(at, 256)
                    yield from zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True)

        def batch(rows):
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), _LOSS]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "part", "whole", "formatted", "loss"])

        held, size = [], 0
        for row in _parts(turns(), TaskContext.get().partitionId(), learn):
            held.append(row)
            size += len(row[3])
            if size > 16 * PART_CHARS:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    order = ["conv_id", "turn", "role", "text"]
    dealt = src.repartitionByRange(shuffle_partitions(src), *order).sortWithinPartitions(*order)
    map_arrow(dealt.select("conv_id", "role", "text"), run, _SCHEMA).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def described(parts: DataFrame) -> DataFrame:
    """Per conversation, from the rows of a dataset alone: ``n_turns``,
    ``turns_sha256`` (role, newline, text, newline of each turn), ``loss_chars``
    and ``loss_sha256`` (unescaped text under the mask) and ``formatted_chars``."""

    def run(batches):
        for b in batches:
            out = []
            for at in range(0, b.num_rows, 64):
                piece = b.slice(at, 64)
                for conv, part, whole, formatted, loss in zip(*(piece.column(i).to_pylist() for i in range(5)), strict=True):
                    found = list(parse(formatted))
                    turns = "".join(f"{r}\n{t}\n" for r, t, _, _ in found)
                    masked = "".join(unescape_text(formatted[s["start"]:s["end"]]) for s in loss)
                    digests = (_hash(turns), _hash(masked), None, None) if whole else (None, None, turns, masked)
                    out.append((conv, part, len(found), len(masked), len(formatted), *digests))
            if out:
                kinds = [pa.int64()] * 5 + [pa.string()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["conv_id", "part", "n_turns", "loss_chars", "formatted_chars", "turns_sha256", "loss_sha256", "turns", "masked"]
    schema = "conv_id bigint, part bigint, n_turns bigint, loss_chars bigint, formatted_chars bigint, turns_sha256 string, loss_sha256 string, turns string, masked string"
    found = shared_table(map_arrow(parts.select("conv_id", "part", "whole", "formatted", "loss"), run, schema), "formatted")
    counts = ["n_turns", "loss_chars", "formatted_chars"]
    done = found.where("turns is null").select("conv_id", *counts, "turns_sha256", "loss_sha256")
    # of each partition the first and last conversation, and those of several parts
    rest = found.where("turns is not null")
    sums = rest.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts])
    hashes = sha256_of_parts(rest, ["conv_id"], "part", ["turns", "masked"])
    joined = sums.alias("s").join(hashes.alias("h"), F.expr("s.conv_id <=> h.conv_id"))
    return done.unionByName(joined.select("s.conv_id", *counts, F.col("turns").alias("turns_sha256"), F.col("masked").alias("loss_sha256")))


def with_planted(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -7, whose texts look like the template."""
    said = r"\### Assistant: </turn> ok"
    planted = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(planted)


def digests(conversations: DataFrame) -> DataFrame:
    """Format ``conversations`` and conversation -7, read the files back and describe them."""
    spark = conversations.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/chat-{uuid.uuid4().hex[:12]}"
    write(with_planted(conversations), path)
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return described(read(spark, path)).select(*columns)


_TEXT = r"regexp_replace(t, '(\\*)(###|</turn>)', '\\\1\2', 'g')"
#: The digests from the source alone; a conflicting turn has both its fields escaped.
ORACLE = rf"""WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc AS (SELECT *, {_TEXT} AS et FROM src)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(r, chr(10), t, chr(10)), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(et) + 15) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id"""
