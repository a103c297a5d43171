"""Chat formatting from an event log.

A conversation is a log of events ``(conv_id, seq, kind, msg_id, role, text)``:

``message``     a whole message; without ``msg_id`` it stands alone
``delta``       text appended to message ``msg_id`` (created by its first event)
``edit``        replaces the text of message ``msg_id`` in place
``regenerate``  discards the text of message ``msg_id`` and every message that
                was created between it and this event; deltas follow

The fold is split so that no conversation has to fit in memory or in one task. What
an event contributes is decided with aggregates and running maxima (over those
conversations only in which something was regenerated; Spark sorts and spills them).
Rendering goes by ranges of (conversation, first event), so a long conversation is
spread over tasks, each holding one message at a time; ordinals are numbers within a
range plus the turns of the conversation in the ranges before, of which there is a
row per range. Only a digest over a whole conversation, which is sequential, streams
it through one task.

Defined cases: null text and null role count as empty; null ``seq`` sorts first;
rows that tie on ``seq`` are ordered by role, then text, and repeated rows are
all kept; an empty log gives an empty result; a null ``conv_id`` is a
conversation of its own; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table, worker

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")

EVENTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("msg_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

TURNS = "conv_id long, part int, ordinal long, piece string, loss_start int, loss_end int"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """No result contains ``<|``: a backslash is put between, whatever number stood there."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(role: str, text: str, loss_roles=("assistant",)) -> tuple[str, int, int]:
    """One formatted turn and the code-point range of it that is under the loss mask."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    piece = f"{head}{body}{END}\n"
    return (piece, len(head), len(head) + len(body)) if role in loss_roles else (piece, 0, 0)


def parse(piece: str) -> tuple[str, str]:
    """Role and text read back from one formatted turn."""
    head, body = piece[len(START) : -len(END) - 1].split("\n", 1)
    return unescape_role(head), unescape(body)


def fold(events: DataFrame) -> DataFrame:
    """Surviving pieces of text: ``conv_id, born, tie_role, tie_text, seq, role, text``.

    ``born`` is the message's first ``seq``. Pieces of one message, in ``seq``
    order, make up its final text.
    """
    e = events.select(
        "conv_id",
        F.coalesce("seq", F.lit(-(2**63))).alias("seq"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
        "msg_id",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    alone = e.where(F.col("msg_id").isNull())
    alone = alone.select("conv_id", F.col("seq").alias("born"), F.lit(None).cast("string").alias("msg_id"), "seq", "role", "text")
    of_message = e.where(F.col("msg_id").isNotNull())
    # map-side combined, so a message of very many deltas costs one row per task
    state = of_message.groupBy("conv_id", "msg_id").agg(
        F.min("seq").alias("born"),
        F.max(F.when(F.col("kind") != "delta", F.col("seq"))).alias("reset"),
        F.min_by("role", F.struct("seq", "role")).alias("first_role"),
    )
    parts = (
        of_message.alias("e")
        .join(state.alias("s"), F.expr("e.conv_id <=> s.conv_id AND e.msg_id = s.msg_id"))
        .where(F.expr("reset IS NULL OR e.seq >= reset"))
        .selectExpr("e.conv_id", "s.born", "e.msg_id", "e.seq", "s.first_role AS role", "IF(e.kind = 'regenerate', '', e.text) AS text")
    )
    regenerated = (
        of_message.alias("e")
        .where("kind = 'regenerate'")
        .join(state.alias("s"), F.expr("e.conv_id <=> s.conv_id AND e.msg_id = s.msg_id"))
        .groupBy("e.conv_id", "s.born")
        .agg(F.max("e.seq").alias("until"))
    )
    # a message goes if an earlier-born one was regenerated after it was born
    born = alone.select("conv_id", "born").union(state.select("conv_id", "born")).select("conv_id", "born", F.lit(None).cast("long").alias("until"))
    touched = regenerated.select(F.col("conv_id").alias("c")).distinct()
    born = born.join(touched, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    line = born.union(regenerated).groupBy("conv_id", "born").agg(F.max("until").alias("until"))
    before = Window.partitionBy("conv_id").orderBy("born").rowsBetween(Window.unboundedPreceding, -1)
    gone = line.withColumn("shadow", F.max("until").over(before)).where("shadow > born").select("conv_id", "born")
    pieces = alone.unionByName(parts)
    return pieces.alias("p").join(gone.alias("g"), F.expr("p.conv_id <=> g.conv_id AND p.born = g.born"), "left_anti")


def _stream_turns(loss_roles):
    def run(batches):
        rows, now, key, ordinal, conv = [], [], None, -1, None
        part = TaskContext.get().partitionId()

        def close():
            nonlocal ordinal, conv
            if key is None:
                return
            ordinal = ordinal + 1 if conv == (key[0],) else 0
            conv = (key[0],)
            rows.append((key[0], part, ordinal, *render(key[3], "".join(now), loss_roles)))

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32()))],
                ["conv_id", "part", "ordinal", "piece", "loss_start", "loss_end"],
            )
            rows.clear()
            return out

        for batch in batches:
            size = 0
            for conv_id, born, msg, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "born", "msg_id", "role", "text"))):
                this = (conv_id, born, msg, role)
                if msg is None or this != key:
                    close()
                    now, key = [], this
                now.append(text)
                size += len(text)
                if len(rows) >= 2000 or size > 4_000_000 and rows:
                    size = 0
                    yield flush()
        close()
        if rows:
            yield flush()

    return worker(run)


def format_turns(events: DataFrame, loss_roles=("assistant",)) -> DataFrame:
    """Formatted turns in order: ``conv_id, ordinal, piece, loss_start, loss_end``.

    A conversation's text is its pieces, concatenated by ``ordinal``. A task renders
    a range of messages; its memory is one message and one output batch.
    """
    spark = events.sparkSession
    mine = F.coalesce("msg_id", F.lit(""))
    order = ["conv_id", "born", mine, F.when(F.col("msg_id").isNull(), F.col("role")), F.when(F.col("msg_id").isNull(), F.col("text")), "seq"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = fold(events).repartitionByRange(n, "conv_id", "born", mine).sortWithinPartitions(*order)
    # written once: ranges come from a sample, which another run need not repeat
    turns = cut(ready.select("conv_id", "born", "msg_id", "role", "text").mapInArrow(_stream_turns(tuple(loss_roles)), TURNS))
    counts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("turns"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.sum("turns").over(before).alias("shift")).where("shift > 0")
    # a range goes on with one conversation at most: fewer rows than ranges
    joined = turns.join(F.broadcast(shift), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    return joined.select("conv_id", (F.col("ordinal") + F.coalesce("shift", F.lit(0))).alias("ordinal"), "piece", "loss_start", "loss_end")


@worker
def _stream_digests(batches):
    rows, key, state = [], (), None

    def close():
        if state is not None:
            rows.append((key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        for conv_id, piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end"))):
            if state is None or key != (conv_id,):
                close()
                key, state = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse(piece)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if b > a:
                masked = unescape(piece[a:b])
                state[2] += len(masked)
                state[3].update(masked.encode())
            state[4] += len(piece)
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], _DIGEST_PA)
            rows.clear()
    close()
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], _DIGEST_PA)


_NAMES = [x.split()[0] for x in DIGEST.split(", ")]
_DIGEST_PA = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in _NAMES])


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, what its formatted turns say when they are parsed again."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "ordinal")
    return ordered.mapInArrow(_stream_digests, DIGEST)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as an event log of stand-alone messages."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("msg_id"), "role", "text"
    )


PROBE = f"{END}{START}assistant ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe conversation -1, formatted and read back."""
    events = conversation_events(table(spark, sf_dir, "conversations"))
    probe = spark.createDataFrame([(-1, i, "message", None, r, PROBE) for i, r in enumerate(("user", "assistant"))], EVENTS)
    return digests(format_turns(events.unionByName(probe)))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
f AS (
  SELECT *, '{START}' || regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\\\*)\\|', '<\\\\\\1|', 'g') || chr(10)
    || regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') || '{END}' || chr(10) AS piece FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
