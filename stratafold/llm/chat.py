"""Chat formatting by prefix-target expansion: every assistant turn becomes one example.

Template of a turn: ``[TURN]role[TEXT]text</s>``. Inside roles and texts ``\\``, ``<`` and ``[`` are written ``\\0``, ``\\1``
and ``\\2``, so no control string can occur there and reading back is exact. An example is the transcript of all turns
before its target followed by the target, of which only the text lies under the loss mask.

``prefix_target_examples`` gives one row per turn with its ``segment``, its place in the transcript and, on assistant turns,
the example that ends there with its loss mask. ``pieces`` writes every example out, context and target; ``read_back``
reads what was written and nothing else. An expanded conversation of n turns has n * n / 2 turns of text. So transcripts are
cut between turns into blocks of ``BLOCK`` characters, a task holds one block at a time and writes the piece that this block
is of every example of the conversation, and a piece leaves its task only as its length, its trained text and, of the last
example, its turns. Turns after the last assistant turn are context of no example; they are written as one more piece.

Defined cases: a null text or role is empty, rows of one turn number are ordered by role and text, a null conversation
identifier is a conversation of its own, repeated rows are repeated turns, other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import partitions, pick

# The control strings of the template.
TURN, TEXT, END = "[TURN]", "[TEXT]", "</s>"
BLOCK = 1 << 16  # characters of a transcript that one task holds


def escape(c: Column) -> Column:
    for plain, code in (("\\", "\\0"), ("<", "\\1"), ("[", "\\2")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(s: str) -> str:
    return s.replace("\\2", "[").replace("\\1", "<").replace("\\0", "\\")


def read_turn(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    if not (segment.startswith(TURN) and segment.endswith(END)):
        raise ValueError("not a formatted turn")
    role, text = segment[len(TURN) : -len(END)].split(TEXT)
    return unescape(role), unescape(text)


def prefix_target_examples(turns: DataFrame, trainable: str = "assistant") -> DataFrame:
    """(conv_id, position, segment, segment_start, example, context_chars, mask_start, mask_end, example_chars, earlier, examples).

    ``earlier`` counts the examples that end before a turn, ``examples`` those of its conversation.
    """
    from ..functions.ranks import running_sums

    t = pick(turns, "conv_id", "turn", "role", "text")
    t = t.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    target = F.col("role") == F.lit(trainable)
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    t = t.withColumn("body", escape(F.col("text"))).withColumn("segment", F.concat(head, F.col("body"), F.lit(END)))
    t = t.withColumn("chars", F.length("segment").cast("long")).withColumn("target", target.cast("long"))
    # equal rows of one conversation are made apart by counting them, so that the order is complete
    t = t.groupBy("conv_id", "turn", "role", "text", "body", "segment", "chars", "target").agg(F.count(F.lit(1)).alias("times"))
    # running sums over buckets of a conversation: a huge one is no single task
    t = running_sums(t, ["conv_id"], ["turn", "role", "text"], {"p": F.col("times"), "c": F.col("chars") * F.col("times"), "e": F.col("target") * F.col("times")})
    t = t.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    start = F.col("c_before") + F.col("k") * F.col("chars")
    is_target = F.col("target") == 1
    mask = start + F.length(F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
    earlier = F.col("e_before") + F.col("k") * F.col("target")
    when = lambda c: F.when(is_target, c)
    return t.select("conv_id", (F.col("p_before") + F.col("k")).alias("position"), "segment", start.alias("segment_start"),
                    when(earlier).alias("example"), when(start).alias("context_chars"), when(mask).alias("mask_start"),
                    when(mask + F.length("body")).alias("mask_end"), when(start + F.col("chars")).alias("example_chars"),
                    earlier.alias("earlier"), F.col("e_total").alias("examples"))


def _table(schema: dict, rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, schema.values())], list(schema))


def pieces(examples: DataFrame, block: int | None = None) -> DataFrame:
    """Every example written out, in pieces: (conv_id, example, piece, start, text, mask_start, mask_end, last).

    The texts of an example's pieces in order are its context and its target; ``start`` is the place of a piece in it. The mask
    stands on the piece that holds the target. ``last`` marks the pieces of the conversation's last example and, with a NULL
    ``example``, the turns behind it.
    """
    size = block or BLOCK
    schema = {"conv_id": pa.int64(), "example": pa.int64(), "piece": pa.int64(), "start": pa.int64(), "text": pa.string(),
              "mask_start": pa.int64(), "mask_end": pa.int64(), "last": pa.bool_()}

    def run(batches):
        now, turns, out, chars = None, [], [], 0

        def written():
            conv, piece = now
            text, start, n = "".join(t[0] for t in turns), turns[0][1], turns[0][5]
            at, done, tail = 0, turns[0][4], 0
            for segment, _, lo, hi, _, _ in turns:
                at += len(segment)
                if lo is not None:
                    yield conv, done, piece, start, text[:at], lo, hi, done == n - 1
                    done, tail = done + 1, at
            for later in range(done, n):
                yield conv, later, piece, start, text, None, None, later == n - 1
            if done == n and tail < at:
                yield conv, None, piece, start + tail, text[tail:], None, None, True

        def flush():
            nonlocal chars
            for row in written() if turns else ():
                out.append(row)
                chars += len(row[4])
                if chars > 1 << 22 or len(out) >= 5000:
                    yield _table(schema, out)
                    out.clear()
                    chars = 0
            turns.clear()

        for b in batches:
            for conv, piece, *turn in zip(*(c.to_pylist() for c in b.columns)):
                if (conv, piece) != now:
                    yield from flush()
                    now = (conv, piece)
                turns.append(turn)
        yield from flush()
        yield _table(schema, out)

    e = examples.withColumn("piece", F.floor(F.col("segment_start") / size).cast("long"))
    e = e.repartition(partitions(examples.sparkSession), "conv_id", "piece").sortWithinPartitions("conv_id", "piece", "position")
    e = e.select("conv_id", "piece", "segment", "segment_start", "mask_start", "mask_end", "earlier", "examples")
    return e.mapInArrow(run, "conv_id long, example long, piece long, start long, text string, mask_start long, mask_end long, last boolean")


def expand(examples: DataFrame) -> DataFrame:
    """(conv_id, example, text, mask_start, mask_end): the pieces of each example put together, for consumers that want one row."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda s: s["text"]), "")
    g = pieces(examples).where("example is not null").groupBy("conv_id", "example")
    return g.agg(text.alias("text"), F.max("mask_start").alias("mask_start"), F.max("mask_end").alias("mask_end"))


def _read_pieces(written: DataFrame) -> DataFrame:
    """(conv_id, piece, example, chars, trained, turns): length and trained text of the pieces; turns of the last example and behind it."""
    schema = {"conv_id": pa.int64(), "piece": pa.int64(), "example": pa.int64(), "chars": pa.int64(), "trained": pa.string(), "turns": pa.string()}

    def run(batches):
        for b in batches:
            out, rest = [], {}
            for conv, example, piece, start, text, lo, hi, last in zip(*(c.to_pylist() for c in b.columns)):
                chars = 0 if example is None else len(text)
                if lo is None and not last:
                    rest[conv, piece] = rest.get((conv, piece), 0) + chars
                    continue
                out.append((conv, piece, example, chars, None if lo is None else unescape(text[lo - start : hi - start]), text if last else None))
            out += [(conv, piece, None, chars, None, None) for (conv, piece), chars in rest.items()]
            yield _table(schema, out)

    return written.mapInArrow(run, "conv_id long, piece long, example long, chars long, trained string, turns string")


def read_back(examples: DataFrame, block: int | None = None) -> DataFrame:
    """What the written examples say, per conversation: turns and trained texts with their digests, characters of all examples.

    A digest of a whole conversation has to pass its turns in order, so a task streams them and keeps two hash states.
    """
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    schema = dict(zip(("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), kinds))

    def run(batches):
        now, state, out = object(), None, []

        def close():
            if state is not None:
                n, turns, chars, loss, size = state
                out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for b in batches:
            for conv, chars, trained, turns in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += chars
                if trained is not None:
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                for segment in turns.split(END)[:-1] if turns is not None else ():
                    role, text = read_turn(segment + END)
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
            if len(out) >= 5000:
                yield _table(schema, out)
                out.clear()
        close()
        yield _table(schema, out)

    e = _read_pieces(pieces(examples, block)).repartition(partitions(examples.sparkSession), "conv_id")
    e = e.sortWithinPartitions("conv_id", "piece", F.col("example").asc_nulls_last()).select("conv_id", "chars", "trained", "turns")
    return e.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def control_conversation(spark) -> DataFrame:
    """A conversation whose texts are made of another template's control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


ORACLE = """
with a as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
b as (
  select *, 16 + length(replace(replace(replace(role, '\\', '\\0'), '<', '\\1'), '[', '\\2'))
    + length(replace(replace(replace(text, '\\', '\\0'), '<', '\\1'), '[', '\\2')) as chars from a),
c as (select *, sum(chars) over (partition by conv_id order by turn, role, text rows unbounded preceding) as upto from b)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  coalesce(sum(upto) filter (role = 'assistant'), 0)::bigint as formatted_chars
from c group by conv_id
"""
