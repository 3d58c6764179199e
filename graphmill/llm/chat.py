"""Chat formatting in budgeted windows.

Turns of a conversation, in order, are laid out by prefix sums of their tokens. The line of tokens is
ruled into strides; a window holds the turns that start in one stride, and a turn that reaches over
the stride's end makes a window of its own, so that a window never breaks a turn and keeps to the
budget unless one turn alone is longer. Every window opens with the conversation's system turn, goes
on with limited history (whole turns that start at most ``history`` tokens before the stride and lead
up to it without a gap), and then has its own turns. Only its own assistant turns are under the loss
mask: what is repeated is masked, so each assistant text counts once over all windows.

Sums are taken on two levels, within blocks of turns and over blocks, so that a conversation with very
many turns is spread over tasks. A window's rows are bounded by the budget.

Format: ``### role:\\n``, text, ``</turn>\\n``. Inside texts and roles the signs that could form a marker,
and the escape sign itself, are written ``\\h`` (#), ``\\l`` (<) and ``\\b`` (the escape sign), in roles also
``\\c`` (:) and ``\\n`` (line end); so no text can hold a marker, and ``unescape`` gives it back.

Null role or text is empty. Null turns come first; equal turns are ordered by role and text, repeated
rows are turns of their own. Null conversation ids form one conversation. The first turn is the system
turn if its role is ``system``; later ones are ordinary. Other columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from graphmill.llm.common import slices, text_bytes, write
from graphmill.llm.tokens import ChunkIds

BUDGET, HISTORY = 2048, 256
#: Turns that are summed together on the lower of two levels.
BLOCK = 256
OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"
# Escapes, in the order in which they are put in; they are taken out the other way round.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))


def _escaped(col: str, escapes) -> Column:
    out = F.coalesce(F.col(col).cast("string"), F.lit(""))
    for plain, coded in escapes:
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def unescape(text: str, escapes=ESCAPES) -> str:
    for plain, coded in reversed(escapes):
        text = text.replace(coded, plain)
    return text


def _head() -> Column:
    return F.concat(F.lit(OPEN), _escaped("role", ROLE_ESCAPES), F.lit(MIDDLE))


def _counted(rows: DataFrame, vocabulary: str | None) -> DataFrame:
    """The rows with ``n``, the tokens of the formatted turn."""
    names = [c for c in rows.columns if c != "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkIds(vocabulary)
        for batch in slices(batches, "piece"):
            n = [known.count(t) for t in text_bytes(batch, "piece")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(n, pa.int64())], names=[*names, "n"]
            )

    fields = [rows.schema[c] for c in names]
    return rows.mapInArrow(run, StructType([*fields, StructField("n", LongType())]))


def _placed(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """The rows with ``s`` (tokens before the turn), stride ``k`` and its tokens ``room``; the system turn joins the first."""
    conv = ["c0", "c1"]
    order = [F.asc_nulls_first("turn"), "role", "text"]
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))
    rows = rows.withColumn("block", block)
    first = rows.groupBy(*conv).agg(F.min(F.struct("turn", "role", "text", "n", "block")).alias("first"))
    is_system = F.col("first.role") == "system"
    first = first.select(
        *conv,
        F.when(is_system, F.col("first")).alias("system"),
        F.when(is_system, F.col("first.n")).otherwise(0).alias("lead"),
    )
    totals = rows.groupBy(*conv, "block").agg(F.sum("n").alias("total"))
    before = Window.partitionBy(*conv).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    totals = totals.join(first, conv)
    inside = Window.partitionBy(*conv, "block").orderBy(*order)
    rows = rows.withColumn("s", F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("nth", F.row_number().over(inside))
    rows = rows.join(totals, [*conv, "block"])
    opening = F.col("system").isNotNull() & (F.col("base") + F.col("s") == 0) & (F.col("nth") == 1)
    rows = rows.withColumn("opening", opening)
    rows = rows.withColumn("s", F.greatest(F.col("base") + F.col("s") - F.col("lead"), F.lit(0)))
    rows = rows.withColumn("room", F.greatest(F.lit(budget // 4), budget - 2 * history - F.col("lead")).cast("long"))
    return rows.withColumn("k", F.expr("if(opening, 0, s div room)"))


def windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None
) -> DataFrame:
    """One row per window: conv_id, window (rising), text, loss_spans, repeated (turns at its head), n_turns, n_tokens."""
    spark = turns.sparkSession
    kind = turns.schema["conv_id"].dataType
    rows = turns.select(
        "conv_id",
        F.coalesce("conv_id", F.lit(0).cast(kind)).alias("c0"),
        F.col("conv_id").isNull().alias("c1"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.concat(_head(), _escaped("text", ESCAPES), F.lit(CLOSE)).alias("piece"),
    )
    rows = spark.read.parquet(write(_counted(rows, vocabulary), "turns"))
    rows = _placed(rows, budget, history)

    crossing = "not opening and s > k * room and s + n > (k + 1) * room"
    near = f"not opening and s >= (k + 1) * room - {history}"
    uses = F.expr(f"""filter(array(
        named_struct('k', k, 'part', if({crossing}, 1, 0), 'own', true),
        named_struct('k', if({near} and not ({crossing}), k, -1), 'part', 1, 'own', false),
        named_struct('k', if({near} and n <= {history}, k + 1, -1), 'part', 0, 'own', false)), u -> u.k >= 0)""")
    rows = rows.withColumn("head", _head()).withColumn("body", _escaped("text", ESCAPES))
    used = rows.select(
        "conv_id", "c0", "c1", "s", "n", "opening", "role", "head", "body", "system", F.explode(uses).alias("use")
    )
    turn = F.struct(
        (~F.col("opening")).alias("later"), "s", "body", "head", "n", "opening", F.col("use.own").alias("own"),
        ((F.col("role") == "assistant") & F.col("use.own")).alias("loss"),
    )
    made = used.groupBy("c0", "c1", F.col("use.k").alias("k"), F.col("use.part").alias("part")).agg(
        F.first("conv_id").alias("conv_id"),
        F.sort_array(F.collect_list(turn)).alias("all"),
        F.first(F.struct("system.role", "system.text", "system.n"), ignorenulls=True).alias("system"),
    )
    made = made.withColumn("own", F.expr("filter(all, t -> t.own)")).where("size(own) > 0")
    made = made.withColumn("past", F.expr("filter(all, t -> not t.own)"))
    # History that leads up to the first own turn: nothing is missing between.
    made = made.withColumn(
        "past",
        F.expr("""filter(past, h -> own[0].s - h.s =
            aggregate(filter(past, g -> g.s >= h.s), 0L, (a, g) -> a + g.n))"""),
    )
    made = made.withColumn("role", F.col("system.role")).withColumn("sys", _escaped("system.text", ESCAPES))
    lead = F.when(
        F.col("role").isNotNull() & ~F.col("own")[0]["opening"],
        F.array(F.struct(_head().alias("head"), F.col("sys").alias("body"), F.col("system.n").alias("n"), F.lit(False).alias("loss"))),
    )
    brief = "x -> named_struct('head', x.head, 'body', x.body, 'n', x.n, 'loss', x.loss)"
    made = made.withColumn("lead", F.coalesce(lead, F.expr(f"transform(slice(own, 1, 0), {brief})")))
    made = made.withColumn("turns", F.expr(f"concat(lead, transform(past, {brief}), transform(own, {brief}))"))
    size = f"length(t.head) + length(t.body) + {len(CLOSE)}"
    spans = f"""aggregate(turns, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,length:bigint>>)),
        (a, t) -> named_struct('at', a.at + {size}, 'spans', if(t.loss, concat(a.spans, array(named_struct(
            'start', a.at + length(t.head), 'length', cast(length(t.body) as bigint)))), a.spans)), a -> a.spans)"""
    close = CLOSE.replace("\n", "\\n")
    return made.select(
        "conv_id",
        "c0",
        "c1",
        F.expr("2 * k + part").alias("window"),
        F.expr(f"array_join(transform(turns, t -> concat(t.head, t.body, '{close}')), '')").alias("text"),
        F.expr(spans).alias("loss_spans"),
        F.expr("cast(size(lead) + size(past) as bigint)").alias("repeated"),
        F.expr("cast(size(turns) as bigint)").alias("n_turns"),
        F.expr("aggregate(turns, 0L, (a, t) -> a + t.n)").alias("n_tokens"),
    )


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    out = []
    for piece in text.split(CLOSE)[:-1]:
        role, _, body = piece[len(OPEN) :].partition(MIDDLE)
        out.append((unescape(role, ROLE_ESCAPES), unescape(body)))
    return out


class Digest:
    """What is read back from the windows of one conversation, in order."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, repeated: int, spans: list[dict]) -> None:
        own = parsed(text)[repeated:]
        self.n_turns += len(own)
        self.chars += len(text)
        for role, body in own:
            self.turns.update(f"{role}\n{body}\n".encode())
        for span in spans:
            target = unescape(text[span["start"] : span["start"] + span["length"]])
            self.loss.update(target.encode())
            self.loss_chars += len(target)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(made: DataFrame) -> DataFrame:
    """conv_id and the digests of its windows; windows stream by in order, none is held.

    A digest over a whole conversation is one sequence, so one task reads it, in bounded memory.
    """
    columns = ["conv_id", "c0", "c1", "text", "loss_spans", "repeated"]
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [LongType(), StringType(), LongType(), StringType(), LongType()]
    kind = made.schema["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(done: list[tuple]) -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in done])
            values = [pa.array([x[1][i] for x in done]) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([ids, *values], names=["conv_id", *names])

        current, held, digest = None, None, Digest()
        for batch in slices(batches):
            done = []
            keys = zip(batch.column("c0").to_pylist(), batch.column("c1").to_pylist(), strict=True)
            values = zip(*(batch.column(c).to_pylist() for c in columns[3:]), strict=True)
            for i, (key, (text, spans, repeated)) in enumerate(zip(keys, values, strict=True)):
                if key != current:
                    if current is not None:
                        done.append((held, digest.row()))
                    current, held, digest = key, batch.column("conv_id").slice(i, 1), Digest()
                digest.add(text, repeated, spans)
            if done:
                yield rows(done)
        if current is not None:
            yield rows([(held, digest.row())])

    ordered = made.repartition("c0", "c1").sortWithinPartitions("c0", "c1", "window").select(*columns)
    return ordered.mapInArrow(run, StructType([kind, *map(StructField, names, types)]))
