"""Roles and turns of chat transcripts by a hidden Markov model, and their canonical form."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.llm.language_id import fold
from sonarium.session import materialize

ROLES = ("system", "user", "assistant")
#: Speaker markers that a line may begin with, by role.
MARKERS = {"system": ("system", "context", "note"), "user": ("user", "human", "q", "question"), "assistant": ("assistant", "ai", "bot", "a", "answer")}
_MARKER = r"^\s*([A-Za-z]{1,9})\s*:\s?"
_LENGTHS = 12
#: 4 kinds of marker, ends with a question mark or not, length class (0: a blank line).
SYMBOLS = 4 * 2 * _LENGTHS
#: What a line does: it begins a turn, goes on with one, or is the blank between a turn and the next. A state is a role
#: and one of these; the role of a gap is that of the turn before.
BEGIN, INSIDE, GAP = KINDS = range(3)
STATES = len(KINDS) * len(ROLES)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Bytes of a transcript in one row; a longer one goes on in further rows.
PIECE_BYTES = 1 << 20
#: Bytes of turns that one task puts into order.
PART_BYTES = 64 << 20


def _marker_kind(line: Column) -> Column:
    """0 without a known marker, else 1 + the role's place."""
    word = F.lower(F.regexp_extract(line, _MARKER, 1))
    kind = F.lit(0)
    for i, role in enumerate(ROLES):
        kind = F.when(word.isin(*MARKERS[role]), i + 1).otherwise(kind)
    return kind


def symbol(line: Column) -> Column:
    """What the model observes of a line."""
    length = F.least(F.floor(F.log2(F.length(F.trim(line)) + 1)).cast("int"), F.lit(_LENGTHS - 1))
    asks = F.rtrim(line).endswith("?").cast("int")
    return ((_marker_kind(line) * 2 + asks) * _LENGTHS + length).cast("int")


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def prior() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pseudo-counts that let markers decide where nothing was learned; no role follows itself but by going on.

    Zeros are impossible: to go on with a turn that has not begun or that a gap has ended, and gaps with text.
    """
    start, step, emit = np.full(STATES, 0.1), np.full((STATES, STATES), 0.1), np.full((STATES, SYMBOLS), 0.05)
    role, kind = np.divmod(np.arange(STATES), len(KINDS))
    start[kind == BEGIN] += 1
    start[kind == INSIDE] = 0
    same = role[:, None] == role
    text, begin, inside, gap = kind[:, None] != GAP, kind == BEGIN, kind == INSIDE, kind == GAP
    step[text & same & inside] += 1
    step[text & ~same & begin] += 0.5
    step[text & same & gap] += 0.5
    step[~text & ~same & begin] += 1
    step[(~text | ~same) & inside] = 0
    step[~same & gap] = 0
    emit[gap] = 0
    emit[gap, 0] = 1
    for r in range(len(ROLES)):
        emit[len(KINDS) * r + BEGIN, (r + 1) * 2 * _LENGTHS : (r + 2) * 2 * _LENGTHS] += 1
    return start, step, emit


def train(lines: DataFrame) -> Model:
    """Count states over ``conv, turn, n, symbol, role, kind`` with known roles (:func:`known_lines`).

    Lines within a turn follow one another; between turns a step is counted where turn numbers follow one another. The
    driver gets counts of states, symbols and steps only.
    """
    number = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int")
    known = lines.where(F.coalesce(number, F.lit(0)) > 0).withColumn("r", number - 1)
    start, step, emit = prior()
    kinds = len(KINDS)
    for row in known.where(F.col("kind") != GAP).groupBy("r", "kind", "symbol").count().collect():
        emit[kinds * row.r + row.kind, row.symbol] += row["count"]
    last = F.count_if(F.col("kind") == INSIDE)
    turns = known.groupBy("conv", "turn").agg(F.max("r").alias("r"), last.alias("last"), F.max((F.col("kind") == GAP).cast("int")).alias("gap"))
    shape = turns.groupBy("r").agg(F.sum((F.col("last") > 0).cast("bigint")).alias("some"), F.sum(F.greatest(F.col("last") - 1, F.lit(0))).alias("more"))
    for row in shape.collect():
        step[kinds * row.r + BEGIN, kinds * row.r + INSIDE] += row.some
        step[kinds * row.r + INSIDE, kinds * row.r + INSIDE] += row.more
    after = turns.select("conv", (F.col("turn") - 1).alias("turn"), F.col("r").alias("s"), F.col("gap").alias("parted"))
    for row in turns.join(after, ["conv", "turn"]).groupBy("r", (F.col("last") > 0).alias("inside"), "s", "parted").count().collect():
        if row.s == row.r:
            continue
        state, gap, begin = kinds * row.r + (INSIDE if row.inside else BEGIN), kinds * row.r + GAP, kinds * row.s + BEGIN
        if row.parted:
            step[state, gap] += row["count"]
            state = gap
        step[state, begin] += row["count"]
    for row in turns.where("turn = 0").groupBy("r").count().collect():
        start[kinds * row.r + BEGIN] += row["count"]
    with np.errstate(divide="ignore"):
        return Model(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), np.log(emit / emit.sum(1, keepdims=True)))


def viterbi(model: Model, symbols: np.ndarray, first: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """The best states, given the scores of the first line's states and what each last state gains afterwards."""
    score = first + model.emit[:, symbols[0]]
    back = np.empty((len(symbols), STATES), np.int8)
    for i in range(1, len(symbols)):
        ways = score[:, None] + model.step
        back[i] = ways.argmax(0)
        score = ways.max(0) + model.emit[:, symbols[i]]
    path = np.empty(len(symbols), np.int64)
    path[-1] = (score if last is None else score + last).argmax()
    for i in range(len(symbols) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def passage(model: Model, symbols: np.ndarray) -> np.ndarray:
    """Best score from each state of the first line to each state of the last one, emissions included."""
    score = np.full((STATES, STATES), -np.inf)
    np.fill_diagonal(score, model.emit[:, symbols[0]])
    for s in symbols[1:]:
        score = (score[:, :, None] + model.step[None]).max(1) + model.emit[:, s]
    return score


_EDGE_SCHEMA = "conv string, piece bigint, score binary"
_JOINT_SCHEMA = "conv string, piece bigint, before int, begin int, last int, after int"
_OUT_SCHEMA = "conv string, piece bigint, n bigint, role string, begins boolean, gap boolean, rendered string"


def _edges(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [passage(model, np.array(symbols, np.int64)).tobytes() for symbols in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("piece"), pa.array(scores, pa.binary())], ["conv", "piece", "score"])

    return run


def _joints(model: Model):
    """For each piece of a conversation the states of its first and last line, and those of their neighbours."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        places = table.column("piece").to_pylist()
        if len(set(places)) < len(places):
            raise ValueError("a piece of a transcript comes twice")
        scores = [np.frombuffer(score).reshape(STATES, STATES) for score in table.column("score").to_pylist()]
        reach, ways = model.start, []
        for i, score in enumerate(scores):
            via = reach[:, None] + model.step if i else np.diag(reach) + np.where(np.eye(STATES) > 0, 0, -np.inf)
            whole = via.max(0)[:, None] + score
            ways.append((via.argmax(0), whole.argmax(0)))
            reach = whole.max(0)
        last, after, rows = int(reach.argmax()), None, []
        for i in range(len(scores) - 1, -1, -1):
            begin = int(ways[i][1][last])
            before = int(ways[i][0][begin]) if i else None
            rows.append((before, begin, last, after))
            last, after = before, begin
        states = [pa.array(v, pa.int32()) for v in zip(*reversed(rows))]
        return pa.table([table.column("conv"), table.column("piece"), *states], ["conv", "piece", "before", "begin", "last", "after"])

    return run


def _only(state: int) -> np.ndarray:
    return np.where(np.arange(STATES) == state, 0.0, -np.inf)


def _render(lines: list[str], cut: list[str | None], path: np.ndarray, after: int | None) -> list[str]:
    """The canonical form, line by line; ``after`` is the state of the line that follows in another piece."""
    kinds = path % len(KINDS)
    follows = np.append(kinds[1:], BEGIN if after is None else after % len(KINDS))
    out = []
    for line, bare, role, kind, then in zip(lines, cut, path // len(KINDS), kinds, follows):
        if kind == GAP:
            out.append("")
            continue
        text = f"{OPEN}{ROLES[role]}\n{line if bare is None else bare}" if kind == BEGIN else f"\n{line}"
        out.append(text + f"{CLOSE}\n" * bool(then != INSIDE))
    return out


def _decode(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["conv", "piece", "lines", "symbols", "cut", "before", "begin", "last", "after"]).to_pylist():
                first = model.start if row["before"] is None else model.step[row["before"]]
                if row["begin"] is not None:
                    first = first + _only(row["begin"])
                path = viterbi(model, np.array(row["symbols"], np.int64), first, None if row["last"] is None else _only(row["last"]))
                n, kinds = len(path), path % len(KINDS)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["conv"]] * n, pa.string()), pa.array([row["piece"]] * n, pa.int64()), pa.array(range(n), pa.int64()),
                    pa.array([ROLES[r] for r in path // len(KINDS)], pa.string()), pa.array(kinds == BEGIN), pa.array(kinds == GAP),
                    pa.array(_render(row["lines"], row["cut"], path, row["after"]), pa.string()),
                ], ["conv", "piece", "n", "role", "begins", "gap", "rendered"])

    return run


def parse(texts: DataFrame, model: Model) -> DataFrame:
    """``conv, piece, n, role, begins, gap, rendered`` for every line of raw transcripts ``conv, text``.

    Only the text is read: its lines, markers and blank lines. A transcript too long for one row goes on in rows with a
    larger ``piece`` (a number; without that column every row is a transcript's whole text), cut between lines. The
    canonical form of a conversation is its ``rendered`` lines by piece and ``n``: a turn opens with its role, its marker
    is taken off, and it is closed; gaps between turns vanish, blank lines within a turn stay.

    A transcript of one row is decoded by itself. For each piece of the others the best scores between the states at
    its ends are computed; a chain of these small tables, one task for a conversation, fixes the states at the cuts, so
    that together the pieces are the best path of the whole. Nothing reaches the driver. Pieces of a null conversation
    count as one conversation if ``piece`` is given. Rows that repeat conversation and piece are an error. A null text
    is empty, and an empty one a single blank line. An empty table gives no rows.
    """
    piece = F.col("piece").cast("bigint") if "piece" in texts.columns else F.lit(None).cast("bigint")
    rows = texts.select(F.col("conv").cast("string").alias("conv"), piece.alias("piece"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    bare = F.transform("lines", lambda line: F.when(_marker_kind(line) > 0, F.regexp_replace(line, _MARKER, "")))
    rows = rows.select("*", F.transform("lines", symbol).alias("symbols"), bare.alias("cut"))
    if "piece" not in texts.columns:
        none = [F.lit(None).cast("int").alias(c) for c in ("before", "begin", "last", "after")]
        return rows.withColumn("piece", F.lit(0).cast("bigint")).select("*", *none).mapInArrow(_decode(model), _OUT_SCHEMA)
    many = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("conv").alias("many"))
    parted = rows.select("conv", "piece", "symbols").join(many, F.col("conv").eqNullSafe(F.col("many")), "left_semi")
    joints = parted.mapInArrow(_edges(model), _EDGE_SCHEMA).groupBy("conv").applyInArrow(_joints(model), _JOINT_SCHEMA)
    joints = materialize(joints, "joints").withColumnsRenamed({"conv": "conv_", "piece": "piece_"})
    joined = rows.join(joints, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("piece") == F.col("piece_")), "left")
    return joined.drop("conv_", "piece_").mapInArrow(_decode(model), _OUT_SCHEMA)


def _entries(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, gap, entry``: what a turn adds to a transcript, in one of four styles by conversation: three
    sets of speaker markers, the second with a blank line between turns, or a blank line and no markers. Roles other than the
    three have no marker. Null texts are empty."""
    # Not the hash that holds conversations out: else a style would be held out of the training.
    style = F.pmod(F.xxhash64(F.coalesce(F.col("conv"), F.lit(""))), F.lit(4)).cast("int")
    marker = F.lit("")
    for i, name in enumerate(ROLES):
        names = F.array(*[F.lit(f"{MARKERS[name][s].capitalize()}: ") for s in range(3)], F.lit(""))
        marker = F.when(F.col("role") == name, F.element_at(names, style + 1)).otherwise(marker)
    rows = turns.select(
        F.col(conv).cast("string").alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    rows = rows.withColumn("style", style).withColumn("gap", F.col("style").isin(1, 3) & (F.coalesce("turn", F.lit(1)) > 0))
    return rows.select("conv", "turn", "role", "style", "gap", F.concat(F.when(F.col("gap"), "\n").otherwise(""), marker, "text").alias("entry"))


def known_lines(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, n, role, style, kind, line, symbol``: the lines of the transcripts with what they are, to learn from."""
    rows = _entries(turns, conv, turn, role, text)
    rows = rows.select("conv", "turn", "role", "style", "gap", F.posexplode(F.split("entry", "\n")).alias("n", "line"))
    place = F.col("n") - F.col("gap").cast("int")
    kind = F.when(place < 0, GAP).when(place == 0, BEGIN).otherwise(INSIDE)
    return rows.select("conv", "turn", "n", "role", "style", kind.alias("kind"), "line", symbol(F.col("line")).alias("symbol"))


def _pieces(most: int):
    """Transcripts from the entries of a task in order: a row ends with its conversation, or where it is long enough."""
    names = ["conv", "piece", "text"]

    def row(conv: str | None, part: int, number: int, entries: list[str]) -> pa.RecordBatch:
        place = pa.array([(part << 32) + number], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), place, pa.array(["\n".join(entries)], pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number, conv, part = [], 0, 0, None, 0
        for batch in batches:
            for new, part, entry in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "entry"))):
                if held and (new != conv or size >= most):
                    yield row(conv, part, number, held)
                    held, size, number = [], 0, number + 1
                conv = new
                held.append(entry)
                size += len(entry.encode()) + 1
        if held:
            yield row(conv, part, number, held)

    return run


def transcripts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                piece_bytes: int = PIECE_BYTES, parts: int | None = None) -> DataFrame:
    """``conv, piece, text``: plain transcripts of turns, in the styles of :func:`_entries`.

    Turns are put into order once, by conversation, number, role and text, over as many parts as their bytes need. A
    conversation is one row unless it is longer than ``piece_bytes`` or a part ends within it; then it goes on in a row
    with a larger ``piece``, so that no task holds a hot conversation. A turn stays whole. Repeated rows are turns of
    their own. A null conversation comes last.
    """
    rows = _entries(turns, conv, turn, role, text)
    if parts is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("entry")), F.lit(0))).first()[0]
        parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    # Rows that are all alike differ in the last number only: they too may lie in several parts.
    rows = rows.withColumn("last", F.col("conv").isNull()).withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    order = ["last", "conv", "turn", "role", "entry", "spread"]
    rows = rows.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    rows = rows.select("conv", F.spark_partition_id().alias("part"), "entry")
    return rows.mapInArrow(_pieces(piece_bytes), "conv string, piece bigint, text string")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as plain transcripts, parsed back from their text into turns with roles and rendered; a quarter
    held out of the training."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    held_out = fold(F.col("conv"), 4) == 2
    model = train(known_lines(turns).where(~held_out))
    texts = materialize(transcripts(turns), "transcripts")
    return parse(texts, model).withColumn("held_out", held_out).withColumnRenamed("conv", "conv_id")
