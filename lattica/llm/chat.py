"""Multi-party chat formatting with perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users; the mask holds the assistant's texts with their end
marks. Narrators (system) are rendered as such and have no perspective of their own.

A rendering comes in parts of consecutive turns: part k holds turns k * TURNS to
k * TURNS + TURNS - 1, so one part for all but very long conversations, and parts in order
make the whole. A part is rendered as a stream; a conversation of any length is spread over
the cluster by part, and more than TURNS messages in a part's turns start a further row
(piece). whole_dialogues puts the parts of a conversation together to one text, so that nobody's
context ends at a part's border, for all conversations whose rendering has at most MAX_CHARS code
points; longer ones stay in parts. Rows that are the whole of their conversation (nearly all)
know it when they are rendered and move no further; the others' parts meet by conversation.
Output grows with turns times participants, as the rotation itself does.

Turns are ordered by number, then speaker, then text (nulls first); a repeated row is the same
message and shown once. A null text is empty, a null speaker is "unknown", null turns are
part -1, and rows without conv_id form one conversation. A conversation of narrators only
has no perspective and gives no row. Very long texts are rendered whole. Messages without a turn
number are ordered among themselves in one task for each conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lattica.llm.common import written

TURNS = 256
#: Code points of a rendering that is put together to one row.
MAX_CHARS = 1 << 20
NARRATORS = ("system",)
END = "<|end|>"

_SPAN = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])


def head(speaker: str, perspective: str, narrators: tuple[str, ...] = NARRATORS) -> str:
    """What stands before a message."""
    if speaker in narrators:
        return f"<|{speaker}|>\n"
    return "<|assistant|>\n" if speaker == perspective else f"<|user name={speaker}|>\n"


class _Piece:
    """What has been rendered of one part, for all perspectives."""

    def __init__(self, key: tuple, speakers: list[str], narrators: tuple[str, ...], alone: bool) -> None:
        self.key, self.speakers, self.narrators, self.alone = key, speakers, narrators, alone
        self.number = 0
        self.last: tuple | None = None
        self._start()

    def _start(self) -> None:
        self.turns = 0
        self.texts: dict[str, list[str]] = {p: [] for p in self.speakers}
        self.at = dict.fromkeys(self.speakers, 0)
        self.masks: dict[str, list[dict]] = {p: [] for p in self.speakers}

    def add(self, turn: int | None, speaker: str, text: str) -> bool:
        """Whether the piece is full."""
        if (turn, speaker, text) == self.last:
            return False
        self.last = (turn, speaker, text)
        self.turns += 1
        for p in self.speakers:
            before = head(speaker, p, self.narrators)
            if speaker == p:
                begin = self.at[p] + len(before)
                self.masks[p].append({"start": begin, "end": begin + len(text) + len(END)})
            whole = f"{before}{text}{END}\n"
            self.texts[p].append(whole)
            self.at[p] += len(whole)
        return self.turns >= TURNS

    def rows(self, last: bool) -> Iterator[tuple]:
        if self.turns:
            sole, longest = last and self.alone and self.number == 0, max(self.at.values())
            for p in self.speakers:
                yield (*self.key, self.number, p, self.turns, "".join(self.texts[p]), self.masks[p], sole, longest)
        self.number += 1
        self._start()


def rotate_perspectives(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """conv_id, part, piece, perspective, n_turns, text, mask (spans in code points of this row's text), sole
    (surely the whole of its conversation from this perspective), longest (code points of the piece's
    longest text of all perspectives)."""
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.coalesce(F.floor(F.col(f"`{turn}`") / TURNS), F.lit(-1)).cast("long").alias("part"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{speaker}`").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    # who takes part travels to each part as a row of its own, so texts are shuffled once
    parts = rows.select("conv_id", "part").distinct()
    cast = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.when(~F.col("speaker").isin(*narrators), F.col("speaker")))).alias("cast")).where(F.size("cast") > 0)
    cast = cast.withColumnRenamed("conv_id", "own")
    alone = parts.groupBy(F.col("conv_id").alias("one")).agg((F.count("*") == 1).alias("alone"))
    parts = parts.join(alone, F.col("conv_id").eqNullSafe(F.col("one"))).drop("one")
    casts = parts.join(cast, F.col("conv_id").eqNullSafe(F.col("own"))).select("conv_id", "part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("text"), "cast", "alone")
    told = rows.select("conv_id", "part", F.lit(1).alias("kind"), "turn", "speaker", "text", F.lit(None).cast("array<string>").alias("cast"), F.lit(None).cast("boolean").alias("alone"))
    both = casts.unionByName(told).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "kind", "turn", "speaker", "text")
    schema = T.StructType(
        [
            both.schema["conv_id"],
            T.StructField("part", T.LongType()),
            T.StructField("piece", T.LongType()),
            T.StructField("perspective", T.StringType()),
            T.StructField("n_turns", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("mask", T.ArrayType(_SPAN, False)),
            T.StructField("sole", T.BooleanType()),
            T.StructField("longest", T.LongType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rendered() -> Iterator[tuple]:
            piece: _Piece | None = None
            for batch in batches:
                for conv, part, kind, number, who, said, cast, alone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if piece and piece.key != (conv, part):
                        yield from piece.rows(True)
                        piece = None
                    if kind == 0:
                        piece = _Piece((conv, part), cast, narrators, alone)
                    elif piece and piece.add(number, who, said):
                        yield from piece.rows(False)
            if piece:
                yield from piece.rows(True)

        waiting: list[tuple] = []
        size = 0
        for row in rendered():
            waiting.append(row)
            size += len(row[5])
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), arrow, strict=True)], names=arrow.names)
                waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), arrow, strict=True)], names=arrow.names)

    return both.mapInArrow(run, schema)


def whole_dialogues(rendered: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """rotate_perspectives' rows with each conversation's parts put together to one row (part and piece NULL,
    mask over the whole text); conversations of more than max_chars from any perspective stay in parts.
    rendered is written first, so that it is computed once."""
    rendered = written(rendered, "zstd")  # texts of several perspectives are much alike
    columns = [c for c in rendered.columns if c not in ("sole", "longest")]
    none, short = F.lit(None).cast("long"), F.col("longest") <= max_chars
    own = rendered.where("sole").withColumns({c: F.when(short, none).otherwise(F.col(c)) for c in ("part", "piece")})
    split = rendered.where("not sole")
    sizes = split.groupBy("conv_id", "perspective").agg(F.sum(F.length("text")).alias("size")).groupBy("conv_id").agg(F.max("size").alias("size"))
    sizes = sizes.select(F.col("conv_id").alias("own"), (F.col("size") <= max_chars).alias("short"))
    marked = split.join(sizes, F.col("conv_id").eqNullSafe(F.col("own")))
    parts = F.array_sort(F.collect_list(F.struct("part", "piece", "n_turns", "text", "mask")))
    whole = marked.where("short").groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    shifted = lambda p, by: F.transform(p["mask"], lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(rendered.schema["mask"].dataType).alias("mask"))
    masks = F.aggregate("parts", start, lambda state, p: F.struct((state["at"] + F.length(p["text"])).alias("at"), F.concat(state["mask"], shifted(p, state["at"])).alias("mask")))
    turns = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n_turns"])
    made = {"part": none, "piece": none, "n_turns": turns, "text": F.array_join("parts.text", ""), "mask": masks["mask"]}
    together = whole.withColumns(made).select(*columns)
    return own.select(*columns).unionByName(together).unionByName(marked.where("not short").select(*columns))
