"""Chat formatting by rotating the perspective over all participants of a dialogue.

Each dialogue is rendered once for every participant: that speaker's turns as the assistant's, the others' as those
of named users. A narrator (the system) speaks in every rendering and has none of its own. A rendering comes as one row per
turn with its place in the whole text and the part that counts for the loss, so a dialogue of any length is
never put together in one task.

Places need lengths, not texts. As if everybody were a user, turns have places that are running sums; in the rendering of one speaker,
each of that speaker's earlier turns is shorter by the same number of characters. So:

1. (dialogue, turn, speaker, digest, length) of every turn, repeated ones counted, are sorted by range. Each partition sums up its
   turns and counts how often each speaker has spoken before.
2. A dialogue inside one partition is then complete. Of those that may go on in another, one row per partition and speaker carries
   the sums over the partitions before.
3. Texts move once, to meet their places; renderings fan out behind that, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

OPEN, CLOSE, MARK, ESCAPED = "<|im_start|>", "<|im_end|>\n", "<|im_", "<\\|im_"
#: Turns of a dialogue that a partition holds back until it has seen all of them.
HELD = 20_000
#: Copies of one turn that are written out in one go.
COPIES = 10_000


def without_marks(text: Column) -> Column:
    """A backslash behind the ``<`` of what would be a mark."""
    return F.replace(text, F.lit(MARK), F.lit(ESCAPED))


def _name(speaker: Column) -> Column:
    return F.regexp_replace(without_marks(speaker), "[\r\n]", " ")


def _sum_up(narrators: tuple[str, ...], names: list[str]):
    """Of sorted rows (conv_id, turn, speaker, digest, n, copies, width): with the place in the partition's share of the dialogue, as if all were users, and who has spoken how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema: pa.Schema | None = None
        conv, held, place, counts, first, spilled = None, [], 0, {}, True, False

        def emit(rows: list[tuple], whole: bool) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            told = [[{"p": p, "n": n.get(p, 0)} for p in (counts if whole else n)] for n in cols[-1]]
            arrays = [pa.array(c, schema.field(k).type) for k, c in enumerate(cols[:-2])]
            arrays += [pa.array(cols[-2], pa.int64()), pa.array(told, pa.list_(pa.struct([("p", pa.string()), ("n", pa.int64())])))]
            arrays += [pa.array([whole] * len(rows)), pa.array([part] * len(rows), pa.int32())]
            return pa.RecordBatch.from_arrays(arrays, [*names, "place", "told", "whole", "part"])

        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv is None or row[0] != conv[0]:
                    if held:
                        yield emit(held, not first and not spilled)
                    first = conv is None
                    conv, held, place, counts, spilled = (row[0],), [], 0, {}, False
                held.append((*row, place, dict(counts)))
                place += row[6] * row[5]
                if row[2] not in narrators:
                    counts[row[2]] = counts.get(row[2], 0) + row[5]
                if len(held) >= HELD:
                    yield emit(held, False)
                    held, spilled = [], True
        if held:
            yield emit(held, False)

    return run


def _with_carried(open_rows: DataFrame) -> DataFrame:
    """Places and counts of dialogues that span partitions, with those of the partitions before."""
    spoken = open_rows.groupBy("conv_id", "part", "speaker").agg(F.sum(F.col("width") * F.col("copies")).alias("w"), F.sum("copies").alias("c"), F.first("narrates").alias("narrates"))
    shares = spoken.groupBy(F.col("conv_id").alias("c1"), F.col("part").alias("q1")).agg(F.sum("w").alias("w"))
    cast = spoken.where("not narrates").select(F.col("conv_id").alias("c2"), F.col("speaker").alias("p")).distinct()
    said = spoken.where("not narrates").select(F.col("conv_id").alias("c3"), F.col("part").alias("q3"), F.col("speaker").alias("p3"), "c")
    grid = shares.join(cast, F.col("c1").eqNullSafe(F.col("c2")), "left")
    grid = grid.join(said, F.col("c1").eqNullSafe(F.col("c3")) & (F.col("q1") == F.col("q3")) & (F.col("p") == F.col("p3")), "left")
    before = Window.partitionBy("c1", "p").orderBy("q1").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select("c1", "q1", "p", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("n"))
    carried = grid.groupBy("c1", "q1").agg(F.first("w").alias("w"), F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "n"))).alias("cast"))
    rows = open_rows.join(carried, F.col("conv_id").eqNullSafe(F.col("c1")) & (F.col("part") == F.col("q1")))
    told = F.expr("transform(cast, x -> struct(x.p as p, x.n + coalesce(try_element_at(map_from_entries(told), x.p), 0L) as n))")
    return rows.withColumn("place", F.col("place") + F.col("w")).withColumn("told", told)


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    narrators: tuple[str, ...] = ("system",),
) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, segment, start, loss_start, loss_end, in_loss.

    ``start`` is the number of characters before the segment in its rendering; ``loss_start`` and ``loss_end`` bound the
    part of it that is trained on (the assistant's words and the mark that ends them) and are equal elsewhere.
    Null text counts as empty, a null speaker as one named "unknown", a null dialogue as a dialogue of its own; a null turn
    comes first. Turns that tie are ordered by speaker and the MD5 of the text; repeated rows are repeated turns. What spells
    a mark in a text or a name gets a backslash behind its ``<``, and a line break in a name becomes a blank, so neither can open or end a turn.
    A dialogue of narrators alone has no rendering. A text of any length counts whole. An empty table gives an empty result; other columns
    are ignored, whatever they are called.
    """
    small_batches(turns.sparkSession, 5000)
    base = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"),
    ).withColumn("digest", F.md5("body"))
    sized = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    key = F.unhex(F.md5(F.concat(sized("conv_id"), sized("turn"), "digest", "speaker"))).alias("key")

    lengths = base.select("conv_id", "turn", "speaker", F.unhex("digest").alias("digest"), F.char_length(without_marks(F.col("body"))).cast("long").alias("n"))
    lengths = lengths.groupBy(*lengths.columns).agg(F.count(F.lit(1)).alias("copies"))
    narrates = F.col("speaker").isin(*narrators)
    head = F.when(narrates, F.char_length("speaker")).otherwise(F.char_length(_name(F.col("speaker"))) + len("user name="))
    lengths = lengths.withColumn("width", F.col("n") + head + len(OPEN) + 1 + len(CLOSE))
    order = ["conv_id", "turn", "speaker", "digest"]
    kinds = dict(lengths.dtypes)
    names = lengths.columns
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "place long, told array<struct<p string, n long>>, whole boolean, part int"])
    placed = lengths.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sum_up(narrators, names), schema)
    placed = materialize(placed.withColumn("narrates", F.col("speaker").isin(*narrators)), "places")
    needed = ["conv_id", "turn", "speaker", "digest", "n", "copies", "width", "place", "told"]
    ready = placed.where("whole").select(*needed).unionByName(_with_carried(placed.where("not whole")).select(*needed))
    ready = ready.withColumn("digest", F.lower(F.hex("digest"))).withColumn("key", key).drop("digest")

    bodies = base.select(key, "body").dropDuplicates(["key"])
    rows = ready.where(F.col("copies") <= COPIES).join(bodies, "key").withColumn("from", F.lit(0).cast("long"))
    if placed.where(F.col("copies") > COPIES).limit(1).count():
        # Copies of one turn stand behind each other; very many are dealt to several tasks before they are written out.
        many = ready.where(F.col("copies") > COPIES).join(bodies, "key").withColumn("from", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)")))
        rows = rows.unionByName(many.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("to", F.least(F.col("from") + COPIES, F.col("copies")) - 1)
    rows = rows.withColumn("copy", F.explode(F.sequence("from", "to"))).withColumn("view", F.explode("told"))
    mine = F.col("speaker") == F.col("view.p")
    role = F.when(mine, "assistant").when(F.col("speaker").isin(*narrators), F.col("speaker")).otherwise("user")
    # What each earlier turn of the perspective is shorter by, as the assistant's.
    less = F.char_length(_name(F.col("view.p"))) + (len("user name=") - len("assistant"))
    rows = rows.select(
        "conv_id",
        F.col("view.p").alias("perspective"),
        "turn",
        "speaker",
        role.alias("role"),
        "body",
        (F.col("place") + F.col("copy") * F.col("width") - less * (F.col("view.n") + F.when(mine, F.col("copy")).otherwise(0))).alias("start"),
        mine.alias("in_loss"),
    )
    opened = F.concat(F.lit(OPEN), "role", F.when(F.col("role") == "user", F.concat(F.lit(" name="), _name(F.col("speaker")))).otherwise(""), F.lit("\n"))
    rows = rows.withColumn("head", opened).withColumn("segment", F.concat("head", without_marks(F.col("body")), F.lit(CLOSE)))
    return rows.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "role",
        "segment",
        "start",
        F.when(F.col("in_loss"), F.col("start") + F.char_length("head")).otherwise(F.col("start")).alias("loss_start"),
        F.when(F.col("in_loss"), F.col("start") + F.char_length("segment") - 1).otherwise(F.col("start")).alias("loss_end"),
        "in_loss",
    )
