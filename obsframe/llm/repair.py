"""Structure repair of conversations by parallel Viterbi with rank convergence (Maleki, Musuvathi and Mytkowicz, PPoPP 2014).

Rows are dealt to ranges of (conversation, turn, role, text) and cut into chunks.  Every chunk but the last of a conversation
starts from a speculative vector of costs behind it.  Fix-up passes hand each chunk the vector its successor found and rerun
it from the end until old and new vectors differ by a constant only, for what lies before is then right as it is.  The
stitched backward costs let each chunk be traced forwards on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from obsframe.llm import viterbi
from obsframe.session import discard, scratch, staged

_SPACE = " \t\n\x0b\x0c\r"
_KEYS = ["c", "known", "turn", "role", "mark"]
_ROW_BITS = 33
_SPECULATED = (0, 0, 0, 0)
_EDITS = (
    "c string, last boolean, known boolean, turn long, role string, mark binary, letters string, deletes long, "
    "inserted array<string>, new_role string, cost long"
)


@dataclass(frozen=True)
class RepairParams:
    """Rows of a chunk, and how many fix-up passes may run before chunks that never converge are composed as matrices."""

    chunk_rows: int = 16_384
    passes: int = 4

    def __post_init__(self):
        if self.chunk_rows < 1 or self.passes < 1:
            raise ValueError("chunk_rows and passes are positive")


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the faults that a checksum of ``conv_id:turn`` decides; nulls read as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    kept = plain.withColumn("_fault", fault).filter("_fault <> 0")
    return kept.select(
        "conv_id",
        "turn",
        F.when(F.col("_fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fault") == 1, F.lit("")).when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def conversation_key(conv_id: Column) -> Column:
    """A text that names a conversation, null ones included."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _keyed(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    turn = F.col("turn").cast("long")
    return rows.select(
        conversation_key(F.col("conv_id")).alias("c"),
        turn.isNotNull().alias("known"),
        F.coalesce(turn, F.lit(0).cast("long")).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("mark"),
        text.alias("text"),
    )


def judged(keyed: DataFrame) -> DataFrame:
    """A row for each different row: n copies, blank, truncated, live (the first of its role and text, and not blank).

    Copies meet in the map tasks, and what is first in a conversation returns by a join on the whole key, so neither equal
    rows nor texts said again and again make a hot group.
    """
    told = F.rtrim(F.col("text"), F.lit(_SPACE))
    flagged = keyed.select(*_KEYS, (told == "").alias("blank"), (~F.right(told, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    rows = flagged.groupBy(*_KEYS, "blank", "truncated").agg(F.count("*").alias("n"))
    first = rows.filter(~F.col("blank")).groupBy("c", "role", "mark").agg(F.min(F.struct("known", "turn")).alias("_at"))
    first = first.select("c", "role", "mark", "_at.known", "_at.turn", F.lit(True).alias("_first"))
    return rows.join(first, _KEYS, "left").withColumn("live", F.col("_first").isNotNull()).drop("_first")


def _initial(role: Column) -> Column:
    letter = F.substring(role, 1, 1)
    return F.when(letter.isin("s", "u", "a"), letter).otherwise("o")


def _chunks(rows: DataFrame, p: RepairParams, folder: str) -> DataFrame:
    """Chunks of the ordered rows of each conversation: c, number (from 1), total, items, codes and what status needs.

    Keys are all different, so ranges are even however long a conversation is; the table fixes them.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *_KEYS).sortWithinPartitions(*_KEYS).withColumn("at", F.monotonically_increasing_id())
    ordered.write.parquet(f"{folder}/ordered")
    ordered = rows.sparkSession.read.parquet(f"{folder}/ordered")
    code = F.when(~F.col("live"), "-").when(F.col("truncated"), F.upper(_initial(F.col("role")))).otherwise(_initial(F.col("role")))
    item = F.struct("at", code.alias("code"), "n", "known", "turn", "role", "mark")
    row = F.col("at") - F.shiftleft(F.shiftright("at", _ROW_BITS), _ROW_BITS)
    cut = ordered.select("c", F.shiftright("at", _ROW_BITS).alias("_range"), F.floor(row / p.chunk_rows).alias("_part"), item.alias("item"))
    grouped = cut.groupBy("c", "_range", "_part").agg(F.array_sort(F.collect_list("item")).alias("items"))
    initials = F.transform("items", lambda x: _initial(x["role"]))
    grouped.select("*", initials.alias("initials")).write.parquet(f"{folder}/chunks")
    chunks = rows.sparkSession.read.parquet(f"{folder}/chunks")
    # One small row for each chunk: the only thing of a conversation that meets in one task.
    along = Window.partitionBy("c").orderBy("_range", "_part")
    places = chunks.select("c", "_range", "_part", F.element_at("initials", -1).alias("_own")).select(
        "c",
        "_range",
        "_part",
        F.row_number().over(along).alias("number"),
        F.count("*").over(Window.partitionBy("c")).alias("total"),
        F.lag("_own").over(along).alias("earlier"),
    )
    codes = F.array_join(F.transform(F.filter("items", lambda x: x["code"] != "-"), lambda x: x["code"]), "")
    return staged(chunks.join(places, ["c", "_range", "_part"]).select("c", "number", "total", "items", codes.alias("codes"), "initials", "earlier"))


def _rows_of(frame: DataFrame, schema: str, work) -> DataFrame:
    """Call ``work`` with each row as a dict; it gives tuples of ``schema``."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for row in batch.to_pylist() for x in work(row)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    return frame.mapInArrow(run, schema)


def _tails(chunks: DataFrame, p: RepairParams) -> DataFrame:
    """c, number, tail: the costs, less a constant, behind each chunk of the conversations that have several."""
    several = chunks.filter("total > 1").select("c", "number", "codes", (F.col("number") == F.col("total")).alias("last"))
    tail = F.when(F.col("last"), F.array(*map(F.lit, viterbi.END))).otherwise(F.array(*map(F.lit, _SPECULATED)))

    def start(row: dict):
        yield row["c"], row["number"], row["tail"], list(viterbi.backward(row["codes"], tuple(row["tail"])))

    def fix(row: dict):
        old, new = tuple(row["tail"]), tuple(row["new"])
        same = viterbi.parallel(row["codes"], old, new)
        yield row["c"], row["number"], row["new"], row["head"] if same else list(viterbi.backward(row["codes"], new)), not same

    schema = "c string, number int, tail array<int>, head array<int>"
    state = staged(_rows_of(several.withColumn("tail", tail), schema, start))
    for _ in range(p.passes):
        following = state.select("c", (F.col("number") - 1).alias("number"), F.col("head").alias("_next"))
        handed = several.join(state, ["c", "number"]).join(following, ["c", "number"], "left")
        passed = staged(_rows_of(handed.withColumn("new", F.coalesce("_next", "tail")), f"{schema}, changed boolean", fix))
        state = passed.drop("changed")
        if passed.filter("changed").isEmpty():
            return state.select("c", "number", "tail")
    return _composed(several)


def _composed(several: DataFrame) -> DataFrame:
    """The same from whole steps of the chunks, for rows that carry a difference on for ever.

    A conversation gathers sixteen numbers for each chunk, never rows.
    """
    steps = _rows_of(several, "c string, number int, entries array<long>", lambda r: [(r["c"], r["number"], viterbi.matrix(r["codes"]))])

    def fold(table: pa.Table) -> pa.Table:
        rows, tail, out = sorted(table.to_pylist(), key=lambda r: -r["number"]), viterbi.END, []
        for r in rows:
            out.append((r["c"], r["number"], list(tail)))
            tail = viterbi.product(r["entries"], tail)
        kinds = [("c", pa.string()), ("number", pa.int32()), ("tail", pa.list_(pa.int32()))]
        return pa.Table.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], schema=pa.schema(kinds))

    return staged(steps.groupBy("c").applyInArrow(fold, "c string, number int, tail array<int>"))


def _entries(chunks: DataFrame, tails: DataFrame) -> DataFrame:
    """c, number, entry: the state before each chunk, from the exits of the chunks before it."""
    known = chunks.filter("total > 1").select("c", "number", "codes").join(tails, ["c", "number"])
    exits = _rows_of(known, "c string, number int, exits array<int>", lambda r: [(r["c"], r["number"], viterbi.exits(r["codes"], tuple(r["tail"])))])

    def fold(table: pa.Table) -> pa.Table:
        state, out = viterbi.START, []
        for r in sorted(table.to_pylist(), key=lambda r: r["number"]):
            out.append((r["c"], r["number"], state))
            state = r["exits"][state]
        kinds = [("c", pa.string()), ("number", pa.int32()), ("entry", pa.int32())]
        return pa.Table.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], schema=pa.schema(kinds))

    return exits.groupBy("c").applyInArrow(fold, "c string, number int, entry int")


def _traced(row: dict):
    """An edit row for each item of a chunk, and one for the end of the conversation."""
    tail = tuple(row["tail"]) if row["tail"] else viterbi.END
    state = row["entry"] or viterbi.START
    letters, end = viterbi.trace(row["codes"], state, tail)
    at = iter(letters)
    for x in row["items"]:
        if x["code"] == "-":
            yield row["c"], False, x["known"], x["turn"], x["role"], x["mark"], "", x["n"], [], None, viterbi.DELETE * x["n"]
            continue
        own = next(at)
        inserted, role, state = viterbi.roles(own, state, x["role"])
        price = viterbi.cost(own, x["code"].isupper()) + viterbi.DELETE * (x["n"] - 1)
        yield row["c"], False, x["known"], x["turn"], x["role"], x["mark"], own, x["n"] - 1, inserted, role, price
    if row["number"] == row["total"]:
        own = viterbi.finish(end)
        inserted, _, _ = viterbi.roles(own, end, "")
        yield row["c"], True, True, 0, "", b"", own, 0, inserted, None, viterbi.cost(own, False)


def _status(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """c, gaps, blank, duplicate, truncated, illegal."""
    n = F.col("n")
    counts = rows.groupBy("c").agg(
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("live"), n - 1).otherwise(n)).alias("duplicate"),
        F.sum((F.col("live") & F.col("truncated")).cast("long")).alias("truncated"),
        F.sum(n - 1).alias("_copies"),
    )
    turns = rows.filter("known").groupBy("c", "turn").agg(F.lit(1).alias("_one")).groupBy("c").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps")
    )
    line = F.when(F.col("earlier").isNotNull(), F.concat(F.array("earlier"), "initials")).otherwise(F.col("initials"))
    pairs = F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line)), lambda a, b: F.concat(a, b))
    bad = chunks.select("c", F.size(F.filter(pairs, lambda x: ~x.isin("su", "ua", "au"))).alias("_bad")).groupBy("c").agg(F.sum("_bad").alias("_bad"))
    joined = counts.join(bad, "c").join(turns, "c", "left")
    # Copies of a row stand side by side, and a role may not follow itself.
    return joined.select("c", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", (F.col("_bad") + F.col("_copies")).alias("illegal"))


def plan(rows: DataFrame, p: RepairParams = RepairParams()) -> tuple[DataFrame, DataFrame]:
    """(edits, status) of the cheapest repair of each conversation.

    rows: conv_id, turn, role, text and any other columns, which are not read.  Null roles and texts read as one space; null
    conversations are one; null turns come first and make no gap; rows of one turn are ordered by role and text hash; equal
    rows are copies of one; an empty table gives no rows.

    A row is blank (only spaces, tabs, line breaks), else duplicate (its role and text stand earlier), else truncated (it
    ends in none of ``.!?``).  Blank and duplicate rows are deleted.  edits has a row for each different row, in the order
    (c, last, known, turn, role, mark): letters of the edits up to its first copy, copies deleted behind it, roles of the rows
    inserted before it, its new role (null if deleted) and the cost; and one with ``last`` set for the end.
    """
    folder = scratch(rows.sparkSession)
    seen = judged(_keyed(rows))
    seen.write.parquet(f"{folder}/judged")
    seen = rows.sparkSession.read.parquet(f"{folder}/judged")
    chunks = _chunks(seen, p, folder)
    status = staged(_status(seen, chunks))
    if chunks.filter("total > 1").isEmpty():
        told = chunks.withColumns({"tail": F.lit(None).cast("array<int>"), "entry": F.lit(None).cast("int")})
    else:
        tails = _tails(chunks, p)
        told = chunks.join(tails.join(_entries(chunks, tails), ["c", "number"]), ["c", "number"], "left")
    edits = staged(_rows_of(told.select("c", "number", "total", "items", "codes", "tail", "entry"), _EDITS, _traced))
    discard(rows.sparkSession, folder)
    return edits, status


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits with the text of each row that stays: the repaired conversations, row by row."""
    texts = _keyed(rows).groupBy(*_KEYS).agg(F.first("text").alias("text"))
    stays = edits.filter("new_role IS NOT NULL").join(texts, _KEYS)
    gone = edits.filter("new_role IS NULL").withColumn("text", F.lit(None).cast("string"))
    return stays.unionByName(gone)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["c", "cost", "audit", "repaired_sha256"]
    key, price, letters, digest, rows = None, 0, [], hashlib.sha256(), 0

    def done():
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, price, "".join(letters), digest.hexdigest())], names=names)

    for batch in batches:
        for r in batch.to_pylist():
            if r["c"] != key:
                if key is not None:
                    yield done()
                key, price, letters, digest, rows = r["c"], 0, [], hashlib.sha256(), 0
            price += r["cost"]
            letters.append(r["letters"] + "D" * r["deletes"])
            told = [(x, "") for x in r["inserted"]] + ([(r["new_role"], r["text"])] if r["new_role"] is not None else [])
            for role, text in told:
                digest.update(("\n" if rows else "").encode() + role.encode() + b":" + text.encode())
                rows += 1
    if key is not None:
        yield done()


def digests(told: DataFrame) -> DataFrame:
    """c, cost, audit and the hash of the repaired conversation.

    An audit is one text and SHA-256 reads its input in order, so here a conversation passes through one task as a stream;
    the repair itself does not.
    """
    n = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["c", "last", "known", "turn", "role", "mark"]
    return told.repartition(n, "c").sortWithinPartitions(*order).mapInArrow(
        _digest_batches, "c string, cost long, audit string, repaired_sha256 string"
    )
