"""Quoted CSV read by many tasks, although a quoted field may hold line breaks.

A file is read as lines, in splits. Whether a line starts a row depends on
whether it starts inside a quoted field, and that on all lines before it. So each
line is told two things, without looking at others: where it would end if it
started outside quotes, and where if inside. One pass over the lines folds these per
split and joins the lines of rows as if each split started outside quotes. From the
first line on after which both ways to start are outside, these rows are certain;
those before it are guesses. Folding the splits of a file in order gives the state
at each split's start, and only the guesses of splits that start inside are joined
anew. Rows that lie across splits come out as fragments, a few per split, and are put
together by themselves. Splits far smaller than a task's work share a task.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockcast.session import cut

# one field, closed: quoted with doubled quotes, or one that does not start with a quote
FIELD = r'(?:"(?:[^"]++|"")*+"|[^",][^,]*+|)'
CLOSED_FROM_OUTSIDE = rf"(?s)^{FIELD}(?:,{FIELD})*+$"
CLOSED_FROM_INSIDE = rf'(?s)^(?:[^"]++|"")*+"(?:,{FIELD})*+$'
PLACE = ["t", "p", "b", "i"]
TASK_BYTES = 16 << 20  # splits smaller than this share a task
TASKS_A_CORE = 4


def lines_of(spark: SparkSession, paths: str | list[str], latest_file_wins: bool) -> DataFrame:
    """Physical lines with their place, and whether they end inside quotes for both ways to start."""
    return marked_lines(spark.read.option("lineSep", "\n").text(paths).select(
        (F.col("_metadata.file_modification_time") if latest_file_wins else F.lit(None).cast("timestamp")).alias("t"),
        F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), "value",
    ))


def marked_lines(lines: DataFrame) -> DataFrame:
    """The same for lines (t, p, b, value) as they are read, before any shuffle."""
    # most lines hold no such character, and a pattern looks at every one
    line = F.when(F.contains("value", F.lit("\r")), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
    return lines.select("t", "p", "b", F.monotonically_increasing_id().alias("i"), line.alias("line"), *open_after(F.col("value"), line))


def open_after(value: Column, line: Column) -> list[Column]:
    """Whether a line ends inside quotes if it starts outside, and if it starts inside."""
    quoted = F.contains(value, F.lit('"'))
    return [(quoted & ~line.rlike(CLOSED_FROM_OUTSIDE)).alias("out_open"), (~quoted | ~line.rlike(CLOSED_FROM_INSIDE)).alias("in_open")]


def tasks_for(lines: DataFrame) -> int:
    """Tasks that read the lines: a split each, or as many splits as make ``TASK_BYTES``; starting a task costs more than reading a small split."""
    spark, splits = lines.sparkSession, lines.rdd.getNumPartitions()
    together = max(1, TASK_BYTES // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(-(-splits // together), min(splits, TASKS_A_CORE * spark.sparkContext.defaultParallelism))


def runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """Start and end of the lines of each split in a batch of (t, p, b, …)."""
    n = batch.num_rows
    if not n:
        return []
    changes = np.flatnonzero(np.diff(batch.column(2).to_numpy()) != 0) + 1
    path = batch.column(1)
    if n > 1:
        other = pc.not_equal(path.slice(1), path.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        changes = np.union1d(changes, np.flatnonzero(other) + 1)
    edges = [0, *changes.tolist(), n]
    return list(zip(edges, edges[1:]))


PIECES = "t timestamp, p string, b long, i long, text string, part string, kind string, is_first boolean, from_out boolean, from_in boolean, closes boolean"
PIECE_TYPES = (pa.timestamp("us", "UTC"), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.bool_()] * 4)
PIECE_NAMES = ["t", "p", "b", "i", "text", "part", "kind", "is_first", "from_out", "from_in", "closes"]


def guessed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from the lines of whole splits as if each started outside quotes, and what puts them right.

    ``row`` holds a certain row as ``text``, ``guess`` one as ``part`` that is right
    only if its split starts outside; ``tail`` and ``guess_tail`` the open row at the
    end of a split. ``ends`` tells where a split ends for both ways to start, and
    whether a row that is open at its start ends in it. ``is_first`` marks the first
    row of a file that is not blank.
    """
    place, first, held, titled, sure, states = None, None, [], False, False, (False, True, False)

    def ended() -> pa.RecordBatch:
        """The end of a split: its states, and the row that is open there."""
        rows = [(*place, None, None, None, "ends", False, *states)]
        if held:
            rows.append((*place, first, None, "\n".join(held), "tail" if sure else "guess_tail", place[2] == 0 and not titled, None, None, None))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), PIECE_TYPES)], PIECE_NAMES)

    for batch in batches:
        for start, end in runs(batch):
            here = tuple(batch.column(c)[start].as_py() for c in range(3))
            if here != place:
                if place:
                    yield ended()
                # a file starts outside quotes
                place, held, titled, sure, states = here, [], False, here[2] == 0, (False, True, False)
            n, i, lines = end - start, batch.column(3).slice(start, end - start), batch.column(4).slice(start, end - start)
            out_open, in_open = (batch.column(c).slice(start, n).to_numpy(zero_copy_only=False) for c in (5, 6))
            after, was, guesses = np.empty(n, bool), 0, 0 if sure else n
            outer, inner, closes = states
            changing = np.flatnonzero(out_open | ~in_open)  # other lines leave either state as it is
            for at, from_out, from_in in zip(changing.tolist(), out_open[changing].tolist(), in_open[changing].tolist()):
                after[was:at] = outer
                outer, inner, was = from_in if outer else from_out, from_in if inner else from_out, at
                closes = closes or not inner
                if not (sure or outer or inner):
                    sure, guesses = True, at + 1
            after[was:] = outer
            states = outer, inner, closes
            ends = np.flatnonzero(~after) + 1
            if not held:
                first = i[0].as_py()
            if not len(ends):
                held.append("\n".join(lines.to_pylist()))
                continue
            texts, numbers = joined(lines, ends, held), i.to_numpy()[np.concatenate([[0], ends[:-1]])]
            numbers[0] = first
            is_first = np.zeros(len(ends), bool)
            if place[2] == 0 and not titled:
                filled = np.flatnonzero(pc.not_equal(pc.utf8_trim(texts, " "), "").to_numpy(zero_copy_only=False))
                is_first[filled[:1]] = titled = bool(len(filled))
            guess, none = pa.array(ends <= guesses), pa.scalar(None, pa.string())
            kinds = pc.if_else(guess, "guess", "row")
            yield pa.RecordBatch.from_arrays([
                *repeated(place, len(ends)), pa.array(numbers, pa.int64()), pc.if_else(guess, none, texts), pc.if_else(guess, texts, none), kinds,
                pa.array(is_first), *[pa.nulls(len(ends), pa.bool_())] * 3], PIECE_NAMES)
            left = lines.slice(ends[-1])
            held = ["\n".join(left.to_pylist())] if len(left) else []
            if held:
                first = i[int(ends[-1])].as_py()
    if place:
        yield ended()


def joined(lines: pa.Array, ends: np.ndarray, held: list[str]) -> pa.Array:
    """The texts of the rows that end after so many lines; the first one begins with what is held."""
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), lines.slice(0, ends[-1])), "\n")
    return pa.concat_arrays([pa.array(["\n".join([*held, texts[0].as_py()])]), texts.slice(1)]) if held else texts


def repeated(place: tuple, n: int) -> list[pa.Array]:
    return [pa.array([x], k).take(pa.array(np.zeros(n, np.int32))) for x, k in zip(place, TYPES)]


ROWS = "t timestamp, p string, b long, i long, text string, kind string, opener long, is_first boolean"
TYPES = (pa.timestamp("us", "UTC"), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
NAMES = ["t", "p", "b", "i", "text", "kind", "opener", "is_first"]


def joined_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from the lines of whole splits, and fragments: ``head`` closes a row of an earlier split, ``inner`` belongs to one as a whole, ``tail`` opens one.

    ``opener`` is the split in which a fragment's row begins. ``is_first`` marks
    the first row of a file that is not blank.
    """
    place, first, held, inside, kind, opener, titled = None, None, [], False, "row", None, False

    def rest() -> pa.RecordBatch:
        """What is held at the end of a split: a fragment."""
        whole = kind == "head"
        row = (*place, first, "\n".join(held), "inner" if whole else "tail", opener if whole else place[2], not whole and place[2] == 0 and not titled)
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, TYPES)], NAMES)

    for batch in batches:
        for start, end in runs(batch):
            here = tuple(batch.column(c)[start].as_py() for c in range(3))
            if here != place:
                if held:
                    yield rest()
                place, held, inside = here, [], batch.column(7)[start].as_py()
                kind, opener, titled = "head" if inside else "row", batch.column(8)[start].as_py(), False
            i, lines = batch.column(3).slice(start, end - start), batch.column(4).slice(start, end - start)
            out_open, in_open = (batch.column(c).slice(start, end - start).to_numpy(zero_copy_only=False) for c in (5, 6))
            after, was = np.empty(end - start, bool), 0
            for at in np.flatnonzero(out_open | ~in_open).tolist():  # other lines leave the state as it is
                after[was:at] = inside
                inside, was = bool(in_open[at] if inside else out_open[at]), at
            after[was:] = inside
            ends = np.flatnonzero(~after) + 1
            if not held:
                first = i[0].as_py()
            if not len(ends):
                held.append("\n".join(lines.to_pylist()))
                continue
            starts = np.concatenate([[0], ends[:-1]])
            texts = joined(lines, ends, held)
            n, numbers = len(ends), i.to_numpy()[starts]
            numbers[0] = first
            is_first = np.zeros(n, bool)
            if place[2] == 0 and not titled:
                filled = np.flatnonzero(pc.not_equal(pc.utf8_trim(texts, " "), "").to_numpy(zero_copy_only=False))
                is_first[filled[:1]] = titled = bool(len(filled))
            kinds = [kind, *["row"] * (n - 1)]
            openers = pa.array([opener if kind == "head" else None, *[None] * (n - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*repeated(place, n), pa.array(numbers, pa.int64()), texts, pa.array(kinds), openers, pa.array(is_first)], NAMES)
            left = lines.slice(ends[-1])
            held, kind = ["\n".join(left.to_pylist())] if len(left) else [], "row"
            if held:
                first = i[int(ends[-1])].as_py()
    if held:
        yield rest()


def split_starts(lines: DataFrame) -> DataFrame:
    """``starts_inside`` of marked lines."""
    return starts_inside(lines.mapInArrow(guessed_rows, PIECES))


def starts_inside(pieces: DataFrame) -> DataFrame:
    """(p, b, starts_inside, opener) for the splits that start inside quotes, with the split where that row begins; the driver folds three flags per split."""
    inside, file, opener, found = False, None, None, []
    for p, b, from_out, from_in, closes in sorted(pieces.filter("kind = 'ends'").select("p", "b", "from_out", "from_in", "closes").collect()):
        inside = inside and p == file
        if inside:
            found.append((p, b, True, opener))
        if not inside or closes:
            opener = b
        inside, file = from_in if inside else from_out, p
    return pieces.sparkSession.createDataFrame(found, "p string, b long, starts_inside boolean, opener long")


def whole_rows(spark: SparkSession, paths: str | list[str], latest_file_wins: bool = False) -> DataFrame:
    """(t, p, b, i, text, is_first): one row per CSV row, as text; ``is_first`` marks the header of each file."""
    return rows_of(lines_of(spark, paths, latest_file_wins))


def rows_of(lines: DataFrame) -> DataFrame:
    """The same from marked lines, which are read once; their rows are cut to the shared folder."""
    tasks = tasks_for(lines)
    pieces = cut(lines.coalesce(tasks).mapInArrow(guessed_rows, PIECES)).coalesce(tasks)
    starts = starts_inside(pieces)
    row = pieces.filter("kind = 'row'").select(*PLACE, "text", "is_first")
    tails = pieces.filter("kind = 'tail'").select(*PLACE, "part", "is_first", F.col("b").alias("opener"))
    guesses = pieces.filter("kind IN ('guess', 'guess_tail')").select(*PLACE, "part", "kind", "is_first")
    if not starts.isEmpty():
        told = guesses.join(F.broadcast(starts), ["p", "b"], "left")  # one row per split that starts inside quotes
        anew = cut(joined_anew(told.filter("starts_inside")))
        guesses = cut(told.filter("starts_inside IS NULL").select(*guesses.columns)).coalesce(tasks)
        row = row.unionByName(anew.filter("kind = 'row'").select(*row.columns))
        tails = tails.unionByName(anew.filter("kind <> 'row'").select(*PLACE, F.col("text").alias("part"), "is_first", "opener"))
    row = row.unionByName(guesses.filter("kind = 'guess'").select(*PLACE, F.col("part").alias("text"), "is_first"))
    tails = tails.unionByName(guesses.filter("kind = 'guess_tail'").select(*PLACE, "part", "is_first", F.col("b").alias("opener")))
    # no row of a file but those that lie across splits leaves its task
    put = tails.groupBy("p", "opener").agg(
        F.array_sort(F.collect_list(F.struct("b", "i", F.col("part").alias("text")))).alias("parts"), F.min("t").alias("t"), F.bool_or("is_first").alias("is_first"))
    across = put.select(
        "t", "p", F.col("parts")[0]["b"].alias("b"), F.col("parts")[0]["i"].alias("i"), F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"), "is_first")
    return row.unionByName(across).filter(F.trim("text") != "")


def joined_anew(guesses: DataFrame) -> DataFrame:
    """Rows and fragments from the lines of guesses whose splits start inside quotes; those of a split meet in one task."""
    lines = guesses.select("t", "p", "b", "i", F.posexplode(F.split("part", "\n", -1)).alias("n", "line"), "starts_inside", "opener")
    marked = lines.select("t", "p", "b", (F.col("i") + F.col("n")).alias("i"), "line", *open_after(F.col("line"), F.col("line")), "starts_inside", "opener")
    return marked.repartition("p", "b").sortWithinPartitions("p", "b", "i").mapInArrow(joined_lines, ROWS)


def header_of(texts: list[str]) -> list[str]:
    """Column names from the header rows of all files, which must agree; blank and repeated names get their place."""
    headers = {tuple(next(csv.reader([text.removeprefix("\ufeff")]))) for text in texts}
    if len({tuple(n.strip().lower() for n in names) for names in headers}) > 1:
        raise ValueError("the files of one call must have the same header")
    names = list(min(headers))
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def parsed(header: list[str], options: dict[str, str]) -> list[Column]:
    """The fields of each row as text columns, named by their place so that odd or repeated names do no harm."""
    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    text = F.from_csv(F.col("text"), schema, options)
    return [text[f"c{i}"].alias(name) for i, name in enumerate(header)]


# one field behind its comma; a quote that is not closed before a comma or the end takes the rest of the row
NEXT_FIELD = r',("(?:[^"]++|"")*+"(?=,|\z)|"[\s\S]*+|[^,]*+)'


def fields(text: Column) -> Column:
    """The fields of a row as an array, for files whose headers differ. An empty field is null, a quoted empty one is not."""
    def plain(field: Column) -> Column:
        inner = F.replace(F.regexp_replace(field, r'^"|"\z', ""), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(field, F.lit('"')), inner).when(field != "", field)

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(NEXT_FIELD), F.lit(1)), plain)
