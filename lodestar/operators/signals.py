"""Signal lines of source files: errors, signatures with their bodies, comments, calls, database operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import estimated_tokens, lines, strip

#: Signal classes in order, with their shares of the budget.
SHARES = {"error_messages": 0.25, "procedures": 0.30, "functions": 0.25, "comments": 0.15, "api_calls": 0.03, "database_operations": 0.02}
BLOCK_LINES = 50
DATABASE_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "FROM ", "INTO ")


#: Lines of a file that are looked at together; a file with more is spread over as many groups as it has of these.
CHUNK_LINES = 2_000


def _classified(line: Column, bare: Column, is_open: Column) -> Column:
    """A line's class by its own words and by whether a block comment is open."""
    upper = F.upper(bare)
    has = lambda c, *subs: F.greatest(*[c.contains(s) for s in subs]) if len(subs) > 1 else c.contains(subs[0])
    error = has(line, "Error_SYS.Record_General", "Error_SYS.Appl_General") | upper.contains("RAISE_APPLICATION_ERROR") | (upper.contains("RAISE") & (upper.contains("EXCEPTION") | line.contains("-20")))
    procedure = upper.startswith("PROCEDURE ") | (upper.contains("PROCEDURE ") & has(upper, "AS", "BEGIN"))
    function = upper.startswith("FUNCTION ") | (upper.contains("FUNCTION ") & has(upper, "RETURN", "AS"))
    return (
        F.when(line.contains("*/"), F.when(bare.startswith("--"), "comments").otherwise("none"))
        .when(error, "error_messages")
        .when(procedure, "procedures")
        .when(function, "functions")
        .when(bare.startswith("--") | is_open, "comments")
        .when(line.contains("_API.") & ~upper.startswith("PACKAGE"), "api_calls")
        .when(has(upper, *DATABASE_WORDS), "database_operations")
        .otherwise("body")
    )


def signal_lines(files: DataFrame, key: str = "file_id", chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """(key, pos, signal, line) of every line that is a signal.

    The class of a line depends on its own words and on whether a block comment is open, which the last opening or
    closing mark before or on it tells. Lines without a class belong to the signature before them, 50 lines a block at most.

    What a line takes over from those before it is a parallel prefix scan, so that one huge file spreads over tasks. Each
    chunk of lines is a function from the state before it (is a comment open; the kind of the open block and how many
    lines it has) to the state behind it, and has few numbers: the comment mark it ends with, the kind of its last
    signature, and how many lines follow that one if a comment was open before the chunk and if not. A window over a
    file's chunks, a row each, composes them; its result is joined to the chunks' lines, which stay where they are."""
    chunk = [key, "chunk"]
    so_far = Window.partitionBy(*chunk).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    line, bare = F.col("line"), F.col("bare")
    rows = files.select(key, F.posexplode(lines(F.col("content"))).alias("pos", "line"))
    number = F.coalesce(F.floor(F.col("pos") / chunk_lines).cast("int"), F.lit(0))  # never null: both reads of the exchange stay alike
    rows = rows.withColumn("chunk", number).repartition(*chunk).withColumn("bare", strip(line))
    mark = F.last(F.when(line.contains("*/"), False).when(line.contains("/*"), True), ignorenulls=True).over(so_far)
    # the class where no comment is open unless the chunk itself opened one; a comment open before it can only turn
    # classes behind errors and signatures into comments, up to the chunk's first mark
    rows = rows.withColumn("mark", mark).withColumn("class", _classified(line, bare, F.coalesce("mark", F.lit(False))))
    counted = F.col("class").isin("procedures", "functions", "body")
    signature = F.col("class").isin("procedures", "functions")
    rows = rows.withColumn("block", F.sum(signature.cast("int")).over(so_far))
    code = F.when(F.col("class") == "procedures", 1).when(F.col("class") == "functions", 2)  # kinds as numbers, which hash aggregates hold
    rows = rows.withColumn("turns", (F.col("class") == "body") & F.col("mark").isNull())  # a body line only if no comment was open
    per_block = rows.groupBy(*chunk, "block").agg(F.sum(counted.cast("int")).alias("counted"), F.sum(F.col("turns").cast("int")).alias("turning"), F.max(code).alias("kind"), F.max_by("mark", "pos").alias("mark"))
    of_last = lambda c: F.max_by(c, "block").alias(c)
    chunks = per_block.groupBy(*chunk).agg(F.max("block").alias("blocks"), *map(of_last, ("counted", "turning", "kind", "mark")))
    # composed: the comment first, as the counts depend on it, then the block
    chunks = chunks.withColumn("was_open", F.coalesce(F.last("mark", ignorenulls=True).over(before), F.lit(False)))
    chunks = chunks.withColumn("own", F.col("counted") - F.when(F.col("was_open"), F.col("turning")).otherwise(0))
    total = F.coalesce(F.sum("own").over(before), F.lit(0))
    chunks = chunks.withColumn("total", total).withColumn("base", F.last(F.when(F.col("blocks") > 0, F.col("total")), ignorenulls=True).over(before))
    state = chunks.select(*chunk, "was_open", F.last("kind", ignorenulls=True).over(before).alias("old_kind"), (F.col("total") - F.coalesce("base", F.lit(0))).alias("old_lines"))
    turned = F.col("was_open") & F.col("mark").isNull() & F.col("class").isin("api_calls", "database_operations", "body")
    rows = rows.join(state, chunk).withColumn("class", F.when(turned, "comments").otherwise(F.col("class")))
    body = F.col("class") == "body"
    rows = rows.withColumn("so_far", F.sum((signature | body).cast("int")).over(so_far))
    begun = F.last(F.when(signature, F.col("so_far") - 1), ignorenulls=True).over(so_far)  # lines before the open block
    rows = rows.withColumn("nth", F.col("so_far") - F.coalesce(begun, -F.col("old_lines")))
    rows = rows.withColumn("kind", F.when(F.coalesce(F.last(code, ignorenulls=True).over(so_far), "old_kind") == 1, "procedures").when(F.coalesce(F.last(code, ignorenulls=True).over(so_far), "old_kind") == 2, "functions"))
    signal = F.when(signature | body, F.when(F.col("nth") <= BLOCK_LINES, F.col("kind"))).when(F.col("class") != "none", F.col("class"))
    trimmed = F.col("class").isin("error_messages", "api_calls", "database_operations")
    return rows.withColumn("signal", signal).where("signal is not null").select(key, "pos", "signal", F.when(trimmed, bare).otherwise(line).alias("line"))


def _section(text: Column, name: str, tokens: int) -> Column:
    chars = int(tokens * SHARES[name]) * 4
    cut = F.substring(text, 1, chars)
    last = F.length(cut) - F.instr(F.reverse(cut), "\n")
    snapped = F.when((F.instr(cut, "\n") > 0) & (last > chars * 0.8), F.substring(cut, F.lit(1), last)).otherwise(cut)
    out = F.when(F.length(text) > chars, snapped).otherwise(text)
    return F.when(strip(out) != "", F.concat(F.lit(f"\n--- {name.upper().replace('_', ' ')} ---\n"), out))


def balanced(signals: DataFrame, available_tokens: int, key: str = "file_id") -> DataFrame:
    """(key, balanced): each class's lines, cut to its share of the budget at a line's end where that is near."""
    grouped = signals.groupBy(key).pivot("signal", list(SHARES)).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))))
    text = {s: F.array_join(F.transform(F.col(s), lambda x: x["line"]), "\n") for s in SHARES}
    return grouped.select(key, F.concat_ws("\n", *[_section(text[s], s, available_tokens) for s in SHARES]).alias("balanced"))


def within_context(files: DataFrame, limit: int = 64_000, reserve: int = 2_000, key: str = "file_id") -> DataFrame:
    """(key, content, tokens): whole contents up to the limit, balanced signals of longer ones."""
    long = files.where(estimated_tokens(F.col("content")) > limit)
    short = files.where(estimated_tokens(F.col("content")) <= limit)
    cut = long.select(key).join(balanced(signal_lines(long, key), limit - reserve, key), key, "left").select(key, F.coalesce("balanced", F.lit("")).alias("content"))
    return short.select(key, "content").unionByName(cut).withColumn("tokens", estimated_tokens(F.col("content")))
