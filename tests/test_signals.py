"""Signal lines as a parallel scan, against a walk from line to line."""

import random

from pyspark.sql import functions as F

from lodestar.operators import signals

PARTS = ["/* opens", "closes */", "/* both */", "-- comment", "-- closes too */", "PROCEDURE Do_It IS", "  function Calc (x_) RETURN NUMBER IS", "x := PROCEDURE as text", "Error_SYS.Record_General(x);", "RAISE no_data EXCEPTION;", "   Other_API.Call(x_);", "PACKAGE Other_API. IS", "  SELECT a INTO b FROM c;", "x_ := 1;", "", "   ", "END Do_It;", "more text", "y_ := x_ + 1;"]


def walk(text):
    out, is_open, kind, nth = [], False, None, 0
    for pos, line in enumerate(text.split("\n")):
        bare, up = line.strip(), line.strip().upper()
        if "*/" in line:
            is_open = False
            found = "comments" if bare.startswith("--") else "none"
        else:
            is_open = is_open or "/*" in line
            if "Error_SYS.Record_General" in line or "RAISE_APPLICATION_ERROR" in up or ("RAISE" in up and ("EXCEPTION" in up or "-20" in line)):
                found = "error_messages"
            elif up.startswith("PROCEDURE ") or ("PROCEDURE " in up and ("AS" in up or "BEGIN" in up)):
                found = "procedures"
            elif up.startswith("FUNCTION ") or ("FUNCTION " in up and ("RETURN" in up or "AS" in up)):
                found = "functions"
            elif bare.startswith("--") or is_open:
                found = "comments"
            elif "_API." in line and not up.startswith("PACKAGE"):
                found = "api_calls"
            elif any(w in up for w in signals.DATABASE_WORDS):
                found = "database_operations"
            else:
                found = "body"
        if found in ("procedures", "functions"):
            kind, nth = found, 1
        elif found == "body":
            nth += 1
        if found in ("procedures", "functions", "body"):
            found = kind if kind and nth <= signals.BLOCK_LINES else None
        if found and found != "none":
            out.append((pos, found, bare if found in ("error_messages", "api_calls", "database_operations") else line))
    return out


def test_chunks_of_any_size_give_what_a_walk_gives(spark):
    r = random.Random(7)
    texts = ["\n".join(r.choices(PARTS, [r.random() ** 3 for _ in PARTS], k=r.randrange(1, 160))) for _ in range(60)]
    texts += ["", "PROCEDURE Long IS\n" + "\n".join(["x"] * 120), "/* open\n" + "\n".join(["x_ := 1;", "B_API.Go(x);"] * 30) + "\nFUNCTION F RETURN x\nx\n*/\ny\nz", "\n".join(["x"] * 70) + "\nPROCEDURE P IS\n" + "\n".join(["y"] * 70)]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id int, content string")
    want = sorted((i, *x) for i, t in enumerate(texts) for x in walk(t))
    for size in (1, 3, 7, 50, 2000):
        got = sorted(tuple(x) for x in signals.signal_lines(files, chunk_lines=size).collect())
        assert got == want, size


def test_one_large_file_spreads_over_tasks(spark):
    """A file of 20 MB, whose state at its end depends on its first line, in as many groups as it has chunks."""
    text = "PROCEDURE Far_Away IS\n" + "x" * 2000 + "\n" + "-- a comment that is no body\n" * 400_000 + "last line of the body\n/*\n" + "B_API.Go(x);\n" * 300_000 + "*/"
    files = spark.createDataFrame([("big", text)], "file_id string, content string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = signals.signal_lines(files).withColumn("task", F.spark_partition_id())
        by_task = {r.task: r.n for r in found.groupBy("task").agg(F.count("*").alias("n")).collect()}
        assert len(by_task) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(by_task.values()) < 0.5 * sum(by_task.values())
        n = {r.signal: r.n for r in found.groupBy("signal").agg(F.count("*").alias("n")).collect()}
        assert n == {"procedures": 3, "comments": 400_000 + 1 + 300_000}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
