import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestar.functions import extract, tokenize
from lodestar.plans import phases

#: Pairs of the published sample vocabulary.
PAIRS = "consign consign consigned consign consigning consign consist consist consisted consist consistency consist consolation consol knack knack knackeries knackeri knavish knavish kneaded knead knightly knight knots knot generate generat generously generous communication communic hopping hop hoping hope relational relat happiness happi flies fli dies die cats cat caresses caress agreed agre news news proceed proceed skies sky controlled control nationally nation".split()


@pytest.mark.parametrize(("word", "want"), list(zip(PAIRS[::2], PAIRS[1::2], strict=True)))
def test_stems(word, want):
    assert tokenize.stem(word) == want


def test_columns(spark):
    df = spark.createDataFrame([(["cats", "hoping"], "Credit_check of customer", 1), (None, None, 2)], "t array<string>, c string, k int")
    rows = df.select("k", tokenize.stemmed(F.col("t")).alias("s"), tokenize.subword_tokens(F.col("c"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"of"}).alias("w")).orderBy("k").collect()
    assert rows[0].s == ["cat", "hope"] and rows[1].s is None and rows[1].w is None
    assert "customer" in rows[0].w and "of" not in rows[0].w


def test_prompt_and_totals(spark, tmp_path):
    df = spark.createDataFrame([("body", "f", "F_API", 3, ["A"], ["note"], [])], "c string, f string, a string, r int, calls array<string>, notes array<string>, names array<string>")
    p = df.select(extract.summary_prompt(*[F.col(c) for c in ("c", "f", "a", "r", "calls", "notes", "names")]).alias("p")).first()["p"]
    assert "Importance rank: 3" in p and "note" in p and "Declared" not in p
    r = spark.createDataFrame([(True, True, [1.0]), (True, False, None), (False, False, None)], "success boolean, has_ai_summary boolean, embedding array<float>")
    assert tuple(phases.phase_totals(r).first()) == (3, 2, 1, 1, 2 / 3, 0.5, 1.0)
    phases.save_metadata(spark, {"a": "b"}, str(tmp_path / "m"))
    moved = phases.archive(spark, str(tmp_path / "m"), "old")
    assert spark.read.parquet(moved).first()["value"] == "b" and phases.archive(spark, str(tmp_path / "none"), "x") is None
