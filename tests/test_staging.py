from pathlib import Path

from colloquy.staging import clear_scratch, staged


def test_scratch_is_found_again_and_cleared(spark):
    before = spark.sparkContext.__dict__.pop("_colloquy_scratch", [])
    df = staged(spark.range(5), "numbers")
    assert df.count() == 5
    (path,) = spark.sparkContext.__dict__["_colloquy_scratch"]
    assert Path(path.removeprefix("file://")).exists() and clear_scratch(spark) == 1 and not Path(path.removeprefix("file://")).exists()
    spark.sparkContext.__dict__["_colloquy_scratch"] = before
