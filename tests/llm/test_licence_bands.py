"""How often a window that holds a whole notice is retrieved."""

from pyspark.sql import functions as F

from tessera.llm import licences


def test_bands_miss_no_more_windows_than_independent_ones(spark):
    n = 40_000
    table, _ = licences._table(spark, licences.TEMPLATES)
    for r in table.collect():
        held = r.t_
        others = 2 * r.tier - licences.SHINGLE + 1 - len(held)
        windows = spark.range(n).select(F.concat(F.array(*map(F.lit, held)), F.array(*(F.xxhash64("id", F.lit(f"other {k}")) for k in range(others)))).alias("s_"))
        asked = licences._minima(F.array(*map(F.lit, held)))
        missed = windows.where(~F.exists(F.zip_with(licences._minima(F.col("s_")), asked, lambda a, b: a == b), lambda same: same)).count()
        print("missed", r.template, missed)
        assert missed <= 2 * n * 0.0005, r.template
