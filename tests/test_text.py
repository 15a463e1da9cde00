"""Hand-checked rows of the text functions."""

import pytest
from pyspark.sql import functions as F

from ringside.functions import scores, text


def one(spark, value, *cols):
    return tuple(spark.createDataFrame([(value,)], "c string").select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first())





@pytest.mark.parametrize(
    "make, value, want",
    [
        (text.normalize_text, "  John   Doe\t", "john doe"),
        (text.normalize_text, None, ""),
        (text.url_id, "http://x/fighter/ABCDEF0123456789", "abcdef0123456789"),
        (text.url_id, " http://x/abcdef0123456789/ ", "abcdef0123456789"),
        (text.url_id, "http://x/abcdef012345678", None),
        (text.url_id, None, None),
        (text.round_number, "Round 12", 12),
        (text.round_number, "Total", None),
        (text.percentage, "50%", 50.0),
        (text.percentage, "---", None),
        (text.percentage, None, None),
        (text.percentage_lenient, "46%", 0.46),
        (text.percentage_lenient, "46", 0.46),
        (text.percentage_lenient, "junk", None),
        (text.clock_seconds, "1:35", 95),
        (text.clock_seconds, "--", None),
        (text.clock_seconds_lenient, "1:75", 135.0),
        (text.clock_seconds_lenient, "1:2:3", None),
        (text.ending_seconds, "3:44", 224),
        (text.ending_seconds, "344", None),
        (text.division, "Light Heavyweight Bout", "Light Heavyweight"),
        (text.division, "Super Heavyweight", "Heavyweight"),
        (text.division, "Women's Flyweight Title", "Women's Flyweight"),
        (text.division, "Tournament Title Bout", None),
        (text.division, None, None),
    ],
)
def test_scalar(spark, make, value, want):
    assert one(spark, value, make(F.col("c"))) == (want,)


@pytest.mark.parametrize(
    "make, value, want",
    [
        (text.bout_sides, "A vs. B", ("A", "B")),
        (text.bout_sides, "A VS B", ("A", "B")),
        (text.bout_sides, "A vs. B vs. C", ("A", "B vs. C")),
        (text.bout_sides, "A v B", (None, None)),
        (text.bout_sides, None, (None, None)),
        (text.outcome_sides, "W/L", ("W", "L")),
        (text.outcome_sides, "D", ("D", None)),
        (text.outcome_sides, None, ("", None)),
        (text.landed_attempted, "5 of 10", (5, 10)),
        (text.landed_attempted, "0 of 0", (0, 0)),
        (text.landed_attempted, None, (None, None)),
        (text.landed_attempted_lenient, "---", (None, None)),
        (text.landed_attempted_lenient, "5 OF 10", (5.0, 10.0)),
        (text.landed_attempted_lenient, "x", (None, None)),
    ],
)
def test_pair(spark, make, value, want):
    assert one(spark, value, *make(F.col("c"))) == want


@pytest.mark.parametrize("make, value", [(text.landed_attempted, "---"), (text.percentage, "50"), (text.clock_seconds, "1:75")])
def test_strict_parsers_fail(spark, make, value):
    cols = make(F.col("c"))
    with pytest.raises(Exception, match="not"):
        one(spark, value, *(cols if isinstance(cols, tuple) else (cols,)))


def test_scores(spark):
    num = lambda e: one(spark, None, e)[0]
    L = F.lit
    assert num(scores.safe_percentage(L(0), L(0))) is None and num(scores.safe_percentage(L(5), L(10))) == 50.0
    assert num(scores.win_rate_probability(L(None).cast("double"), L(0.5))) == 0.5
    assert num(scores.win_rate_probability(L(0.0), L(0.0))) == 0.5
    assert round(num(scores.win_rate_probability(L(0.6), L(0.2))), 9) == 0.75
    assert round(num(scores.glicko_expected(L(1500.0), L(1400.0), L(30.0))), 3) == 0.639 or round(num(scores.glicko_expected(L(1500.0), L(1400.0), L(30.0))), 4) == 0.6395
    assert num(scores.decay(L(1461), 4.0)) == 0.5


def test_strict_parsers_take_padded_texts(spark):
    rows = [("p", "  5 of 10\t"), ("p", "5 of 10\n"), ("p", None), ("q", " 50.5% "), ("q", "\t---"), ("q", " "), ("c", " 1:35\x1c"), ("c", "-- "), ("c", "1:35")]
    want = {"p": [(5, 10), (5, 10), (None, None)], "q": [50.5, None, None], "c": [95, None, 95]}
    make = {"p": lambda c: F.struct(*text.landed_attempted(c)), "q": text.percentage, "c": text.clock_seconds}
    for k, f in make.items():
        own = spark.createDataFrame([r for r in rows if r[0] == k], "k string, c string").coalesce(1)
        assert [tuple(v) if k == "p" else v for (v,) in own.select(f(F.col("c"))).collect()] == want[k]


def test_only_unmatched_texts_are_stripped(spark):
    """Stripping took most of the time of the parsers: it stands behind the first match."""
    plan = spark.range(1).select(text.landed_attempted(F.col("id").cast("string"))[0].alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.index("RLIKE") < plan.index("regexp_replace")
