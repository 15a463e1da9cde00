"""Explicit schemas of the raw tables, and the names of the statistics."""

from __future__ import annotations

from pyspark.sql import types as T


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: Raw tables as they arrive: text only; numbers are parsed, never inferred.
RAW = {
    "event_details": _text("EVENT", "URL", "DATE", "LOCATION"),
    "fighter_details": _text("FIRST", "LAST", "NICKNAME", "URL"),
    "fight_details": _text("EVENT", "BOUT", "URL"),
    "fight_results": _text("EVENT", "BOUT", "OUTCOME", "WEIGHTCLASS", "METHOD", "ROUND", "TIME", "TIME FORMAT", "REFEREE", "DETAILS", "URL"),
    "fight_stats": _text("EVENT", "BOUT", "ROUND", "FIGHTER", "KD", "SIG.STR.", "SIG.STR. %", "TOTAL STR.", "TD", "TD %", "SUB.ATT", "REV.", "CTRL", "HEAD", "BODY", "LEG", "DISTANCE", "CLINCH", "GROUND"),
}

#: "X of Y" statistics, and the raw columns that they come from.
PAIRS = {
    "significant_strikes": "SIG.STR.",
    "total_strikes": "TOTAL STR.",
    "takedowns": "TD",
    "head_strikes": "HEAD",
    "body_strikes": "BODY",
    "leg_strikes": "LEG",
    "distance_strikes": "DISTANCE",
    "clinch_strikes": "CLINCH",
    "ground_strikes": "GROUND",
}
COUNTS = {"knockdowns": "KD", "submission_attempts": "SUB.ATT", "reversals": "REV."}
PERCENTAGES = {"significant_strikes_pct": "SIG.STR. %", "takedown_pct": "TD %"}
CONTROL = "control_time_seconds"
#: The summed statistics of a fighter in a fight.
SUMS = [*COUNTS, *[f"{p}_{k}" for p in PAIRS for k in ("landed", "attempted")], CONTROL]
#: Differences between the two sides of a fight.
DIFFERENCES = ["knockdowns", "submission_attempts", "reversals", CONTROL, "significant_strikes_landed", "significant_strikes_attempted", "total_strikes_landed", "total_strikes_attempted", "takedowns_landed", "takedowns_attempted", *PERCENTAGES]
#: Statistics with running sums and means before a fight.
HISTORY = DIFFERENCES[:10]
