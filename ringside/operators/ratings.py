"""Sequential skill ratings: Elo in several dialects, with time decay, and Glicko-2.

A rating needs the opponent's current rating, so bouts have to be walked through in order; no
window can do that. The walk is a fold over narrow rows, sorted within a partition: rows
stream through in Arrow batches, and only the state of each competitor is held, never the
bouts. Each configuration is a walk of its own, and so is each league of competitors who are not
connected with others, if these are sought (apart); those run in parallel. What doesn't depend
on ratings is left to window functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import exp, log, pi, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import DAYS_PER_YEAR
from ..functions.text import NON_STANDARD_DIVISIONS, standard_result
from ..sources.tables import cut
from .components import connected


@dataclass(frozen=True)
class EloConfig:
    initial_rating: float = 1500.0
    base_k: float = 32.0
    boosted_k: float = 64.0
    scale: float = 400.0
    provisional_fights: int = 3
    half_life_years: float | None = None

    def __post_init__(self):
        if self.half_life_years is not None and self.half_life_years <= 0:
            raise ValueError("the half-life must be positive")

    @property
    def label(self) -> str:
        """The published form: whole numbers, and the half-life only where there is one."""
        decays = "" if self.half_life_years is None else f"_half{self.half_life_years:.0f}y"
        return f"init{self.initial_rating:.0f}_base{self.base_k:.0f}_boost{self.boosted_k:.0f}_scale{self.scale:.0f}_prov{self.provisional_fights}{decays}"


@dataclass(frozen=True)
class Dialect:
    """What differs between the rating variants.

    draws: a draw scores half for both, else it changes nothing. no_contests: a no contest counts as
    a fight and stores the decayed rating; else it only moves the clock. switches: a change of
    division makes a competitor provisional again. shared_k: one K for both, boosted if either is
    provisional. decided_only: bouts without a winner are left out altogether. least: bound of
    the expected score.
    """

    draws: bool = True
    no_contests: bool = True
    switches: bool = True
    shared_k: bool = False
    decided_only: bool = False
    least: float = 0.0


PRODUCTION = Dialect()
WIN_LOSS = Dialect(draws=False, no_contests=False, switches=False)
SHARED_K = Dialect(draws=False, no_contests=False, switches=False, shared_k=True, decided_only=True, least=1e-15)


class _State:
    __slots__ = ("rating", "fights", "since", "division", "day")

    def __init__(self, rating: float):
        self.rating, self.fights, self.since, self.division, self.day = rating, 0, 0, None, None


class EloWalk:
    """The state of one walk; step() takes the bouts in order. It runs once a bout and config, so it makes few objects."""

    def __init__(self, config: EloConfig, dialect: Dialect):
        self.config, self.dialect, self.states = config, dialect, {}
        c, d = config, dialect
        self.fixed = (c.initial_rating, c.base_k, c.boosted_k, c.scale, c.provisional_fights, c.half_life_years and c.half_life_years * DAYS_PER_YEAR, d.switches, d.shared_k, d.draws, d.no_contests, d.least, 1.0 - d.least)

    def step(self, day: int, one, two, result_1: str, result_2: str, division: str | None) -> tuple:
        start, base_k, boosted_k, scale, provisional, half_life, switches, shared_k, draws, no_contests, least, most = self.fixed
        states = self.states
        s = states.get(one)
        if s is None:
            s = states[one] = _State(start)
        t = states.get(two)
        if t is None:
            t = states[two] = _State(start)
        moved_1 = moved_2 = False
        if switches and division is not None and division not in NON_STANDARD_DIVISIONS:
            own = s.division
            if own is not None and own != division and own not in NON_STANDARD_DIVISIONS:
                moved_1, s.since = True, 0
            own = t.division
            if own is not None and own != division and own not in NON_STANDARD_DIVISIONS:
                moved_2, t.since = (True, 0) if t is not s else (moved_1, 0)
        held_1 = a = s.rating
        held_2 = b = t.rating
        days_1 = days_2 = 0
        factor_1 = factor_2 = 1.0
        if half_life is not None:
            if s.day is not None:
                days_1 = max(0, day - s.day)
                factor_1 = 2.0 ** (-days_1 / half_life)
                a = start + (a - start) * factor_1
            if t.day is not None:
                days_2 = max(0, day - t.day)
                factor_2 = 2.0 ** (-days_2 / half_life)
                b = start + (b - start) * factor_2
        expected = 1.0 / (1.0 + 10.0 ** ((b - a) / scale))
        if expected < least:
            expected = least
        elif expected > most:
            expected = most
        fights_1, fights_2 = s.fights, t.fights
        new_1 = fights_1 < provisional or (switches and s.since < provisional)
        new_2 = fights_2 < provisional or (switches and t.since < provisional)
        if shared_k:
            new_1 = new_2 = new_1 or new_2
        k_1 = boosted_k if new_1 else base_k
        k_2 = boosted_k if new_2 else base_k
        score = None
        if draws:
            if result_1 != "NC" and result_2 != "NC":
                score = 1.0 if result_1 == "W" else 0.0 if result_1 == "L" else 0.5 if result_1 == "D" else None
                if score is None:
                    raise ValueError(f"unknown result {result_1!r} of {one!r} against {two!r} on day {day}")
        elif result_1 == "W" and result_2 == "L":
            score = 1.0
        elif result_1 == "L" and result_2 == "W":
            score = 0.0
        if score is None:
            after_1, after_2 = a, b
        else:
            after_1 = a + k_1 * (score - expected)
            after_2 = b + k_2 * ((1.0 - score) - (1.0 - expected))
        if score is not None or no_contests:
            s.rating = after_1
            s.fights += 1
            s.since += 1
            t.rating = after_2
            t.fights += 1
            t.since += 1
        s.day = t.day = day
        if division is not None:
            s.division = t.division = division
        return (held_1, held_2, a, b, after_1, after_2, expected, 1.0 - expected, k_1, k_2, days_1, days_2, factor_1, factor_2, fights_1, fights_2, moved_1, moved_2, score is not None)


ELO_FIELDS = (
    [(f"rating_historical_{n}_before", "double") for n in (1, 2)]
    + [(f"rating_{n}_before", "double") for n in (1, 2)]
    + [(f"rating_{n}_after", "double") for n in (1, 2)]
    + [(f"expected_{n}", "double") for n in (1, 2)]
    + [(f"k_{n}", "double") for n in (1, 2)]
    + [(f"days_{n}", "long") for n in (1, 2)]
    + [(f"recency_{n}", "double") for n in (1, 2)]
    + [(f"career_{n}", "long") for n in (1, 2)]
    + [(f"switch_{n}", "boolean") for n in (1, 2)]
    + [("rating_updated", "boolean")]
)


def _fold(rows: DataFrame, by: list[str], make, fields: list[tuple[str, str]], packs: list[list[str]], only: list[str] | None = None, slots: int = 1) -> DataFrame:
    """Walk the rows of each `by` value in order of (day, fight_id), for each config; make(config) gives the walk.

    packs: configs that are walked side by side, in one task over the same rows; each pack gets tasks of its own, `slots` of
    them for the values of `by`. Rows are shuffled once a pack. only: the fields that are wanted.
    """
    wanted = [(k, *f) for k, f in enumerate(fields) if only is None or f[0] in only]
    keep = ["fight_id", "day", "fighter_1_id", "fighter_2_id", "fighter_1_result", "fighter_2_result"]
    schema = T.StructType([T.StructField("config", T.StringType()), *[rows.schema[c] for c in keep]])
    for _, name, kind in wanted:
        schema = schema.add(name, kind)
    names, kinds = schema.names, {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Arrow arrays, as frames of Python values take longer than the walk
        key, walks = None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            configs = packs[batch.column("pack")[0].as_py()]  # a task has one pack
            own = list(zip(*[batch.column(c).to_pylist() for c in by])) or [()] * n
            starts = [0, *[k for k in range(1, n) if own[k] != own[k - 1]]]
            columns = [batch.column(c).to_pylist() for c in ("day", "fighter_1_id", "fighter_2_id", "fighter_1_result", "fighter_2_result", "division")]
            walks = walks or [None] * len(configs)
            for j, config in enumerate(configs):
                out, walk, last = [], walks[j], key
                for s, e in zip(starts, [*starts[1:], n]):
                    if walk is None or own[s] != last:
                        walk, last = make(config), own[s]
                    out.extend(map(walk.step, *[c[s:e] for c in columns]))
                walks[j] = walk
                told = [pa.array([x[k] for x in out], kinds[kind]) for k, _, kind in wanted]
                yield pa.RecordBatch.from_arrays([pa.repeat(config, n), *[batch.column(c) for c in keep], *told], names)
            key = own[-1]

    rows = rows.withColumn("pack", F.explode(F.array(*[F.lit(k) for k in range(len(packs))])) if len(packs) > 1 else F.lit(0))
    place = F.col("pack")
    if by:
        place = place + len(packs) * F.pmod(F.xxhash64(*by), F.lit(slots)).cast("int")
    ordered = rows.repartitionById(len(packs) * slots, place).sortWithinPartitions(*by, "day", "fight_id")
    # days are numbers in the walk, as dates would become objects
    dated = [F.date_from_unix_date("day").alias("date") if c == "day" else F.col(c) for c in names]
    return ordered.drop("date").mapInArrow(run, schema).select(*dated)


def _narrow(bouts: DataFrame, decided_only: bool) -> DataFrame:
    division = F.col("division") if "division" in bouts.columns else F.lit(None).cast("string")
    r1, r2 = (standard_result(F.col(f"fighter_{n}_result")) for n in (1, 2))
    known = ["league"] if "league" in bouts.columns else []
    rows = bouts.select(*known, "fight_id", "date", F.unix_date("date").alias("day"), "fighter_1_id", "fighter_2_id", r1.alias("fighter_1_result"), r2.alias("fighter_2_result"), division.alias("division"))
    return rows.filter("(fighter_1_result, fighter_2_result) in (('W', 'L'), ('L', 'W'))") if decided_only else rows


MOST_SLOTS = 1000


MOST_BROADCAST = 1_000_000  # competitors


def with_leagues(rows: DataFrame) -> DataFrame:
    """`rows` with `league`, the same for competitors who are connected by bouts; walks apart take it where it is there."""
    rows = cut(rows)
    found = cut(connected(rows, "fighter_1_id", "fighter_2_id"))
    own = F.broadcast(found) if found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else found
    # both sides are of one league, so either tells it
    league = F.coalesce("fighter_1_id", "fighter_2_id").eqNullSafe(F.col("id"))
    return rows.join(own.withColumnRenamed("component", "league"), league, "left").drop("id")


def _leagues(rows: DataFrame) -> tuple[DataFrame, int]:
    """`rows` with `league`, and into how many tasks leagues go."""
    rows = cut(rows if "league" in rows.columns else with_leagues(rows))
    return rows, max(1, rows.select("league").distinct().limit(MOST_SLOTS).count())


def _packs(configs: list[str], slots: int, cores: int) -> list[list[str]]:
    """Configs that are walked side by side: as few packs as give each core some tasks, but one config each at most."""
    n = min(len(configs), -(-4 * cores // slots))
    return [configs[k::n] for k in range(n)]


def elo(bouts: DataFrame, configs: dict[str, EloConfig], dialect: Dialect = PRODUCTION, only: list[str] | None = None, apart: bool = False) -> DataFrame:
    """One row for each bout and config: ratings before and after, both sides (see ELO_FIELDS).

    only: the fields that are wanted; the others don't leave the walk. apart: competitors who are not
    connected by any bouts are walked in tasks of their own, which gives the same ratings; to find
    them takes some rounds over the pairs that met.
    """
    rows, by, slots = _narrow(bouts, dialect.decided_only), [], 1
    if apart:
        rows, slots = _leagues(rows)
        by = ["league"]
    packs = _packs(list(configs), slots, bouts.sparkSession.sparkContext.defaultParallelism)
    return _fold(rows, by, lambda config: EloWalk(configs[config], dialect), ELO_FIELDS, packs, only, slots)


def by_fighter(rated: DataFrame, bouts: DataFrame) -> DataFrame:
    """Two rows a bout of what elo() returns, with result, division and debut."""
    view = lambda a, b: F.struct(
        F.col(f"fighter_{a}_id").alias("fighter_id"),
        F.col(f"fighter_{b}_id").alias("opponent_id"),
        F.col(f"fighter_{a}_result").alias("result"),
        F.col(f"career_{a}").alias("career_fights_before"),
        (F.col(f"career_{a}") == 0).alias("is_debut"),
        F.col(f"switch_{a}").alias("is_division_change"),
        F.col(f"k_{a}").alias("k_factor"),
        F.col("rating_updated"),
        F.col(f"days_{a}").alias("days_since_last_fight"),
        F.col(f"recency_{a}").alias("recency_factor"),
        F.col(f"expected_{a}").alias("expected_score"),
        F.col(f"rating_historical_{a}_before").alias("rating_historical_before"),
        F.col(f"rating_{a}_before").alias("rating_before"),
        F.col(f"rating_{a}_after").alias("rating_after"),
    )
    met = rated.join(bouts.select("fight_id", "division"), "fight_id")
    return met.select("config", "fight_id", "date", "division", F.inline(F.array(view(1, 2), view(2, 1))))


class GlickoWalk:
    """Glicko-2, a rating period for each bout; bouts without a winner must be left out."""

    UNIT = 173.7178

    def __init__(self, rating: float = 1500.0, rd: float = 350.0, volatility: float = 0.06, tau: float = 0.5, tolerance: float = 1e-12):
        self.start, self.tau, self.tolerance, self.states = (rating, rd, volatility), tau, tolerance, {}

    def update(self, state: tuple[float, float, float], games: list[tuple[float, float, float]]) -> tuple[float, float, float]:
        """state and games: (rating, deviation, volatility), [(opponent's rating, deviation, score)]."""
        mu, phi, sigma = (state[0] - 1500.0) / self.UNIT, state[1] / self.UNIT, state[2]
        inverse_v = gain = 0.0
        for rating, rd, score in games:
            g = 1 / sqrt(1 + 3 * (rd / self.UNIT) ** 2 / pi**2)
            e = 1 / (1 + exp(-g * (mu - (rating - 1500.0) / self.UNIT)))
            inverse_v += g * g * e * (1 - e)
            gain += g * (score - e)
        v = 1 / inverse_v
        delta, a = v * gain, log(sigma * sigma)
        f = lambda x: exp(x) * (delta**2 - phi**2 - v - exp(x)) / (2 * (phi**2 + v + exp(x)) ** 2) - (x - a) / self.tau**2
        low = a
        if delta**2 > phi**2 + v:
            high = log(delta**2 - phi**2 - v)
        else:
            k = 1
            while f(a - k * self.tau) < 0:
                k += 1
            high = a - k * self.tau
        fl, fh = f(low), f(high)
        while abs(high - low) > self.tolerance:
            new = low + (low - high) * fl / (fh - fl)
            fn = f(new)
            low, fl = (high, fh) if fn * fh <= 0 else (low, fl / 2)
            high, fh = new, fn
        sigma = exp(low / 2)
        phi = 1 / sqrt(1 / (phi * phi + sigma * sigma) + inverse_v)
        return (mu + phi * phi * gain) * self.UNIT + 1500.0, phi * self.UNIT, sigma

    def step(self, day: int, one, two, result_1: str, result_2: str, division: str | None) -> tuple:
        a, b = self.states.get(one, self.start), self.states.get(two, self.start)
        score = 1.0 if result_1 == "W" else 0.0
        self.states[one] = self.update(a, [(b[0], b[1], score)])
        self.states[two] = self.update(b, [(a[0], a[1], 1.0 - score)])
        return (*a, *b, *self.states[one], *self.states[two])


GLICKO_FIELDS = [(f"{what}_{n}_{when}", "double") for when in ("before", "after") for n in (1, 2) for what in ("rating", "rd", "vol")]


def glicko2(bouts: DataFrame, tau: float = 0.5, apart: bool = False) -> DataFrame:
    """One row for each bout with a winner: rating, deviation and volatility of both sides. apart: as in elo()."""
    rows, by, slots = _narrow(bouts, True), [], 1
    if apart:
        rows, slots = _leagues(rows)
        by = ["league"]
    return _fold(rows, by, lambda config: GlickoWalk(tau=tau), GLICKO_FIELDS, [["glicko2"]], slots=slots).drop("config")


def candidate_configs(base: EloConfig | None = None) -> dict[str, EloConfig]:
    """One parameter changed at a time; fixed values of the sweep, with their published names."""
    base = base or EloConfig()
    return {
        "baseline_v0.1": base,
        "k_menor_16_32": replace(base, base_k=16.0, boosted_k=32.0),
        "k_menor_24_48": replace(base, base_k=24.0, boosted_k=48.0),
        "sem_boost_k_igual_base": replace(base, boosted_k=base.base_k),
        "boost_k_maior_96": replace(base, boosted_k=96.0),
        "scale_200": replace(base, scale=200.0),
        "scale_600": replace(base, scale=600.0),
        **{f"provisional_{n}": replace(base, provisional_fights=n) for n in (1, 3, 5, 7, 9)},
    }


def half_life_configs(years: tuple[float | None, ...] = (None, 1.0, 2.0, 3.0, 4.0, 5.0), base: EloConfig | None = None) -> dict[str, EloConfig]:
    return {"baseline" if y is None else f"half_life_{y:g}y": replace(base or EloConfig(), half_life_years=y) for y in years}
