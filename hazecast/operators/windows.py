"""Rolling, lagged, forward and exponentially weighted features.

All windows of one table share one partitioning and one order, so they plan
as one exchange, one sort and one Window node. The columns are written as SQL
text: a hundred of them then cost one call each to plan.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazecast.fixed_values import (
    CHANGE_WINDOWS, EWMA_SPANS, HORIZONS, LAG_STEPS, ROLLING_WINDOWS, WINDOWED)
from hazecast.operators import layout

HALO_BACK = 24
HALO_AHEAD = 72


@dataclass(frozen=True)
class Frames:
    """What "n before" means: rows of the series, or hours on the clock."""

    series: str = "PARTITION BY station_id, block ORDER BY pos"
    by_hour: bool = False

    def trailing(self, n: int) -> str:
        unit = "RANGE" if self.by_hour else "ROWS"
        return f"OVER ({self.series} {unit} BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def shifted(self, column: str, n: int) -> str:
        """Value n steps later (earlier if negative), null where absent."""
        if self.by_hour:
            at = f"{abs(n)} {'FOLLOWING' if n > 0 else 'PRECEDING'}"
            return f"max({column}) OVER ({self.series} RANGE BETWEEN {at} AND {at})"
        return f"{'lead' if n > 0 else 'lag'}({column}, {abs(n)}) OVER ({self.series})"

    def so_far(self) -> str:
        return f"OVER ({self.series} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def rolling_mean(f: Frames) -> dict[str, str]:
    return {f"{c}_rolling_mean_{n}h": f"avg({c}) {f.trailing(n)}"
            for c in WINDOWED for n in ROLLING_WINDOWS}


def rolling_std(f: Frames) -> dict[str, str]:
    """Sample deviation; 0 where fewer than two values are in the frame."""
    return {f"{c}_rolling_std_{n}h": f"coalesce(stddev_samp({c}) {f.trailing(n)}, 0D)"
            for c in WINDOWED for n in ROLLING_WINDOWS}


def rolling_extremes(f: Frames) -> dict[str, str]:
    out = {}
    for c in WINDOWED:
        for n in ROLLING_WINDOWS:
            out[f"{c}_rolling_min_{n}h"] = f"min({c}) {f.trailing(n)}"
            out[f"{c}_rolling_max_{n}h"] = f"max({c}) {f.trailing(n)}"
    return out


def ranges() -> dict[str, str]:
    """What follows each maximum. Made of the extremes: a window function written twice is evaluated twice."""
    return {f"{c}_rolling_max_{n}h": f"{c}_rolling_max_{n}h - {c}_rolling_min_{n}h AS {c}_range_{n}h"
            for c in WINDOWED for n in ROLLING_WINDOWS}


def lags(f: Frames) -> dict[str, str]:
    return {f"{c}_lag_{n}h": f.shifted(c, -n) for c in WINDOWED for n in LAG_STEPS}


def change_rates(f: Frames) -> dict[str, str]:
    return {f"aqi_change_rate_{n}h": f"(aqi - {f.shifted('aqi', -n)}) / {n}D"
            for n in CHANGE_WINDOWS}


def targets(f: Frames) -> dict[str, str]:
    return {f"aqi_target_{n}h": f.shifted("aqi", n) for n in HORIZONS}


# --- Exponentially weighted means -----------------------------------------
#
# Weights age by d = 1 - 2/(span+1) per position, over nulls too. Inside a
# block, sum(x * d^-k) / sum(d^-k) over the values so far is the mean from the
# block alone. What came before enters as one state: `mean`, `weight` (as seen
# at the last value) and `last`, that value's position. States combine
# associatively. Blocks are at least 512 positions wide, so of the blocks that
# hold a value only the last two before a row can matter: the third is older
# than the first by over 512 positions, d^512 < 3e-19 at span 24, below what a
# double keeps. However long a run of nulls is, the state skips over it.

def decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def _growth(span: int, k: str) -> str:
    return f"pow({1.0 / decay(span)!r}D, {k})"


def _sums(column: str, span: int, k: str, window: str = "") -> tuple[str, str]:
    """Weighted sum of a column's values, and of the weights they have."""
    growth = _growth(span, k)
    return (f"sum({column} * {growth}) {window}",
            f"sum(CASE WHEN {column} IS NOT NULL THEN {growth} END) {window}")


def _state(last: str, parts: dict[int, tuple[str, str]]) -> str:
    fields = [f"'last', {last}"]
    for span, (mean, weight) in parts.items():
        fields += [f"'mean_{span}', {mean}", f"'weight_{span}', {weight}"]
    return f"named_struct({', '.join(fields)})"


def _combined(earlier: str, later: str) -> str:
    """State after ``later`` when ``earlier`` came before it."""
    parts = {}
    for span in EWMA_SPANS:
        aged = (f"{earlier}.weight_{span} * "
                f"pow({decay(span)!r}D, {later}.last - {earlier}.last)")
        weight = f"({aged} + {later}.weight_{span})"
        parts[span] = (f"({earlier}.mean_{span} * {aged} + "
                       f"{later}.mean_{span} * {later}.weight_{span}) / {weight}", weight)
    both = _state(f"{later}.last", parts)
    return f"CASE WHEN {earlier} IS NULL THEN {later} WHEN {later} IS NOT NULL THEN {both} END"


def state_columns() -> list[str]:
    """Columns that hold a series' state after a row: mean and weight per column and span."""
    return [f"{c}_{part}_{span}" for c in WINDOWED for span in EWMA_SPANS for part in ("mean", "weight")]


def _seeded(seed: DataFrame) -> DataFrame:
    """States from before the first row, as those of a block ahead of all others."""
    states = []
    for c in WINDOWED:
        parts = {span: (f"{c}_mean_{span}", f"{c}_weight_{span}") for span in EWMA_SPANS}
        known = f"{c}_mean_{EWMA_SPANS[0]} IS NOT NULL"
        states.append(f"CASE WHEN {known} THEN {_state('CAST(-1 AS BIGINT)', parts)} END AS {c}")
    return seed.selectExpr("station_id", "CAST(-1 AS BIGINT) AS block", *states)


def block_states(df: DataFrame, block_rows: int, seed: DataFrame | None = None) -> DataFrame:
    """State each block starts with, one row per (station, block).

    ``seed`` has ``state_columns`` of series that began before their first row here.
    """
    k = f"(pos - block * {block_rows})"
    sums, states = [], []
    for c in WINDOWED:
        sums.append(F.expr(f"max(CASE WHEN {c} IS NOT NULL THEN {k} END)").alias(f"{c}_k"))
        parts = {}
        for span in EWMA_SPANS:
            s, w = _sums(c, span, k)
            sums += [F.expr(s).alias(f"{c}_s{span}"), F.expr(w).alias(f"{c}_w{span}")]
            parts[span] = (f"{c}_s{span} / {c}_w{span}",
                           f"{c}_w{span} / {_growth(span, f'{c}_k')}")
        state = _state(f"block * {block_rows} + {c}_k", parts)
        states.append(f"CASE WHEN {c}_k IS NOT NULL THEN {state} END AS {c}")
    totals = layout.with_block(df, block_rows).groupBy("station_id", "block").agg(*sums)
    own = totals.selectExpr("station_id", "block", *states)
    if seed is not None:
        own = own.unionByName(_seeded(seed))

    before = ("OVER (PARTITION BY station_id ORDER BY block "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    met = own.selectExpr(
        "*", *[f"last({c}, true) {before} AS {c}_prev" for c in WINDOWED])
    joined = met.selectExpr(
        "station_id", "block", *[f"{_combined(f'{c}_prev', c)} AS {c}" for c in WINDOWED])
    return joined.selectExpr(
        "station_id", "block",
        *[f"last({c}, true) {before} AS {c}_carry" for c in WINDOWED])


def ewma_sums(f: Frames, block_rows: int) -> dict[str, str]:
    """Sums over a block's own values so far, to be met with its state."""
    k = f"CASE WHEN own THEN pos - block * {block_rows} END"
    out = {}
    for c in WINDOWED:
        for span in EWMA_SPANS:
            out[f"_{c}_s{span}"], out[f"_{c}_w{span}"] = _sums(c, span, k, f.so_far())
    return out


def ewma_from(block_rows: int) -> dict[str, str]:
    out = {}
    for c in WINDOWED:
        state = f"{c}_carry"
        for span in EWMA_SPANS:
            s, w, mean = f"_{c}_s{span}", f"_{c}_w{span}", f"{state}.mean_{span}"
            weight = (f"{state}.weight_{span} * "
                      f"pow({decay(span)!r}D, block * {block_rows} - {state}.last)")
            out[f"{c}_ewma_{span}h"] = (
                f"CASE WHEN {w} IS NULL THEN {mean} WHEN {state} IS NULL THEN {s} / {w} "
                f"ELSE ({s} + {mean} * {weight}) / ({w} + {weight}) END")
    return out


def ewma_weights(block_rows: int) -> dict[str, str]:
    """The weight behind each mean, as seen at its row: with the mean, the state after it."""
    out = {}
    for c in WINDOWED:
        state = f"{c}_carry"
        for span in EWMA_SPANS:
            w, d = f"_{c}_w{span}", f"{decay(span)!r}D"
            aged = f"pow({d}, pos - block * {block_rows})"
            carried = f"{state}.weight_{span} * pow({d}, pos - {state}.last)"
            out[f"{c}_weight_{span}"] = (
                f"CASE WHEN {w} IS NULL THEN {carried} WHEN {state} IS NULL THEN {w} * {aged} "
                f"ELSE {w} * {aged} + {carried} END")
    return out


GROUPS = {
    "rolling_mean": rolling_mean,
    "rolling_std": rolling_std,
    "rolling_minmax": rolling_extremes,
    "lags": lags,
    "change_rate": change_rates,
    "targets": targets,
}


def with_window_features(df: DataFrame, groups: list[str], frame: str = "rows",
                         block_rows: int = layout.BLOCK_ROWS, seed: DataFrame | None = None,
                         weights: bool = False, numbered: bool = False) -> DataFrame:
    """Add the named groups (keys of ``GROUPS``, and ``ewma``).

    ``frame="rows"`` counts rows of the series, ``frame="time"`` counts hours,
    which differ where hours are missing. For parts of series, ``seed`` gives the state
    before a part's first row; with ``weights`` the weights behind the means are added.
    Rows that are ``numbered`` bring ``pos`` as ``layout.positions`` would make it.
    """
    if frame not in ("rows", "time"):
        raise ValueError("frame is 'rows' or 'time'")
    by_hour = frame == "time"
    place = layout.hour_positions if by_hour else layout.positions
    placed = df if numbered else place(df)
    with_ewma = "ewma" in groups
    columns = [c for c in df.columns if not numbered or c != "pos"]

    back = HALO_BACK if set(groups) - {"targets", "ewma"} else 0
    ahead = HALO_AHEAD if "targets" in groups else 0
    blocks = layout.blocks_with_halo(placed, block_rows, back, ahead, from_zero=not by_hour)
    frames = Frames(by_hour=by_hour)

    made: dict[str, str] = {}
    for name in groups:
        if name != "ewma":
            made |= GROUPS[name](frames)
    spans = ranges()
    names = [e for n in made for e in ((n, spans[n]) if n in spans else (n,))]
    if with_ewma:
        made |= ewma_sums(frames, block_rows)
    out = blocks.selectExpr(
        *columns, "pos", "block", "own", *[f"{e} AS {n}" for n, e in made.items()]
    ).filter("own")
    if not with_ewma:
        return out.selectExpr(*columns, *names)
    # joined on what the windows are partitioned by: the wide rows stay put
    states = block_states(placed.select("station_id", "pos", *WINDOWED), block_rows, seed)
    ewma = ewma_from(block_rows) | (ewma_weights(block_rows) if weights else {})
    return out.join(states, ["station_id", "block"], "left").selectExpr(
        *columns, *names, *[f"{e} AS {n}" for n, e in ewma.items()])
