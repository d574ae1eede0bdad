"""Quantities recorded in different units: penalised segmentation of each trace's history, then conversion to °C."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import _spike_kernel, _unit_kernel as kernel
from tracelake.operators._groups import groups, numbers
from tracelake.operators._slots import HALO_SLOTS, chunked
from tracelake.session import materialize

UNITS = kernel.UNITS
#: Costs that evidence from outside the values puts on a trace beginning in another unit.
NAME_COST, NOTE_COST, GUESS_COST, FOREIGN_COST, LOGGER_COST, TRACE_CAP = 40.0, 25.0, 3.0, 3.0, 20.0, 30.0
#: How channel names and header notes tell a unit; the first that matches holds.
NAME_PATTERNS = (
    ("dC", r"(?i)1/10 ?°?c|deci-?c|\bx ?10\b"),
    ("F", r"(?i)\(°?f\)|[\[_ ]deg\.? ?f|fahrenheit"),
    ("K", r"(?i)\(k\)|[\[_]k\]?$|kelvin"),
    ("C", r"(?i)\(°?c\)|[\[_ ]deg\.? ?c|celsius"),
)
NOTE_PATTERNS = (
    ("dC", r"(?i)tenths|by 10\b|0\.1 ?°?(deg)? ?c"),
    ("F", r"(?i)fahrenheit|imperial|temp(erature)? unit ?= ?(deg)? ?f\b"),
    ("K", r"(?i)kelvin|thermodynamic|absolute|temp(erature)? unit ?= ?(deg)? ?k\b"),
    ("C", r"(?i)celsius|metric|temp(erature)? unit ?= ?(deg)? ?c\b"),
)
#: Nodes that one node of the next level joins.
FANOUT = 256
_EDGES = "first_value double, last_value double, first_scale double, last_scale double, linked_first boolean, linked_last boolean, first_us long, last_us long, interval_s double"
_NODE_DDL = f"trace_id string, node long, costs array<double>, {_EDGES}"
_SEGMENT_DDL = (
    f"trace_id string, chunk long, costs array<double>, {_EDGES}, n long, n_setpoint long, "
    "pair array<int>, path_us array<long>, path_row array<long>, path_unit array<int>, path_n array<long>, "
    "path_low array<double>, path_high array<double>"
)
_PACKED_DDL = (
    "trace_id string, chunk long, interval_s double, us array<long>, row_idx array<long>, value array<double>, setpoint array<double>, core array<boolean>, "
    "bend array<int>, bend_n array<long>, step array<int>, step_n array<long>"
)
_READING_DDL = "trace_id string, row_idx long, unit_no int, value double"
_CHOSEN_DDL = "trace_id string, node long, first_unit int, last_unit int"
_RUN_DDL = "trace_id string, run long, unit int"
#: A stretch's levels are the extremes of its readings' rolling medians over so many readings on either side.
LEVEL_HALF = 20
_KINDS = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    "array<boolean>": pa.list_(pa.bool_()),
}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(part.split()[0], _KINDS[part.split()[1]]) for part in ddl.split(", ")])


def _batch(out: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)


def unit_told(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """The unit a text tells, null if none."""
    told = F.lit(None).cast("string")
    for unit, pattern in reversed(patterns):
        told = F.when(text.rlike(pattern), unit).otherwise(told)
    return told


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk: its readings in order of time, copies left out, and how many bends and steps have which size."""
    schema = _schema(_PACKED_DDL)
    columns = ("us", "row_idx", "value", "setpoint")
    for table, bounds in groups(batches, ("trace_id", "chunk")):
        core, chunks, intervals = table["core"].to_numpy(), numbers(table, "chunk"), numbers(table, "interval_s")
        whole = [numbers(table, n) for n in columns]
        for a, b in zip(bounds[:-1], bounds[1:]):  # a batch each, so that chunks don't pile up
            us, rows, values, setpoint = (c[a:b] for c in whole)
            once = np.flatnonzero(np.append(True, (us[1:] != us[:-1]) | (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])))
            own = core[a:b][once]
            if not own.any():
                continue
            bends, steps = _spike_kernel.own_sizes(values[once], own)
            found = (
                table["trace_id"][int(a)].as_py(), chunks[a], intervals[a], us[once], rows[once], values[once], setpoint[once], own,
                *_spike_kernel.size_bins(bends), *_spike_kernel.size_bins(steps[steps > _spike_kernel.LEAST]),
            )
            yield _batch({f.name: [x] for f, x in zip(schema, found)}, schema)


def packed(cells: DataFrame) -> DataFrame:
    """The chunks, one row each, written once: what reads them needs no shuffle or sort of readings again."""
    return materialize(cells.mapInArrow(_pack, _PACKED_DDL))


def chunk_rows(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Row number and list columns of each packed chunk of a batch, as arrays."""
    flat, bounds = [], []
    for name in names:
        column = batch.column(name)
        bounds.append(column.offsets.to_numpy())
        flat.append(column.values.to_numpy(zero_copy_only=False))
    for i in range(batch.num_rows):
        yield i, [f[o[i] : o[i + 1]] for f, o in zip(flat, bounds)]


def noise_scales(chunks: DataFrame) -> DataFrame:
    """(trace_id, chunk, noise): the noise of each trace, for every packed chunk of it.

    It is the median of the trace's bends (second differences) as a standard deviation, at least half its usual smallest
    step (first percentile); both are read from counts by logarithmic size, summed over the chunks, so they do not
    depend on where a trace is cut. A size is known to 1/16 of an octave.
    """
    each = lambda kind: chunks.select("trace_id", F.lit(kind).alias("kind"), F.explode(F.arrays_zip(F.col(kind).alias("bin"), F.col(f"{kind}_n").alias("n"))).alias("x"))
    counts = each("bend").unionByName(each("step")).groupBy("trace_id", "kind", "x.bin").agg(F.sum("x.n").alias("n"))
    whole = Window.partitionBy("trace_id", "kind")
    upto = F.sum("n").over(whole.orderBy("bin"))
    share = F.when(F.col("kind") == "bend", 0.5).otherwise(0.01)
    reached = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(whole)).filter(F.col("upto") >= share * F.col("all"))
    size = F.when(F.col("bin") > -32768, F.pow(F.lit(2.0), (F.col("bin") + 0.5) / _spike_kernel.BINS)).otherwise(0.0)
    told = reached.groupBy("trace_id").agg(*[F.min(F.when(F.col("kind") == k, size)).alias(k) for k in ("bend", "step")])
    noise = F.greatest(F.coalesce("bend", F.lit(0.0)) * _spike_kernel.MAD_TO_SIGMA / 6**0.5, F.coalesce("step", F.lit(0.0)) / 2)
    return chunks.select("trace_id", "chunk").join(told.select("trace_id", noise.alias("noise")), "trace_id", "left").select(
        "trace_id", "chunk", F.coalesce("noise", F.lit(0.0)).alias("noise")
    )


def segment_chunk(us: np.ndarray, rows: np.ndarray, values: np.ndarray, setpoint: np.ndarray, core: np.ndarray, interval: float, noise: float) -> dict:
    """Costs and paths of one chunk's own readings (see kernel.segment), spikes and bursts left out; the halo tells what is around them."""
    keep = np.flatnonzero(kernel.sane(values, noise))
    keep = keep[~kernel.bursts(values[keep], noise)]
    if not core[keep].any():
        keep = np.arange(len(values))
    holes = np.append(0, np.cumsum(np.diff(us) / 1e6 > kernel.HOLE_SLOTS * interval)) if interval > 0 else np.zeros(len(us), dtype=int)
    holes = holes[keep]
    value, own = values[keep], core[keep]
    rate, stuck = kernel.local_rate(value), kernel.frozen(value)
    emission = kernel.emission(value, setpoint[keep])[:, own]
    level = kernel.rolling_median(value, LEVEL_HALF)[own] if np.isfinite(setpoint[keep]).mean() < 0.1 else np.full(own.sum(), np.nan)
    keep, value, rate, stuck, holes = keep[own], value[own], rate[own], stuck[own], holes[own]
    cost, paths = kernel.segment(
        us[keep] / 1e6, value, setpoint[keep], interval, noise, least=kernel.MIN_STRETCH, refine=True, rows=emission, context=(rate, stuck, np.diff(holes) == 0)
    )
    scale, steps = np.maximum(noise, rate), np.abs(np.diff(value)) if len(value) > 1 else np.zeros(1)
    out = {
        "n": len(keep), "n_setpoint": int(np.isfinite(setpoint[keep]).sum()), "costs": cost.ravel(), "first_value": value[0],
        "last_value": value[-1], "first_scale": max(scale[0], steps[0]), "last_scale": max(scale[-1], steps[-1]), "linked_first": not stuck[0],
        "linked_last": not stuck[-1], "first_us": us[keep[0]], "last_us": us[keep[-1]], "interval_s": interval,
    }
    columns: dict[str, list] = {name: [] for name in ("pair", "path_us", "path_row", "path_unit", "path_n", "path_low", "path_high")}
    ends: dict[tuple[int, int], tuple] = {}  # the 16 paths share most of their stretches
    for first in range(kernel.N):
        for last in range(kernel.N):
            path = paths[first][last]
            for (at, unit), end in zip(path, [at for at, _ in path[1:]] + [len(keep)]):
                if (at, end) not in ends:
                    ends[at, end] = (level[at:end].min(), level[at:end].max())
                row = (first * kernel.N + last, us[keep[at]], rows[keep[at]], unit, end - at, *ends[at, end])
                for name, x in zip(columns, row):
                    columns[name].append(x)
    return out | columns


def _segment_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(_SEGMENT_DDL)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        intervals, noises, chunks = (batch.column(n).to_numpy() for n in ("interval_s", "noise", "chunk"))
        out: dict[str, list] = {f.name: [] for f in schema}
        for i, columns in chunk_rows(batch, ("us", "row_idx", "value", "setpoint", "core")):
            found = segment_chunk(*columns, float(intervals[i]), float(noises[i]))
            found |= {"trace_id": batch.column("trace_id")[i].as_py(), "chunk": int(chunks[i])}
            for name in out:
                out[name].append(found[name])
        yield _batch(out, schema)


def _links(table: pa.Table, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Costs of the pieces a .. b-1 of a trace, and of the level shift from each to the next."""
    part = table.slice(a, b - a)
    costs = part["costs"].combine_chunks().flatten().to_numpy().reshape(b - a, kernel.N, kernel.N)
    flag = lambda n: part[n].to_numpy().astype(bool)
    first_us, last_us, interval = (numbers(part, n) for n in ("first_us", "last_us", "interval_s"))
    near = (first_us[1:] - last_us[:-1]) / 1e6 <= kernel.HOLE_SLOTS * interval[1:]
    scale = np.maximum(numbers(part, "first_scale")[1:], numbers(part, "last_scale")[:-1])
    linked = flag("linked_first")[1:] & flag("linked_last")[:-1] & near
    return costs, kernel.jump_costs(numbers(part, "last_value")[:-1], numbers(part, "first_value")[1:], scale, linked)


def _join_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One node for each group of up to FANOUT nodes that follow each other."""
    schema = _schema(_NODE_DDL)
    for table, bounds in groups(batches, ("trace_id", "parent")):
        out: dict[str, list] = {f.name: [] for f in schema}
        for a, b in zip(bounds[:-1], bounds[1:]):
            a, b = int(a), int(b)
            out["costs"].append(kernel.compose(*_links(table, a, b)).ravel())
            for name, at in [("trace_id", a), ("interval_s", a)] + [(f"first_{n}", a) for n in ("value", "scale", "us")] + [("linked_first", a)]:
                out[name].append(table[name][at].as_py())
            for name in ("last_value", "last_scale", "last_us", "linked_last"):
                out[name].append(table[name][b - 1].as_py())
            out["node"].append(table["parent"][a].as_py())
        yield _batch(out, schema)


def _choose_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last unit of each node, from those of the node that it was joined to."""
    schema = _schema(_CHOSEN_DDL)
    for table, bounds in groups(batches, ("trace_id", "parent")):
        out: dict[str, list] = {f.name: [] for f in schema}
        nodes = numbers(table, "node")
        for a, b in zip(bounds[:-1], bounds[1:]):
            a, b = int(a), int(b)
            pairs = kernel.descend(*_links(table, a, b), table["first_unit"][a].as_py(), table["last_unit"][a].as_py())
            out["trace_id"] += [table["trace_id"][a].as_py()] * (b - a)
            out["node"] += nodes[a:b].tolist()
            out["first_unit"] += [p[0] for p in pairs]
            out["last_unit"] += [p[1] for p in pairs]
        yield _batch(out, schema)


def _grouped(nodes: DataFrame, run, ddl: str) -> DataFrame:
    return nodes.repartition("trace_id", "parent").sortWithinPartitions("trace_id", "parent", "node").mapInArrow(run, ddl)


def chosen_units(chunks: DataFrame, priors: DataFrame) -> DataFrame:
    """(trace_id, node, first_unit, last_unit): the units at both ends of each chunk on the cheapest way through its trace.

    Cost tables compose by min-plus products, which associate: FANOUT chunks that follow each other become a node, FANOUT
    nodes one of the next level, up to one per trace. There the ends are chosen, and from there down the ends of the
    nodes below; no task ever sees more than FANOUT nodes of a trace at once.
    """
    names = [part.split()[0] for part in _NODE_DDL.split(", ")]
    levels = [chunks.withColumnRenamed("chunk", "node").select(*names)]
    parent = F.floor(F.col("node") / FANOUT).cast("long").alias("parent")
    most = levels[0].agg(F.max("node")).first()[0] or 0  # one number
    while most > 0:
        levels.append(materialize(_grouped(levels[-1].select("*", parent), _join_nodes, _NODE_DDL)))
        most //= FANOUT
    ways = F.array(*[F.struct((F.col("prior")[i] + F.col("costs")[i * kernel.N + j]).alias("cost"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(kernel.N) for j in range(kernel.N)])
    best = F.array_min(ways)
    top = levels.pop().join(priors, "trace_id")
    chosen = top.select("trace_id", "node", best["i"].alias("first_unit"), best["j"].alias("last_unit"))
    for level in reversed(levels):
        above = chosen.withColumnRenamed("node", "parent")
        chosen = _grouped(level.select("*", parent).join(above, ["trace_id", "parent"]), _choose_nodes, _CHOSEN_DDL)
    return chosen


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of the runs of a trace that has several: changes its own levels contradict and runs that are too short are undone."""
    schema = _schema(_RUN_DDL)
    for table, bounds in groups(batches, ("trace_id",)):
        units, sizes, low, high = (numbers(table, n).copy() for n in ("unit", "n", "low", "high"))
        bare = table["bare"].to_numpy()
        for a, b in zip(bounds[:-1], bounds[1:]):
            if bare[a]:
                _undo_contradicted(units[a:b], low[a:b], high[a:b])
            for i in range(a + 1, b - 1):
                if sizes[i] < kernel.MIN_STRETCH:
                    units[i] = units[i - 1]
        yield pa.RecordBatch.from_arrays([table["trace_id"].combine_chunks().cast(pa.string()), table["run"].combine_chunks(), pa.array(units, type=pa.int32())], schema=schema)


def _undo_contradicted(units: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """Undo changes after which the levels fit those before the change only if the unit did not change."""

    def levels(lowest: float, highest: float, unit: int) -> np.ndarray:
        return kernel.SCALE[unit] * np.array([lowest, highest]) + kernel.OFFSET[unit]

    for i in range(1, len(units)):
        before, after = int(units[i - 1]), int(units[i])
        if before == after or not (np.isfinite(low[i]) and np.isfinite(low[:i]).any()):
            continue
        earlier = units[:i] == before
        if not np.isfinite(low[:i][earlier]).any():
            continue
        left = levels(np.nanmin(low[:i][earlier]), np.nanmax(high[:i][earlier]), before)
        changed, same = levels(low[i], high[i], after), levels(low[i], high[i], before)
        if left[1] - left[0] >= 20 and np.abs(same - left).max() < 5 < np.abs(changed - left).max() - 5:
            units[i] = before


def _priors(chunks: DataFrame, trace_rows: DataFrame, file_metadata: DataFrame) -> DataFrame:
    """One row per trace: cost of beginning in each unit, from channel name, header note, guess and logger.

    The logger's evidence sums, over its traces, how much dearer each unit is for the trace as a whole (capped).
    """
    channels = trace_rows.filter(F.col("trace_id").isNotNull()).groupBy("trace_id").agg(
        F.min("source_file").alias("source_file"), F.min("channel").alias("channel")
    )
    files = file_metadata.filter(F.col("source_file").isNotNull()).groupBy("source_file").agg(
        F.min("logger_id").alias("logger_id"), F.min("header_note").alias("note"), F.min("detected_temperature_unit").alias("guess")
    )
    traces = channels.join(files, "source_file", "left")
    stay = [F.sum(F.col("costs")[i * kernel.N + i]).alias(f"c{i}") for i in range(kernel.N)]
    own = chunks.groupBy("trace_id").agg(*stay)
    least = F.least(*[F.col(f"c{i}") for i in range(kernel.N)])
    own = own.select("trace_id", *[F.least(F.col(f"c{i}") - least, F.lit(TRACE_CAP)).alias(f"c{i}") for i in range(kernel.N)])
    known = traces.join(own, "trace_id", "left")
    logger = known.filter(F.col("logger_id").isNotNull()).groupBy("logger_id").agg(*[F.sum(f"c{i}").alias(f"l{i}") for i in range(kernel.N)])
    low = F.least(*[F.coalesce(F.col(f"l{i}"), F.lit(0.0)) for i in range(kernel.N)])
    told = known.join(logger, "logger_id", "left").select(
        "trace_id",
        unit_told(F.col("channel"), NAME_PATTERNS).alias("name"),
        unit_told(F.col("note"), NOTE_PATTERNS).alias("note"),
        # C is what the earlier step says of any name, F what it says of any with an f after temp: neither tells
        F.when((F.col("guess") == "K") | ((F.col("guess") == "F") & ~F.col("channel").rlike("(?i)te?mp.*f")), F.col("guess")).alias("told_guess"),
        *[F.least(F.coalesce(F.col(f"l{i}") - low, F.lit(0.0)), F.lit(LOGGER_COST)).alias(f"l{i}") for i in range(kernel.N)],
    )
    prior = []
    for i, unit in enumerate(UNITS):
        cost = F.col(f"l{i}") + F.lit(FOREIGN_COST if i else 0.0)
        cost = cost + F.when(F.col("name").isNotNull(), F.when(F.col("name") != unit, NAME_COST).otherwise(0.0)).otherwise(
            F.when(F.col("note") != unit, NOTE_COST).otherwise(0.0)
        )
        prior.append(cost + F.when(F.col("told_guess") != unit, GUESS_COST).otherwise(0.0))
    return told.select("trace_id", F.array(*prior).alias("prior"))


def unit_starts(packs: DataFrame, trace_rows: DataFrame, file_metadata: DataFrame) -> DataFrame:
    """Per trace and chunk, the readings at which a unit begins to hold (arrays start_us, start_row, unit), and the noise."""
    noise = materialize(noise_scales(packs))
    judged = packs.drop("bend", "bend_n", "step", "step_n").join(noise, ["trace_id", "chunk"])
    chunks = materialize(judged.mapInArrow(_segment_chunks, _SEGMENT_DDL))
    chosen = chosen_units(chunks, _priors(chunks, trace_rows, file_metadata)).withColumnRenamed("node", "chunk")
    zipped = F.arrays_zip("pair", "path_us", "path_row", "path_unit", "path_n", "path_low", "path_high")
    own = F.filter(zipped, lambda x: x["pair"] == F.col("first_unit") * kernel.N + F.col("last_unit"))
    stretches = chunks.join(chosen, ["trace_id", "chunk"]).select("trace_id", "chunk", "n_setpoint", F.col("n").alias("n_chunk"), F.posexplode(own).alias("place", "x"))
    order = Window.partitionBy("trace_id").orderBy("chunk", "place")
    begins = F.coalesce(F.lag("x.path_unit").over(order) != F.col("x.path_unit"), F.lit(False)).cast("long")
    stretches = stretches.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    stretches = materialize(stretches.select("trace_id", "chunk", "place", "run", "n_setpoint", "n_chunk", "x.*"))
    finite = lambda c: F.when(~F.isnan(c), F.col(c))
    runs = stretches.groupBy("trace_id", "run").agg(
        F.max("path_unit").alias("unit"), F.sum("path_n").alias("n"), F.min(finite("path_low")).alias("low"), F.max(finite("path_high")).alias("high")
    )
    first = F.col("place") == 0
    bare = stretches.groupBy("trace_id").agg(
        F.max("run").alias("last_run"), (F.sum(F.when(first, F.col("n_setpoint"))) < 0.1 * F.sum(F.when(first, F.col("n_chunk")))).alias("bare")
    )
    several = runs.join(bare.filter("last_run > 0"), "trace_id").select("trace_id", "run", "unit", "n", "low", "high", "bare")
    settled = several.repartition("trace_id").sortWithinPartitions("trace_id", "run").mapInArrow(_settle, _RUN_DDL)
    units = stretches.join(settled, ["trace_id", "run"], "left").withColumn("unit", F.coalesce("unit", "path_unit"))
    starts = units.groupBy("trace_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "path_us", "path_row", "unit"))).alias("s"))
    take = lambda name: F.transform("s", lambda x: x[name])
    starts = starts.select("trace_id", "chunk", take("path_us").alias("start_us"), take("path_row").alias("start_row"), take("unit").alias("unit"))
    return materialize(starts.join(noise, ["trace_id", "chunk"]))


def units_of(us: np.ndarray, rows: np.ndarray, start_us: np.ndarray, start_row: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The unit of each reading: that of the last start at or before it, the first one before any."""
    if len(units) == 1:
        return np.full(len(us), units[0])
    begun = (start_us[None, :] < us[:, None]) | ((start_us[None, :] == us[:, None]) & (start_row[None, :] <= rows[:, None]))
    return units[np.maximum(begun.sum(axis=1) - 1, 0)]


def with_units(cells: DataFrame, trace_rows: DataFrame, file_metadata: DataFrame) -> DataFrame:
    """The packed chunks with the readings at which a unit begins to hold (start_us, start_row, unit) and their trace's noise."""
    packs = packed(cells)
    return packs.drop("setpoint", "interval_s", "bend", "bend_n", "step", "step_n").join(unit_starts(packs, trace_rows, file_metadata), ["trace_id", "chunk"])


def _own_readings(foreign: bool):
    """Readings of the chunks themselves with their units; of foreign ones each row_idx once a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(_READING_DDL)
        for batch in batches:
            for i, (us, rows, values, core, start_us, start_row, unit) in chunk_rows(batch, ("us", "row_idx", "value", "core", "start_us", "start_row", "unit")):
                units = units_of(us, rows, start_us, start_row, unit)
                own = np.flatnonzero(core & (units > 0) if foreign else core)
                if foreign:
                    own = own[np.unique(rows[own], return_index=True)[1]]
                if len(own):
                    trace = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(own), np.int32)), batch.column("trace_id").slice(i, 1)).cast(pa.string())
                    row_idx = pa.array(rows[own], mask=rows[own] < 0)
                    yield pa.RecordBatch.from_arrays([trace, row_idx, pa.array(units[own].astype(np.int32)), pa.array(values[own])], schema=schema)

    return run


def _unit_name() -> Column:
    return F.element_at(F.array(*[F.lit(u) for u in UNITS]), F.col("unit_no") + 1)


def celsius(value: Column, unit_no: Column) -> Column:
    pick = lambda numbers_: F.element_at(F.array(*[F.lit(float(x)) for x in numbers_]), unit_no + 1)
    return value * pick(kernel.SCALE) + pick(kernel.OFFSET)


def readings_in_celsius(trace_rows: DataFrame, file_metadata: DataFrame) -> DataFrame:
    """Every reading with a temperature once: (trace_id, row_idx, recorded_unit, temperature_c).

    recorded_unit is C, F, K or dC (tenths of °C). Each chunk of a trace is segmented exactly (dynamic program over all
    readings, stretches of at least MIN_STRETCH, cost on log values: log-ratio to the setpoint in absolute temperature,
    plausible range, level shifts that a known mapping explains); the chunks' tables of cost by (first, last unit) are
    composed along the trace level by level, starting from what channel name, header note, guess and the logger's other
    traces tell. Neither a chunk's view (it has a halo) nor the noise (counted over the whole trace) depends on the cut.
    Rows without temperature (null, NaN, infinite), trace_id or ts are left out; rows delivered twice come out once;
    a null row_idx stays null; a trace without metadata is judged by its values; empty tables give an empty result.
    """
    packs = with_units(chunked(trace_rows, halo=HALO_SLOTS), trace_rows, file_metadata)
    rows = packs.mapInArrow(_own_readings(False), _READING_DDL)
    return rows.select("trace_id", "row_idx", _unit_name().alias("recorded_unit"), celsius(F.col("value"), F.col("unit_no")).alias("temperature_c"))


def foreign_readings(trace_rows: DataFrame, file_metadata: DataFrame) -> DataFrame:
    """Readings recorded in another unit than °C (trace_id, row_idx, recorded_unit)."""
    packs = with_units(chunked(trace_rows, halo=HALO_SLOTS), trace_rows, file_metadata)
    rows = packs.mapInArrow(_own_readings(True), _READING_DDL)
    return rows.select("trace_id", "row_idx", _unit_name().alias("recorded_unit"))
