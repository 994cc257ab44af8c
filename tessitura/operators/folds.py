"""Recursive kernels over tables: a fold that carries state along sorted tracks, and a parallel scan for linear ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.operators.kernels import CLOSED, Kernel, System, coefficient, followed, run


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint, where a folder for them is set (spark.checkpoint.dir): a step that reads its input twice then doubles nothing
    of what is below it, and a lost executor costs a re-read. Else df itself."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df


#: Tracks of similar length that go through a kernel side by side, their frames with what fills them up to the longest, the rows that a task
#: holds at a time, and those that it hands on at once.
SIDE, CELLS, ROWS, HANDED = 256, 1 << 19, 1 << 18, 1 << 16


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {'double' if df.schema[c].dataType.simpleString() in ('float', 'double') else df.schema[c].dataType.simpleString()}" for c in columns)


def _codes(part: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """The number of the run of equal values that each row of sorted rows is in; null equals null."""
    new = np.zeros(len(part), bool)
    for c in columns:
        v = pd.factorize(part[c], use_na_sentinel=False)[0]
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _whole_runs(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches, cut anew so that no run of equal values is split."""
    held: list[pd.DataFrame] = []
    for part in batches:
        if len(part):
            code = _codes(part, columns)
            last = int(np.searchsorted(code, code[-1]))
            if last:
                yield pd.concat([*held, part.iloc[:last]], ignore_index=True) if held else part.iloc[:last].reset_index(drop=True)
                held = []
            elif held and _codes(pd.concat([held[-1].iloc[-1:], part.iloc[:1]]), columns)[-1]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _numbered(keys: pa.Array) -> np.ndarray:
    """_codes of a column in Arrow, whose values become no Python objects."""
    new = np.zeros(len(keys), bool)
    if len(keys) > 1:
        null = keys.is_null(nan_is_null=True).to_numpy(zero_copy_only=False)
        differ = pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
        new[1:] = differ & ~(null[1:] & null[:-1]) | (null[1:] != null[:-1])
    return np.cumsum(new)


def _ended(batches):
    yield from batches
    yield None


def _same(a, b) -> bool:
    return bool(a == b or pd.isna(a) and pd.isna(b))


def _side_by_side(values: np.ndarray, code: np.ndarray, kernel: Kernel) -> np.ndarray:
    """Whole tracks through a kernel, SIDE at a time, or so many that CELLS hold them, the shortest first."""
    sizes = np.bincount(code - code[0])
    starts = np.cumsum(sizes) - sizes
    out, order = np.empty_like(values), np.argsort(sizes, kind="stable")
    a = 0
    while a < len(order):
        some = order[a : a + SIDE]
        fits = sizes[some] * np.arange(1, len(some) + 1) <= CELLS
        some = some[: max(1, int(fits.sum()))]
        a += len(some)
        x = np.zeros((sizes[some].max(), len(some), values.shape[1]))
        for n, k in enumerate(some):
            x[: sizes[k], n] = values[starts[k] : starts[k] + sizes[k]]
        y, _ = run(kernel, x)
        for n, k in enumerate(some):
            out[starts[k] : starts[k] + sizes[k]] = y[: sizes[k], n]
    return out


def fold(signal: DataFrame, key: str, kernel: Kernel, channels: list[str], partitions: int | None = None, dealt: bool = False) -> DataFrame:
    """(key, frame, channels): each track through a kernel, in the order of its frames.

    One shuffle by key and one sort, which a chain of kernels shares. A task reads its sorted tracks in stretches of ROWS rows:
    tracks that end within one are stepped side by side, so that numpy works on whole frames of tracks; a longer one goes
    on with the state it had, so that memory does not grow with a track. State starts at silence. With `dealt`, no track of the
    signal is in two partitions, and nothing is shuffled.
    """
    cut = signal.select(key, "frame", *[F.col(c).cast("double").alias(c) for c in channels])

    names = [key, "frame", *channels]

    def apply(batches):
        held, rows, state, track = [], 0, None, None  # state: of the track that goes on
        for part in _ended(batches):
            if part is not None:
                held.append(part)
                rows += part.num_rows
            if not rows or part is not None and rows < ROWS:
                continue
            own = pa.Table.from_batches(held).combine_chunks()
            keys, frames, *read = (own.column(k).chunk(0) for k in range(len(names)))
            code = _numbered(keys)
            values = np.empty((rows, len(channels)))
            for k, column in enumerate(read):
                values[:, k] = column.to_numpy(zero_copy_only=False)
            del read, column
            if state is not None and not _same(track, keys[0].as_py()):
                state = None
            edge = 0
            if state is not None:
                edge = int(np.searchsorted(code, 1))
                y, state = run(kernel, values[:edge, None, :], state)
                values[:edge] = y[:, 0]
                state = state if edge == rows else None
            last = rows if part is None else int(np.searchsorted(code, code[-1]))
            if last > edge:
                values[edge:last] = _side_by_side(values[edge:last], code[edge:last], kernel)
                edge = last
            if rows - edge >= ROWS:
                y, state = run(kernel, values[edge:, None, :])
                values[edge:], edge = y[:, 0], rows
            track = keys[-1].as_py()
            held, rows = (own.slice(edge).to_batches(), rows - edge) if edge < rows else ([], 0)
            del own
            for a in range(0, edge, HANDED):
                b = min(edge, a + HANDED)
                yield pa.RecordBatch.from_arrays([keys[a:b], frames[a:b], *[pa.array(values[a:b, k], from_pandas=True) for k in range(len(channels))]], names)

    # a stated number: steps cost more than their bytes tell, so partitions are not to be put together
    own = cut if dealt else cut.repartition(partitions or int(signal.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return own.sortWithinPartitions(key, "frame").mapInArrow(apply, _schema(cut, names))


#: A sample under this is silent, and a track that has been silent for so many seconds has ended.
QUIET, HUSH = 1e-6, 2.0
#: Seconds after which a tail is cut off that has not ended: a driven feedback loop may sound for ever.
LONGEST = 600.0


def fold_until_silent(signal: DataFrame, key: str, kernel: Kernel, channels: list[str], rate: float, quiet: float = QUIET, hush: float = HUSH, longest: float = LONGEST) -> DataFrame:
    """What fold gives, and after a track's last frame the frames in which its kernel goes on ringing, until none of them has passed
    `quiet` for `hush` seconds; those silent seconds are left out. A tail that sounds on after `longest` seconds ends there."""
    cut = signal.select(key, "frame", *[F.col(c).cast("double").alias(c) for c in channels])
    patience = max(1, int(hush * rate))

    def rung(track, frame, state):
        held, silent, left = [], 0, int(longest * rate)
        while silent < patience and left > 0:
            y, state = run(kernel, np.zeros((min(patience, ROWS, left), 1, len(channels))), state)
            left -= len(y)
            loud = np.flatnonzero(np.abs(y).max((1, 2)) > quiet)
            held.append(y[:, 0])
            silent = silent + len(y) if not len(loud) else len(y) - 1 - int(loud[-1])
            if len(loud):
                some = np.concatenate(held)
                some = some[: len(some) - silent]
                yield pd.DataFrame({key: track, "frame": np.arange(frame + 1, frame + 1 + len(some)), **{c: some[:, n] for n, c in enumerate(channels)}})
                frame, held = frame + len(some), [y[len(y) - silent :, 0]] if silent else []

    def apply(batches):
        track, frame, state = None, None, None
        for part in batches:
            if not len(part):
                continue
            code, values = _codes(part, [key]), part[channels].to_numpy(float)
            for a, b in zip((edges := np.append(np.flatnonzero(np.append(True, np.diff(code) > 0)), len(part))), edges[1:]):
                if state is not None and not _same(track, part[key].iloc[a]):
                    yield from rung(track, frame, state)
                    state = None
                y, state = run(kernel, values[a:b, None, :], state)
                values[a:b], track, frame = y[:, 0], part[key].iloc[a], int(part["frame"].iloc[b - 1])
                yield part.iloc[a:b].assign(**{c: values[a:b, n] for n, c in enumerate(channels)})
        if state is not None:
            yield from rung(track, frame, state)

    dealt = cut.repartition(int(signal.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return dealt.sortWithinPartitions(key, "frame").mapInPandas(apply, _schema(cut, [key, "frame", *channels]))


def _dealt(signal: DataFrame, key: str, block: int) -> DataFrame:
    """signal with `_track` and `_block`, dealt out by them. A track is a struct, which equals itself even where its key is null; the number of
    partitions is a stated one, as steps cost more than their bytes tell."""
    parts = int(signal.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return signal.withColumns({"_track": F.struct(key), "_block": F.floor(F.col("frame") / block)}).repartition(parts, "_track", "_block")


def _joined(blocks: DataFrame, began: DataFrame, key: str, state: str) -> DataFrame:
    """Blocks with the state that each begins with; they stay where they are."""
    return blocks.join(began.select(F.struct(key).alias("_track"), "_block", state), ["_track", "_block"])


def affine_scan(signal: DataFrame, key: str, system: System, channels=("x",), block: int = 256) -> DataFrame:
    """(key, frame, channels): a linear recurrence s' = M s + B x, y = C s + D x over tracks of any length, a block at a time.

    A block's end state from silence is a matrix product, and the state at its start follows from those before it, by a fold
    over one row a block; then a block's output is a product with the impulse response, plus the response to its start.
    Exact for any length, as the fold carries the state itself. Tracks have frames 0 to n-1; a missing one counts as silence. The signal is shuffled by track and
    block, so no task holds a track; the blocks' states alone are sorted by track.
    """
    channels = list(channels)
    m, b, c = (np.asarray(v, float) for v in system[:3])
    n, wide = len(m), len(channels)
    powers = [np.eye(n)]
    for _ in range(block):
        powers.append(powers[-1] @ m)
    response = np.array([c @ p @ b for p in powers[: block - 1]])
    toeplitz = np.zeros((block, block))  # [from, to]
    for k in range(block):
        toeplitz[k, k], toeplitz[k, k + 1 :] = system[3], response[: block - k - 1]
    into = np.stack([p @ b for p in powers[block - 1 :: -1]])  # [frame, state] at the end of a block
    answers, jump = np.stack([c @ p for p in powers[:block]]), powers[block]
    kind = signal.schema[key].dataType.simpleString()
    blocks = _dealt(signal.select(key, "frame", *[F.col(x).cast("double").alias(x) for x in channels]), key, block)

    def filled(part: pd.DataFrame):
        code = _codes(part, [key, "_block"])
        at = (part["frame"] - part["_block"] * block).to_numpy()
        x = np.zeros((code[-1] + 1, wide, block))
        for k, name in enumerate(channels):
            x[code, k, at] = part[name].to_numpy()
        return code, at, x

    def ends(batches):
        for part in _whole_runs(batches, [key, "_block"]):
            code, _, x = filled(part)
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            yield pd.DataFrame({key: part[key].to_numpy()[first], "_block": part["_block"].to_numpy()[first], "_state": list((x @ into).reshape(len(x), -1))})

    def starts(batches):
        last, state, after = None, np.zeros((wide, n)), 0
        for part in batches:
            if not len(part):
                continue
            begin, out = np.append(True, np.diff(_codes(part, [key])) > 0), []
            begin[0] = last is None or not _same(part[key].iloc[0], last[0])
            for new, k, own in zip(begin, part["_block"], part["_state"]):
                if new:
                    state = np.zeros((wide, n))
                elif k > after:  # blocks without a frame
                    state = state @ np.linalg.matrix_power(jump, k - after).T
                out.append(state.ravel())
                state, after = state @ jump.T + np.reshape(own, (wide, n)), k + 1
            last = (part[key].iloc[-1],)
            yield part.assign(_state=out)

    def finish(batches):
        for part in _whole_runs(batches, [key, "_block"]):
            code, at, x = filled(part)
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            state = np.stack(part["_state"].to_numpy()[first]).reshape(len(x), wide, n)
            y = x @ toeplitz + state @ answers.T
            yield pd.DataFrame({key: part[key], "frame": part["frame"], **{name: y[code, k, at] for k, name in enumerate(channels)}})

    states = f"`{key}` {kind}, _block long, _state array<double>"
    ended = blocks.drop("_track").sortWithinPartitions(key, "_block", "frame").mapInPandas(ends, states)
    began = ended.repartition(key).sortWithinPartitions(key, "_block").mapInPandas(starts, states)
    both = _joined(blocks, began, key, "_state")
    out = both.select(key, "_block", "frame", *channels, "_state").sortWithinPartitions(key, "_block", "frame")
    return out.mapInPandas(finish, f"`{key}` {kind}, frame long, " + ", ".join(f"`{x}` double" for x in channels))


def follower_scan(signal: DataFrame, key: str, up: float, down: float, start: float, low: float, high: float, x: str = "x", keep=(), block: int = 256) -> DataFrame:
    """(key, frame, x, keep): y' = x + c (y - x) with c = `up` where x > y and `down` otherwise, over tracks of any length, a block at a time.

    A frame takes y to the greater (or, if it rises more slowly than it falls, the lesser) of two lines, so a block takes it to the greatest of one
    line for each number of rises in it: a convex function, of which a block finds the intercepts, for all its starts between
    `low` and `high`, where x and `start` must lie. A fold over one row a block finds the starts; then all blocks are
    stepped side by side. Tracks have frames 0 to n-1. The signal is shuffled by track and block; the lines alone, at most a number a frame, are sorted by track.
    """
    keep = list(keep)
    rises, falls, sign = (up, down, 1.0) if up <= down else (down, up, -1.0)
    kind = signal.schema[key].dataType.simpleString()
    blocks = _dealt(signal.select(key, "frame", F.col(x).cast("double").alias(x), *[F.col(c).cast("double").alias(c) for c in keep]), key, block)

    def grid(part: pd.DataFrame):
        code = _codes(part, [key, "_block"])
        at = (part["frame"] - part["_block"] * block).to_numpy()
        values = np.zeros((block, code[-1] + 1))
        values[at, code] = part[x].to_numpy()
        return code, at, values, np.bincount(code, minlength=code[-1] + 1)

    def lines(batches):
        ends = np.array([low, high] if sign > 0 else [-high, -low])
        for part in _whole_runs(batches, [key, "_block"]):
            code, _, values, sizes = grid(part)
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            lanes, out = values.shape[1], [None] * values.shape[1]
            cuts = np.zeros((lanes, 1))  # by the number of rises
            for k in range(int(sizes.max())):
                target = sign * values[k][:, None]
                wide = np.full((lanes, k + 2), -np.inf)
                wide[:, 1:] = target * (1 - rises) + rises * cuts
                wide[:, :-1] = np.maximum(wide[:, :-1], target * (1 - falls) + falls * cuts)
                cuts = wide
                done = np.flatnonzero(sizes == k + 1)
                if len(done):
                    slope = rises ** np.arange(k + 2) * falls ** np.arange(k + 1, -1, -1)
                    best = np.sort((slope * ends[:, None] + cuts[done][:, None, :]).argmax(2), 1)
                    for lane, (a, b) in zip(done, best):  # no line beyond the best ones at both ends is ever the best
                        out[lane] = (int(a), cuts[lane, a : b + 1])
            yield pd.DataFrame({key: part[key].to_numpy()[first], "_block": part["_block"].to_numpy()[first], "_size": sizes, "_first": [o[0] for o in out], "_cuts": [o[1] for o in out]})

    def starts(batches):
        last, y = None, start
        for part in batches:
            if not len(part):
                continue
            begin, out = np.append(True, np.diff(_codes(part, [key])) > 0), []
            begin[0] = last is None or not _same(part[key].iloc[0], last[0])
            for new, size, a, cuts in zip(begin, part["_size"], part["_first"], part["_cuts"]):
                y = start if new else y
                out.append(y)
                n = np.arange(a, a + len(cuts))
                y = sign * float(np.max(rises**n * falls ** (size - n) * (sign * y) + cuts))
            last = (part[key].iloc[-1],)
            yield pd.DataFrame({key: part[key], "_block": part["_block"], "_start": out})

    def finish(batches):
        for part in _whole_runs(batches, [key, "_block"]):
            code, at, values, _ = grid(part)
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            y = followed(values, part["_start"].to_numpy()[first], up, down)
            yield pd.DataFrame({key: part[key], "frame": part["frame"], x: y[at, code], **{c: part[c] for c in keep}})

    ended = blocks.drop("_track").sortWithinPartitions(key, "_block", "frame").mapInPandas(lines, f"`{key}` {kind}, _block long, _size long, _first long, _cuts array<double>")
    began = ended.repartition(key).sortWithinPartitions(key, "_block").mapInPandas(starts, f"`{key}` {kind}, _block long, _start double")
    both = _joined(blocks, began, key, "_start")
    out = both.select(key, "_block", "frame", x, *keep, "_start").sortWithinPartitions(key, "_block", "frame")
    return out.mapInPandas(finish, f"`{key}` {kind}, frame long, `{x}` double" + "".join(f", `{c}` double" for c in keep))


#: Frames of a block whose windows look back; at least as many as they look back.
BACK = 4096


def _looking_back(signal: DataFrame, key: str, frames: int, columns) -> DataFrame:
    """signal with `columns`, functions of a window over the rows of each track so far, which look back `frames` frames at most: each block of
    a track is a window of its own, which has those frames of the block before as well."""
    size = max(BACK, frames)
    mine = F.floor(F.col("frame") / size)
    twice = signal.withColumn("_block", F.explode(F.when(F.col("frame") % size >= size - frames, F.array(mine, mine + 1)).otherwise(F.array(mine))))
    order = Window.partitionBy(key, "_block").orderBy("frame")
    return twice.withColumns({name: make(order) for name, make in columns.items()}).filter(mine == F.col("_block")).drop("_block")


def _decibels(x):
    return F.when(x <= 1e-6, F.lit(-120.0)).otherwise(20 * F.log10(F.greatest(x, F.lit(1e-12))))


#: Decibels that any sample has at most.
LOUDEST = 6200.0


def compressed(signal: DataFrame, key: str, rate: float, threshold: float, slope: float, knee: float, attack: float, release: float, makeup: float, frames: int, limit: bool) -> DataFrame:
    """(key, frame, l, r): the compressor over tracks with frames 0 to n-1, many blocks of a track at a time. Look-ahead is a window over blocks, the
    level's follower a scan, all else an expression."""
    peak = F.greatest(F.abs("l"), F.abs("r"))
    before = lambda c: lambda w: F.coalesce(F.lag(c, frames).over(w), F.lit(0.0))
    loudest = lambda w: F.max(peak).over(w.rowsBetween(-(frames - 1), 0) if limit else w.rowsBetween(0, 0))
    found = _looking_back(signal.select(key, "frame", "l", "r"), key, frames, {"_level": loudest, "_l": before("l"), "_r": before("r")})
    found = found.select(key, "frame", _decibels(F.col("_level")).alias("_level"), F.col("_l").alias("l"), F.col("_r").alias("r"))
    env = follower_scan(found, key, coefficient(attack, rate), coefficient(release, rate), -120.0 if limit else 0.0, -120.0, LOUDEST, "_level", ["l", "r"])
    over = F.col("_level") - threshold
    lost = F.when(over > 0, over * slope).otherwise(F.lit(0.0))
    if knee > 0:
        t = (over + knee / 2) / knee
        lost = F.when(F.abs(over) < knee / 2, t * t * (slope * knee / 2)).when(over >= knee / 2, over * slope).otherwise(F.lit(0.0))
    gain = F.pow(F.lit(10.0), (makeup - lost) / 20)
    return env.select(key, "frame", (F.col("l") * gain).alias("l"), (F.col("r") * gain).alias("r"))


def gated(signal: DataFrame, key: str, rate: float, threshold: float, attack: float, release: float, hold: int, floor: float) -> DataFrame:
    """(key, frame, l, r): the gate over tracks with frames 0 to n-1, many blocks of a track at a time: the level's follower is a scan, the hold
    a window over blocks, and the gain's follower a scan again."""
    up, down = coefficient(attack, rate), coefficient(release, rate)
    level = signal.select(key, "frame", _decibels(F.greatest(F.abs("l"), F.abs("r"))).alias("_level"), "l", "r")
    env = follower_scan(level, key, up, down, -120.0, -120.0, LOUDEST, "_level", ["l", "r"])
    open_ = lambda w: F.max(F.when(F.col("_level") >= threshold, 1)).over(w.rowsBetween(-hold, 0))
    found = _looking_back(env, key, max(1, hold), {"_open": open_})
    found = found.select(key, "frame", F.when(F.col("_open") == 1, F.lit(0.0)).otherwise(F.lit(floor)).alias("_gain"), "l", "r")
    gain = follower_scan(cut(found), key, up, down, floor, min(floor, 0.0), 0.0, "_gain", ["l", "r"])
    factor = F.when(F.col("_gain") <= CLOSED, F.lit(0.0)).otherwise(F.pow(F.lit(10.0), F.col("_gain") / 20))
    return gain.select(key, "frame", (F.col("l") * factor).alias("l"), (F.col("r") * factor).alias("r"))


def dynamics(signal: DataFrame, key: str, kernel: Kernel) -> DataFrame:
    """A compressor or gate by its scan in place of the fold."""
    name, values = kernel.dynamics
    return (compressed if name == "compressor" else gated)(signal, key, **values)


def delayed(signal: DataFrame, key: str, frames: int, x: str = "x") -> DataFrame:
    """A delay of whole frames, silent before; a window, no Python."""
    return signal.withColumn(x, F.coalesce(F.lag(x, frames).over(Window.partitionBy(key).orderBy("frame")), F.lit(0.0)))


def lookahead_peak(signal: DataFrame, key: str, frames: int, x: str = "x") -> DataFrame:
    """x delayed by `frames`, and the peak of the last `frames` frames, on one sort."""
    order = Window.partitionBy(key).orderBy("frame")
    peak = F.max(F.abs(x)).over(order.rowsBetween(-(frames - 1), 0))
    return signal.withColumns({"peak": peak, "delayed": F.coalesce(F.lag(x, frames).over(order), F.lit(0.0))})


def interpolated_delay(signal: DataFrame, key: str, frames: float, x: str = "x") -> DataFrame:
    """A delay of a fractional number of frames without feedback, from two lags on one sort."""
    order, low = Window.partitionBy(key).orderBy("frame"), int(frames)
    tap = lambda d: F.coalesce(F.lag(x, d).over(order), F.lit(0.0))
    return signal.withColumn(x, tap(low) * (1 - (frames - low)) + tap(low + 1) * (frames - low))
