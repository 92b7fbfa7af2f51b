"""Training-log roll-up and early stopping as keyed-state streams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from helixframe.config import EarlyStopOptions

GROUPS_PER_KEY = 1024
EVALUATIONS_PER_BLOCK = 4096

# The processors are local classes, so that they travel to the Python workers by
# value and the package need not be installed there.


def _loss_rollup(accumulation: int) -> StatefulProcessor:
    class LossRollup(StatefulProcessor):
        """Open optimizer steps of one (run, block): their loss so far and micro-steps seen.

        There are many such keys with few rows each, so a call is a few array operations, one read and one write of state.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.open = handle.getValueState(
                "open", "completed_steps array<bigint>, loss array<double>, n array<bigint>, small_step array<bigint>"
            )

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            groups, losses, places = [], [], []
            for chunk in rows:
                chunk = chunk[chunk["completed_steps"].notna().to_numpy()]
                groups.append(chunk["completed_steps"].to_numpy(dtype="int64"))
                losses.append(chunk["loss"].to_numpy(dtype="float64", na_value=math.nan))
                places.append(chunk["small_step"].to_numpy(dtype="int64"))
            names, at = np.unique(np.concatenate(groups), return_inverse=True)
            loss, place = np.concatenate(losses), np.concatenate(places)
            sums = np.bincount(at, weights=np.where(np.isnan(loss), 0.0, loss), minlength=len(names))  # a NULL counts as a row only
            counts, lasts = np.bincount(at, minlength=len(names)), np.full(len(names), np.iinfo(np.int64).min)
            np.maximum.at(lasts, at, place)
            # A step with all its micro-steps in this batch has none in the state.
            full = counts >= accumulation
            closed = list(zip(names[full].tolist(), sums[full].tolist(), lasts[full].tolist(), strict=True))
            kept = self.open.get()
            waiting = {g: (x, n, last) for g, x, n, last in zip(*kept, strict=True)} if kept else {}
            for group, x, n, last in zip(*(v[~full].tolist() for v in (names, sums, counts, lasts)), strict=True):
                if group in waiting:
                    before = waiting.pop(group)
                    x, n, last = x + before[0], n + before[1], max(last, before[2])
                if n >= accumulation:
                    closed.append((group, x, last))
                else:
                    waiting[group] = (x, n, last)
            if waiting:
                self.open.update((list(waiting), *(list(v) for v in zip(*waiting.values(), strict=True))))
            elif kept:
                self.open.clear()
            if closed:
                steps, total, last = zip(*closed, strict=True)
                yield pd.DataFrame({"run": [key[0]] * len(steps), "completed_steps": steps, "loss": np.array(total) / accumulation, "small_step": last})

        def close(self) -> None:
            pass

    return LossRollup()


def loss_rollup_stream(log: DataFrame, accumulation: int) -> DataFrame:
    """Optimizer-step loss, emitted once all micro-steps of the step have arrived.

    Input (run, small_step, loss), in any order. State is keyed by run and a block
    of optimizer steps, so one large run spreads over many tasks, and holds only
    steps that are not yet complete.
    """
    group = F.floor((F.col("small_step") - 1) / accumulation).cast("bigint")
    keyed = log.select("run", "small_step", "loss", group.alias("completed_steps")).withColumn(
        "block", F.floor(F.col("completed_steps") / GROUPS_PER_KEY).cast("bigint")
    )
    run_type = log.schema["run"].dataType.simpleString()
    return keyed.groupBy("run", "block").transformWithStateInPandas(
        statefulProcessor=_loss_rollup(accumulation),
        outputStructType=f"run {run_type}, completed_steps bigint, loss double, small_step bigint",
        outputMode="Append",
        timeMode="None",
    )


def _block_records(size: int) -> StatefulProcessor:
    class BlockRecords(StatefulProcessor):
        """The records of one block of evaluations, each higher than all before it, and evaluations before their turn.

        Whatever came before the block, its records tell the best so far at every place and which evaluations gain.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.known = handle.getValueState("known", "n bigint, places array<bigint>, metrics array<double>")
            self.early = handle.getValueState("early", "places array<bigint>, metrics array<double>")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            n, places, metrics = self.known.get() if self.known.exists() else (0, [], [])
            waiting = self.early.get() if self.early.exists() else ([], [])
            at, values = [np.array(waiting[0], dtype="int64")], [np.array(waiting[1], dtype="float64")]
            for chunk in rows:
                at.append((chunk["eval_no"].to_numpy() - 1) % size)
                values.append(chunk["metric"].to_numpy(dtype="float64"))
            at, first = np.unique(np.concatenate(at), return_index=True)  # a repeated evaluation counts once
            values = np.concatenate(values)[first][at >= n]
            at = at[at >= n]
            inside = at == n + np.arange(len(at))
            count = len(at) if inside.all() else int(inside.argmin())
            if count < len(at):
                self.early.update((at[count:].tolist(), values[count:].tolist()))
            elif self.early.exists():
                self.early.clear()
            if count:
                real = np.where(np.isnan(values[:count]), -math.inf, values[:count])  # NaN: no gain, and no new best
                before = np.maximum.accumulate(np.concatenate([[metrics[-1] if len(metrics) else -math.inf], real]))
                higher = np.flatnonzero(real > before[:-1])
                places, metrics = [*places, *(n + higher).tolist()], [*metrics, *real[higher].tolist()]
                n += count
                self.known.update((int(n), places, metrics))
                yield pd.DataFrame({"run": [key[0]], "block": [int(key[1])], "n": [int(n)], "places": [places], "metrics": [metrics]})

        def close(self) -> None:
            pass

    return BlockRecords()


def _early_stop(patience: int, threshold: float, size: int) -> StatefulProcessor:
    def walk(n: int, places, metrics, best: float, waited: int) -> tuple[int | None, float, int]:
        """Go through a block by its records: place of the stop, best so far, evaluations waited."""
        gained = -1 - waited
        for place, metric in zip(places, metrics, strict=True):
            if place - gained > patience:
                break
            if math.isfinite(metric) and metric - best > threshold:
                gained = place
            best = max(best, metric)
        stop = gained + patience
        # a stop before the block's end; records up to it, and no later ones, have been seen
        return (stop if stop < n else None), best, n - 1 - gained

    class EarlyStop(StatefulProcessor):
        """Progress of one run over its finished blocks, and the records of blocks that wait for their turn."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.progress = handle.getValueState("progress", "block bigint, best double, waited bigint, done boolean")
            self.blocks = handle.getMapState("blocks", "block bigint", "n bigint, places array<bigint>, metrics array<double>")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            block, best, waited, done = self.progress.get() if self.progress.exists() else (0, -math.inf, 0, False)
            for chunk in rows:
                for at, n, places, metrics in zip(chunk["block"], chunk["n"], chunk["places"], chunk["metrics"], strict=True):
                    kept = self.blocks.getValue((int(at),)) if self.blocks.containsKey((int(at),)) else (0,)
                    if not done and at >= block and kept[0] < n:
                        self.blocks.updateValue((int(at),), (int(n), [int(p) for p in places], [float(m) for m in metrics]))
            stops = []
            while not done and self.blocks.containsKey((block,)):
                n, places, metrics = self.blocks.getValue((block,))
                stop, upto, left = walk(n, places, metrics, best, waited)
                if stop is not None:
                    done = True
                    stops.append((key[0], int(block * size + stop + 1), None if upto == -math.inf else upto))
                    self.blocks.clear()
                elif n < size:
                    break
                else:
                    self.blocks.removeKey((block,))
                    block, best, waited = block + 1, upto, left
            self.progress.update((int(block), float(best), int(waited), done))
            yield pd.DataFrame(stops, columns=["run", "stop_no", "best"])

        def close(self) -> None:
            pass

    return EarlyStop()


def early_stop_stream(log: DataFrame, options: EarlyStopOptions = EarlyStopOptions()) -> DataFrame:
    """One row per run at the evaluation that stops it.

    Input (run, eval_no, metric) with evaluations numbered from 1, in any order. Two keyed states follow one another. The
    first is keyed by run and a block of evaluations, so that one large run spreads over many tasks; it takes a block's
    evaluations in turn, holds early ones, and passes the block's records on whenever their unbroken start grows. The second is
    keyed by run and walks its blocks in order: a message per block and micro-batch reaches it, not a row per evaluation. A stopped
    run's state there is one row; its later blocks keep their records.
    """
    run_type, size = log.schema["run"].dataType.simpleString(), EVALUATIONS_PER_BLOCK
    blocks = (
        log.select("run", "eval_no", "metric", F.floor((F.col("eval_no") - 1) / size).cast("bigint").alias("block"))
        .groupBy("run", "block")
        .transformWithStateInPandas(
            statefulProcessor=_block_records(size),
            outputStructType=f"run {run_type}, block bigint, n bigint, places array<bigint>, metrics array<double>",
            outputMode="Append",
            timeMode="None",
        )
    )
    return blocks.groupBy("run").transformWithStateInPandas(
        statefulProcessor=_early_stop(options.patience, options.threshold, size),
        outputStructType=f"run {run_type}, stop_no bigint, best double",
        outputMode="Append",
        timeMode="None",
    )


def event_time_rollup(log: DataFrame, kinds: list[str], width: str = "1 hour", delay: str | None = "10 minutes") -> DataFrame:
    """(start, stop, kinds..., n, total, least, most) of ``value`` per window of event time ``ts`` and kind.

    On a stream, a window is emitted once, when the watermark (the latest event time seen, less ``delay``) has passed its end, and
    rows that come after that are dropped; the state holds open windows only, as partial aggregates. On a table, or with ``delay``
    None, every window counts. Rows without ``ts`` belong to no window; a NULL kind is a kind of its own, and NULL values count as rows only.
    """
    timed = log.where(F.col("ts").isNotNull())
    if delay is not None:
        timed = timed.withWatermark("ts", delay)
    rolled = timed.groupBy(F.window("ts", width).alias("w"), *kinds).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    return rolled.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *kinds, "n", "total", "least", "most")
