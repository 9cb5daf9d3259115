"""Songs as a stream of lines: the words already used are the state of each song."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import align, lattice
from ..operators.lattice import COLUMNS as WHOLE
from ..operators.segment import DEFAULTS, GENERATED, best_path
from ..sources import text as texts

COLUMNS = [f.strip().split()[0] for f in GENERATED.split(",")]
#: The state store that stateful processors need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def generate_stream(lines: DataFrame, parameters: dict | None = None, idle: str | None = None) -> DataFrame:
    """Words for a stream of lines(song, line, n, breaks, spans), each song's lines in order of arrival.

    spans: array<struct<i, t, c: array<struct<sim, id>>>>, the ranked candidates of each run. The
    state of a song is the set of its used words. With idle, such as `1 hour`, it is dropped after
    that time without a line; Spark then keeps running batches while no lines come.
    """
    p = DEFAULTS | (parameters or {})
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = set(state.get[0]) if state.exists else set()
        out = []
        for r in pd.concat(list(batches)).sort_values("line", kind="stable").itertuples():
            ranked = {(x["i"], x["t"]): [(c["sim"], c["id"]) for c in x["c"]] for x in (r.spans if r.spans is not None else [])}
            path = best_path(int(r.n), set(map(int, r.breaks)), ranked, used, p)[1]
            used |= {w["id"] for w in path if w["id"] is not None}
            out += [(r.song, r.line, k, w["i"], w["t"], w["id"], w["sim"], w["score"], w["id"] is None, False) for k, w in enumerate(path)]
        state.update((sorted(used),))
        if wait:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=COLUMNS)

    return lines.groupBy("song").applyInPandasWithState(step, GENERATED, "used array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)


def _apart(df: DataFrame) -> DataFrame:
    """df, whose Python expressions above and below run once each."""
    return df.mapInArrow(lambda batches: batches, df.schema)


def units_stream(lines: DataFrame, make: Callable[[], texts.Tokenizer] = texts.Characters, text_col: str = "text") -> DataFrame:
    """Streaming form of sources.text.lyrics: units, surfaces and breaks of raw lines; other columns stay."""
    from ..operators.segment import phrase_breaks

    told = _apart(lines.withColumn("tokens", texts.tokenize_together(F.coalesce(F.col(text_col), F.lit("")), make)).drop(text_col))
    named = _apart(told.withColumn("u", align.align_line(F.col("tokens"))).drop("tokens"))
    each = lambda f: F.transform("u", lambda x: x[f])
    return named.withColumn("units", each("pronunciation")).withColumn("surfaces", each("surface_form")).withColumn("breaks", phrase_breaks(each("phrase"))).drop("u")


def _loaded(make, arguments):
    from pyspark.errors import PySparkRuntimeError

    try:
        return make(*arguments)
    except PySparkRuntimeError:
        return None


class OnExecutors:
    """A broadcast that a processor may hold: the driver looks at the processor before any broadcast is loaded there, and finds none."""

    def __init__(self, shared):
        self.shared = shared

    def __reduce__(self):
        return _opened, self.shared.__reduce__()


def _opened(make, arguments) -> OnExecutors:
    return OnExecutors(_loaded(make, arguments))


class Song(StatefulProcessor):
    """A song's used words: one entry of a map for each, so that a batch writes only what it adds."""

    def __init__(self, shared, parameters: dict, wait: int | None):
        self.shared, self.p, self.wait = shared, parameters, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "id string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        words = lattice.held(self.shared.shared)
        lines = pd.concat(list(rows)).sort_values("line", kind="stable")
        busy = None
        before: set[str] = set()
        if not self.p["DUPLICATE"]:
            before = {k[0] for k in self.used.keys()}
            busy = {n for x in before if (n := words.numbered(x)) is not None}
        out = pd.DataFrame(lattice.covered_songs(words, self.p, lines.itertuples(), busy), columns=WHOLE)
        if busy is not None:
            for x in sorted(set(out["id"].dropna()) - before):
                self.used.updateValue((x,), (1,))
        if self.wait:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def generate_lines(lines: DataFrame, found: lattice.Index, parameters: dict | None = None, idle: str | None = None, make: Callable[[], texts.Tokenizer] = texts.Characters) -> DataFrame:
    """Whole GENERATED rows for a stream of raw lines(song, line, text[, weights, locks]), each song's lines in order of arrival.

    The index of the word list is the static side. Lines of a song that come in one batch are
    taken in order of their number; weights and locks mean what they mean to lattice.generate.
    With idle, a song's used words are forgotten after that time without a line. The session
    must use the state store STORE, and the index must be small enough to be broadcast.
    """
    if not found.fits():
        raise ValueError("a stream's word list must fit into a broadcast: generate in foreachBatch over lattice.generate for longer ones")
    p = DEFAULTS | (parameters or {})
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    rows = lattice.line_rows(units_stream(lines, make))
    return rows.groupBy("song").transformWithStateInPandas(Song(OnExecutors(found.shared()), p, wait), lattice.GENERATED, "append", "ProcessingTime" if wait else "None")


def callbacks(each_line: Callable[[int, int, list[dict]], None] | None = None, at_end: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch, which also takes (rows, 0) of a batch job.

    each_line(song, line, rows) is called on the executors for every whole line, a song's lines
    in order; at_end(rows, batch) on the driver once all lines of a batch are told. A task or a
    batch that is run again tells its lines again.
    """

    def tell(rows) -> None:
        for (song, line), some in groupby(rows, lambda r: (r.song, r.line)):
            each_line(song, line, [r.asDict(recursive=True) for r in some])

    def run(made: DataFrame, batch: int) -> None:
        if each_line is not None:
            made.repartition("song").sortWithinPartitions("song", "line", "word").foreachPartition(tell)
        if at_end is not None:
            at_end(made, batch)

    return run
