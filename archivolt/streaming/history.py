"""Rolling history of every conversation in a stream of turns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from archivolt import fixed

OUTPUT = "conv_id long, last_turn long, pairs long, questions string, batches_due long, waiting long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RollingHistory(StatefulProcessor):
    """Pairs of a question and the turn after it, whatever order turns arrive in.

    A turn waits in the state until its neighbour is there: a question for the
    turn after it, an answer for the one before.  What is kept of a
    conversation is what waits, its newest ``n`` questions and three numbers.
    """

    def __init__(self, n: int, interval: int, wait_ms: int | None):
        self.n, self.interval, self.wait_ms = n, interval, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "turn long, role string, text string", self.wait_ms)
        # One value, so that a conversation costs one read and one write of it.
        self.known = handle.getValueState("known", "last_turn long, pairs long, long_answers long, turns array<long>, questions array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, count, long, known, questions = self.known.get() or (-1, 0, 0, [], [])
        before = [tuple(r) for r in self.waiting.get()]
        fresh = [(int(r.turn), r.role, r.text) for r in rows]
        turns = {}
        for turn, role, text in before + fresh:
            turns.setdefault(turn, (role, text))
        newest, open_ = list(zip(known, questions)), []
        for turn in sorted(turns):
            role, text = turns[turn]
            if role != "user":
                if turn - 1 not in turns:
                    open_.append((turn, role, text))
            elif turn + 1 not in turns:
                open_.append((turn, role, text))
            elif turns[turn + 1][0] == "assistant":
                count += 1
                long += len(turns[turn + 1][1] or "") > fixed.ANALYSIS_MIN_ANSWER
                newest.append((turn, text))
        newest = sorted(newest, key=lambda pair: pair[0])[-self.n:]
        if open_:
            self.waiting.put(open_)
        elif before:
            self.waiting.clear()
        last = max(last, max(turns))
        self.known.update((last, count, long, [t for t, _ in newest], [q for _, q in newest]))
        yield Row(conv_id=key[0], last_turn=last, pairs=count, questions="\n".join(q or "" for _, q in newest),
                  batches_due=long // self.interval, waiting=long % self.interval)

    def close(self) -> None:
        pass


def rolling_history(turns: DataFrame, n: int = fixed.HISTORY_PAIRS, interval: int = fixed.ANALYSIS_INTERVAL, wait_ms: int | None = None) -> DataFrame:
    """Per conversation: the last ``n`` questions and how many analyses are due, after each batch that brings turns of it.

    ``turns`` holds conv_id, turn, role, text; turns of a conversation are
    numbered without gaps, and may arrive in any order, in one batch or many: a
    late turn is put in its place.  A turn that comes twice while it waits
    counts once.  Turns that wait longer than ``wait_ms`` for their neighbour
    are forgotten; without it they wait for ever.  The session's state store
    must be RocksDB (:data:`PROVIDER`).
    """
    return turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").transformWithState(
        RollingHistory(n, interval, wait_ms), OUTPUT, "update", "processingTime" if wait_ms else "none")
