"""A run that stores its replies as it goes: items as a stream of small files, a stored batch for each step.

A step asks the items of a few files and stores their graded responses before the
next begins, so a lost job loses the replies of the step that it was in, and no
more. Batches are named by the step: one that is delivered again after it was
stored is left out without asking, one that was broken off is asked again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import slug
from ..sources.schema import ERROR, RESPONSES
from ..sources.store import Folder, Store, todo

COMMIT_EVERY = 25


@dataclass
class Progress:
    """How far a run is: items of this start, those done, what their samples came to, and the seconds since."""

    items: int
    done: int = 0
    right: int = 0
    failed: int = 0
    seconds: float = 0.0
    asked: int = 0  # items that were asked since the run was started or resumed

    @property
    def remaining(self) -> int:
        return self.items - self.done

    @property
    def remaining_seconds(self) -> float | None:
        """By the mean of what was asked so far; unknown before the first step is stored."""
        return self.remaining * self.seconds / self.asked if self.asked else None


def _folder(store: Store, run_id: str) -> str:
    """Where a run's queues are. Run ids of one slug are told apart by their hash."""
    name = store.spark.range(1).select(F.concat_ws("-", slug(F.lit(run_id)), F.xxhash64(F.lit(run_id)).cast("string")).alias("s")).first().s
    return f"{store.folder}/queues/{name}"


def progress_of(store: Store, run_id: str) -> Progress | None:
    """How far a run is, for others to ask while it is at work."""
    notes = Folder(store.spark, _folder(store, run_id))
    steps = [n for n in notes.names() if n.startswith("step-")]
    return Progress(**json.loads(notes.get(steps[-1]))) if steps else None


def _queue(items: DataFrame, folder: str, commit_every: int) -> int:
    """Write the items as files of at most ``commit_every`` each; how many there are."""
    n = items.count()
    items.repartition(max(1, -(-n // commit_every))).write.option("maxRecordsPerFile", commit_every).parquet(f"{folder}/items")
    return n


def run_in_steps(
    store: Store, run_id: str, respond: Callable[[DataFrame], DataFrame], commit_every: int = COMMIT_EVERY, files: int = 1, resume: bool = True,
    chosen: Callable[[DataFrame], DataFrame] = lambda items: items, watch: Callable[[Progress], None] = lambda progress: None, steps: int | None = None,
) -> Progress:
    """Put the stored items that this run has not done to a model, ``files`` times ``commit_every`` items a step, each stored before the next.

    A queue that an earlier call did not finish is gone through first, from the step
    at which it was broken off. Then come the other items that are not done, those
    whose call failed before among them. Without ``resume`` a new queue holds all
    items. ``chosen`` narrows the items that are queued. ``watch`` is told of each
    stored step. A step is dealt out over all cores, so its size, not a file's,
    should be some items for each of them. What a step costs beside its items does
    not shrink with them: with ``steps``, a queue of more files than that many steps
    would take is gone through in that many, of more files each, so the time of a
    long run grows with its items alone, and a lost job loses that share of it.
    """
    notes = Folder(store.spark, _folder(store, run_id))
    began, state = time.monotonic(), Progress(0)
    open_ = [n.removeprefix("open-") for n in notes.names() if n.startswith("open-")]
    if not resume:
        for n in open_:
            notes.remove(f"open-{n}")
    elif open_:
        _work_off(store, run_id, open_[-1], respond, files, watch, state, began, steps)
    items = chosen(store.read("items"))
    left = todo(items, store.read("responses"), run_id) if resume else items
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    n = _queue(left, f"{notes.path}/{name}", commit_every)
    if n:
        notes.put(f"open-{name}", str(n))
        _work_off(store, run_id, name, respond, files, watch, state, began, steps)
    return state


def _work_off(store: Store, run_id: str, name: str, respond: Callable[[DataFrame], DataFrame], files: int, watch: Callable[[Progress], None], state: Progress, began: float, steps: int | None = None) -> None:
    """Go through a queue from where it stands to its end, and close it."""
    spark, notes = store.spark, Folder(store.spark, _folder(store, run_id))
    queue = f"{notes.path}/{name}/items"
    kept = spark.read.parquet(queue)
    columns = StructType.fromDDL(RESPONSES).names
    if steps:
        files = max(files, -(-sum(n.endswith(".parquet") for n in Folder(spark, queue).names()) // steps))
    state.items += int(notes.get(f"open-{name}"))
    if any(n.startswith(name) for n in store._log("responses", "names").names()):  # it was begun before
        own = store.read("responses").where(F.col("run_id") == run_id)
        state.done += kept.select("item_id").join(own, "item_id", "left_semi").count()

    def step(batch: DataFrame, number: int) -> None:
        label = f"{name}-{number:08d}"
        if store.batch_named("responses", label):
            return
        seen = Observation()
        wide = batch.repartition(max(1, spark.sparkContext.defaultParallelism))
        graded = respond(wide).select(*columns).observe(
            seen, F.count(F.when(F.col("correct"), 1)).alias("right"), F.count(F.when(F.col("raw") == ERROR, 1)).alias("failed"),
        )
        store.upsert("responses", graded, name=label)
        asked = batch.count()
        state.done, state.asked = state.done + asked, state.asked + asked
        state.right, state.failed = state.right + seen.get["right"], state.failed + seen.get["failed"]
        state.seconds = round(time.monotonic() - began, 3)
        notes.put(f"step-{label}", json.dumps(asdict(state)))
        watch(state)

    stream = spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", files).parquet(queue)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{notes.path}/{name}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    notes.remove(f"open-{name}")

