"""Live progress: observed counts, and tasks seen while a job runs."""

import threading
import time

from pyspark.sql import functions as F

from tonguemill.core.config import JobConfig
from tonguemill.operators import translation, translators
from tonguemill.operators.progress import Progress
from tests.test_translation import fake, segments


def test_steps_tell_their_counts_and_tasks_are_seen(spark, tmp_path):
    told = []
    progress = Progress(spark, lambda step, counts: told.append((step, counts)))
    n = iter(range(99))

    def save(df, label):
        at = f"{tmp_path}/{next(n)}"
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    keep = progress.saver(save)
    segs = keep(segments(spark, {1: ["a"] * 30, 2: ["c"], 9: ["d", "e"]}), "segments")
    batches = keep(translation.gather_batches(segs, translation.assign_batches(segs)), "batches")
    keep(translators.model(fake({2}), save)(batches, JobConfig("", "")), "answers")
    keep(segs.limit(0), "none")
    assert told == [("segments", {"rows": 33}), ("batches", {"rows": 4, "items": 33}), ("answers", {"rows": 4, "translations": 31, "errors": 1}), ("none", {"rows": 0})]
    assert [tuple(r) for r in progress.table().collect()][1] == ("batches", 4, 33, None)
    sums = translation.batch_progress(translation.assign_batches(segs)).agg(F.count("*"), F.sum("size")).first()
    assert tuple(sums) == (4, 33)

    seen, over = set(), threading.Event()

    def look():
        while not over.is_set():
            seen.add(progress.tasks())
            time.sleep(0.05)

    watcher = threading.Thread(target=look)
    watcher.start()
    try:
        keep(spark.range(0, 24, 1, 24).mapInPandas(lambda it: (time.sleep(0.2) or b for b in it), "id long"), "slow")
    finally:
        over.set()
        watcher.join()
        progress.stop()
    before = min(seen)[0]
    assert any(before < done < total for done, total in seen) and progress.counts["slow"] == {"rows": 24}
