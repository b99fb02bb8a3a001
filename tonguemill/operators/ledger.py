"""The request ledger: what a model was asked and answered, so that nothing is asked twice.

A request's key is a hash of the model and the prompt. Keys that the ledger holds aren't asked; equal prompts are asked once and their
answer meets all of them in a join. Tasks write answers down in groups as they come, so a lost task, executor or driver costs the
requests of one group for each task at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.core.config import JobConfig, open_folder
from tonguemill.core.shared import hadoop_path, own_folder, put
from tonguemill.operators.translation import KEY, RETRY, build_prompt, guard_prompt, read_responses, response_error, retry_union

#: Requests that are written down together, and may be asked again if their task is lost.
GROUP = 64
RECORD = "key string, run string, http_status int, body string"
_RECORD = pa.schema([("key", pa.string()), ("run", pa.string()), ("http_status", pa.int32()), ("body", pa.string())])


def request_key(model: Column | str, prompt: Column | str) -> Column:
    """A hash of all that decides an answer."""
    return F.sha2(F.concat_ws("\0", F.lit(model) if isinstance(model, str) else model, prompt), 256)


class RequestLedger:
    """Answers in a folder of Parquet files that driver and executors share; it may outlive the job and serve others.

    `run` names an attempt to get good answers: within a run nothing is asked twice, not even what failed; a new run asks again what has no
    good answer yet. A good answer is of status 2xx, is JSON and holds a text.
    """

    def __init__(self, spark: SparkSession, path: str, run: str = "first", group: int = GROUP):
        self.spark, self.path, self.run, self.group = spark, path.rstrip("/"), run, group
        fs, folder = hadoop_path(spark, self.path)
        fs.mkdirs(folder)

    def records(self) -> DataFrame:
        """(key, run, http_status, body) of every request."""
        return self.spark.read.schema(RECORD).parquet(self.path)

    def answers(self) -> DataFrame:
        """(key, http_status, body): a good answer if there is one, else this run's. What was written down twice counts once."""
        good = response_error(F.col("body"), F.col("http_status")).isNull()
        mine = self.records().withColumn("good", good).where(F.col("good") | (F.col("run") == self.run))
        best = F.max_by(F.struct("http_status", "body"), F.struct("good", F.col("run") == self.run, "run"))
        return mine.groupBy("key").agg(best.alias("a")).select("key", "a.http_status", "a.body")

    def ask(self, requests: DataFrame, call: Callable[[str], tuple[int, str]], tasks: int = 8, in_flight: int = 4) -> None:
        """Asks what the ledger doesn't hold of requests (key, prompt), once for each key.

        At most tasks * in_flight calls are under way at a time. Requests are dealt by key and asked in its order, so a task that runs again
        finds the groups that its lost attempt has written. A speculative copy of a running task would ask what is under way once more; jobs
        with paid calls run without spark.speculation.
        """
        folder, run, size = self.path, self.run, self.group
        once = requests.groupBy("key").agg(F.any_value("prompt").alias("prompt"))
        todo = once.join(self.answers().select("key"), "key", "left_anti").repartition(tasks, "key").sortWithinPartitions("key")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(in_flight) as pool:
                for keys, prompts in _groups(batches, size):
                    name = hashlib.sha256("\0".join([run, *keys]).encode()).hexdigest()
                    at = f"{folder}/{name}.parquet"
                    fs, path = open_folder(at)
                    if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
                        got = list(pool.map(call, prompts))
                        rows = pa.Table.from_arrays([pa.array(keys), pa.array([run] * len(keys)), pa.array([s for s, _ in got], pa.int32()), pa.array([b for _, b in got], pa.string())], schema=_RECORD)
                        put(at, lambda out, rows=rows: pyarrow.parquet.write_table(rows, out))
                    yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64())], names=["n"])

        todo.mapInArrow(work, "n long").write.format("noop").mode("overwrite").save()


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[str], list[str]]]:
    keys, prompts = [], []
    for batch in batches:
        for key, prompt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys.append(key)
            prompts.append(prompt)
            if len(keys) == size:
                yield keys, prompts
                keys, prompts = [], []
    if keys:
        yield keys, prompts


def asked_once(ledger: RequestLedger, call: Callable[[str], tuple[int, str]], model: str = "", tasks: int = 8, in_flight: int = 4) -> Callable[[DataFrame, JobConfig], DataFrame]:
    """A translator that asks a model through a ledger, twice at most for each batch. `call` takes a prompt and gives (status, body)."""

    def run(batches: DataFrame, config: JobConfig) -> DataFrame:
        prompts = guard_prompt(build_prompt(batches, config.target), config.max_prompt).select(*KEY, "batch_id", F.size("items").alias("expected"), "prompt", "status", "error")
        prompts = prompts.withColumn("key", request_key(model, F.col("prompt")))
        # written once, as they are read by each step below
        at = own_folder(ledger.spark, "prompts")
        prompts.write.mode("overwrite").parquet(at)
        asked = ledger.spark.read.schema(prompts.schema).parquet(at)
        good = asked.where("status = 'ok'").drop("status", "error")

        def told(rows: DataFrame, answers: DataFrame) -> DataFrame:
            return read_responses(rows.drop("prompt").join(answers, "key")).select(*KEY, "batch_id", "translations", "error")

        def again(first: DataFrame) -> DataFrame:
            rows = good.join(first.where("error is not null").select(*KEY, "batch_id"), [*KEY, "batch_id"], "left_semi").withColumn("prompt", F.concat("prompt", F.lit(RETRY)))
            return rows.withColumn("key", request_key(model, F.col("prompt")))

        ledger.ask(good.select("key", "prompt"), call, tasks, in_flight)
        ledger.ask(again(told(good, ledger.answers())).select("key", "prompt"), call, tasks, in_flight)
        answers = ledger.answers()  # one listing for both attempts: Spark takes two scans of a folder for the same
        first = told(good, answers)
        second = told(again(first), answers)
        refused = asked.where("status <> 'ok'").select(*KEY, "batch_id", F.lit(None).cast("array<string>").alias("translations"), "error")
        return retry_union(first, second).unionByName(refused)

    return run
