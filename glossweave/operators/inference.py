"""Batched calls of a user's model: plan, prompt, call, parse, check, retry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave import schemas
from glossweave.functions import patterns as P
from glossweave.operators.batching import char_batches
from glossweave.operators.gate import accept_retry, gate
from glossweave.operators.replies import compose, item_text, reply_items
from glossweave.plans.scan import row_numbers
from glossweave.session import cut, stored

Model = Callable[[str], str]


_ANSWERS = "prompt_hash string, answer string, error string"


def _ask(model: Model, prompt: str) -> tuple[str | None, str | None]:
    """The reply and the error of one call; one of them is null, or both if nothing came."""
    try:
        return model(prompt), None
    except Exception as failure:
        return None, f"{type(failure).__name__}: {failure}"


def call_model(
    rows: DataFrame, keys: list[str], model: Model, prompt: str, reply: str = "reply",
    tasks: int | None = None, error: str = "error",
) -> DataFrame:
    """Send each row's prompt to the model; a call that fails gives a null reply and its error.

    Calls are slow and rows are small, so rows are spread by their whole key over a fixed
    number of tasks (the shuffle partitions unless given); left to the size rule, many
    calls would be merged into one task.
    """
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [_ask(model, text) for text in frame[prompt]]
            out = frame.copy()
            out[reply] = pd.Series([m[0] for m in made], index=frame.index, dtype=object)
            out[error] = pd.Series([m[1] for m in made], index=frame.index, dtype=object)
            yield out

    return rows.repartition(tasks, *keys).mapInPandas(call, f"{schema}, `{reply}` string, `{error}` string")


def call_model_once(
    rows: DataFrame, model: Model, prompt: str, answers: str, step: str, reply: str = "reply",
    tasks: int | None = None, rounds: int = 4, error: str = "error",
) -> DataFrame:
    """As `call_model`, with every answer written to the table `answers` before it is used.

    `answers` is a Parquet folder all executors share, for one model; it is made when missing
    and only ever added to. Its key is the hash of `step` and prompt: a prompt answered there
    is not sent again, whichever run or attempt sent it, and equal prompts of one step are sent
    once. A later step may ask the same again. Different prompts go in `rounds` slices of their
    hashes, each a job of its own whose answers stay when a later one fails; of the slice
    that fails, all calls are repeated. Calls that failed or gave nothing are stored with
    their error for the record and sent again by the next run. Rows without a prompt (null)
    are not sent.
    """
    spark = rows.sparkSession
    spark.createDataFrame([], _ANSWERS).write.mode("append").parquet(answers)
    hashed = rows.withColumn("_hash", F.sha2(F.concat(F.lit(step + "\n"), prompt), 256))
    asked = cut(
        hashed.where(F.col(prompt).isNotNull())
        .groupBy(F.col("_hash").alias("prompt_hash")).agg(F.first(prompt).alias("_prompt"))
        .join(_stored(spark, answers).where(F.col("answer").isNotNull()), "prompt_hash", "left_anti")
    )
    for n in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("prompt_hash"), F.lit(rounds)) == n)
        made = call_model(part, ["prompt_hash"], model, "_prompt", "answer", tasks)
        made.select("prompt_hash", "answer", "error").write.mode("append").parquet(answers)
    # Read here and now: files that later steps add to the folder don't change this result.
    own = hashed.select(F.col("_hash").alias("prompt_hash")).distinct()
    got = cut(_stored(spark, answers).join(own, "prompt_hash", "left_semi"))
    got = got.select(
        F.col("prompt_hash").alias("_hash"), F.col("answer").alias(reply),
        F.when(F.col("answer").isNull(), F.col("error")).alias(error),
    )
    return hashed.join(got, "_hash", "left").drop("_hash")


def _stored(spark: SparkSession, answers: str) -> DataFrame:
    """A row per prompt of the table; runs side by side may have stored two answers."""
    rows = spark.read.schema(_ANSWERS).parquet(answers)
    return rows.groupBy("prompt_hash").agg(F.min("answer").alias("answer"), F.max("error").alias("error"))


def translate_fresh(
    paragraphs: DataFrame, model: Model, instruction: str = "{content}",
    limit: int = P.BATCH_CHARS, answers: str | None = None,
) -> DataFrame:
    """Translate `(book_id, pos, text, tier)` rows that are no duplicates.

    Short and normal paragraphs go in numbered batches, long ones alone. A batch without a
    readable reply is sent again one by one. Results are written in the job that makes the calls,
    so that no later step repeats them; a task that is retried does. Tables between the calls are
    deleted after their last use.
    With the folder `answers` a rerun sends only what is not answered there (see
    `call_model_once`). `error` is what the last call of a row without an answer gave.
    """

    def call(rows: DataFrame, by: list[str], prompt: str, reply: str, step: str) -> DataFrame:
        """The caller writes the rows at once, in one job."""
        if answers is None:
            return call_model(rows, by, model, prompt, reply)
        return call_model_once(rows, model, prompt, answers, step, reply)

    keys = ["book_id", "tier", "batch_no"]
    grouped = paragraphs.where(F.col("tier") != schemas.TIER_LONG)
    # Batches and places in them are settled on narrow rows; texts join them once.
    numbers = stored(char_batches(
        grouped.select("book_id", "tier", "pos", F.length("text").alias("chars")),
        ["book_id", "tier"], "pos", "chars", limit,
    ))
    places = row_numbers(numbers.table, keys, "pos", "item_no")
    numbered = stored(grouped.join(places, ["book_id", "tier", "pos"]))
    numbers.drop()

    prompts = compose(numbered.table, keys, "pos").withColumn(
        "prompt", F.replace(F.lit(instruction), F.lit("{content}"), F.col("prompt"))
    )
    replies = stored(call(prompts.select(*keys, "prompt"), keys, "prompt", "reply", "batch").drop("prompt"))
    answered = replies.table.where(F.coalesce("reply", F.lit("")).rlike(rf"\[{P.DIGIT}+\]"))
    # The first item of a batch stands for its call, so calls add up over any grouping.
    opens = (F.col("item_no") == 1).cast("int")
    placed = stored(
        numbered.table.join(answered.select(*keys, reply_items(F.col("reply")).alias("items")), keys, "left").select(
            "book_id", "pos", "text", "tier", opens.alias("calls"), F.col("items").isNotNull().alias("answered"),
            F.coalesce(item_text(F.col("items"), F.col("item_no")), F.lit("")).alias("translated"),
        )
    )
    numbered.drop()
    replies.drop()
    done = placed.table.where("answered").select(
        "book_id", "pos", "text", "tier", "translated", "calls", F.lit(None).cast("string").alias("error")
    )
    unanswered = placed.table.where(~F.col("answered")).select(
        "book_id", "pos", "text", "tier", (F.col("calls") + 1).alias("calls")
    )
    alone = paragraphs.where(F.col("tier") == schemas.TIER_LONG).select(
        "book_id", "pos", "text", "tier", F.lit(1).alias("calls")
    )
    single = call(alone.unionByName(unanswered), ["book_id", "pos"], "text", "translated", "single")
    gated = gate(done.unionByName(single).withColumnRenamed("text", "original"))
    # Everything below, and the caller, reads this table; its final texts follow from the rest.
    checked = stored(gated.drop("final_text", "length_ratio")).table.withColumn(
        "final_text", F.when(F.col("action") == "keep_original", F.col("original")).otherwise(F.col("translated"))
    )
    placed.drop()
    back = checked.where(F.col("action") == "retry")
    again = stored(call(
        back.select("book_id", "pos", "original"), ["book_id", "pos"], "original", "again", "retry"
    )).table.withColumnRenamed("error", "_again_error")
    # Only what was sent back is joined with its second answer.
    return retried(back, again).unionByName(accepted(checked.where(F.col("action") != "retry")))


def accepted(checked: DataFrame) -> DataFrame:
    """Rows that the gate did not send back, as `retried` gives them."""
    return checked.select(
        "book_id", "pos", "original", "tier", "issues", "action", F.col("final_text").alias("translated"),
        F.col("action").isin("keep_original", "keep").alias("failed"), "calls", "error",
    )


def retried(checked: DataFrame, again: DataFrame) -> DataFrame:
    """Rows with what one more call gave for those the gate sent back; see `accept_retry`."""
    new = F.col("again")
    accepted = accept_retry(F.col("translated"), new)
    return checked.join(again.drop("original"), ["book_id", "pos"], "left").select(
        "book_id", "pos", "original", "tier", "issues", "action",
        F.when((F.col("action") == "retry") & accepted, new)
        .otherwise(F.col("final_text"))
        .alias("translated"),
        (
            F.col("action").isin("keep_original", "keep")
            | ((F.col("action") == "retry") & ~accepted)
        ).alias("failed"),
        (F.col("calls") + (F.col("action") == "retry").cast("int")).alias("calls"),
        F.coalesce("_again_error", "error").alias("error"),
    )
