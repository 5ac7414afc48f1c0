"""The boundary to models that write, judge or read: prompts in, replies out.

A ``Generator`` is called on the executors, once a row, with retries and a breaker against errors of transport; a reply or an error becomes a
column and never fails the job. ``Echo`` is a deterministic stand-in for tests. It says nothing about a model's quality.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from functools import partial
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.batches import parts
from pagemill.operators import pages as pg
from pagemill.streaming.states import Breaker


class Generator(Protocol):
    def reply(self, prompt: str, max_tokens: int) -> str: ...


class Echo:
    """The last ``max_tokens`` words of the prompt, behind a prefix; fails where the prompt holds ``poison``."""

    def __init__(self, prefix: str = "", poison: str | None = None):
        self.prefix, self.poison = prefix, poison

    def reply(self, prompt: str, max_tokens: int) -> str:
        if self.poison and self.poison in prompt:
            raise ValueError(f"refused: {self.poison}")
        return self.prefix + " ".join(prompt.split()[-max_tokens:])


class ChatCompletion:
    """An endpoint that speaks the common chat protocol. ``temperature`` and ``seed`` are the call's parameter regime."""

    def __init__(self, url: str, model: str, temperature: float = 0.0, seed: int | None = None, timeout: float = 600.0, json_mode: bool = False):
        self.url, self.model, self.timeout = url, model, timeout
        self.options = {"temperature": temperature} | ({} if seed is None else {"seed": seed}) | ({"response_format": {"type": "json_object"}} if json_mode else {})

    def reply(self, prompt: str, max_tokens: int) -> str:
        import json
        from urllib.request import Request, urlopen

        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": max_tokens, **self.options}
        with urlopen(Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=self.timeout) as r:
            return json.load(r)["choices"][0]["message"]["content"]


def _call(batches: Iterator[pa.RecordBatch], generator: Generator, max_tokens: int, tries: int, wait: float, timeout: float = 30.0, whole: bool = True) -> Iterator[pa.RecordBatch]:
    breaker = Breaker(successes=2, timeout=timeout)
    for batch in parts(batches):
        replies, errors, tokens = [], [], []
        for prompt in batch.column(batch.num_columns - 1).to_pylist():
            reply = error = None
            for k in range(0 if prompt is None else tries):
                try:
                    if breaker.state["status"] == "open":  # no row is lost to an open circuit: it waits and goes on
                        time.sleep(max(0.0, breaker.state["since"] + breaker.timeout - time.time()))
                    reply, error = generator.reply(prompt, max_tokens), None
                    breaker.step(time.time(), True, 0)
                    break
                except OSError as e:  # the service, or the way to it
                    error = f"{type(e).__name__}: {e}"
                    breaker.step(time.time(), False, 0)
                    if k + 1 < tries:
                        time.sleep(wait * 2**k)
                except Exception as e:  # noqa: BLE001  what the service says about this prompt is a result here
                    error = f"{type(e).__name__}: {e}"
                    breaker.step(time.time(), True, 0)
                    break
            replies.append(reply)
            errors.append(error)
            tokens.append(len((prompt or "").split()) + len((reply or "").split()))
        passed = batch.num_columns - (0 if whole else 1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:passed], pa.array(replies, pa.string()), pa.array(errors, pa.string()), pa.array(tokens, pa.int64())], [*batch.schema.names[:passed], "reply", "error", "tokens"])


def generate(rows: DataFrame, prompt: Column, generator: Generator, max_tokens: int = 2000, tries: int = 3, wait: float = 1.0, keep: Sequence[str] | None = None) -> DataFrame:
    """``rows`` with prompt, reply, error and tokens. A null prompt is not asked: it has no reply, no error and no tokens.
    With ``keep`` only these columns go through the workers and come back, and the prompt does not come back."""
    rows = rows.withColumn("prompt", prompt) if keep is None else rows.select(*keep, prompt.alias("prompt"))
    back = [f for f in rows.schema if keep is None or f.name != "prompt"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in back), "reply string, error string, tokens long"])
    return rows.mapInArrow(partial(_call, generator=generator, max_tokens=max_tokens, tries=tries, wait=wait, whole=keep is None), schema)


def prompt(template: str, **columns: Column) -> Column:
    """A template with {names} as a column."""
    out = F.lit(template)
    for name, value in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def map_reduce(chunks: DataFrame, generator: Generator, map_template: str, merge_template: str, max_tokens: int) -> DataFrame:
    """One reply per chunk, joined in order, and one reply per document over that; a document with a failed chunk fails."""
    each = generate(chunks.select("doc_id", "chunk", "text"), prompt(map_template, text=F.col("text")), generator, max(100, max_tokens // 4), keep=["doc_id", "chunk"])
    parts = F.array_sort(F.collect_list(F.struct("chunk", F.col("reply").alias("r"))))
    text = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("[部分 "), (p["chunk"] + 1).cast("string"), F.lit("] "), p["r"])), "\n\n")
    whole = each.groupBy("doc_id").agg(text.alias("text"), F.count("error").alias("_failed"))
    # one plan, so no chunk is asked about twice
    out = generate(whole, F.when(F.col("_failed") == 0, prompt(merge_template, text=F.col("text"))), generator, max_tokens, keep=["doc_id", "_failed"])
    failed = F.when(F.col("_failed") > 0, F.concat(F.col("_failed").cast("string"), F.lit(" parts failed")))
    return out.select("doc_id", "reply", F.coalesce(failed, "error").alias("error"))


def _refine(key, table, generator: Generator, first: str, then: str, max_tokens: int):
    reply = error = None
    try:
        for text in table.sort_by("chunk").column("text").to_pylist():
            ask = first.replace("{text}", text) if reply is None else then.replace("{text}", text).replace("{summary}", reply)
            reply = generator.reply(ask, max_tokens)
    except Exception as e:  # noqa: BLE001
        reply, error = None, f"{type(e).__name__}: {e}"
    return pa.table({"doc_id": pa.array([key[0].as_py()], pa.int64()), "reply": pa.array([reply], pa.string()), "error": pa.array([error], pa.string())})


def refine(chunks: DataFrame, generator: Generator, first: str, then: str, max_tokens: int = 800) -> DataFrame:
    """A document's chunks one after the other, each with the summary so far."""

    def run(key, table):
        return _refine(key, table, generator, first, then, max_tokens)

    return chunks.select("doc_id", "chunk", "text").groupBy("doc_id").applyInArrow(run, "doc_id long, reply string, error string")


# How many characters of text each field's prompt may hold.
FIELD_CAPS = {"metadata": 12000, "scope": 10000, "recommendations": 14000, "key_findings": 14000, "conclusions": 12000}


def field_tasks(retrieved: DataFrame, chunks: DataFrame, caps: dict[str, int] = FIELD_CAPS) -> DataFrame:
    """A row per document and field: the text of its chunks, in order, within the field's cap."""
    rows = retrieved.join(chunks.select("doc_id", "chunk", "text"), ["doc_id", "chunk"])
    cap = F.coalesce(*(F.when(F.col("field") == f, n) for f, n in caps.items()), F.lit(12000))
    return pg.joined(rows, "chunk", F.col("text"), "\n\n", keys=("doc_id", "field")).withColumn("text", F.substr("text", F.lit(1), cap))


def section_tasks(pages: DataFrame, rules, many: int = 30, size: int = 20, overlap: int = 3) -> DataFrame:
    """A row per document, section and window of pages: sections of many pages are cut into windows."""
    rows = pages.withColumn("section", pg.section(F.col("text"), rules))
    group = Window.partitionBy("doc_id", "section")
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(group), "_at": F.row_number().over(group.orderBy("page_no")) - 1})
    step = size - overlap
    first, last = F.greatest(F.lit(0), F.ceil((F.col("_at") - size + 1) / step)), F.least(F.floor((F.col("_n") - 1) / step), F.floor(F.col("_at") / step))
    chunk = F.explode(F.when(F.col("_n") > many, F.when(last >= first, F.sequence(first, last))).otherwise(F.array(F.lit(0).cast("long"))))
    return rows.withColumn("chunk", chunk).groupBy("doc_id", "section", "chunk").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count(F.lit(1)).alias("pages"))


def judge(rows: DataFrame, generator: Generator, template: str, runs: int, **columns: Column) -> DataFrame:
    """``runs`` replies per row; the score is what stands before the first bar, null otherwise."""
    from pagemill.functions.text import judge_score

    asked = rows.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    return generate(asked, prompt(template, **columns), generator, 200).withColumn("score", judge_score(F.col("reply")))


# The status that each kind of error is answered with.
STATUS = {"ContentTooShort": 422, "InvalidFile": 400, "ServiceUnavailable": 503}


def status_of(error: Column, statuses: dict[str, int] = STATUS) -> Column:
    found = F.lit(500)
    for kind, status in statuses.items():
        found = F.when(error == kind, status).otherwise(found)
    return F.when(error.isNull(), 200).otherwise(found)


def wanted_labels(reply: Column, labels: Sequence[str]) -> Column:
    """The first of the labels, in their order, that the reply holds in any case; the last if none."""
    found = F.lit(labels[-1])
    for label in reversed(labels):
        found = F.when(F.contains(F.upper(reply), F.lit(label)), label).otherwise(found)
    return found
