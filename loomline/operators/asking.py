"""Stages that ask an outside service: deterministic answers first, each distinct question once, several at a time, answers kept.

Questions are told apart by the hash of their text. A call looks up which of its questions have an answer in a shared folder, and asks the
others. Each attempt of a task logs its answers, a line each, as soon as they have come, and one that runs again looks into the logs of
the attempts before it; what all tasks were told is one compressed table for each call, and then its logs go. So a lost executor, a repeated
stage or a later run asks only what is still open, and answers take a few files for each call, not one each.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from threading import Lock

import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import name_key
from ..session import scratch
from ..sources.tail import store
from .annotation import compact, race_and_accent
from .lookup import listed, named_roles
from .merging import merged
from .sequence import capacity_windows

Client = Callable[[str], str]
Check = Callable[[dict], list[str]]


def ask(client: Client, check: Check, prompt: str, retries: int) -> dict:
    """answer (JSON text or None), errors and tries of one question, put again with the errors that its answers had."""
    errors, answer, n = ["not asked"], None, 0
    while errors and n <= retries:
        asked = f"{prompt}\n\nThe last answer was wrong: {'; '.join(errors)}" if n else prompt
        n += 1
        try:
            answer = json.loads(client(asked))
            errors = check(answer) if isinstance(answer, dict) else ["not an object"]
        except ValueError as e:
            errors = [f"not JSON: {e}"]
        except Exception as e:  # a failing service is a question's error, not the stage's  # noqa: BLE001
            errors = [f"{type(e).__name__}: {e}"]
    return {"answer": None if errors else json.dumps(answer, sort_keys=True), "errors": "; ".join(errors), "tries": n}


#: Characters of a text that all prompts begin with that a task holds at a time.
HELD = 1 << 26
TOLD = "digest string, answer string, errors string, tries long"


class Log:
    """What the attempts of one task were told, a line for each question; each attempt writes a file of its own.

    On stores whose files are seen only when they are closed, a lost attempt's answers are lost with it.
    """

    def __init__(self, path: str, partition: int, attempt: int):
        self.system, self.path = store(path)
        self.known: dict[str, dict] = {}
        if attempt:
            for f in self.system.get_file_info(fs.FileSelector(self.path, allow_not_found=True)):
                if f.base_name.startswith(f"{partition:06d}-"):
                    with self.system.open_input_stream(f.path) as old:
                        for line in old.read().split(b"\n")[:-1]:  # a line without its end was being written
                            found = json.loads(line)
                            if found["answer"] is not None:
                                self.known[found["digest"]] = found
        self.file, self.out, self.lock = f"{self.path}/{partition:06d}-{uuid.uuid4().hex}.json", None, Lock()

    def put(self, found: dict) -> None:
        with self.lock:
            if self.out is None:
                self.system.create_dir(self.path, recursive=True)
                self.out = self.system.open_output_stream(self.file)
            self.out.write(json.dumps(found).encode() + b"\n")
            self.out.flush()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def head_text(path: str) -> str:
    """The text of one row that was stored in a folder."""
    system, inside = store(path)
    return pq.read_table(inside, filesystem=system).column(0)[0].as_py()


def digested(rows: DataFrame, head: str) -> DataFrame:
    """rows (key, __prompt) with __digest, the hash of the prompt after the text stored in head, which is hashed once for each task."""
    schema = T.StructType([*rows.schema.fields, T.StructField("__digest", T.StringType())])

    def run(batches):
        begin = hashlib.sha256(head_text(head).encode())
        for b in batches:
            out = []
            for text in b.column(1):
                h = begin.copy()
                h.update(text.as_py().encode())
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "__digest"])

    return rows.mapInArrow(run, schema)


def answered(df: DataFrame, key: str, prompt: str, client: Client, check: Check, answers: str, at_once: int = 8, retries: int = 2, made: Callable[[DataFrame], DataFrame] | None = None, head: DataFrame | None = None) -> DataFrame:
    """key, answer (JSON text or null), errors, tries of every row; asked now. Equal prompts are one question; a null prompt is an empty one.

    made: adds the prompt to rows of df, where prompts are long but what they are made of is short: they are made once to be told apart, and
    again where they are asked, and never move. Keys must then be distinct and not null.

    head: one row of one text that every prompt begins with, and that the column prompt leaves out. It is stored once for a call, each task reads it
    once, and it is put before a prompt only where that is asked; fewer questions are open at a time where it is long. Digests are those of whole prompts.

    answers: a folder that all executors share. at_once: how many questions a task has open at a time. Right answers are kept for good; a question whose
    answers were all wrong is open again the next time. client and check are sent to the executors, so they must be picklable.
    """
    spark = df.sparkSession
    scratch(spark)
    whole = lambda rows, *more: (made(rows) if made else rows).select(*more, F.coalesce(prompt, F.lit("")).alias("__prompt"))
    # rows, questions and answers meet by sorting: the planner goes by compressed sizes, and would send them to the driver
    run_path = f"{answers.rstrip('/')}/{uuid.uuid4().hex}"
    if head is not None:
        head.coalesce(1).write.parquet(f"{run_path}/head")
    full = whole(df, key)
    full = full.withColumn("__digest", F.sha2("__prompt", 256)) if head is None else digested(full, f"{run_path}/head")
    asked = full.select(key, "__digest").checkpoint()
    kept = kept_answers(spark, answers).withColumnRenamed("digest", "__digest")
    met = kept.join(asked.select("__digest").distinct().hint("merge"), "__digest", "left_semi").select("__digest", "answer", F.lit("").alias("errors"), "tries").checkpoint()
    some = not met.isEmpty()
    if made is None:
        open_ = full.join(met.select("__digest").hint("merge"), "__digest", "left_anti") if some else full
        questions = open_.groupBy("__digest").agg(F.first("__prompt").alias("__prompt"))
    else:
        one = asked.groupBy("__digest").agg(F.min(key).alias(key))
        one = one.join(met.select("__digest").hint("merge"), "__digest", "left_anti") if some else one
        questions = whole(df.join(one.hint("merge"), key), "__digest")

    headed = head is not None

    def run(batches):
        task = TaskContext.get()
        begin = head_text(f"{run_path}/head") if headed else ""
        open_at_once = max(1, min(at_once, HELD // max(1, len(begin))))
        log = Log(f"{run_path}/log", task.partitionId(), task.attemptNumber())

        def one(digest: str, text: str) -> dict:
            found = log.known.get(digest)
            if found is None:
                found = {"digest": digest} | ask(client, check, begin + text, retries)
                log.put(found)
            return found

        with ThreadPoolExecutor(open_at_once) as pool:
            for b in batches:
                for lo in range(0, b.num_rows, 2 * at_once):
                    part = b.slice(lo, 2 * at_once)
                    out = list(pool.map(one, part.column(0).to_pylist(), part.column(1).to_pylist()))
                    yield pa.record_batch([part.column(0), *(pa.array([x[c] for x in out], k) for c, k in (("answer", pa.string()), ("errors", pa.string()), ("tries", pa.int64())))], names=["digest", "answer", "errors", "tries"])
        log.close()

    questions.mapInArrow(run, TOLD).write.parquet(f"{run_path}/told")
    system, path = store(run_path)
    for done in ("log", "head"):
        system.delete_dir_contents(f"{path}/{done}", missing_dir_ok=True)
    told = spark.read.schema(TOLD).parquet(f"{run_path}/told").withColumnRenamed("digest", "__digest")
    return asked.join((told.unionByName(met) if some else told).hint("merge"), "__digest").select(key, "answer", "errors", "tries")


def kept_answers(spark, answers: str) -> DataFrame:
    """digest, answer, tries of the answers kept in a folder: of calls that ended, and in the logs of those that didn't."""
    system, path = store(answers)
    found = []
    for run in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        base = f"{answers.rstrip('/')}/{run.base_name}"
        for f in system.get_file_info([f"{run.path}/told/_SUCCESS"]):
            if f.type != fs.FileType.NotFound:
                found.append(spark.read.schema(TOLD).parquet(f"{base}/told"))
        if any(f.size for f in system.get_file_info(fs.FileSelector(f"{run.path}/log", allow_not_found=True))):
            found.append(spark.read.schema(TOLD).json(f"{base}/log"))
    if not found:
        return spark.createDataFrame([], "digest string, answer string, tries long")
    every = reduce(DataFrame.unionByName, found).filter("digest is not null and answer is not null")
    return every.groupBy("digest").agg(F.first(F.struct("answer", "tries")).alias("x")).select("digest", "x.*")


def consolidated(candidates: DataFrame, bridge: DataFrame, key: str, aliases: str, client: Client, answers: str, **how) -> DataFrame:
    """key, role_id and how: match where the aliases name exactly one role; else asked, where the service chose one of the roles they
    name; else none. Only what the match leaves open, and has roles to choose from, is asked.

    The prompt is a JSON object with names and roles; the answer is one with role_id, which must be one of these roles.
    """
    scratch(candidates.sparkSession)
    named, lists = named_roles(candidates, bridge, key, aliases)
    named, lists = named.checkpoint(), lists.checkpoint()
    several = F.col("__many").isNotNull() | (F.size("__few") > 1)
    own = candidates.select(key, F.array_sort(F.array_distinct(F.array_compact(aliases))).alias("names"))
    prompt = F.concat(F.lit('{"names":'), F.to_json("names"), F.lit(',"roles":'), F.col("__roles"), F.lit("}"))
    made = lambda rows: listed(rows, lists, key, F.to_json).withColumn("prompt", prompt)
    told = answered(named.filter(several).join(own.hint("merge"), key), key, "prompt", client, lambda a: [] if isinstance(a.get("role_id"), str) else ["no role_id"], answers, made=made, **how)
    chosen = told.select(key, F.get_json_object("answer", "$.role_id").alias("__chosen")).filter("__chosen is not null")
    # the answer is one of the roles that the aliases name
    said = candidates.select(key, F.explode(F.array_distinct(F.transform(aliases, name_key))).alias("alias")).join(chosen.hint("merge"), key)
    right = said.join(bridge.withColumnRenamed("role_id", "__chosen").hint("merge"), ["alias", "__chosen"], "left_semi").select(key, "__chosen").distinct()
    out = named.select(key, F.when(~several, F.try_element_at("__few", F.lit(1))).alias("__one")).join(right.hint("merge"), key, "left")
    return out.select(key, F.coalesce("__one", "__chosen").alias("role_id"), F.when(F.col("__one").isNotNull(), "match").when(F.col("__chosen").isNotNull(), "asked").otherwise("none").alias("how"))


CHARACTERS = "struct<characters:array<struct<name:string,age_stage:string,gender:string,race_or_accent:string,occupation:string,personality_type:string>>>"


def character_rows(told: DataFrame, order: str) -> DataFrame:
    """Incoming records for merging.merged from answers with characters, in the order of the answers and inside them.

    order: a whole number below 2 ** 31. Entries without a name drop out.
    """
    race, accent = race_and_accent(F.coalesce("c.race_or_accent", F.lit("")))
    absent = lambda c: F.coalesce(F.nullif(F.btrim(c), F.lit("")), F.lit("unknown"))
    traits = F.filter(F.transform(F.split(F.coalesce("c.personality_type", F.lit("")), "[,;]"), lambda x: F.btrim(x)), lambda x: ~F.lower(x).isin("", "unknown"))
    rows = told.select(order, F.posexplode(F.from_json("answer", CHARACTERS)["characters"]).alias("pos", "c")).filter("trim(coalesce(c.name, '')) <> ''")
    none = F.lit(None).cast("string")
    return rows.select(
        (F.col(order).cast("long") * (1 << 31) + F.col("pos")).alias("ord"), F.btrim("c.name").alias("name"), none.alias("profile_id"), none.alias("person_id"), absent(F.col("c.age_stage")).alias("age_stage"), absent(F.col("c.gender")).alias("gender"),
        race.alias("race_or_ethnicity"), accent.alias("accent"), F.when(F.lower(absent(F.col("c.occupation"))) != "unknown", F.btrim("c.occupation")).alias("occupation"), traits.alias("personality"), F.array().cast("array<string>").alias("aliases"),
    )


def discovered(chapters: DataFrame, registry: DataFrame, client: Client, answers: str, most: int = 20_000, render: Callable[[Column, Column], Column] | None = None, block: int | None = None, **how) -> DataFrame:
    """The registry after the characters of all chapters were asked for, chunk by chunk of at most so many characters of text.

    chapters: order (whole numbers), title, text of one book; registry: as in merging.merged. Chunks are asked side by side, each with the registry as
    it was before; their characters are merged in the order of chapters. render: makes a prompt of the known characters (JSON) and a chunk's
    text, which are put after one another by default. A chunk that gets no right answer adds nothing.
    """
    scratch(chapters.sparkSession)
    known = registry.select("role_id", "display_name", "age_stage", "gender", F.col("race_or_ethnicity").alias("race"), "accent", "occupation", "personality", "aliases")
    listed = F.array_sort(F.collect_list(F.struct("name", "age_stage", "gender", "race_or_accent", "occupation", "personality")))
    summary = compact(known).agg(F.to_json(listed).alias("known"))  # the registry of one book as one text, as prompts need it
    one = chapters.select(F.lit(0).alias("__book"), F.col("order").alias("__order"), "title", F.coalesce("text", F.lit("")).alias("text")).withColumn("__n", F.length("text"))
    chunked = capacity_windows(one, "__book", ["__order"], "__n", most, alone=True, block=block)
    part = F.concat(F.lit("## "), F.coalesce("title", F.lit("")), F.lit("\n"), F.col("text"))
    texts = chunked.groupBy("window_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__order", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("chunk"))
    right = lambda a: [] if isinstance(a.get("characters"), list) else ["characters is no list"]
    known_ = F.coalesce("known", F.lit("[]"))
    if render is None:
        begin = summary.select(F.concat(F.lit("Known characters: "), known_, F.lit("\n\n")).alias("head"))
        told = answered(texts.checkpoint(), "window_id", "chunk", client, right, answers, head=begin, **how)
    else:
        made = lambda rows: rows.join(F.broadcast(summary)).withColumn("prompt", render(known_, F.col("chunk")))
        told = answered(texts.checkpoint(), "window_id", "prompt", client, right, answers, made=made, **how)
    return merged(registry, character_rows(told, "window_id"))
