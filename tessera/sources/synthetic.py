"""Synthetic rows, each made from its id and a seed alone."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import md5_word


def arithmetic(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """id, a, b, op, answer with a and b in [-10000, 10000]."""

    def draw(name: str, size: int):
        return md5_word(F.concat_ws(":", F.lit(name), F.lit(seed), F.col("id").cast("string"))) % size

    rows = spark.range(n).select("id", (draw("a", 20_001) - 10_000).alias("a"), (draw("b", 20_001) - 10_000).alias("b"), F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("*")), (draw("op", 3) + 1).cast("int")).alias("op"))
    return rows.withColumn("answer", F.when(F.col("op") == "+", F.col("a") + F.col("b")).when(F.col("op") == "-", F.col("a") - F.col("b")).otherwise(F.col("a") * F.col("b")))


#: The words of a needle prompt's filler, and the prompts' wording.
FILLER = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta", "lambda"]
NEEDLE_HEAD = "You will be given a long text. Memorize the secret token.\n\nSECRET_TOKEN = {needle}\n\n"
NEEDLE_TAIL = "\nQuestion: What is the SECRET_TOKEN?\nAnswer:"
LOG_HEAD = "You are given a long log of variable assignments.\nRules:\n- Each line is VAR_xxxxxx = integer, or VAR_xxxxxx = VAR_yyyyyy + k.\n- Compute the requested VAR at the end.\n\nLOG BEGIN\n"
#: An episode's numbers.
BASE, LINES, DERIVED, ANEW, ASKED, SOURCES, LITERAL, STEP = 64, 128, 0.65, 0.35, 32, 129, 10_000_000, 9999
LOG_TAIL = "\nLOG END\n\nQuestion: What is {query_key}?\nAnswer with just the integer."


def needles(spark: SparkSession, n: int, target_tokens: int, seed: int = 0) -> DataFrame:
    """id, prompt, answer: a secret token, filler of 32 words a line up to the
    target less 64 byte tokens, and the question."""

    @F.udtf(returnType="prompt: string, answer: string")
    class Needle:
        def eval(self, i: int):
            rng = random.Random(f"{seed}:{i}")
            answer = f"ZXQ-{rng.randint(1000, 9999)}"
            text = NEEDLE_HEAD.format(needle=answer)
            while len(text.encode()) < target_tokens - 64:
                text += " ".join(rng.choices(FILLER, k=32)) + "\n"
            yield text + NEEDLE_TAIL, answer

    spark.udtf.register("tessera_needle", Needle)
    return spark.sql(f"select id, prompt, answer from range({n}), lateral tessera_needle(cast(id as int))")


def variable(i: int) -> str:
    return f"VAR_{i:06d}"


def assignments(rng: np.random.Generator, values: list[int], asked: int) -> Iterator[str]:
    """Endless lines of a log that binds `values`: literals for the first BASE, then new
    variables, most of them a step from some earlier one; now and then `asked` is bound
    anew to a step from one of the first."""
    base = rng.integers(-LITERAL, LITERAL, BASE, endpoint=True).tolist()
    for i, x in enumerate(base):
        values.append(x)
        yield f"{variable(i)} = {x}"
    while True:
        derived, anew = rng.random(2) < (DERIVED, ANEW)
        if derived:
            source, step = int(rng.integers(len(values))), int(rng.integers(-STEP, STEP, endpoint=True))
            values.append(values[source] + step)
            yield f"{variable(len(values) - 1)} = {variable(source)} + {step}"
        else:
            values.append(int(rng.integers(-LITERAL, LITERAL, endpoint=True)))
            yield f"{variable(len(values) - 1)} = {values[-1]}"
        if anew:
            source, step = int(rng.integers(min(len(values), SOURCES))), int(rng.integers(-STEP, STEP, endpoint=True))
            values[asked] = values[source] + step
            yield f"{variable(asked)} = {variable(source)} + {step}"


def kv_episodes(spark: SparkSession, n: int, min_tokens: int, max_tokens: int, seed: int = 0) -> DataFrame:
    """id, prompt, answer: a log of assignments, LINES of them at a time until the prompt
    has a drawn number of byte tokens, and the value that the asked variable then has."""

    @F.udtf(returnType="prompt: string, answer: string")
    class Episode:
        def eval(self, i: int):
            rng = np.random.default_rng([seed, i])
            goal, asked = int(rng.integers(min_tokens, max_tokens, endpoint=True)), int(rng.integers(ASKED, endpoint=True))
            values: list[int] = []
            log, lines, tail = assignments(rng, values, asked), [], LOG_TAIL.format(query_key=variable(asked))
            room = goal - len((LOG_HEAD + tail).encode())
            while not lines or sum(map(len, lines)) + len(lines) - 1 < room:
                lines += islice(log, LINES)
            yield LOG_HEAD + "\n".join(lines) + tail, str(values[asked])

    spark.udtf.register("tessera_episode", Episode)
    return spark.sql(f"select id, prompt, answer from range({n}), lateral tessera_episode(cast(id as int))")


def kv_answer(prompt: str) -> int:
    """The queried variable's value at the log's end, by replaying the log."""
    values: dict[str, int] = {}
    for line in prompt.split("LOG BEGIN\n", 1)[1].split("\nLOG END", 1)[0].split("\n"):
        name, _, right = line.partition(" = ")
        left, plus, step = right.partition(" + ")
        values[name] = values[left] + int(step) if plus else int(right)
    return values[prompt.split("Question: What is ", 1)[1].split("?", 1)[0]]
