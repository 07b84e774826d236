"""Text providers: what rewrites queries, routes, scores and writes reports.

A provider answers a column of prompts with a column of texts; null stands for a failure, and each step
of the workflow has its own fallback for it. The built-in one is deterministic and made of expressions;
any other is a function from a list of prompts to a list of texts, run in batches on the executors.
"""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, functions as F

from roundsmith.functions.scalar import map_name, tokens


class TextProvider(Protocol):
    def rewrite(self, query: Column) -> Column: ...

    def route(self, raw: Column) -> Column: ...

    def critique(self, raw: Column, context: Column) -> Column: ...

    def analyse(self, raw: Column, context: Column) -> Column: ...

    def coach(self, report: Column) -> Column: ...


NO_REPORT = "ValueError: the text provider gave no report"


def outcome(provider: TextProvider, step: str, **parts: Column) -> Column:
    """The answer of a step whose failure ends a task: text, and error if there is none."""
    if hasattr(provider, "outcome"):
        return provider.outcome(step, **parts)
    text = getattr(provider, step)(*parts.values())
    return F.struct(text.alias("text"), F.when(text.isNull(), F.lit(NO_REPORT)).alias("error"))


#: What the analyst reads of a match, in either dialect.
MATCH = "rounds array<struct<round_number int, round int, winner string, kills array<struct<tick long, killer string, victim string, is_headshot int, is_first_kill boolean>>, grenades array<struct<type string, thrower string>>, flash_blinds array<struct<attacker string, blind_duration double>>, plants array<struct<site string>>, events array<struct<type string, killer string, victim string, player string, item string, site string>>>>"


def _tally(names: Column) -> Column:
    """How often each name occurs, as text, in order of name."""
    known = F.filter(names, lambda x: x.isNotNull())
    each = F.transform(F.array_sort(F.array_distinct(known)), lambda n: F.concat(n, F.lit(" "), F.size(F.filter(known, lambda x: x == n)).cast("string")))
    return F.when(F.size(known) > 0, F.array_join(each, ", ")).otherwise("none")


def match_report(raw: Column) -> Column:
    """The metrics of one match from its JSON text: rounds won, kills, deaths, first kills, rounds with two kills
    and more, headshots, utility, blinds and plants. Damage is not among the events, so there is none of it."""
    rounds = F.coalesce(F.from_json(raw, MATCH)["rounds"], F.array().cast(MATCH.partition(" ")[2]))
    said = lambda r, kind: F.filter(F.coalesce(r["events"], F.slice(r["events"], 1, 0)), lambda e: e["type"] == kind)
    flat = lambda f: F.flatten(F.transform(rounds, lambda r: F.coalesce(f(r), F.array().cast("array<string>"))))
    two = lambda a, b: F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    of = lambda r, who: two(F.transform(r["kills"], lambda k: k[who]), F.transform(said(r, "kill"), lambda e: e[who]))
    first = lambda r: two(F.transform(F.filter(r["kills"], lambda k: k["is_first_kill"]), lambda k: k["killer"]), F.transform(F.slice(said(r, "kill"), 1, 1), lambda e: e["killer"]))
    several = lambda r: F.filter(F.array_distinct(of(r, "killer")), lambda n: F.size(F.filter(of(r, "killer"), lambda x: x == n)) >= 2)
    lines = {
        "Rounds won": F.transform(rounds, lambda r: r["winner"]),
        "Kills": flat(lambda r: of(r, "killer")),
        "Deaths": flat(lambda r: of(r, "victim")),
        "First kills": flat(first),
        "Rounds with two kills and more": flat(several),
        "Headshots": flat(lambda r: F.transform(F.filter(r["kills"], lambda k: k["is_headshot"] == 1), lambda k: k["killer"])),
        "Utility": flat(lambda r: two(F.transform(r["grenades"], lambda g: g["type"]), F.transform(said(r, "utility"), lambda e: e["item"]))),
        "Blinds": flat(lambda r: F.transform(r["flash_blinds"], lambda b: b["attacker"])),
        "Plants": flat(lambda r: two(F.transform(r["plants"], lambda p: p["site"]), F.transform(said(r, "bomb_planted"), lambda e: e["site"]))),
    }
    return F.concat_ws("\n", F.concat(F.lit("Rounds: "), F.size(rounds).cast("string")), *(F.concat(F.lit(f"{name}: "), _tally(names)) for name, names in lines.items()))


class RuleProvider:
    """Deterministic and offline: queries stay, the map is read from the payload, contexts are scored by
    the share of their words that the payload has, the analyst reports the match's metrics, and the coach
    hands the report on."""

    def rewrite(self, query: Column) -> Column:
        return query

    def route(self, raw: Column) -> Column:
        name = F.regexp_extract(raw, r'"map(?:_name)?"\s*:\s*"([^"]*)"', 1)
        return F.when(name != "", F.to_json(F.create_map(F.lit("map"), map_name(name))))

    def critique(self, raw: Column, context: Column) -> Column:
        words = F.array_distinct(tokens(context))
        share = F.size(F.array_intersect(words, tokens(raw))) / F.greatest(F.size(words), F.lit(1))
        return F.round(F.least(share * 4, F.lit(1.0)), 6).cast("string")

    def analyse(self, raw: Column, context: Column) -> Column:
        return F.concat(match_report(raw), F.lit("\nKnown tactics:\n"), context)

    def coach(self, report: Column) -> Column:
        return F.concat(F.lit("Advice from the report:\n"), report)


#: Prompts for providers that take free text; the braces are filled by columns.
PROMPTS = {
    "rewrite": "Rewrite this query with precise tactical terms. Answer with the query alone.\n{query}",
    "route": 'Name the map of this match as JSON, such as {"map": "Mirage"}; {} if there is none.\n{raw}',
    "critique": "Score from 0 to 1 how relevant the context is to the match. Answer with the number alone.\nMatch: {raw}\nContext: {context}",
    "analyse": "Analyse this match for first kills, multiple kills and utility.\nMatch: {raw}\nContext: {context}",
    "coach": "Give training advice from this report.\n{report}",
}


def _within(seconds: float | None, call: Callable, *args):
    """What call gives, or TimeoutError after so many seconds; the call goes on in a thread that nothing waits for."""
    if seconds is None:
        return call(*args)
    done: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            done.put((call(*args), None))
        except BaseException as e:
            done.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        out, error = done.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds:g} s") from None
    if error is not None:
        raise error
    return out


def answers(ask: Callable[[list[str]], list[str | None]], prompts: list[str | None], seconds: float | None = None) -> tuple[list[str | None], list[str | None]]:
    """Texts and errors, one of each for each prompt. Null prompts are not asked and have neither. If asking for
    several prompts fails, takes longer than seconds, or gives another number of texts, each half is asked on its own, so that a bad
    or slow prompt fails alone: of n prompts at most about 2 log2(n) more requests for each."""
    texts, errors = [None] * len(prompts), [None] * len(prompts)

    def part(at: list[int]) -> None:
        try:
            got = list(_within(seconds, ask, [prompts[k] for k in at]))
            if len(got) != len(at):
                raise ValueError(f"{len(got)} answers to {len(at)} prompts")
        except Exception as e:
            if len(at) > 1:
                part(at[: len(at) // 2])
                part(at[len(at) // 2 :])
            else:
                errors[at[0]] = f"{type(e).__name__}: {e}"
            return
        for k, text in zip(at, got, strict=True):
            texts[k], errors[k] = text, NO_REPORT if text is None else None

    at = [k for k, prompt in enumerate(prompts) if prompt is not None]
    if at:
        part(at)
    return texts, errors


class FunctionProvider:
    """Wraps a batch function of prompts; with connect, answer takes a client that connect makes, one for each task
    of Spark. An exception, or an answer that takes longer than seconds, fails its own prompt alone. Prompts whose parts are all
    null are never asked."""

    def __init__(self, answer: Callable[..., list[str | None]], prompts: dict[str, str] | None = None, connect: Callable | None = None, seconds: float | None = None):
        self.prompts = PROMPTS | (prompts or {})

        @F.pandas_udf("text string, error string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            ask = answer
            for prompt in batches:
                if connect is not None and ask is answer and prompt.notna().any():
                    ask = partial(answer, connect())
                text, error = answers(ask, [p if isinstance(p, str) else None for p in prompt], seconds)
                yield pd.DataFrame({"text": text, "error": error}, dtype=object)

        self._run = run

    def _prompt(self, step: str, **parts: Column) -> Column:
        out = F.lit(self.prompts[step])
        for name, value in parts.items():
            out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
        return F.when(F.coalesce(*parts.values()).isNotNull(), out)

    def _ask(self, step: str, **parts: Column) -> Column:
        return self.outcome(step, **parts)["text"]

    def outcome(self, step: str, **parts: Column) -> Column:
        return self._run(self._prompt(step, **parts))

    def rewrite(self, query: Column) -> Column:
        return self._ask("rewrite", query=query)

    def route(self, raw: Column) -> Column:
        return self._ask("route", raw=raw)

    def critique(self, raw: Column, context: Column) -> Column:
        return self._ask("critique", raw=raw, context=context)

    def analyse(self, raw: Column, context: Column) -> Column:
        return self._ask("analyse", raw=raw, context=context)

    def coach(self, report: Column) -> Column:
        return self._ask("coach", report=report)


def hashing_embedder(dims: int = 64) -> Callable[[Column], Column]:
    """An offline embedding: counts of hashed words, as a vector of unit length (zeros without words)."""

    def embed(text: Column) -> Column:
        places = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)))
        counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))
        length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(counts, lambda x: F.when(length > 0, x / length).otherwise(0.0))

    return embed
