"""The bounded agent workflow as a plan over a table of matches.

Route, then retrieve and critique up to MAX_TRIES times, then analyse and coach. A pass handles all
matches that are still pending at once; finished ones wait. Every failure has a silent fallback: no
route, the sentinel for no context, score 1.0 for no score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from roundsmith.functions.providers import NO_REPORT, RuleProvider, TextProvider, hashing_embedder, outcome
from roundsmith.functions.scalar import CRITIQUE_CHARS, NO_CONTEXT, NO_CONTEXT_MARK, QUERY_CHARS, ROUTER_CHARS, prefix, score, strip, strip_fences
from roundsmith.operators import retrieval
from roundsmith.plans.lineage import cut, saved

PASS_SCORE, MAX_TRIES = 0.7, 3
EVERY = "*"
#: Filters up to which they are sent to every task.
SENT_FILTERS = 100_000


def initial_state(matches: DataFrame) -> DataFrame:
    """match_id, raw_data and the five other fields of the state at the start."""
    return matches.select(
        "match_id", "raw_data", F.lit("").alias("rag_context"), F.lit("").alias("analyst_report"), F.lit("").alias("coach_advice"),
        F.create_map().cast("map<string,string>").alias("retrieval_metadata"), F.lit(1.0).alias("critique_score"), F.lit(0).alias("retry_count"),
    )


def route(state: DataFrame, provider: TextProvider) -> DataFrame:
    """Sets retrieval_metadata; texts of 20 characters and less, and answers that are no JSON object of
    texts, have none."""
    raw = F.coalesce(F.col("raw_data"), F.lit(""))
    answer = strip_fences(provider.route(prefix(raw, ROUTER_CHARS)))
    found = F.when(F.try_parse_json(answer).isNotNull(), F.from_json(answer, "map<string,string>"))
    empty = F.create_map().cast("map<string,string>")
    return state.withColumn("retrieval_metadata", F.coalesce(F.when(F.length(raw) > 20, found), empty))


def part_of(metadata: Column) -> Column:
    """The filter that metadata ask for: all their keys together; one that no document has finds none."""
    pairs = F.array_sort(F.map_entries(metadata))
    return F.concat(F.lit(EVERY), F.coalesce(F.array_join(F.transform(pairs, lambda e: F.to_json(F.struct(e["key"].alias("k"), e["value"].alias("v")))), ""), F.lit("")))


def asked_parts(kb: DataFrame, keys: list[str], asked: DataFrame) -> DataFrame:
    """part, seq, doc_id, text, vec: the documents of each filter that is asked for (metadata), under its part_of. kb has
    doc_id, seq, text, vec and a column for each key; of keys that it does not have, and values that none has, nothing
    is found.

    Each filter meets the documents of its rarest value alone, which are then held against its other values. Up to
    SENT_FILTERS filters go to every task, so no text is shuffled; of more, texts are joined to what is found."""
    filters = asked.select(part_of(F.col("metadata")).alias("part"), F.coalesce(F.map_entries("metadata"), F.array()).alias("_asked")).dropDuplicates(["part"])
    value = lambda k: F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"))
    whole = kb.select("seq", "doc_id", "text", "vec", F.filter(F.array(*(value(k) for k in sorted(keys))), lambda e: e["value"].isNotNull()).alias("_own"))
    own = whole.select("doc_id", "_own")
    each = own.withColumn("_pair", F.explode("_own"))
    counts = each.groupBy("_pair").agg(F.count("*").alias("_n"))
    pairs = filters.withColumn("_pair", F.explode("_asked")).join(counts, "_pair", "left")
    rarest = pairs.groupBy("part").agg(F.min_by(F.struct("_pair", "_asked"), F.struct(F.coalesce("_n", F.lit(0)), "_pair")).alias("_r")).select("part", "_r.*")
    all_of = filters.where(F.size("_asked") == 0)
    rarest = saved(rarest, "rarest")
    if rarest.count() <= SENT_FILTERS:
        some = whole.withColumn("_pair", F.explode("_own")).join(F.broadcast(rarest), "_pair").where(F.size(F.array_except("_asked", "_own")) == 0)
        every = whole.withColumn("part", F.lit(EVERY)).join(F.broadcast(all_of), "part", "left_semi")
        return some.select("part", "seq", "doc_id", "text", "vec").unionByName(every.select("part", "seq", "doc_id", "text", "vec"))
    found = each.join(rarest, "_pair").where(F.size(F.array_except("_asked", "_own")) == 0).select("part", "doc_id")
    every = own.select(F.lit(EVERY).alias("part"), "doc_id").join(all_of, "part", "left_semi")
    return kb.select("seq", "doc_id", "text", "vec").join(found.unionByName(every), "doc_id").select("part", "seq", "doc_id", "text", "vec")


def knowledge_retriever(kb: DataFrame, keys: list[str] = ["map"], embed: Callable[[Column], Column] | None = None) -> Callable[[DataFrame, TextProvider], DataFrame]:
    """A retriever over kb: hybrid search with the rewritten query."""
    embed = embed or hashing_embedder()

    def retrieve(pending: DataFrame, provider: TextProvider) -> DataFrame:
        asked = prefix(F.coalesce(F.col("raw_data"), F.lit("")), QUERY_CHARS)
        queries = pending.select(F.col("match_id").alias("query_id"), part_of(F.col("retrieval_metadata")).alias("part"), F.coalesce(strip(provider.rewrite(asked)), asked).alias("query"))
        queries = cut(queries.withColumn("qvec", embed(F.col("query"))))  # used several times; a provider answers once
        laid = saved(asked_parts(kb, keys, pending.select(F.col("retrieval_metadata").alias("metadata"))), "asked-parts")
        return retrieval.context(queries, retrieval.hybrid_search(queries, laid)).withColumnRenamed("query_id", "match_id")

    return retrieve


def critique(state: DataFrame, provider: TextProvider) -> DataFrame:
    """Sets critique_score, and counts the try in any case. Contexts with the sentinel pass: what the provider gets of
    them is null, as a function of a column is computed for all rows whatever condition stands around it."""
    context = F.col("rag_context")
    ask = ~F.contains(context, F.lit(NO_CONTEXT_MARK)) & (context != "")
    asked = F.when(ask, provider.critique(F.when(ask, prefix(F.coalesce("raw_data", F.lit("")), QUERY_CHARS)), F.when(ask, prefix(context, CRITIQUE_CHARS))))
    return state.withColumns({"critique_score": score(asked), "retry_count": F.col("retry_count") + 1})


def needs_retry() -> Column:
    return (F.col("critique_score") < PASS_SCORE) & (F.col("retry_count") < MAX_TRIES) & ~F.isnan("critique_score")


def refine(state: DataFrame, retrieve: Callable[[DataFrame, TextProvider], DataFrame], provider: TextProvider, judge: Callable[[DataFrame, TextProvider], DataFrame] = critique) -> DataFrame:
    """Retrieve and critique, for those that need it again and again, at most MAX_TRIES times."""
    names, done, pending = state.columns, None, state
    for k in range(MAX_TRIES):
        found = retrieve(pending, provider)
        one = judge(pending.drop("rag_context").join(found, "match_id", "left").withColumn("rag_context", F.coalesce("rag_context", F.lit(NO_CONTEXT))), provider).select(names)
        one = cut(one)  # each pass begins with a short plan
        last = k == MAX_TRIES - 1
        finished = one if last else one.where(~needs_retry())
        done = finished if done is None else done.unionByName(finished)
        pending = one.where(needs_retry())
    return done


def run(matches: DataFrame, retrieve: Callable[[DataFrame, TextProvider], DataFrame], provider: TextProvider | None = None) -> DataFrame:
    """The final state of each match (match_id, raw_data), with the error that ended it, if one did."""
    provider = provider or RuleProvider()
    state = refine(route(initial_state(matches), provider), retrieve, provider)
    state = state.withColumn("_analyst", outcome(provider, "analyse", raw=F.col("raw_data"), context=F.col("rag_context")))
    state = state.withColumn("analyst_report", F.col("_analyst.text"))
    coach = F.when(F.col("analyst_report").isNotNull(), outcome(provider, "coach", report=F.col("analyst_report")))
    state = state.withColumn("_coach", coach).withColumns({"coach_advice": F.col("_coach.text"), "error": F.coalesce(F.col("_analyst.error"), F.col("_coach.error"))})
    return state.drop("_analyst", "_coach")


def task_results(state: DataFrame) -> DataFrame:
    """task_id, status, result, error: SUCCESS with the advice, or FAILURE with what went wrong."""
    ok = F.col("analyst_report").isNotNull() & F.col("coach_advice").isNotNull()
    return state.select(F.col("match_id").alias("task_id"), F.when(ok, "SUCCESS").otherwise("FAILURE").alias("status"), F.when(ok, F.col("coach_advice")).alias("result"), F.when(~ok, F.coalesce("error", F.lit(NO_REPORT))).alias("error"))
