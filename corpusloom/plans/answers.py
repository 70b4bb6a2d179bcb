"""Whole plans: the frozen retrieval baseline, recovery, and answering a table of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.models import extractive_answers
from corpusloom.functions.text import collapse
from corpusloom.operators import dense, fusion, lexical, routing
from corpusloom.sources.sinks import written


@dataclass(frozen=True)
class Baseline:
    """How many rows each step keeps, and the gate's bounds."""

    lexical: int = 30
    dense: int = 30
    fused: int = 24
    candidates: int = 12
    shown: int = 5
    sufficient: float = 0.5
    related: float = 0.2
    pattern: str | None = None  # of comparisons, split into two searches

    def __post_init__(self):
        if min(self.lexical, self.dense, self.fused, self.candidates, self.shown) <= 0:
            raise ValueError("every step keeps some rows")
        if self.related > self.sufficient:
            raise ValueError("what is sufficient is related")


def retrieve(docs: DataFrame, vectors: DataFrame, questions: DataFrame, plan: Baseline = Baseline(), scorer: Callable[[Column, Column], Column] | None = None, keep: Column | None = None, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """query_id, doc_id, score, rank. ``docs`` (doc_id, text), ``vectors`` (vec_id = doc_id, embedding), ``questions`` (query_id, text, embedding).

    Both lanes, fused; a comparison's two sides are searched by themselves, each by its own text and ``embed`` of it,
    and interleaved; the original question reranks. Without ``embed`` both sides take the question's vector.
    """
    asked = questions
    if plan.pattern:
        variants = routing.comparison_variants(questions, plan.pattern).join(questions.select("query_id", "embedding"), "query_id")
        if embed:
            variants = variants.join(questions.select("query_id", F.col("text").alias("__whole")), "query_id").withColumn("embedding", F.when(F.col("variant") == F.col("__whole"), F.col("embedding")).otherwise(embed(F.col("variant"))))
        asked = written(variants.select((F.col("query_id") * 2 + F.col("variant_no")).alias("query_id"), F.col("variant").alias("text"), "embedding"), "asked")
    lex = lexical.bm25(docs, asked.select("query_id", "text"), plan.lexical, keep=keep)
    den = dense.cosine_top_k(vectors, asked.select("query_id", "embedding"), plan.dense).withColumnRenamed("vec_id", "doc_id")
    fused = fusion.reciprocal_rank_fusion([lex, den], plan.fused)
    if plan.pattern:
        sides = [fused.where(F.pmod("query_id", F.lit(2)) == n).withColumn("query_id", F.floor(F.col("query_id") / 2)) for n in (0, 1)]
        fused = fusion.round_robin(sides, plan.candidates)
    return fusion.rerank(fused.where(F.col("rank") <= plan.candidates), questions, docs, plan.shown, scorer)


def ask(docs: DataFrame, vectors: DataFrame, questions: DataFrame, plan: Baseline = Baseline(), scorer=None, rewrite=collapse, generate=extractive_answers, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """query_id, status, answer, evidence_ids: a batch of questions from routing to an answer or a refusal.

    Out of scope: refused. Related but insufficient evidence: ``rewrite`` once, ``embed`` the new text and search again.
    The second gate decides. Evidence of a generated answer is what was retrieved for it, so citations can't name anything else.
    """
    routed = routing.route_question(questions.select("query_id", "text"))
    open_ = questions.join(routed.where("not out_of_scope").select("query_id"), "query_id")
    first = written(retrieve(docs, vectors, open_, plan, scorer, embed=embed), "first-search")
    gate = fusion.gate(first, open_, plan.sufficient, plan.related)
    again = open_.join(gate.where("decision = 'rewrite'").select("query_id"), "query_id").withColumn("text", rewrite(F.col("text")))
    if embed:
        again = again.withColumn("embedding", embed(F.col("text")))
    second = written(retrieve(docs, vectors, again, plan, scorer, embed=embed), "second-search")
    last = fusion.gate(second, again, plan.sufficient, plan.related, rewritten=True)
    decided = gate.where("decision <> 'rewrite'").unionByName(last)
    found = first.join(gate.where("decision = 'generate'").select("query_id"), "query_id").unionByName(second.join(last.where("decision = 'generate'").select("query_id"), "query_id"))
    answers = generate(docs.select("doc_id", "text").join(found, "doc_id"))
    scope = routed.select("query_id", F.when(F.col("out_of_scope"), "refuse_out_of_domain").alias("scope"))
    return scope.join(decided.select("query_id", "decision"), "query_id", "left").join(answers, "query_id", "left").select("query_id", F.coalesce("scope", "decision").alias("status"), "answer", "evidence_ids")


def recover(base: DataFrame, plan: DataFrame, search: Callable[[DataFrame], DataFrame], questions: DataFrame, docs: DataFrame, k: int, margin: float = 0.0, scorer=None) -> DataFrame:
    """The base ranking with evidence of targeted queries. ``plan`` is (query_id, target_no, text), what a planner wants to know; without rows for a question its baseline stays."""
    plan = written(plan.withColumn("__asked", F.monotonically_increasing_id()), "targets")  # an id for each target, whatever the questions' ids are
    found = search(plan.select(F.col("__asked").alias("query_id"), "text")).withColumnRenamed("query_id", "__asked")
    found = found.join(plan.select("__asked", "query_id", F.col("target_no").cast("int").alias("target_no")), "__asked").select("query_id", "target_no", "doc_id", F.col("rank").alias("place"))
    own = base.where("rank <= 5").select("query_id", "doc_id", (F.col("rank") + 100).alias("place")).join(plan.select("query_id", F.col("target_no").cast("int").alias("target_no")), "query_id")
    pool = found.where("place <= 5").unionByName(own.select("query_id", "target_no", "doc_id", "place"))
    scored = fusion.rerank(pool.select("query_id", "doc_id").distinct(), questions, docs, 1_000, scorer)
    return fusion.support_gated(base, pool.join(scored.select("query_id", "doc_id", "score"), ["query_id", "doc_id"]), k, margin)


def traced(ranking: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """(query_id, step_no, role, action): the trace of a coordinated search, a row for each role's step."""
    each = F.array(*[F.struct(F.lit(n).cast("long").alias("step_no"), F.lit(r).alias("role"), F.lit(a).alias("action")) for n, (r, a) in enumerate(steps)])
    return ranking.select("query_id").distinct().select("query_id", F.explode(each).alias("s")).select("query_id", "s.*")


def bounded_recovery(questions: DataFrame, evidence: DataFrame, judge: Callable[[DataFrame, DataFrame], DataFrame], search: Callable[[DataFrame], DataFrame], rounds: int = 2, queries: int = 2) -> DataFrame:
    """query_id, doc_id, score: evidence after at most ``rounds`` rounds of at most ``queries`` searches for questions judged partial or missing.

    ``judge(questions, evidence)`` gives (query_id, verdict, queries array<string>); sufficient and contradicted end a question.
    """
    for _ in range(rounds):
        verdict = judge(questions, evidence).where("verdict in ('partial', 'missing')")
        asked = verdict.select("query_id", F.posexplode(F.slice("queries", 1, queries)).alias("n", "text"))
        found = search(asked.select((F.col("query_id") * queries + F.col("n")).alias("query_id"), "text")).withColumn("query_id", F.floor(F.col("query_id") / queries))
        fresh = found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
        evidence = fusion.merge_best(evidence.withColumn("rank", F.lit(0).cast("long")), fresh).select("query_id", "doc_id", "score")
    return evidence
