"""Rules that send questions to a type, a subject or a tool; their word lists are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import TOKEN, collapse

#: In order of precedence: (type, pattern or None, phrases).
QUESTION_RULES = (
    ("mcq", r"(^|[^a-z0-9])[a-d][.)]", ()),
    ("comparison", None, ("compare", " than ")),
    ("exact_quote", None, ("quote", '"')),
    ("definition", None, ("define", "what is")),
    ("essay", None, ("discuss", "explain")),
)
OUT_OF_SCOPE = ("weather", "football")
REFERENCES = (" it ", " that ", " this ")
TOOL_RULES = (("source_page", ("page",)), ("citation", ("cite", "source")), ("graph", ("relate", "link")))
ACROSS = ("across",)
LANGUAGE_PHRASES = {"en": (" the ", " and ", " of "), "fr": (" le ", " et ", " de "), "de": (" der ", " und ", " die "), "es": (" el ", " y ", " de ")}


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases], F.lit(False))


def norm(text: Column) -> Column:
    """Lower-cased, white space collapsed: what phrases are looked for in."""
    return F.lower(collapse(text))


def in_scope(df: DataFrame, column: str, scope: set | None) -> DataFrame:
    """Rows of the partitions in ``scope``: None is all, the empty set none."""
    return df if scope is None else df.where(F.col(column).isin(*sorted(scope))) if scope else df.where(F.lit(False))


def resolve_scope(kind: str, subject: str | None, known: tuple[str, ...]) -> set[str]:
    """The partitions of a request: one within a subject, all of them globally; what contradicts itself is an error."""
    if kind == "within_subject":
        if subject not in known:
            raise ValueError("a request within a subject names exactly one that is known")
        return {subject}
    if kind == "global":
        if subject is not None:
            raise ValueError("a global request names no subject")
        return set(known)
    raise ValueError(f"no such scope: {kind}")


def route_question(queries: DataFrame, rules=QUESTION_RULES, out_of_scope: tuple[str, ...] = OUT_OF_SCOPE) -> DataFrame:
    text = norm(F.col("text"))
    route = None
    for name, pattern, phrases in rules:
        hit = text.rlike(pattern) | contains_any(text, phrases) if pattern else contains_any(text, phrases)
        route = F.when(hit, name) if route is None else route.when(hit, name)
    return queries.select("query_id", route.otherwise("general").alias("route"), contains_any(text, out_of_scope).alias("out_of_scope"))


def phrases(spark: SparkSession, of: dict[str, tuple[str, ...]]) -> DataFrame:
    """The phrase dimension: (subject, phrases), a row for each subject."""
    return spark.createDataFrame([(s, list(p)) for s, p in of.items()], "subject string, phrases array<string>")


def route_subject(queries: DataFrame, dimension: DataFrame) -> DataFrame:
    """The subject whose phrases the question holds most of; none if two have as many, or none has any."""
    text = norm(F.col("text"))
    dims = [(r["subject"], tuple(r["phrases"])) for r in dimension.orderBy("subject").collect()]  # the dimension is a parameter
    hits = F.array(*[F.struct(reduce(lambda a, b: a + b, [F.contains(text, F.lit(p)).cast("int") for p in ps]).alias("hits"), F.lit(s).alias("subject")) for s, ps in dims])
    best = F.array_max(F.transform("h", lambda x: x["hits"]))
    top = F.filter("h", lambda x: (x["hits"] == F.col("best")) & (x["hits"] > 0))
    routed = queries.withColumn("h", hits).withColumn("best", best).withColumn("top", top)
    return routed.select("query_id", F.when(F.size("top") == 1, F.col("top")[0]["subject"]).alias("subject"))


def comparison_variants(queries: DataFrame, pattern: str) -> DataFrame:
    """query_id, variant_no, variant: the two sides of a comparison, or the question as it is."""
    side = lambda n: F.trim(F.regexp_extract("text", pattern, n), F.lit(" .,?!"))
    split = F.when(F.regexp_extract("text", pattern, 1) != "", F.array(side(1), side(2))).otherwise(F.array("text"))
    return queries.select("query_id", F.posexplode(split).alias("variant_no", "variant")).withColumn("variant_no", F.col("variant_no").cast("long"))


def needs_context(text: Column, references: tuple[str, ...] = REFERENCES, short: int | str = 4) -> Column:
    """A question that refers back, or is short: of at most so many tokens, or of a pattern."""
    brief = norm(text).rlike(short) if isinstance(short, str) else F.regexp_count(text, F.lit(TOKEN)) <= short
    return contains_any(norm(text), references) | brief


def refusals(gated: DataFrame) -> DataFrame:
    return gated.where("decision like 'refuse%'").select("query_id", F.lit("refused").alias("status"), F.col("decision").alias("reason"), F.lit(0).cast("long").alias("n_citations"))


def route_tool(text: Column, subject: Column, rules=TOOL_RULES, across: tuple[str, ...] = ACROSS) -> Column:
    """Source page, citation, graph, then across subjects (also where the subject is null), then within one."""
    low, route = norm(text), None
    for name, ps in rules:
        route = F.when(contains_any(low, ps), name) if route is None else route.when(contains_any(low, ps), name)
    return route.when(contains_any(low, across) | subject.isNull(), "cross_subject").otherwise("subject")
