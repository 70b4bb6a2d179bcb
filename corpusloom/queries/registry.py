"""All queries over the reference's operators, with the SQL they are held against."""

from corpusloom.queries import corpus, curation, evaluation, retrieval

FLAGSHIP = "hybrid_topk"
MODULES = (retrieval, corpus, evaluation, curation)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: s for m in MODULES for name, s in m.ORACLES.items()}
