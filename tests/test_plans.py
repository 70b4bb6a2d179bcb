"""What plans must keep: filters and columns reach the scan, no products of tables, no Python where built-ins do."""

import pytest

from corpusloom.queries import registry


def plan(spark, sf, name):
    return registry.QUERIES[name](spark, sf)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


COLUMNS = {
    "latency_percentiles": "struct<event_type:string,value:double>",
    "page_coverage": "struct<doc_id:bigint,n_chars:bigint>",
    "leakage_check": "struct<l_orderkey:bigint,l_partkey:bigint>",
    "overuse_counts": "struct<p_brand:string>",
    "json_props": "struct<event_type:string,props:string>",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_are_pruned(spark, sf, name):
    assert f"ReadSchema: {COLUMNS[name]}" in plan(spark, sf, name)


@pytest.mark.parametrize("name,pushed", [("page_coverage", "GreaterThan(n_chars,1000)"), ("draft_filter", "Not(EqualTo(lang,es))"), ("span_overlap", "EqualTo(l_returnflag,R)"), ("account_memory", "EqualTo(event_type,signup)")])
def test_filters_are_pushed(spark, sf, name, pushed):
    assert pushed in plan(spark, sf, name)


NATIVE = ["bm25_topk", "bm25_postings", "rrf_positional", "near_dup_jaccard", "section_fill", "marginal_roles", "html_blocks", "metric_slices", "graph_paths", "span_overlap", "citation_verify", "conversation_titles", "anomaly_score", "heading_levels"]


@pytest.mark.parametrize("name", NATIVE)
def test_no_products(spark, sf, name):
    assert "CartesianProduct" not in plan(spark, sf, name)


@pytest.mark.parametrize("name", ["bm25_topk", "section_fill", "marginal_roles", "html_blocks", "graph_paths", "span_overlap", "near_dup_jaccard", "heading_levels", "page_quality"])
def test_no_python(spark, sf, name):
    text = plan(spark, sf, name)
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
