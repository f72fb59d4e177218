"""Pages that are made of a small table's rows are parsed by as many tasks as there are cores."""

import pytest

from sedgeline.catalog import Catalog
from sedgeline.operators import pages
from sedgeline.plans import built, headers, nested

SF = "/root/testdata/sf0.001"


def test_rows_are_dealt_out_and_none_is_lost(spark):
    c = Catalog(spark, SF)
    dealt = c.spread("customer")
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert min(sizes) > 0 and sum(sizes) == c.table("customer").count()


@pytest.mark.parametrize("query", [built.page_feed_link, built.page_block_kinds, built.page_empty_elements, nested.nested_text, headers.header_copies, headers.leading_image], ids=lambda q: q.__name__)
def test_the_parser_runs_after_the_deal(spark, query):
    plan = query(Catalog(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition ") >= plan.count("MapInArrow") >= 1


def test_stored_pages_are_written_by_several_tasks(spark):
    c = Catalog(spark, SF)
    assert len(pages.nodes(built.built(c)).inputFiles()) >= spark.sparkContext.defaultParallelism
