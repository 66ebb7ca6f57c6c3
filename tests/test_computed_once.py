"""Heavy column work is computed once per row and dealt over all tasks."""

import pytest

from gigledger import plans

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    return plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["a08_jsonld_events", "a11_body_routes", "a11_routed_bodies", "a09_page_cards", "b12_vendor_mapper", "b11_vendor_classification", "i07_record_completeness"])
def test_work_on_derived_bodies_is_dealt_over_all_tasks(spark, name):
    assert "Repartition" in _plan(spark, name)


def test_classification_reads_a_record_once(spark):
    assert _plan(spark, "b11_vendor_classification").count("$.classifications") <= 3


def test_a_lineup_is_read_once(spark):
    assert _plan(spark, "i07_record_completeness").count("isHeadliner") <= 4


def test_filters_on_a_link_class_do_not_compute_it_again(spark):
    assert _plan(spark, "c07_record_filter").count("boxoffice") <= 4


def test_an_event_is_judged_before_it_meets_its_claims(spark):
    met = [line for line in _plan(spark, "i15_source_trust").splitlines() if "Project [source_id" in line]
    assert met and not any("tickets_link" in line for line in met)


def test_a_candidate_is_held_once_while_the_best_is_sought(spark):
    assert "min_by(" not in _plan(spark, "e23_image_candidates")
