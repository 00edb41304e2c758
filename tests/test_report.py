"""Gates, chains of evidence, nested reports and result rows of small alerts."""

import json

import pytest

from faultline.operators import report as R

ALERT = ["service", "win"]


@pytest.fixture(scope="module")
def parts(spark):
    candidates = spark.createDataFrame(
        [
            ("s", 1, "a", 4.0, 0.8, 0.7, 0.5, 0.9), ("s", 1, "b", 1.0, 0.2, 0.2, 0.2, 0.5),  # a strong root
            ("t", 1, "a", 1.0, 0.5, 0.0, 0.5, 0.9), ("t", 1, "b", 1.0, 0.5, 0.2, 0.12, 0.45),  # the first fails its margin, the second is weak
            ("u", 2, "c", 0.0, 0.0, 0.0, 0.0, 0.1),  # nothing passes
        ], "service string, win long, root_service string, gain double, relative double, margin double, identifiability double, confidence double",
    )
    ranked = R.gated(candidates, ALERT, R.Gates())
    groups = spark.createDataFrame([("s", 1, "a", "CPU", "cpu.x", 0.9, 2.0), ("s", 1, "a", "CPU", "cpu.y", 0.0, 0.1), ("s", 1, "b", "load", "req", 0.5, 1.0), ("t", 1, "b", "load", "req", 0.5, 1.0)], "service string, win long, entity string, category string, metric string, contribution double, residual double")
    evidence = spark.createDataFrame([("s", 1, "a", "e1", 0.6, True), ("s", 1, "b", "e2", 0.7, False)], "service string, win long, entity string, source string, strength double, used boolean")
    paths = spark.createDataFrame([("s", 1, "a", "a.cpu.x", ["a.cpu.x", "s.req"], 0.4, 1), ("s", 1, "b", "b.req", ["b.req", "q", "s.req"], 0.4, 1)], "service string, win long, entity string, root string, path array<string>, score double, rank int")
    return ranked, groups, evidence, paths


def test_the_first_candidate_that_passes_all_gates_is_primary(parts):
    got = {r.service: r for r in R.primary(parts[0], ALERT, R.Gates()).collect()}
    assert (got["s"].status, got["s"].primary_root, got["s"].reasons, got["s"].candidates) == ("strong", "a", [], 2)
    assert (got["t"].status, got["t"].primary_root, got["t"].confidence) == ("weak", "b", 0.45)
    assert (got["u"].status, got["u"].primary_root) == ("ambiguous", None)
    assert got["u"].reasons == ["low_counterfactual", "low_margin", "low_identifiability", "low_confidence", "zero_candidate_signature"]


def test_chain_nested_report_and_result(parts):
    from pyspark.sql import functions as F

    ranked, groups, evidence, paths = parts
    chain = R.evidence_chain(ranked, groups, evidence, paths.withColumn("source", F.concat_ws(">", "path")), ALERT)
    kinds = sorted((r.candidate, r.kind, r.source, r.strength) for r in chain.where("service = 's'").collect())
    assert kinds == sorted([
        ("a", "source_anomaly", "cpu.x", 2.0), ("a", "solver_contribution", "cpu.x", 0.9), ("b", "source_anomaly", "req", 1.0), ("b", "solver_contribution", "req", 0.5), ("a", "counterfactual", "a", 0.8), ("b", "counterfactual", "b", 0.2),
        ("a", "normalized_evidence", "e1", 0.6), ("b", "excluded_evidence", "e2", 0.0), ("a", "propagation_path", "a.cpu.x>s.req", 0.4), ("b", "propagation_path", "b.req>q>s.req", 0.4),
    ])
    make = lambda: {r.service: r for r in R.nested(R.primary(ranked, ALERT, R.Gates()), ranked, chain.repartition(3), paths, ALERT).collect()}
    report = make()
    assert [c.root_service for c in report["s"].ranked_candidates] == ["a", "b"] and len(report["s"].evidence_chain) == 10 and report["u"].paths is None
    assert {k: r.fingerprint for k, r in report.items()} == {k: r.fingerprint for k, r in make().items()} and len({r.fingerprint for r in report.values()}) == 3
    assert json.loads(json.dumps(report["s"].asDict(recursive=True)))["evidence_chain"][0]["kind"]
    result = {r.service: r for r in R.result_rows(groups, paths, ALERT).collect()}
    assert (result["s"].top_metrics, result["s"].top_services, result["s"].root_type, result["s"].path) == (["a.cpu.x", "b.req"], ["a/cpu.x", "b/req"], "CPU", ["a.cpu.x", "s.req"])
    assert result["t"].path == ["b"] and set(result) == {"s", "t"}
