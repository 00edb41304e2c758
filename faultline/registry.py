"""The registered queries over the monitoring views, each with the same query as SQL where SQL has it."""

from __future__ import annotations

from faultline.plans import aggregation, alerts, baselines, chain, diagnosis, evidence, functions, inventory, joint, learner, lifecycle, propagation, reports, rerun, roots, sinks, sources, streams, topology, views  # noqa: F401

QUERIES = views.QUERIES
ORACLE_SQL = views.ORACLE


def FLAGSHIP(spark, sf_dir):
    return QUERIES["alr_09_alert_windows"](spark, sf_dir)
