"""Plan checks: read a query's physical plan the way a Spark user does
(``explain``) and verify the properties the operators rely on at scale."""

from overhaul.plans.inspect import plan_text, scan_files, scans, count_nodes, forbidden_nodes

__all__ = ["plan_text", "scan_files", "scans", "count_nodes", "forbidden_nodes"]
