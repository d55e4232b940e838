"""Data products a user calls: co-view graph, recommendation, churn, working capital."""
