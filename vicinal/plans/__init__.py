"""End-to-end plans: estimators, registered queries and their SQL."""
