"""The analyses: account panel, health scores, churn features, segments and models."""
