"""Evidence-audited structured extraction on Spark."""
