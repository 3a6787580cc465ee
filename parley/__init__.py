"""Conversation-text analytics on Spark: redact, classify, report."""
