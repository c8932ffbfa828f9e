"""Structured Streaming forms of the guardrails, the limiter and the session memory."""
