"""Structured Streaming: incremental daily route partials and streamed scenarios."""
