"""The event feed as a stream: the same aggregates as in batch."""
