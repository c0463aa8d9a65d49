"""Change streams: ordered outbox, contiguous prefixes, folded state, windows."""
