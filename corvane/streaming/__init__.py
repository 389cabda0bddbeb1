"""Event decoding and incremental index maintenance."""
