"""The ordered parts as Structured Streaming: windows of premiums, positions as keyed state."""
