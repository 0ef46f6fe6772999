"""Units, sentinels, type codes and schemas of the exchange state."""
