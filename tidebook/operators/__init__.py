"""DataFrame operators over positions, risk, books, funding, pools, deltas and the transaction log."""
