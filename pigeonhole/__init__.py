"""Document-filing analytics on Spark: outlines, decisions, corrections, cost and ledger work as DataFrame jobs."""
