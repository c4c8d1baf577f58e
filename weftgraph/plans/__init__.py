"""Multi-step plans: loops over DataFrames, shared storage and whole jobs."""
