"""End-to-end plans: fit a model, generate rows from it, summarise runs."""
