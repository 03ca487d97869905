"""Rules, schedules, costs, chunks, versions, retrieval and evaluation over DataFrames."""
