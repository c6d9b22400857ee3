"""Timeline analytics as lazy Spark plans: every operator maps DataFrames keyed by ``video_id`` to DataFrames."""
