"""residuum: a Spark-first engine for position-aware entity data (features, transfer, evaluation)."""
