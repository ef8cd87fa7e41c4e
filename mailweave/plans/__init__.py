"""Query plans: every registered query as a (Spark builder, oracle SQL) pair."""
