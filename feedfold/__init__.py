"""Review-feed analytics as Spark jobs: parse, fold, flag, label, sample, score."""
