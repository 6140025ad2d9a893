"""casework: Spark-native case analytics (enrich, profile, sample, model,
score, retrieve, decide) as DataFrame-in, DataFrame-out functions."""

__version__ = "0.1.0"
