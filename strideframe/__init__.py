"""strideframe: wearable-sensor analytics as Spark DataFrame, Structured Streaming and Spark ML operators."""
