"""tributary: record fusion on Spark, with training-data operators in ``tributary.llm``."""
