"""weftline: Spark jobs for integrating spatial count samples, and for training-data work (subpackage ``llm``)."""
